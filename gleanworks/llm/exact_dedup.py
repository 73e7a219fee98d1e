"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of characters; distinct blocks are sorted into integer names, adjacent
names are paired, distinct pairs are sorted into names again, until each document has one name. Two documents have the
same (level, name) exactly if their texts are equal: names stand for contents, never for hashes of them.

Blocks travel to their name by a 64-bit key. A key that stands for two different blocks is found (least and greatest
block per key differ) and such blocks are told apart by their content, so a colliding key changes nothing. Equal blocks
are merged before the shuffle, so a text that fills a third of the rows is sent once per task.

Defined cases: a null text counts as empty; empty texts are equal to each other; of equal texts the largest doc_id stays,
a null doc_id only if the group has no other; rows that repeat both doc_id and text share their fate. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .common import query, read

BLOCK = 4096  # characters
NAME_BUCKETS = 4096  # ranges of sort keys that are numbered apart


def _blocks(text: Column, size: int) -> Column:
    """The text cut into blocks of ``size`` characters; an empty text is one empty block."""
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _key(block: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - bits)


def sorted_names(df: DataFrame, cols: list[str], by: Column, buckets: int = NAME_BUCKETS) -> DataFrame:
    """Distinct ``cols`` with an integer ``name``: the place in the sort order of each bucket, woven into one number range.

    ``by`` spreads the values over buckets, so that no task sorts them all.
    """
    w = Window.partitionBy("_b").orderBy(*cols)
    return (df.select(*cols).distinct().withColumn("_b", F.pmod(by, F.lit(buckets)))
            .withColumn("name", F.col("_b") + F.lit(buckets) * (F.row_number().over(w) - 1).cast("long")).drop("_b"))


def name_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), block: int = BLOCK,
               key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, text_sha256, and the identity (level, name) of the text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    src = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], body.alias("_t"),
                      F.monotonically_increasing_id().alias("_row"))

    # Level 0: one name per distinct block. min = max proves that a key stands for one block only.
    blocks = src.select(F.explode(_blocks(F.col("_t"), block)).alias("_block")).select(_key(F.col("_block"), key_bits).alias("_key"), "_block")
    known = cut_lineage(blocks.groupBy("_key").agg((F.min("_block") != F.max("_block")).alias("_shared")))
    clashes = known.where("_shared").select("_key")
    clashing = not clashes.isEmpty()
    if clashing:  # some 64-bit keys are shared: row numbers must then fit a second reading of the texts
        src = cut_lineage(src)
    rows = cut_lineage(src.select(
        "_row", *[f"_k{i}" for i in range(len(keep))], F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256"),
        F.transform(_blocks(F.col("_t"), block), lambda b: _key(b, key_bits)).alias("_keys")))
    names = cut_lineage(sorted_names(known.where("not _shared"), ["_key"], F.col("_key")))
    cells = rows.select("_row", F.posexplode("_keys").alias("_at", "_key"))
    level = cells.join(names, "_key").select("_row", "_at", "name")
    if clashing:
        level = level.union(_named_by_content(src, block, key_bits, clashes))
    level = cut_lineage(level)

    # Level k: names of adjacent pairs. A row that is down to one name is done.
    done = level.join(rows.where(F.size("_keys") == 1).select("_row"), "_row", "left_semi").select("_row", F.lit(0).alias("_level"), "name")
    finished = [done]
    k, width = 0, rows.select("_row", F.size("_keys").alias("_width")).where("_width > 1")
    level = level.join(width, "_row")
    while not level.isEmpty():
        k += 1
        pairs = cut_lineage(level.groupBy("_row", F.expr("_at div 2").alias("_at"), F.expr("(_width + 1) div 2").alias("_width")).agg(
            F.max(F.when(F.col("_at") % 2 == 0, F.col("name"))).alias("_left"),
            F.coalesce(F.max(F.when(F.col("_at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("_right")))
        named = sorted_names(pairs, ["_left", "_right"], F.xxhash64("_left", "_right"))
        level = cut_lineage(pairs.join(named, ["_left", "_right"]).select("_row", "_at", "_width", "name"))
        finished.append(level.where("_width = 1").select("_row", F.lit(k).alias("_level"), "name"))
        level = level.where("_width > 1")
    out = finished[0]
    for f in finished[1:]:
        out = out.union(f)
    return rows.join(out, "_row").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "text_sha256",
                                         F.col("_level").alias("level"), "name")


def _named_by_content(src: DataFrame, block: int, key_bits: int, clashes: DataFrame) -> DataFrame:
    """Names of the blocks whose key is shared, by their content; negative, so that they meet no other name."""
    cells = src.select("_row", F.posexplode(_blocks(F.col("_t"), block)).alias("_at", "_block"))
    cells = cut_lineage(cells.withColumn("_key", _key(F.col("_block"), key_bits)).join(clashes, "_key", "left_semi"))
    names = sorted_names(cells, ["_block"], F.xxhash64("_block"))
    return cells.join(names, "_block").select("_row", "_at", (-2 - F.col("name")).alias("name"))


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, level, name."""
    named = cut_lineage(name_texts(docs, text, (doc_id,), block, key_bits).withColumnRenamed(doc_id, "doc_id"))
    groups = cut_lineage(named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))  # so that a hot group is split in the join
    return named.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "level", "name")


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return mark_duplicates(read(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
