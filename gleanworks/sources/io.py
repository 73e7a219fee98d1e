"""Readers and writers: JSON Lines samples, runs, labels, logs, traces, image listings; guarded sinks."""

from __future__ import annotations

from collections.abc import Mapping

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as sc
from ..ordering import rank_in_groups

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


# ---- reading ----

def read_samples(spark: SparkSession, path: str, schema: str = sc.SAMPLE, keep_corrupt: bool = True) -> DataFrame:
    """JSON Lines with an explicit schema; malformed lines are kept in ``_corrupt_record`` and blank lines skipped.

    ``seq`` numbers rows in file order. Each input split is one numbering bucket, so no global sort takes place.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    text = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = text.select(parsed.alias("r"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_pos")).select("r.*", "_file", "_block", "_pos")
    out = rank_in_groups(raw, [], [F.col("_file"), F.col("_block"), F.col("_pos")], F.struct("_file", "_block"), "seq")
    out = out.drop("_file", "_block", "_pos")
    return out if keep_corrupt else out.filter("_corrupt_record is null").drop("_corrupt_record")


def count_malformed(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.when(F.col("_corrupt_record").isNull(), 1)).alias("n_ok"), F.count("_corrupt_record").alias("n_malformed"))


def require_nonempty(df: DataFrame, what: str = "input") -> DataFrame:
    """Zero rows are an error, not a small result."""
    if df.isEmpty():
        raise ValueError(f"{what} holds no valid row")
    return df


def read_suite(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """A benchmark suite from ``path`` (JSON Lines), or the small built-in ``fallback`` where there is none; ``suite_source`` says which, so that nobody takes the latter's score for a result."""
    if exists(spark, path):
        return spark.read.schema(fallback.schema).json(path).withColumn("suite_source", F.lit("data"))
    return fallback.withColumn("suite_source", F.lit("fixture"))


PAIR = "id string, prompt string, query string, chosen string, rejected string, images array<string>, image string, source string, error_type string"


def read_pairs(spark: SparkSession, paths: Mapping[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """Preference pairs (JSON Lines) by name, and the names whose path does not exist: those are left out, not an error. Lines that are no JSON have no chosen answer and fall out later."""
    missing = [name for name, path in paths.items() if not exists(spark, path)]
    return {name: spark.read.schema(PAIR).json(path) for name, path in paths.items() if name not in missing}, missing


def scan_images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, length, modificationTime of image files below ``root``; file contents are only read when asked for."""
    glob = "*.{" + ",".join(s for x in IMAGE_SUFFIXES for s in (x, x.upper())) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    df = df.filter(~F.substring_index("path", "/", -1).startswith("."))
    cols = ["path", "length", "modificationTime"]
    return df.select(*cols, F.md5("content").alias("content_md5")) if content else df.select(*cols)


def read_runs(spark: SparkSession, *globs: str) -> DataFrame:
    """Evaluation runs from many files; the run tag comes from the file name ``eval_<tag>_raw``."""
    df = spark.read.schema(sc.EVAL_RECORD).json(list(globs)).withColumn("_name", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    tag = F.regexp_extract("_name", r"^eval_(.*)_raw$", 1)
    return df.withColumn("tag", F.when(tag != "", tag).otherwise(F.col("_name"))).drop("_name")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(sc.LABEL).json(path)


def read_train_state(spark: SparkSession, path: str) -> DataFrame:
    """Trainer state files: run, step, loss, eval_loss, ... one row per log entry."""
    df = spark.read.schema(sc.TRAIN_STATE).option("multiLine", "true").json(path)
    return df.select(F.col("_metadata.file_path").alias("run"), F.explode("log_history").alias("h")).select("run", "h.*")


def train_log_entries(text: DataFrame, run: str = "run", line: str = "value") -> DataFrame:
    """Dict literals printed into text logs. ``text``: run, value. Unparsable entries are left out."""
    found = text.select(run, F.explode(F.regexp_extract_all(F.col(line), F.lit(r"(\{[^{}]*'(?:eval_)?loss'[^{}]*\})"), F.lit(1))).alias("d"))
    parsed = F.from_json(F.replace("d", F.lit("'"), F.lit('"')), sc.TRAIN_LINE, {"mode": "PERMISSIVE"})
    return found.select(run, parsed.alias("h")).select(run, "h.*").filter("loss is not null or eval_loss is not null")


def read_train_text(spark: SparkSession, path: str) -> DataFrame:
    return train_log_entries(spark.read.text(path).select(F.col("_metadata.file_path").alias("run"), "value"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Step rows with their session id: the line's own, else that of their file's header. Footers are ignored; totals are always recomputed."""
    raw = spark.read.schema(sc.TRACE_LINE).json(path).withColumn("_file", F.col("_metadata.file_path"))
    head = raw.filter("type = 'header'")
    alone = head.groupBy("_file").agg(F.min("session_id").alias("_sid"), F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_file", "_sid")  # files of one session
    meta = head.groupBy("session_id").agg(F.first("meta").alias("meta"))
    steps = raw.filter("type = 'step'").select("_file", "session_id", F.col("index").alias("idx"), "kind", "name", "ms", "ok", "in_tokens", "out_tokens", "cost",
                                               F.coalesce("detail", F.create_map().cast("map<string,string>")).alias("detail"), "started_at")
    named = steps.join(alone, "_file", "left").withColumn("session_id", F.coalesce("session_id", "_sid")).drop("_file", "_sid")
    return named.join(meta, "session_id", "left").withColumn("session_id", F.coalesce("session_id", F.lit("unknown")))


TRACE_STEPS = 100_000  # steps of one session that lie in one file


def write_traces(steps: DataFrame, path: str, files: int | None = None) -> None:
    """header, step and footer lines of many sessions a file. ``steps``: session_id, idx, kind, name, ms, ok, tokens, cost, detail.

    Sessions are dealt to ``files`` files (by default as many as a shuffle has) by hash, so the number of files does not follow the number of sessions; a session of more than ``TRACE_STEPS`` steps
    goes on in others. Every line names its session.
    """
    none = lambda t: F.lit(None).cast(t)
    part = F.floor(F.col("idx") / TRACE_STEPS)
    step = steps.select("session_id", F.lit(1).alias("_o"), part.alias("_part"), "idx", F.lit("step").alias("type"), F.col("idx").alias("index"), "kind", "name", "ms", "ok",
                        "in_tokens", "out_tokens", "cost", "detail", none("int").alias("n_steps"), none("double").alias("total_ms"), none("double").alias("total_cost"))
    foot = steps.groupBy("session_id").agg(F.max(part).alias("_part"), F.count(F.lit(1)).cast("int").alias("n_steps"), F.sum("ms").alias("total_ms"), F.sum("cost").cast("double").alias("total_cost"),
                                           F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens")).withColumns({"_o": F.lit(2), "type": F.lit("footer")})
    head = steps.groupBy("session_id").agg(F.min(part).alias("_part")).withColumns({"_o": F.lit(0), "type": F.lit("header")})
    rows = step.unionByName(foot, allowMissingColumns=True).unionByName(head, allowMissingColumns=True)
    keys = [F.col("session_id"), F.col("_part")]
    dealt = rows.repartition(files, *keys) if files else rows.repartition(*keys)
    dealt.sortWithinPartitions("session_id", "_part", "_o", "idx").drop("_o", "_part", "idx").write.mode("overwrite").json(path)


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """One operational table from parquet or, with connection options, over JDBC."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc, dbtable=name).load()
    return spark.read.schema(sc.WAREHOUSE[name]).parquet(path)


# ---- shop payloads ----

def _tail(col: Column) -> Column:
    return F.element_at(F.split(F.coalesce(col, F.lit("")), "/"), -1)


def flatten_products(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested product JSON -> flat product; ids lose their prefix, images without url are dropped, options become a map."""
    p = raw.withColumn("p", F.from_json(payload, sc.RAW_PRODUCT, {"mode": "PERMISSIVE"}))
    urls = F.transform(F.filter(F.coalesce("p.images.nodes", F.array().cast("array<struct<url:string>>")), lambda i: F.coalesce(i["url"], F.lit("")) != ""), lambda i: i["url"])
    variants = F.transform("p.variants.nodes", lambda v: F.struct(
        _tail(v["id"]).alias("id"), v["title"].alias("title"), v["sku"].alias("sku"), v["price"].alias("price"), v["inventoryQuantity"].alias("inventory"),
        F.map_from_entries(F.coalesce(F.transform(v["selectedOptions"], lambda o: F.struct(o["name"].alias("key"), o["value"].alias("value"))),
                                      F.array().cast("array<struct<key:string,value:string>>"))).alias("options")))
    rest = [c for c in raw.columns if c != payload]
    return p.select(*rest, _tail(F.col("p.id")).alias("id"), "p.title", "p.description", F.col("p.productType").alias("category"), "p.vendor", "p.tags",
                    urls.alias("image_urls"), variants.alias("variants"), F.col("p.updatedAt").alias("updated_at"))


def flatten_orders(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested order JSON -> (orders, order lines, fulfillments)."""
    o = raw.select(F.from_json(payload, sc.RAW_ORDER, {"mode": "PERMISSIVE"}).alias("o")).select("o.*").withColumn("order_id", _tail(F.col("id")))
    orders = o.select("order_id", "name", F.col("createdAt").alias("created_at"), F.col("displayFinancialStatus").alias("financial_status"),
                      F.col("displayFulfillmentStatus").alias("fulfillment_status"), F.expr("try_cast(totalPriceSet.shopMoney.amount as decimal(18,4))").alias("amount"),
                      F.col("totalPriceSet.shopMoney.currencyCode").alias("currency"), _tail(F.col("customer.id")).alias("customer_id"))
    lines = o.select("order_id", F.posexplode("lineItems.nodes").alias("line", "l")).select(
        "order_id", "line", "l.title", "l.quantity", "l.sku", F.expr("try_cast(l.originalUnitPriceSet.shopMoney.amount as decimal(18,4))").alias("unit_price"))
    ship = o.select("order_id", F.posexplode("fulfillments").alias("part", "f")).select(
        "order_id", "part", "f.status", F.col("f.createdAt").alias("created_at"), F.explode_outer("f.trackingInfo").alias("t")).select(
        "order_id", "part", "status", "created_at", F.col("t.number").alias("tracking"), F.col("t.company").alias("carrier"), F.col("t.url").alias("url"))
    return orders, lines, ship


# ---- writing ----

def write_guarded(df: DataFrame, path: str, report: DataFrame | None = None, report_path: str | None = None, fmt: str = "parquet",
                  partition_by: tuple[str, ...] = ()) -> None:
    """Report first and always; data only when there is any. An empty result never replaces existing data.

    Data goes to a staging folder, is checked there, and is moved into place.
    """
    spark = df.sparkSession
    if report is not None:
        report.coalesce(1).write.mode("overwrite").json(report_path)
    staging = path.rstrip("/") + ".__staging"
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(staging)
    fs, target = _fs(spark, path)
    _, temp = _fs(spark, staging)
    _, old = _fs(spark, path.rstrip("/") + ".__old")
    if spark.read.schema(df.schema).format(fmt).load(staging).isEmpty():
        fs.delete(temp, True)
        raise ValueError(f"nothing left to write; {path} is unchanged")
    if fs.exists(target):
        if not fs.rename(target, old):
            raise OSError(f"cannot move {path} aside")
    if not fs.rename(temp, target):
        fs.rename(old, target)
        raise OSError(f"cannot move staged data to {path}")
    if fs.exists(old):
        fs.delete(old, True)


SFT_TAGS = {"columns": {"messages": "messages", "images": "images"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant",
                                                                        "system_tag": "system"}}
CONVERSATION_TAGS = {"columns": {"messages": "conversations", "images": "images"}, "tags": {"role_tag": "from", "content_tag": "value"}}


def write_sft(df: DataFrame, path: str, tags: dict = SFT_TAGS) -> None:
    """Rows with a ``split`` column as JSON Lines partitioned by split, plus a small manifest of file, columns, tags and counts."""
    write_guarded(df, path, fmt="json", partition_by=("split",))
    spark = df.sparkSession
    counts = {r["split"]: r["count"] for r in spark.read.schema(df.schema).json(path).groupBy("split").count().collect()}  # one row per split
    names = {"train": "sft_train", "val": "sft_eval", "test": "sft_test"}
    manifest = {n: {"file_name": f"split={s}", "formatting": "sharegpt", "rows": counts.get(s, 0), **tags} for s, n in names.items()}
    fs, p = _fs(spark, path.rstrip("/") + "_manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False, indent=2), "utf-8"))
    out.close()
