"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domain, language and source. What a node cannot use (its tokens times ``max_epochs`` are fewer
than its share) goes to its siblings, in proportion to their weights, before anything goes back to its parent's siblings: each level
is filled knowing how much its whole subtree can take. A leaf's budget is read from its seeded epochs: whole epochs, then the longest prefix of
the next epoch's order that fits. Where the prefix ends is found from sums per leaf and key range, then inside one
range, so no leaf is sorted by one task and rows never move: each row compares its key with its leaf's last key.

Defined cases: null language or source is a leaf value of its own (shown as null); texts without words have no tokens and come with
any epoch order that reaches them; a null doc_id is ordered by its text; rows that share doc_id (or, without one, the text) share
their place in the order and stay or go together; an empty table gives an empty result. Floors leave less than one token per node unspent.
Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .common import query, read

# Domain of each source; sources that are not named are in the domain "other".
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"), "reference": ("src8", "src9", "src10", "src11", "src12"),
           "forum": ("src13", "src14", "src15", "src16")}
# Weights among siblings; names that are not listed weigh 1.
DOMAIN_WEIGHTS = {"web": 4, "reference": 3, "forum": 2, "other": 1}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}
SHARE, MAX_EPOCHS, SEED = 0.7, 2, 5
BROADCAST_LEAVES = 100_000
KEYS = ("domain", "language", "source")


def _lookup(c: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def domain_of(source: Column) -> Column:
    return _lookup(source, {s: d for d, names in DOMAINS.items() for s in names}, "other")


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds ``given``: each parent's ``budget`` on its children in proportion to ``weight``, none above its ``room``.

    Children are taken by room per weight. While a child's room is below its share of what is left, it gets its room and
    leaves; the first one that is not sets the share per weight for all that follow.
    """
    order = [F.col("room") / F.col("weight"), F.col(child)]
    w = Window.partitionBy(*parents).orderBy(*order) if parents else Window.partitionBy(F.lit(0)).orderBy(*order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    left = nodes.withColumn("_left", F.col("budget") - F.coalesce(F.sum("room").over(before), zero)).withColumn("_weights", F.sum("weight").over(after))
    full = left.withColumn("_full", F.min((F.col("room") * F.col("_weights") <= F.col("weight") * F.col("_left")).cast("int")).over(upto))
    free = F.when(F.col("_full") == 0, F.struct("_left", "_weights"))
    out = full.withColumn("_at", F.first(free, ignorenulls=True).over(upto))
    return (out.withColumn("given", F.when(F.col("_full") == 1, F.col("room")).otherwise(F.expr("weight * _at._left div _at._weights")))
            .drop("_left", "_weights", "_full", "_at"))


def budgets(leaves: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """``leaves(domain, language, source, tokens)`` with ``budget``: tokens that each leaf is to give."""
    room = leaves.withColumn("room", F.col("tokens") * max_epochs)
    total = room.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("long").alias("budget"))

    def up(*keys: str) -> DataFrame:
        return room.groupBy(*keys).agg(F.sum("room").alias("room"))

    def down(above: DataFrame, keys: list[str]) -> DataFrame:
        given = above.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("given").alias("budget"))
        nodes = room if len(keys) == 2 else up(*KEYS[:len(keys) + 1])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return nodes.join(given, on).drop(*[f"_{k}" for k in keys])

    budget = total.select("budget").scalar()
    domains = fill(up("domain").withColumn("weight", _lookup(F.col("domain"), DOMAIN_WEIGHTS, 1).cast("long")).withColumn("budget", budget), [], "domain")
    languages = fill(down(domains, ["domain"]).withColumn("weight", _lookup(F.col("language"), LANGUAGE_WEIGHTS, 1).cast("long")), ["domain"], "language")
    sources = fill(down(languages, ["domain", "language"]).withColumn("weight", _lookup(F.col("source"), SOURCE_WEIGHTS, 1).cast("long")), ["domain", "language"], "source")
    return sources.select(*KEYS, "tokens", F.col("given").alias("budget"))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
        language: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with domain, language, source_leaf, n_tokens, leaf_budget, epoch (whole epochs given) and copies (how often the row is given)."""
    own = [c for c in docs.columns if c not in ("domain", "language", "source_leaf", "n_tokens", "leaf_budget", "epoch", "copies")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    made = docs.select(row, domain_of(F.col(source)).alias("domain"), F.col(language).alias("language"), F.col(source).alias("source"),
                       F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit("")).alias("_name"), token_count(F.col(text)).alias("n_tokens"))
    # Leaves, then keys: narrow tables only.
    narrow = cut_lineage(made.drop("_row"))
    leaves = narrow.groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(cut_lineage(leaves), share, max_epochs)
    plan = cut_lineage(plan.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "budget", F.expr("if(tokens = 0, 0, budget div tokens)").alias("epoch"),
                                   F.expr("if(tokens = 0, 0, budget % tokens)").alias("rest")))
    n_leaves = plan.count()
    on = F.lit(True)
    for k in KEYS:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))

    def with_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan) if n_leaves <= BROADCAST_LEAVES else plan, on).drop(*[f"_{k}" for k in KEYS])

    def key() -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("_name")).cast("binary"))

    keyed = with_plan(narrow, plan).withColumn("_key", key()).withColumn("_range", F.substring("_key", 1, 3))
    sums = keyed.groupBy(*KEYS, "rest", "_range").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(*KEYS).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (sums.withColumn("_sum", F.sum("n").over(w)).where(F.col("_sum") > F.col("rest")).groupBy(*KEYS)
            .agg(F.min(F.struct("_range", (F.col("_sum") - F.col("n")).alias("_before"))).alias("_edge"))
            .select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("_edge._range").alias("_edge"), "_edge._before"))
    edge = cut_lineage(edge)
    inside = (with_plan(keyed, edge).where(F.col("_range") == F.col("_edge")).groupBy(*KEYS, "_before", "rest", "_key").agg(F.sum("n_tokens").alias("n")))
    w = Window.partitionBy(*KEYS).orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (inside.withColumn("_sum", F.col("_before") + F.sum("n").over(w)).where(F.col("_sum") <= F.col("rest"))
            .groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(F.max("_key").alias("_last")))
    # Rows up to the last key: all ranges before the edge, and the edge's up to the key that still fits.
    cut = plan
    for more in (edge.drop("_before"), last):
        renamed = more.select(*[F.col(f"_{k}").alias(f"__{k}") for k in KEYS], *[c for c in more.columns if c not in [f"_{k}" for k in KEYS]])
        same = F.lit(True)
        for k in KEYS:
            same = same & F.col(f"_{k}").eqNullSafe(F.col(f"__{k}"))
        cut = cut.join(renamed, same, "left").drop(*[f"__{k}" for k in KEYS])
    cut = cut_lineage(cut)
    out = with_plan(made, cut).withColumn("_key", key()).withColumn("_range", F.substring("_key", 1, 3))
    more = (F.col("rest") > 0) & (F.col("_edge").isNull() | (F.col("_range") < F.col("_edge")) | ((F.col("_range") == F.col("_edge")) & F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False))))
    return out.select(*[F.col("_row")[c].alias(c) for c in own], "domain", "language", F.col("source").alias("source_leaf"), "n_tokens",
                      F.col("budget").alias("leaf_budget"), "epoch", (F.col("epoch") + more.cast("long")).alias("copies"))


def take(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed rows with their own columns, each as often as it is given."""
    rows = mix(docs, share, max_epochs, seed)
    rows = rows.where("copies > 0").withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))) if max_epochs > 1 else rows.where("copies > 0")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def _case(col: str, table: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def _fill_sql(name: str, source: str, parents: str, child: str) -> str:
    """The filling of one level: ``source`` has the children with room, weight and budget."""
    over = f"OVER ({f'PARTITION BY {parents} ' if parents else ''}ORDER BY room::DOUBLE / weight, {child} NULLS FIRST ROWS BETWEEN"
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(room) {over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(weight) {over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM ({source})),
{name}_b AS (SELECT *, min((room * ws <= weight * l)::INT) {over} UNBOUNDED PRECEDING AND CURRENT ROW) AS fl FROM {name}_a),
{name}_c AS (SELECT *, first_value(CASE WHEN fl = 0 THEN struct_pack(l := l, ws := ws) END IGNORE NULLS) {over} UNBOUNDED PRECEDING AND CURRENT ROW) AS e0 FROM {name}_b),
{name} AS (SELECT * EXCLUDE (l, ws, fl, e0), CASE WHEN fl = 1 THEN room ELSE weight * e0.l // e0.ws END AS given FROM {name}_c)"""


def mix_sql(table: str, share: float, max_epochs: int, seed: int) -> str:
    """Common table expressions that end in ``mixed(doc_id, domain, language, source, n_tokens, leaf_budget, epoch, copies)``."""
    domain = _case("source", {s: f"'{d}'" for d, names in DOMAINS.items() for s in names}, "'other'")
    levels = [
        _fill_sql("dom", f"SELECT domain, sum(room) AS room, {_case('domain', DOMAIN_WEIGHTS, '1')} AS weight, any_value(total) AS budget FROM leaf GROUP BY domain", "", "domain"),
        _fill_sql("lng", f"SELECT x.*, {_case('language', LANGUAGE_WEIGHTS, '1')} AS weight, dom.given AS budget FROM (SELECT domain, language, sum(room) AS room FROM leaf GROUP BY 1, 2) x JOIN dom USING (domain)", "domain", "language"),
        _fill_sql("src", f"SELECT x.*, {_case('source', SOURCE_WEIGHTS, '1')} AS weight, lng.given AS budget FROM (SELECT domain, language, source, tokens, room FROM leaf) x JOIN lng ON lng.domain = x.domain AND lng.language IS NOT DISTINCT FROM x.language",
                  "domain, language", "source")]
    return f"""
tok AS (SELECT doc_id, {domain} AS domain, lang AS language, source, coalesce(doc_id::VARCHAR, md5(text), '') AS name, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {table}),
leaf AS (SELECT domain, language, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {max_epochs} AS room, floor((sum(sum(n_tokens)) OVER ())::DOUBLE * {share})::HUGEINT AS total FROM tok GROUP BY 1, 2, 3),
{",".join(levels)},
plan AS (SELECT domain, language, source, given, CASE WHEN tokens = 0 THEN 0 ELSE given // tokens END AS epoch, CASE WHEN tokens = 0 THEN 0 ELSE given % tokens END AS rest FROM src),
keyed AS (SELECT t.*, p.given, p.epoch, p.rest, md5('{seed}|' || p.epoch::VARCHAR || '|' || name) AS k FROM tok t JOIN plan p ON p.domain = t.domain AND p.language IS NOT DISTINCT FROM t.language AND p.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT doc_id, domain, language, source, n_tokens, given::BIGINT AS leaf_budget, epoch::BIGINT AS epoch,
          (epoch + (rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY k) <= rest)::INT)::BIGINT AS copies FROM keyed)"""


@query("op3_source_mixing", f"WITH {mix_sql('documents', SHARE, MAX_EPOCHS, SEED)} SELECT * FROM mixed")
def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "language", "source", "n_tokens", "leaf_budget", "epoch", "copies")
