"""Webhook ingestion, routing, index maintenance, redaction and roll-ups as Structured Streaming jobs.

Sinks write one folder per micro-batch, so a replayed batch replaces itself; where a batch has several sinks, a manifest entry written last says which attempt counts. Together with the checkpoint
every delivery takes effect once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import lexicons as lx, schemas as sc
from ..functions import shop as sh
from ..operators.usage import latest_products
from ..session import cut_lineage


def event_source(spark: SparkSession, path: str | None = None, kafka: Mapping[str, str] | None = None, per_trigger: int = 100) -> DataFrame:
    """Webhook envelopes from a folder of JSON Lines (body base64-encoded) or from Kafka."""
    if kafka is not None:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        return raw.select(F.from_json(F.col("value").cast("string"), sc.WEBHOOK).alias("e")).select("e.*")
    return spark.readStream.schema(sc.WEBHOOK).option("maxFilesPerTrigger", per_trigger).json(path)


def dedup_events(events: DataFrame, ttl: str = "2 days") -> DataFrame:
    """Each delivery id once while it is remembered; events without id always pass. Works on streams and on tables."""
    blank = F.coalesce("webhook_id", F.lit("")) == ""
    named, unnamed = events.filter(~blank), events.filter(blank)
    if events.isStreaming:
        named = named.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["webhook_id"])
    else:
        named = named.dropDuplicates(["webhook_id"])
    return named.unionByName(unnamed)


def classify(events: DataFrame, secret: str, ttl: str = "2 days") -> DataFrame:
    """Add status: 401 bad signature, 400 bad JSON, 200 accepted. The order is signature, then id, then body: a forged event
    cannot use up the id of a real one."""
    checked = events.withColumn("_ok", sh.valid_body(F.col("body"), F.col("signature"), secret))
    bad = checked.filter(~F.col("_ok")).withColumn("status", F.lit(401))
    good = dedup_events(checked.filter("_ok"), ttl)
    text = F.decode(F.col("body"), "utf-8")
    good = good.withColumn("status", F.when(F.try_parse_json(text).isNull(), F.lit(400)).otherwise(F.lit(200)))
    out = good.unionByName(bad).withColumn("payload", F.decode(F.col("body"), "utf-8"))
    return out.withColumn("topic", sh.normalize_topic(F.col("topic"))).drop("_ok", "body", "signature")


SINKS = ("accepted", "quarantine")


def commit_batch(spark: SparkSession, out: str, batch_id: int, attempt: str) -> None:
    """The manifest entry of a batch: which attempt's files count. Written last; a replay replaces it."""
    entry = spark.range(1, numPartitions=1).select(F.lit(attempt).alias("attempt"))
    entry.write.mode("overwrite").parquet(f"{out}/commits/batch={batch_id}")


def committed(spark: SparkSession, out: str, sink: str) -> DataFrame:
    """Rows of a sink whose batch has been committed, of the attempt that was: what an interrupted or replayed batch left behind is not seen."""
    commits = spark.read.schema("attempt string, batch long").parquet(f"{out}/commits")
    return spark.read.parquet(f"{out}/{sink}").join(commits, ["batch", "attempt"], "left_semi").drop("batch", "attempt")


def ingest_events(events: DataFrame, secret: str, out: str, checkpoint: str, ttl: str = "2 days", trigger: dict | None = None,
                  between: Callable[[int], None] | None = None) -> StreamingQuery:
    """Accepted events to ``out/accepted``, the rest with its status to ``out/quarantine``; ``committed`` reads either.

    Both sinks of a batch are written to folders of this attempt, then one manifest entry makes them visible together. ``between`` is called with the batch's number after the first sink.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        attempt = uuid.uuid4().hex
        batch = cut_lineage(batch)
        batch.filter("status = 200").write.parquet(f"{out}/accepted/batch={batch_id}/attempt={attempt}")
        if between:
            between(batch_id)
        batch.filter("status <> 200").write.parquet(f"{out}/quarantine/batch={batch_id}/attempt={attempt}")
        commit_batch(batch.sparkSession, out, batch_id, attempt)

    return (classify(events, secret, ttl).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def route(events: DataFrame, topics: tuple[str, ...] = lx.TOPICS) -> DataFrame:
    """Add ``route``: the topic if a handler exists, else ``unknown``."""
    t = sh.normalize_topic(F.col("topic"))
    return events.withColumn("route", F.when(t.isin(*topics), t).otherwise(F.lit("unknown")))


def topic_counts(events: DataFrame) -> DataFrame:
    return route(events).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def handle_with_retry(handlers: Mapping[str, Callable[[DataFrame, int], None]], out: str, attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: one handler per route, retried; what still fails goes to a dead-letter table with its error.

    Routes without handler are written there too, instead of being lost.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(route(batch))
        for name in [*handlers, None]:
            part = batch.filter(F.col("route") == name) if name else batch.filter(~F.col("route").isin(*handlers))
            error, used = "no handler", 0
            if name:
                error = None
                for used in range(1, attempts + 1):
                    try:
                        handlers[name](part, batch_id)
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001 - the handler is user code; its failure is recorded below
                        error = str(e)
            if error is not None:
                part.withColumn("error", F.lit(error)).withColumn("attempts", F.lit(used)).write.mode("overwrite").parquet(
                    f"{out}/dead/route={(name or 'other').replace('/', '_')}/batch={batch_id}")

    return run


# ---- product index ----

def index_delta(changes: DataFrame, encode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Newest change per touched product. Only rows that stay are encoded; deletes are kept as tombstones.

    ``changes``: shop, id, updated_at, seq, deleted, title, ...
    """
    c = changes.withColumn("_o", F.struct(-F.unix_micros("updated_at"), -F.col("seq")))
    from ..ordering import first_wins
    newest = first_wins(c, ["shop", "id"], "_o").drop("_o")
    if encode is None:
        return newest
    live = encode(newest.filter(~F.col("deleted")))
    return live.unionByName(newest.filter("deleted"), allowMissingColumns=True)


def product_index_sync(changes: DataFrame, out: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame] | None = None,
                       trigger: dict | None = None) -> StreamingQuery:
    """Append one delta per micro-batch, partitioned by shop: the work follows the touched products, not the index size."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        index_delta(batch, encode).write.mode("overwrite").partitionBy("shop").parquet(f"{out}/batch={batch_id}")

    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _index_rows(spark: SparkSession, out: str, last: int | None = None) -> DataFrame:
    """The compacted table that the pointer names, if there is one, and the deltas after it (up to batch ``last``)."""
    base, upto = index_pointer(spark, out)
    deltas = spark.read.option("mergeSchema", "true").option("basePath", out).parquet(f"{out}/batch=*").filter(F.col("batch") > upto)
    if last is not None:
        deltas = deltas.filter(F.col("batch") <= last)
    deltas = deltas.drop("batch")
    return deltas if base is None else spark.read.parquet(f"{out}/{base}").unionByName(deltas, allowMissingColumns=True)


def current_index(spark: SparkSession, out: str) -> DataFrame:
    """Newest state of every product."""
    return latest_products(_index_rows(spark, out))


def index_pointer(spark: SparkSession, out: str) -> tuple[str | None, int]:
    """(folder of the compacted table, last batch in it): the pointer with the highest number that was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/pointers")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None, -1
    top = spark.read.schema("base string, upto long").parquet(f"{out}/pointers").orderBy(F.col("upto").desc()).first()
    return (top["base"], top["upto"]) if top else (None, -1)


def compact_index(spark: SparkSession, out: str) -> None:
    """Fold all deltas so far into one table under a new name, then switch the pointer: readers see the old tables or the new one, never a half of it.

    Deleted products stay as tombstones, so that an older change that comes late does not bring them back.
    """
    last = spark.read.option("basePath", out).parquet(f"{out}/batch=*").agg(F.max("batch")).first()[0]
    if last is None or last <= index_pointer(spark, out)[1]:
        return
    name = f"base-{last}-{uuid.uuid4().hex}"
    index_delta(_index_rows(spark, out, last)).write.partitionBy("shop").parquet(f"{out}/{name}")
    pointer = spark.range(1, numPartitions=1).select(F.lit(name).alias("base"), F.lit(last).cast("long").alias("upto"))
    pointer.write.mode("append").parquet(f"{out}/pointers")


# ---- privacy requests ----

def redact_customers(tables: dict[str, DataFrame], requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove the messages of the named customers, then their sessions. ``requests``: shop_id, customer_id. Returns tables and audit rows."""
    req = requests.select("shop_id", "customer_id").distinct()
    doomed = cut_lineage(tables["sessions"].join(req, ["shop_id", "customer_id"], "left_semi").select(F.col("id").alias("session_id"), "shop_id", "customer_id"))
    out = dict(tables)
    out["messages"] = tables["messages"].join(doomed.select("session_id"), "session_id", "left_anti")
    out["sessions"] = tables["sessions"].join(req, ["shop_id", "customer_id"], "left_anti")
    per = doomed.groupBy("shop_id", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    audit = req.join(per, ["shop_id", "customer_id"], "left").select(
        "shop_id", F.lit("customer").alias("actor"), F.lit("redact").alias("action"), F.to_json(F.struct("customer_id", F.coalesce("n", F.lit(0)).alias("sessions"))).alias("details"))
    return out, audit


def redact_shops(tables: dict[str, DataFrame], requests: DataFrame, order: tuple[str, ...] = lx.SHOP_REDACT_ORDER) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove everything of the named shops, dependants before owners. ``requests``: shop_id."""
    req = requests.select("shop_id").distinct()
    out = dict(tables)
    for name in order:
        if name not in out:
            continue
        t = out[name]
        if name == "messages":
            gone = tables["sessions"].join(req, "shop_id", "left_semi").select(F.col("id").alias("session_id"))
            out[name] = t.join(gone, "session_id", "left_anti")
        elif name == "shops":
            out[name] = t.join(req, t["id"] == req["shop_id"], "left_anti")
        else:
            out[name] = t.join(req, "shop_id", "left_anti")
    audit = req.select("shop_id", F.lit("shop").alias("actor"), F.lit("redact").alias("action"), F.lit("{}").alias("details"))
    return out, audit


def uninstall(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """Blank the access tokens and drop the index of the named shops."""
    req = requests.select("shop_id").distinct().withColumn("_gone", F.lit(True))
    out = dict(tables)
    shops = tables["shops"].join(req, tables["shops"]["id"] == req["shop_id"], "left")
    out["shops"] = shops.withColumn("access_token", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("access_token"))).drop("_gone", "shop_id")
    out["product_index"] = tables["product_index"].join(req, "shop_id", "left_anti")
    return out


def export_customer(tables: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """All messages of the named customers: shop_id, customer_id, session_id, role, content, image_urls, created_at."""
    s = tables["sessions"].join(requests.select("shop_id", "customer_id").distinct(), ["shop_id", "customer_id"], "left_semi")
    m = tables["messages"].select("session_id", "role", "content", "image_urls", "created_at")
    return s.select("shop_id", "customer_id", F.col("id").alias("session_id")).join(m, "session_id")


def redact_stream(events: DataFrame, load: Callable[[], dict[str, DataFrame]], save: Callable[[dict[str, DataFrame], DataFrame, int], None],
                  checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Apply redaction requests as they arrive. ``events``: topic, shop_id, customer_id; ``load``/``save`` read and replace the tables."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch.withColumn("topic", sh.normalize_topic(F.col("topic"))))
        tables, audit = redact_customers(load(), batch.filter("topic = 'customers/redact'"))
        tables, more = redact_shops(tables, batch.filter("topic = 'shop/redact'"))
        save(tables, audit.unionByName(more), batch_id)

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# ---- roll-ups ----

def trace_rollup(steps: DataFrame, width: str = "1 minute", late: str | None = "10 minutes") -> DataFrame:
    """Trace totals per tumbling window; the same expression serves tables and streams."""
    from ..operators.agent import trace_summary
    src = steps.withWatermark("ts", late) if steps.isStreaming and late else steps
    out = trace_summary(src.withColumn("w", F.window("ts", width)), ["w"])
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def session_rollup(turns: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """session_id, started_at, ended_at, n_messages, tokens, resolved, escalated per activity session (gap-based)."""
    src = turns.withWatermark("ts", late) if turns.isStreaming and late else turns
    g = src.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_messages"), F.sum("tokens").cast("long").alias("tokens"),
        F.bool_or("resolved").alias("resolved"), F.bool_or("escalated").alias("escalated"))
    return g.drop("w")
