"""Keeping spans and costs current while logs grow: idempotent appends, then only the touched buckets of sessions are rebuilt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.cost import cost_ledger, unpriced_ledger
from tidemark.operators.merge import insert_absent
from tidemark.operators.spans import IDLE_MS, spans

BUCKETS = 64


def bucketed(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))


def _stored(like: DataFrame, path: str, buckets: DataFrame | None = None) -> DataFrame:
    """What path holds (nothing yet: no rows), of the given buckets only, so that other partitions are not read."""
    spark = like.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], like.schema)
    own = spark.read.schema(like.schema).parquet(path)
    return own if buckets is None else own.join(F.broadcast(buckets), "bucket", "left_semi")  # at most BUCKETS rows


def _rebuild(df: DataFrame, touched: DataFrame, path: str) -> None:
    """Replace the touched buckets under path; one that has no rows any more is removed."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    empty = touched.join(df.select("bucket").distinct(), "bucket", "left_anti").collect()  # at most BUCKETS rows
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in empty:
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={r.bucket}")
        gone.getFileSystem(conf).delete(gone, True)


def cycle(batch: DataFrame, events_path: str, spans_path: str, idle_ms: int = IDLE_MS, prices: DataFrame | None = None, costs_path: str = "") -> None:
    """One batch of events (event_id, session_id, thread_id, ts, kind, ...): a repeated event changes nothing, a late one rebuilds its session.

    With prices, the two cost ledgers of the touched buckets follow under costs_path (ledger, unpriced).
    """
    new = bucketed(batch.dropDuplicates(["event_id"]))
    touched = new.select("bucket").distinct()
    stored = _stored(new, events_path, touched)
    insert_absent(stored, new, ["event_id"]).select(*new.columns).write.mode("append").partitionBy("bucket").parquet(events_path)
    whole = _stored(new, events_path, touched)
    keep = ("session_id", "source", "project_id", "group_id", "is_subagent")
    _rebuild(bucketed(spans(whole, idle_ms, tuple(c for c in keep if c in new.columns))), touched, spans_path)
    if prices is not None:
        for name, ledger in (("ledger", cost_ledger), ("unpriced", unpriced_ledger)):
            _rebuild(bucketed(ledger(whole, prices)), touched, f"{costs_path}/{name}")


def corpus_totals(spans_: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row for whoever watches: spans, active time and cost as they stand."""
    return spans_.agg(F.count("*").alias("spans"), F.coalesce(F.sum("ms"), F.lit(0)).alias("active_ms")).crossJoin(ledger.agg(F.coalesce(F.sum("total_nano"), F.lit(0)).alias("cost_nano")))  # one row each


def follow(stream: DataFrame, events_path: str, spans_path: str, checkpoint: str, idle_ms: int = IDLE_MS, then: Callable[[int], None] | None = None, prices: DataFrame | None = None, costs_path: str = "", **trigger) -> StreamingQuery:
    """cycle() for each micro-batch of a stream; a batch that runs again after a failure leaves the same rows. then: told of each batch done."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            cycle(batch, events_path, spans_path, idle_ms, prices, costs_path)
            if then:
                then(number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()
