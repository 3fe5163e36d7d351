"""What the operators of this package share: inputs, staged tables, runs in Arrow batches and connected components.

Common rules for `documents`: a null text counts as an empty one; a row without doc_id is never
compared with others; rows that repeat a doc_id count as one document wherever documents are counted.
"""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: [\x20\x09-\x0D].
SPACE = b" \t\n\r\x0b\x0c"
#: Spark's bound on the bytes of an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and whole text only, so that other columns never clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Temporary folders of sessions in local mode that have no spark.checkpoint.dir, by application id.
_OWN_DIRS: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or where that is unset a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor see")
    own = spark.sparkContext.applicationId
    if own not in _OWN_DIRS:
        _OWN_DIRS[own] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return _OWN_DIRS[own]


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder's path below base_dir."""
    return f"{base_dir(spark)}/tidemark/{kind}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run inside hands Arrow batches of about `size` bytes to Python, whatever the session's bound is: a batch is held several times, by the JVM
    outside its heap and by each worker."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def staged(df: DataFrame, kind: str, batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor depend on one executor's disk. batch: bytes of the Arrow batches
    meanwhile."""
    path = shared_dir(df.sparkSession, kind)
    with batches_of(df.sparkSession, batch) if batch else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything staged below base_dir; call it when the results have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base_dir(spark)}/tidemark")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows without a copy, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of each run of equal keys in a batch that is sorted by them."""
    n = len(keys[0])
    if not n:
        return
    cut = np.zeros(n - 1, bool)
    for k in keys:
        cut |= k[1:] != k[:-1]
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    yield from zip(edges[:-1], edges[1:])


def roots(parent: np.ndarray) -> np.ndarray:
    """Each node's root, by pointer jumping, of a forest whose parents are never larger than their children."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links a-b (vectorised min-label with pointer jumping)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        label = roots(label)
    return label


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): rows (id long, component_id long = smallest id reachable).

    Alternating large-star and small-star passes. A hot node's links are summed by a partial
    aggregate and joined back (which Spark splits when skewed), never gathered in one group.
    Nodes without links have no row. Every pass is staged in the shared folder.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return nodes.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def pieces(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))
