"""Embedding near-dedup: an epsilon grid order join of unit vectors.

For unit vectors a cosine of at least t means a distance of at most eps = sqrt(2 - 2t). Vectors with equal label and
length are projected on the leading principal directions, laid on a grid of cell size eps and sorted by their
cells (epsilon grid order), then cut into blocks. A block reaches only blocks whose first cells
differ by at most one; of those pairs, the ones whose bounding boxes are further apart than eps are dropped before any
vector moves. A task joins two blocks recursively: intervals of both sequences are halved, and a pair of intervals is
skipped if its boxes are too far apart. What is left is compared by exact cosines. A task returns, for each vector, the number
of its links and its first link in each component of the block pair, so a group of n near copies makes rows in proportion to n
for each block pair. Equal vectors are one class from the start.

Defined results: vectors that are null, zero or hold null or non-finite components, and those without label, link with nothing;
vectors of different lengths never link; rows that repeat a vec_id count as one if the vector and the label are the same;
a null vec_id comes back unlinked; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, partitions, pieces, read, staged, union

#: Leading principal directions used for the grid; vectors in a block; vectors at which the recursion stops.
GRID_DIMS, BLOCK, LEAF = 6, 1024, 64


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition and vector length: number, sums and products of the unit vectors, flat."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, x in _unit_batches(batch.column(0)):
            own = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            sums[size] = sums.get(size, 0) + own
    for size, own in sums.items():
        yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(own), size, np.int32)), "at": pa.array(np.arange(len(own))), "value": pa.array(own)})


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x over their norms; the largest magnitude goes first, so that no square of a tiny or huge component is lost."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _unit(values: pa.Array) -> np.ndarray:
    return unit(np.asarray(values.flatten(), float).reshape(len(values), -1))


def _unit_batches(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        yield int(size), _unit(column.filter(pa.array(sizes == size)))


def principal_directions(vectors: DataFrame, dims: int = GRID_DIMS) -> dict[int, np.ndarray]:
    """By vector length: the leading eigenvectors of the covariance. Only sums of bounded size reach the driver."""
    sums = vectors.select("embedding").mapInArrow(_moments, "size int, at long, value double").groupBy("size", "at").agg(F.sum("value").alias("value"))
    out = {}
    for size, own in sums.toPandas().groupby("size"):
        flat = own.sort_values("at")["value"].to_numpy()
        n, mean = flat[0], flat[1 : size + 1] / flat[0]
        _, v = np.linalg.eigh(flat[size + 1 :].reshape(size, size) / n - np.outer(mean, mean))
        out[int(size)] = v[:, ::-1][:, :dims]
    return out


def _boxes_far(lo_a, hi_a, lo_b, hi_b, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((gap * gap).sum()) > eps * eps


def join_sequences(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i in x, j in y) of the pairs with cosine >= least; if same, only i < j. Intervals that are surely apart are skipped."""
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and c + 1 > d or same and d <= a:
            continue
        if _boxes_far(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0), eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            cos = x[a:b] @ y[c:d].T
            close = cos >= least
            for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):  # too near the bound for a rounded product
                close[i, j] = math.fsum(x[a + i] * y[c + j]) >= least
            i, j = np.nonzero(close)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
            continue
        m, k = (a + b) // 2, (c + d) // 2
        xs = [(a, m), (m, b)] if b - a > LEAF else [(a, b)]
        ys = [(c, k), (k, d)] if d - c > LEAF else [(c, d)]
        todo.extend((*p, *q) for p in xs for q in ys)
    return tuple(np.concatenate(z) if found else np.zeros(0, np.int64) for z in (zip(*found) if found else ((), ())))  # type: ignore[return-value]


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept, one row per row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    valid = rows.where(sound)
    named = staged(valid.distinct().withColumn("class", F.xxhash64("label", "embedding")), "vectors")
    classes = staged(named.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    basis = spark.sparkContext.broadcast(principal_directions(classes))
    eps = math.sqrt(2 - 2 * least)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("embedding"))
            sizes = np.asarray(col.value_lengths())
            out = np.zeros((len(sizes), GRID_DIMS))
            for size in np.unique(sizes):
                own = sizes == size
                p = _unit(col.filter(pa.array(own))) @ basis.value[int(size)]
                out[own, : p.shape[1]] = p
            cell = np.floor(out / eps).astype(np.int32)
            place = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), GRID_DIMS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sizes.astype(np.int32)), batch.column("rep"), batch.column("n"), col, place, *(pa.array(cell[:, i]) for i in range(GRID_DIMS))], ["label", "size", "rep", "n", "embedding", "place", *(f"c{i}" for i in range(GRID_DIMS))])

    label_type = classes.schema["label"].dataType.simpleString()
    grid = classes.mapInArrow(cells, f"label {label_type}, size int, rep long, n long, embedding array<double>, place array<double>, " + ", ".join(f"c{i} int" for i in range(GRID_DIMS)))
    order = ["label", "size", *(f"c{i}" for i in range(GRID_DIMS)), "rep"]
    parts = max(1, min(partitions(spark), pieces(classes.count(), BLOCK)))
    cut = grid.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = f"block long, label {label_type}, size int, low array<double>, high array<double>, first int, last int, reps array<long>, counts array<long>, places array<double>, vectors array<double>"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def made(rows: list[dict]) -> pa.RecordBatch:
            places = np.array([r["place"] for r in rows])
            vectors = unit(np.array([r["embedding"] for r in rows]))
            one = {"block": number, "label": rows[0]["label"], "size": rows[0]["size"], "low": places.min(0).tolist(), "high": places.max(0).tolist(), "first": rows[0]["c0"], "last": rows[-1]["c0"], "reps": [r["rep"] for r in rows], "counts": [r["n"] for r in rows], "places": places.ravel().tolist(), "vectors": vectors.ravel().tolist()}
            return pa.RecordBatch.from_pylist([one], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("label", label_arrow), ("size", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("first", pa.int32()), ("last", pa.int32()), ("reps", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("places", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= BLOCK or (r["label"], r["size"]) != (held[0]["label"], held[0]["size"])):
                    yield made(held)
                    number, held = number + 1, []
                held.append(r)
        if held:
            yield made(held)

    from pyspark.sql.pandas.types import to_arrow_type

    label_arrow = to_arrow_type(classes.schema["label"].dataType)
    block = staged(cut.mapInArrow(blocks, kinds), "vector-blocks")
    reach = block.select("block", "label", "size", "low", "high", F.explode(F.sequence("first", F.col("last") + 1)).alias("cell"))
    seen = block.select(F.col("block").alias("block_b"), "label", "size", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence("first", "last")).alias("cell"))
    both = reach.join(seen, ["label", "size", "cell"])
    gaps = F.aggregate(F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low_b", "high_b"), lambda p, q: F.greatest(F.lit(0.0), p["low"] - q["high_b"], q["low_b"] - p["high"])), F.lit(0.0), lambda t, g: t + g * g)
    near = both.where(gaps <= (eps + 1e-9) ** 2).select(F.least("block", "block_b").alias("a"), F.greatest("block", "block_b").alias("b")).distinct()
    held = ["size", "reps", "counts", "places", "vectors"]
    pairs = near.repartition(max(partitions(spark), 1), "a", "b")
    for side in "ab":
        pairs = pairs.join(block.select(F.col("block").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in held)), side)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size, same = r["size_a"], r["a"] == r["b"]
                x, y = (np.array(r[f"vectors_{s}"]).reshape(-1, size) for s in "ab")
                px, py = (np.array(r[f"places_{s}"]).reshape(-1, GRID_DIMS) for s in "ab")
                i, j = join_sequences(x, px, y, py, least, same)
                ids = np.concatenate([r["reps_a"], r["reps_b"]]).astype(np.int64)
                counts = np.concatenate([r["counts_a"], r["counts_b"]]).astype(np.float64)
                j = j + len(x)
                links = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
                root = union(len(ids), i, j)
                own = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]]), pa.array(links[own].astype(np.int64))], ["a", "b", "links"])

    found = staged(pairs.mapInArrow(link, "a long, b long, links long"), "vector-links")
    totals = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts_of = components(found.select("a", "b")).withColumnRenamed("id", "rep")
    by_class = classes.select("label", "embedding", "rep", "n").join(totals, "rep", "left").join(parts_of, "rep", "left")
    by_class = by_class.select(F.col("label").alias("l"), F.xxhash64("label", "embedding").alias("class"), F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component"))
    out = named.join(by_class, (named["class"] == by_class["class"]) & (named["label"] == by_class["l"]) & (named["embedding"] == by_class["e"])).select(F.col("vec_id").alias("id"), "n_links", "component")
    per_id = out.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    done = rows.select("vec_id").join(per_id, F.col("vec_id") == F.col("id"), "left")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))


def op8_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
