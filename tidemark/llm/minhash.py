"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles. Documents of equal sets are one class, whose key comes from the set's digest, so
two texts under one doc_id are compared each on its own set. A class has HASHES MinHash
samples: the first BANDS * ROWS form the bands, and all are folded into an odd sketch, a bitmap in which every sample flips one bit, so the
XOR of two sketches counts the samples that differ. Classes that share a band are candidates; a pair whose sketches or sizes put
its similarity surely below the bound is dropped, the others are confirmed on their full sets.

Only components are wanted, so links are found in two passes. The first confirms each class against its likeliest partner alone.
The second takes the buckets that still hold several components: a task compares the classes of two blocks of a bucket, the
likeliest pairs first, skips pairs whose components it has joined already, and returns only the links that joined two
components. So both passes make rows in proportion to the classes of a bucket (of a block pair, for buckets above BLOCK), a bucket of
any size is dealt to many tasks, and no pair is skipped unless its link cannot change the result.

Defined results: texts without words (null, empty, blank) have an empty set and link with nothing; fewer words than the
shingle's are one shingle; rows that repeat a doc_id share one result (the union of their links); a row without doc_id comes back unlinked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, id_text, partitions, read, runs, slices, staged
from tidemark.llm.words import mix, odd_numbers, word_hashes

#: Bands of ROWS samples: a pair of similarity 0.8 shares none with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS, HASHES, BITS = 32, 5, 320, 1024
#: How far below the bound an estimate may lie for a pair that reaches it: five deviations of 0.026.
SLACK = 0.13
#: Classes in a block of a bucket; candidates that are compared with one copy of their partner's text.
BLOCK, FANOUT = 512, 256


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(words, len(h))
    factors = odd_numbers(64, 17 + size)
    with np.errstate(over="ignore"):
        total = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            total += h[k : k + len(total)] * factors[k % 64]
            if k >= 64:
                total = mix(total)
    return np.unique(mix(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES MinHash samples (uint64) of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((HASHES, len(sets)), np.uint64)
    flips, factors, held = odd_numbers(HASHES, 5), odd_numbers(HASHES, 6), np.empty_like(flat)
    for k in range(HASHES):
        np.bitwise_xor(flat, flips[k], out=held)
        np.multiply(held, factors[k], out=held)
        out[k] = np.minimum.reduceat(held, starts)
    return out.T


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x BITS / 8 bytes): each sample flips one bit."""
    with np.errstate(over="ignore"):
        at = (mix(samples + np.arange(HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)).astype(np.int64)
    flat = np.bincount((at + np.arange(len(at))[:, None] * BITS).ravel(), minlength=len(at) * BITS)
    return np.packbits((flat & 1).astype(bool).reshape(len(at), BITS), axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    share = np.minimum(2 * differing / BITS, 0.999)
    return 1 + BITS / (4 * HASHES) * np.log(1 - share)


def _profiles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, keys = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2)
            at = 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and (to == at or size < 4_000_000):  # bytes of text in a piece
                    size, to = size + len(texts[to]), to + 1
                sets = [shingles(t, words) for t in texts[at:to]]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, sketch = [None] * len(sets), [None] * len(sets)
                if full:
                    samples = signatures([sets[i] for i in full])
                    held = np.zeros((len(full), BANDS), np.uint64)
                    with np.errstate(over="ignore"):
                        for r in range(ROWS):
                            held = mix(held * np.uint64(31) + samples[:, r : BANDS * ROWS : ROWS])
                    odd = odd_sketches(samples)
                    for j, i in enumerate(full):
                        bands[i], sketch[i] = held[j].view(np.int64), odd[j].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:to], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), keys.slice(at, to - at), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "text_key", "digest", "bands", "sketch"])
                at = to

    return run


def _similar(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], least: float) -> np.ndarray:
    """Estimates (a x b) of the pairs of different components that may reach the bound, -9 for the others; a, b: component, size, sketch."""
    est = estimate(np.bitwise_count(a[2][:, None] ^ b[2][None]).sum(2, dtype=np.int32))
    low, high = np.minimum(a[1][:, None], b[1][None]), np.maximum(a[1][:, None], b[1][None])
    return np.where((est >= least - SLACK) & (a[0][:, None] != b[0][None]) & (low >= (least - 1e-9) * high), est, -9.0)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block of a pair; both are all rows where a block meets itself (side 2)."""
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray], list[bytes]]]:
    """(bucket, i, j), [side, rep, component, size, sketch] and texts, if there are any, of each block pair; rows come sorted by block pair."""
    held: list[tuple] = []
    last = None

    def whole():
        return last, [np.concatenate(x) for x in zip(*(h[:5] for h in held))], [t for h in held for t in h[5]]

    for batch in batches:
        key, i, j, side, rep, part, size = (np.asarray(batch.column(k)) for k in range(7))
        sketch = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        for x, y in runs(key, i, j):
            now = (key[x], i[x], j[x])
            if now != last and held:
                yield whole()
                held = []
            last = now
            texts = batch.column(8).slice(x, y - x).cast(pa.large_binary()).to_pylist() if batch.num_columns > 8 else []
            held.append((side[x:y], rep[x:y], part[x:y], size[x:y], sketch[x:y], texts))
    if held:
        yield whole()


def _best(least: float):
    """Each class's likeliest partner in each block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, rep, part, size, sketch), _ in _blocks(batches):
            a, b = _sides(side)
            for own, others in ((a, b), (b, a))[: 1 if len(a) == len(side) else 2]:
                for x in range(0, len(own) if len(others) else 0, 128):
                    o = own[x : x + 128]
                    est = _similar((part[o], size[o], sketch[o]), (part[others], size[others], sketch[others]), least)
                    at = est.argmax(1)
                    top = est[np.arange(len(o)), at]
                    ok = top > 0
                    yield pa.RecordBatch.from_arrays([pa.array(rep[o[ok]]), pa.array(rep[others[at[ok]]]), pa.array(top[ok])], ["rep", "hub", "est"])

    return run


def _live(least: float):
    """The rows of each block pair that have a candidate in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), (side, rep, part, size, sketch), _ in _blocks(batches):
            a, b = _sides(side)
            live = np.zeros(len(side), bool)
            for x in range(0, len(a), 128):
                o = a[x : x + 128]
                ok = _similar((part[o], size[o], sketch[o]), (part[b], size[b], sketch[b]), least) > 0
                live[o] |= ok.any(1)
                live[b] |= ok.any(0)
            n = int(live.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket)), pa.array(np.full(n, i)), pa.array(np.full(n, j)), pa.array(side[live]), pa.array(rep[live]), pa.array(part[live]), pa.array(size[live]), pa.array([s.tobytes() for s in sketch[live]], pa.binary())], ["bucket", "i", "j", "side", "rep", "part", "size", "sketch"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * shared >= percent * united, of two sorted sets."""
    if len(y) < len(x):
        x, y = y, x
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _join_blocks(words: int, percent: int):
    """Links between components, from the full sets of the rows of a block pair: those that join two components not joined in it yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, _, part, size, sketch), texts in _blocks(batches):
            a, b = _sides(side)
            x, y, est = [], [], []
            for k in range(0, len(a), 128):
                o = a[k : k + 128]
                found = _similar((part[o], size[o], sketch[o]), (part[b], size[b], sketch[b]), percent / 100)
                u, v = np.nonzero(found > 0)
                x.append(o[u]), y.append(b[v]), est.append(found[u, v])
            names, of = np.unique(part, return_inverse=True)
            root = np.arange(len(names))
            sets: dict[int, np.ndarray] = {}
            joined = []
            if x:
                x, y, est = np.concatenate(x), np.concatenate(y), np.concatenate(est)
                for k in np.argsort(-est, kind="stable"):
                    p, q = root[of[x[k]]], root[of[y[k]]]
                    if p == q:
                        continue
                    for r in (x[k], y[k]):
                        if r not in sets:
                            sets[r] = shingles(texts[r], words)
                    if _linked(sets[x[k]], sets[y[k]], percent):
                        root[root == max(p, q)] = min(p, q)
                        joined.append((names[p], names[q]))
            pairs = np.array(joined, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _confirm(words: int, percent: int):
    """Rows sorted by hub and salt, the hub's own text first: the candidates that are linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, kind, rep, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4).cast(pa.large_binary()).to_pylist()):
                if not kind:
                    last, own = (hub, salt), shingles(text, words)
                elif last == (hub, salt) and _linked(shingles(text, words), own, percent):
                    a.append(rep), b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _dealt(inside: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes of the buckets that hold several components, dealt to the block pairs of their bucket and sorted by them."""
    own = inside.join(parts, "rep")
    open_ = own.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = own.join(open_, "bucket", "left_semi").join(classes.select("rep", "size", "sketch"), "rep").withColumn("g", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    dealt = own.select("bucket", "g", "rep", "part", "size", "sketch", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("h"))
    side = F.when(F.col("g") == F.col("h"), 2).when(F.col("g") < F.col("h"), 0).otherwise(1)
    rows = dealt.select("bucket", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), side.alias("side"), "rep", "part", "size", "sketch")
    return rows.repartition(partitions(inside.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (rep, part) after the links (a, b) between parts."""
    found = components(links)
    return staged(parts.join(found, F.col("part") == F.col("id"), "left").select("rep", F.coalesce("component_id", "part").alias("part")), "parts")


def near_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs' doc_id, n_shingles, component_id and kept, one row per row; linked means 100 * shared >= percent * united."""
    spark, least = docs.sparkSession, percent / 100
    texts = id_text(docs)
    profile = staged(texts.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(_profiles(words), "doc_id long, n_shingles long, text_key long, digest binary, bands array<long>, sketch binary"), "minhash")
    full = profile.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    members = full.select("doc_id", "digest").distinct()
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    one = full.groupBy("digest").agg(first, F.max("n_shingles").alias("size"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = staged(one.select(F.xxhash64("digest").alias("rep"), "digest", F.col("first.doc_id").alias("least"), F.col("first.text_key").alias("text_key"), "size", "bands", "sketch"), "near-classes")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("bucket"))
    who = F.bit_xor(F.xxhash64("rep")).alias("who"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("who_too")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), *who).where("n > 1")
    once = shared.groupBy("n", "who", "who_too").agg(F.min("bucket").alias("bucket")).select("n", "bucket")  # buckets of the same classes count once
    inside = staged(banded.join(once, "bucket").select("bucket", "n", "rep").distinct(), "buckets")
    parts = inside.select("rep", F.col("rep").alias("part")).distinct()
    wanted = classes.join(parts.select("rep"), "rep", "left_semi").select("rep", "least", "text_key")
    found = texts.join(wanted, (texts["doc_id"] == wanted["least"]) & (F.xxhash64("text") == wanted["text_key"]))
    own_text = staged(found.select("least", "text_key", "rep", "text").dropDuplicates(["least", "text_key", "rep"]).select("rep", "text"), "near-texts")
    n = partitions(spark)

    best = _dealt(inside, parts, classes).mapInArrow(_best(least), "rep long, hub long, est double").groupBy("rep").agg(F.max_by("hub", "est").alias("hub"))
    pairs = best.groupBy(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).agg(F.min("hub").alias("hub"))
    pairs = staged(pairs.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("rep")), "near-pairs")
    fans = pairs.groupBy("hub").agg(F.ceil(F.count("*") / FANOUT).cast("int").alias("fans"))
    sent = pairs.join(fans, "hub").select("hub", F.pmod(F.xxhash64("rep"), "fans").cast("int").alias("salt"), F.lit(1).alias("kind"), "rep")
    hubs = fans.select("hub", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("hub").alias("rep"))
    rows = sent.union(hubs).join(own_text, "rep").select("hub", "salt", "kind", "rep", "text")
    rows = rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    parts = _merged(parts, rows.mapInArrow(_confirm(words, percent), "a long, b long"))

    live = _dealt(inside, parts, classes).mapInArrow(_live(least), "bucket long, i int, j int, side int, rep long, part long, size long, sketch binary")
    rows = live.join(own_text, "rep").select("bucket", "i", "j", "side", "rep", "part", "size", "sketch", "text")
    rows = rows.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    parts = _merged(parts, rows.mapInArrow(_join_blocks(words, percent), "a long, b long"))

    reps = classes.select("rep", "digest", "least")
    tied = parts.join(reps, "rep")
    named = tied.join(tied.groupBy("part").agg(F.min("least").alias("b")), "part").select("rep", "b")
    final = members.join(reps.join(named, "rep", "left").select("digest", F.coalesce("b", "least").alias("b")), "digest").select(F.col("doc_id").alias("a"), "b")
    twice = members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():  # a doc_id with several texts ties their components
        linked = components(final)
        final = linked.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    final = final.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    done = profile.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def drop_near_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id."""
    gone = near_documents(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("near_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so that none of docs' own clashes
    left = rows.join(gone, F.col("row.doc_id").cast("long") == F.col("near_id"), "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(read(spark, sf_dir, "documents"), words=4, percent=80)
