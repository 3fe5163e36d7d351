"""Suffix-array dedup of long repeated byte strings: blockwise suffix sorting, one bucket at a time, with difference-cover ranks.

A suffix is dealt to the bucket of its anchor: the K-byte gram with the least hash (the leftmost of them) inside the LENGTH bytes that
begin there. Equal strings have equal anchors, so they always meet in one bucket, and a bucket whose anchor occurs once holds no repeat and is
never built. What is shuffled is not suffixes but contexts: the bytes around an occurrence of the anchor, which hold all suffixes it
serves; equal contexts are summed first, and a bucket of equal contexts alone needs no bytes at all.

A bucket's suffixes are sorted by their first PERIOD bytes. Ties are resolved by ranks, which bound the memory: the SAMPLE-byte
strings at the places of a difference cover (6 of 31) are ranked once, and two tied suffixes, wherever they stand, have an offset of less than
PERIOD at which both are covered; their ranks there, and the few bytes up to LENGTH, decide. The sort is a three-way
quicksort over all tied groups at once; what compares equal to a pivot is a repeat.

A bucket of more than HOT contexts is split by longer common prefixes: its contexts are cut into pieces of STEPS[0] neighbouring
suffixes, keyed by the bytes that all of these share, equal pieces are summed again, and the smaller buckets are sorted as the others; with
STEPS[1] = 1 suffix to a piece, a bucket holds equal suffixes only. So no bucket is ever gathered beyond HOT contexts.

Defined results: a null or empty text has no bytes; texts shorter than LENGTH bytes keep everything unless they lie in a repeat (they
cannot); rows that repeat a doc_id each count as a text of their own, and what repeats between them goes; a row without
doc_id is never compared and keeps its text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, partitions, read, runs, slices, staged
from tidemark.llm.words import mix

LENGTH, K = 200, 40
STARTS = LENGTH - K + 1  # starts whose string can hold a given anchor
#: A difference cover of 31: every residue is a difference of two of its members. SAMPLE bytes are ranked at each covered place.
PERIOD, COVER, SAMPLE = 31, (1, 5, 11, 24, 25, 27), 168
#: Contexts sorted at once; contexts of one bucket above which it is split, and the suffixes of a piece then; bytes hashed at once.
BATCH, HOT, STEPS, CHUNK = 1_000, 1_000, (16, 1), 1 << 19
#: Bits of a bitmap of anchors for each anchor in it, and their bounds (the largest has 64 MB; beyond, it passes more on to the exact joins).
SPARSE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 2**64))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, p, np.uint64)]), dtype=np.uint64) for p in (_P, inverse)]
    return _POWERS[0], _POWERS[1]


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the given valid starts (sorted) in data: per anchor its hash, its place, and the first and last start it serves."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    power, inverse = _powers(max(n, CHUNK + 2 * LENGTH))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
        grams = mix(mix((sums[K:] - sums[:-K]) * inverse[: n - K + 1]))
    index = np.uint64((1 << 22) - 1)
    packed = (grams & ~index) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(packed) // STARTS) + 1
    padded = np.full(blocks * STARTS, ~np.uint64(0), np.uint64)
    padded[: len(packed)] = packed
    table = padded.reshape(blocks, STARTS)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[starts], ahead[starts + STARTS - 1]) & index).astype(np.int64)
    cut = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    place = at[np.concatenate([[0], cut])]
    return grams[place], place, first, last


def _chunks(ids: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Texts side by side: (bytes, valid starts, [(row, offset in its text, place in the bytes)]); a long text comes in overlapping parts."""
    held, rows, starts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            part = text[a : a + CHUNK + LENGTH - 1]
            if len(part) < LENGTH or ids[row] is None:
                continue
            if size and size + len(part) > CHUNK:
                yield np.frombuffer(b"".join(held), np.uint8), np.concatenate(starts), rows
                held, rows, starts, size = [], [], [], 0
            held.append(part)
            rows.append((row, a, size))
            starts.append(np.arange(size, size + len(part) - LENGTH + 1))
            size += len(part)
    if size:
        yield np.frombuffer(b"".join(held), np.uint8), np.concatenate(starts), rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for data, starts, _ in _chunks(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            h, n = np.unique(anchors(data, starts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def _offsets() -> np.ndarray:
    """By two residues: an offset at which places of these residues are both covered."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
    return out


_OFFSETS = _offsets()


def _words(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number that compares as they do."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def _refine(group: np.ndarray, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and groups (numbers that ascend along the order) after sorting inside each group by key; groups of one are dropped."""
    by = np.argsort(key, kind="stable")
    by = by[np.argsort(group[by], kind="stable")]
    g, k, order = group[by], key[by], order[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    g = np.cumsum(new) - 1
    more = np.bincount(g)[g] > 1
    return g[more], order[more]


def sort_bucket(contexts: list[bytes], bucket: np.ndarray, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats among the suffixes of some buckets: bool, contexts x STARTS, by the distance from the start to the anchor.

    left, right: the largest and smallest such distance a context serves; its bytes run from anchor - left to anchor - right + LENGTH.
    """
    m, serves = len(contexts), left - right + 1
    text = np.frombuffer(b"".join(contexts), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(c) for c in contexts])]).astype(np.int64)
    of = np.repeat(np.arange(m), serves)  # context of each suffix
    step = np.arange(len(of)) - np.repeat(np.cumsum(serves) - serves, serves)
    place = edges[of] + step
    words = _words(text)
    out = np.zeros((m, STARTS), bool)

    # the first PERIOD bytes (and one more), eight at a time; suffixes alone in their group are unique
    order = np.arange(len(place))
    group, order = _refine(np.unique(bucket, return_inverse=True)[1][of], order, words[place])
    for k in (8, 16, 24):
        group, order = _refine(group, order, words[place[order] + k])
    if not len(order):
        out[of, left[of] - step] = counts[of] > 1
        return out

    # ranks of the covered places that tied suffixes can need
    near = np.zeros(len(text) + 1, np.int32)
    np.add.at(near, place[order], 1)
    np.add.at(near, np.minimum(place[order] + PERIOD, len(text)), -1)
    covered = np.flatnonzero((np.cumsum(near[:-1]) > 0) & np.isin(np.arange(len(text)) % PERIOD, COVER))
    covered = covered[covered + SAMPLE <= len(text)]
    rank = np.full(len(text), -1, np.int64)
    sample = np.lib.stride_tricks.sliding_window_view(text, SAMPLE)[covered]
    rank[covered] = np.unique(np.ascontiguousarray(sample).view(f"V{SAMPLE}").ravel(), return_inverse=True)[1]
    del sample

    # three-way quicksort of the tied groups by pivots
    equal = np.zeros(len(place), bool)
    weight = counts[of]
    while len(order):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(group)]]))
        own = place[order]
        pivot = np.repeat(own[starts + sizes // 2], sizes)
        d = _OFFSETS[pivot % PERIOD, own % PERIOD]
        side = np.sign(rank[own + d] - rank[pivot + d])
        for k in range(SAMPLE, LENGTH, 8):  # bytes before SAMPLE + d are equal where the ranks are
            tied = np.flatnonzero(side == 0)
            x, y = words[own[tied] + k], words[pivot[tied] + k]
            side[tied] = np.where(x > y, 1, np.where(x < y, -1, 0))
        same = np.flatnonzero(side == 0)
        total = np.zeros(len(starts), np.int64)
        at = np.repeat(np.arange(len(starts)), sizes)
        np.add.at(total, at[same], weight[order[same]])
        equal[order[same]] = total[at[same]] > 1
        rest = np.flatnonzero(side)
        group, order = _refine(at[rest], order[rest], side[rest])
    out[of, left[of] - step] = equal | (weight > 1)
    return out


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; contexts of whole buckets are sorted together, about BATCH at once."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        h, digest, left, right, n, context = zip(*held)
        repeats = sort_bucket(list(context), np.array(h), np.array(left), np.array(right), np.array(n))
        some = np.flatnonzero(repeats.any(1) & (np.array(n) == 1))
        mask = np.packbits(repeats[some], axis=1)
        return pa.RecordBatch.from_arrays([pa.array([h[i] for i in some], pa.int64()), pa.array([digest[i] for i in some], pa.binary()), pa.array([x.tobytes() for x in mask], pa.binary())], ["h", "digest", "mask"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if len(held) >= BATCH and row[0] != held[-1][0]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def _digest(context: bytes, left: int) -> bytes:
    return xxhash.xxh3_128_digest(context, seed=left)


def _cut(step: int):
    """Pieces of contexts: the suffixes at distances k * step to k * step + step - 1, keyed by the bucket and the bytes that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h_of", "digest_of", "h", "digest", "left", "right", "n", "context"]
        for batch in batches:
            rows: list[tuple] = []
            for h, digest, left, right, n, context in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for low in range(right // step * step, left + 1, step):
                    r, own_left = max(low, right), min(low + step - 1, left)
                    piece = context[left - own_left : left - r + LENGTH]
                    shared = context[left - low : left - low + LENGTH - step + 1]  # inside the context, as some start at low to low + step - 1 is
                    rows.append((h, digest, xxhash.xxh3_64_intdigest(shared, seed=(h ^ low) & (2**64 - 1)) - 2**63, _digest(piece, own_left), own_left, r, n, piece))
                if len(rows) >= 50_000:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    return run


_KINDS = {"h_of": pa.int64(), "digest_of": pa.binary(), "key": pa.int64(), "at": pa.int64(), "h": pa.int64(), "digest": pa.binary(), "left": pa.int32(), "right": pa.int32(), "n": pa.int64(), "context": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*rows))], names)


def _any(pdf: pd.Series) -> pd.Series:
    """The union of the masks of a context's pieces."""
    return pd.Series([np.bitwise_or.reduce(np.array([np.frombuffer(m, np.uint8) for m in masks]), axis=0).tobytes() for masks in pdf])


def _whole(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(left, right):
        bits = np.zeros(STARTS, bool)
        bits[b : a + 1] = True
        out.append(np.packbits(bits).tobytes())
    return pd.Series(out)


_SHAPE = ["h", "digest", "left", "right", "n", "context"]


def _verdict(contexts: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """(h, digest, mask) of the contexts that hold repeats; mask: bits by distance from the start to the anchor. contexts are staged."""
    spark = contexts.sparkSession
    whole, union = F.pandas_udf(_whole, "binary"), F.pandas_udf(_any, "binary")
    buckets = contexts.groupBy("h").agg(F.count("*").alias("m"))
    cool = contexts.join(buckets.where(f"m > 1 AND m <= {HOT}").select("h"), "h").select(*_SHAPE)
    sorted_ = cool.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_sort, "h long, digest binary, mask binary")
    out = contexts.where("n > 1").select("h", "digest", whole("left", "right").alias("mask")).union(sorted_)
    hot = buckets.where(f"m > {HOT}").select("h")
    if not steps or hot.isEmpty():
        return out
    kinds = "h_of long, digest_of binary, h long, digest binary, left int, right int, n long, context binary"
    cut = staged(contexts.join(hot, "h").select(*_SHAPE).mapInArrow(_cut(steps[0]), kinds), "pieces")
    summed = cut.groupBy("h", "digest", "left", "right").agg(F.sum("n").alias("n"), F.any_value("context").alias("context"))
    inner = _verdict(staged(summed, "contexts"), steps[1:])
    back = cut.select("h_of", "digest_of", "h", "digest").join(inner, ["h", "digest"]).groupBy("h_of", "digest_of").agg(F.collect_list("mask").alias("masks"))
    back = back.join(contexts.where("n = 1").select(F.col("h").alias("h_of"), F.col("digest").alias("digest_of")), ["h_of", "digest_of"], "left_semi")
    return out.union(back.select("h_of", "digest_of", union("masks")))


def _bitmap(anchored: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap as bytes) of the column h; its size follows the number of rows up to MOST_BITS."""
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (SPARSE * anchored.count()).bit_length()))
    at = anchored.select(F.pmod("h", F.lit(bits)).alias("at"))

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one part of the bitmap (2^15 bits) after the other."""
        now, held = None, np.zeros(1 << 15, bool)
        for pdf in batches:
            for part, own in pdf.groupby("part"):
                if part != now and now is not None:
                    yield pd.DataFrame({"part": [now], "bits": [np.packbits(held, bitorder="little").tobytes()]})
                    held[:] = False
                now = part
                held[own["low"].to_numpy()] = True
        if now is not None:
            yield pd.DataFrame({"part": [now], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    rows = at.selectExpr("cast(at div 32768 as int) part", "cast(at % 32768 as int) low")
    rows = rows.repartition(partitions(anchored.sparkSession), "part").sortWithinPartitions("part").mapInPandas(cell, "part int, bits binary")
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # at most bits / 2^15 rows of 4 KB
        table[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    return bits, table


def _occurrences(held, context: bool):
    """The anchors in the bitmap: where they stand (with a key of their text), or the bytes around them, equal ones of a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _SHAPE if context else ["key", "at", "h", "left", "right", "digest"]
        bits, packed = held.value
        for batch in slices(batches):
            texts, keys = batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()
            for data, starts, rows in _chunks(batch.column(0).to_pylist(), texts):
                h, place, first, last = anchors(data, starts)
                b = h % np.uint64(bits)
                own = np.flatnonzero(packed[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1)
                raw = data.tobytes()
                edges = np.array([r[2] for r in rows])
                for x in range(0, len(own), 20_000):
                    o = own[x : x + 20_000]
                    around = [raw[i : j + LENGTH] for i, j in zip(first[o].tolist(), last[o].tolist())]
                    left, right, of = (place[o] - first[o]).tolist(), (place[o] - last[o]).tolist(), h[o].view(np.int64).tolist()
                    digest = [_digest(c, d) for c, d in zip(around, left)]
                    if context:
                        seen: dict[tuple, list] = {}
                        for row in zip(of, digest, left, right, around):
                            seen.setdefault(row[:2], [*row[:4], 0, row[4]])[4] += 1
                        yield _batch([tuple(r) for r in seen.values()], names)
                    else:
                        which = np.searchsorted(edges, first[o], "right") - 1
                        at = [rows[w][1] + p - rows[w][2] for w, p in zip(which.tolist(), place[o].tolist())]
                        yield _batch(list(zip((keys[rows[w][0]] for w in which.tolist()), at, of, left, right, digest)), names)

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans array<struct<a long, b long>>): the runs of starts (a..b, inclusive) of repeated strings in each text."""
    sc = docs.sparkSession.sparkContext
    counts = docs.select("doc_id", "text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    again = sc.broadcast(_bitmap(staged(counts, "anchors")))
    places = staged(docs.select("doc_id", "text", "key").mapInArrow(_occurrences(again, False), "key long, at long, h long, left int, right int, digest binary"), "places")
    kinds = staged(places.groupBy("h", "digest", "left", "right").agg(F.count("*").alias("n")), "kinds")
    buckets = kinds.groupBy("h").agg(F.count("*").alias("m"))
    mixed = staged(buckets.where("m > 1").select("h"), "mixed")
    around = docs.select("doc_id", "text", "key").mapInArrow(_occurrences(sc.broadcast(_bitmap(mixed)), True), "h long, digest binary, left int, right int, n long, context binary")
    contexts = around.join(mixed, "h", "left_semi").groupBy("h", "digest", "left", "right").agg(F.sum("n").alias("n"), F.any_value("context").alias("context"))
    whole = F.pandas_udf(_whole, "binary")
    plain = kinds.where("n > 1").join(mixed, "h", "left_anti").select("h", "digest", whole("left", "right").alias("mask"))
    verdict = plain.union(_verdict(staged(contexts, "contexts"), STEPS))
    judged = places.join(verdict, ["h", "digest"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, a, b = [], [], []
            for key, at, left, right, mask in zip(*(batch.column(i).to_pylist() for i in range(5))):
                bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=STARTS)
                rs = np.flatnonzero(bits)
                for i, j in runs(rs - np.arange(len(rs))):
                    keys.append(key), a.append(at - int(rs[j - 1])), b.append(at - int(rs[i]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, a, b)], ["key", "a", "b"])

    found = judged.select("key", "at", "left", "right", "mask").mapInArrow(spans, "key long, a long, b long")
    return found.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans of every row of docs."""
    rows = id_text(docs)
    twice = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        keyed = rows.withColumn("key", F.col("doc_id"))
    else:  # a key for each row, fixed by writing it down
        keyed = staged(rows.withColumn("key", F.monotonically_increasing_id()), "rows")
    gone = repeated_spans(keyed).select(F.col("key").alias("gone_key"), "spans")

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans):
            data = text.encode()
            if own is None:
                out.append((data, len(data), 0, 0))
                continue
            pairs = np.array(sorted((s["a"], s["b"] + LENGTH) for s in own), np.int64)
            reach = np.maximum.accumulate(pairs[:, 1])
            new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
            a, b = pairs[new, 0], reach[np.concatenate([new[1:] - 1, [len(pairs) - 1]])]
            kept = b"".join(data[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)]))
            out.append((kept, len(data), len(data) - len(kept), len(a)))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    done = keyed.join(gone, F.col("key") == F.col("gone_key"), "left").select("doc_id", cut("text", "spans").alias("c"))
    return done.select("doc_id", "c.kept", "c.n_bytes", "c.n_removed", "c.n_spans")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
