"""Line dedup: sharded minimal perfect hashes over the distinct line hashes, probed by the documents' lines.

Lines are never joined as text. Each document sends the 128-bit hashes of its long lines. The distinct hashes are dealt to
shards; a shard is a minimal perfect hash, built level by level (keys alone on a bit of a level's bitmap take that bit, the others go on to the
next level; a key's slot is the rank of its bit), over a compact array of 64-bit fingerprints and one of saturated document counts; the few keys
whose count reaches the bound also have the document that keeps the line. The documents' hashes stream past their shard's
arrays, and count and keeper decide. A shard that many lines probe is copied to as many salts as its probes need, so a line that holds a third of all
rows is probed by many tasks.

Defined results: a null or empty text is one empty line and loses nothing; a row without doc_id comes back
unchanged; rows that repeat a doc_id count as one document and are all treated alike; a line's copies inside the document
that keeps it all stay; an empty table gives an empty result; a column of docs named as one of the added ones gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, id_text, partitions, pieces, runs, slices, staged

#: Distinct lines in a shard (about 1 MB of arrays); probes that one copy of a shard takes; bits of a level for each key still there.
SHARD_KEYS, PROBES, SPARSE = 100_000, 400_000, 2
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None if the key is shorter than min_chars code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                found = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                keys.extend(found)
                ids.extend([doc] * len(found))
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "hi", "lo"])

    return run


def _mix(hi: np.ndarray, lo: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hi.astype(np.uint64) ^ (lo.astype(np.uint64) + np.uint64(seed) * _GOLD) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def build_mph(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level sizes, all levels' bits end to end) of a minimal perfect hash over distinct keys."""
    left, sizes, levels = np.arange(len(hi)), [], []
    while len(left):
        size = SPARSE * len(left) + 1
        at = (_mix(hi[left], lo[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size), levels.append(alone)
        left = left[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool)


def mph_slots(sizes: np.ndarray, bits: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The slot (0..n-1) of each key of the set, each used once; -1, or a slot whose fingerprint differs, for other keys."""
    ranks, out, left, base = np.cumsum(bits) - 1, np.full(len(hi), -1), np.arange(len(hi)), 0
    for level, size in enumerate(sizes.tolist()):
        at = base + (_mix(hi[left], lo[left], level) % np.uint64(size)).astype(np.int64)
        here = bits[at]
        out[left[here]] = ranks[at[here]]
        left, base = left[~here], base + size
    return out


def _shard(min_docs: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One shard's arrays in one cell: sizes, then levels, bits, fingerprints, keepers by rank among the frequent slots, counts."""
        hi, lo, n = pdf["hi"].to_numpy(), pdf["lo"].to_numpy(), len(pdf)
        sizes, bits = build_mph(hi, lo)
        slot = mph_slots(sizes, bits, hi, lo)
        prints, counts, keepers = np.zeros(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.int64)
        prints[slot], counts[slot], keepers[slot] = lo, np.minimum(pdf["n_docs"], 255), pdf["keeper"]
        keepers = keepers[counts >= min_docs]
        blob = np.array([len(sizes), len(bits), n, len(keepers)], np.int64).tobytes() + sizes.tobytes() + prints.tobytes() + keepers.tobytes() + counts.tobytes() + np.packbits(bits).tobytes()
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "arrays": [blob]})

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    levels, size, n, kept = np.frombuffer(blob, np.int64, 4)
    sizes, prints, keepers = np.split(np.frombuffer(blob, np.int64, levels + n + kept, 32), [levels, levels + n])
    at = 32 + 8 * (levels + n + kept)
    counts = np.frombuffer(blob, np.uint8, n, at)
    return sizes, np.unpackbits(np.frombuffer(blob, np.uint8, -1, at + n), count=size).view(bool), prints, counts, keepers


def _probe(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and salt with the arrays first; yields the (document, key) pairs to drop."""
        arrays, at = None, None
        for batch in batches:
            shard, salt, kind, hi, lo, doc = (np.asarray(batch.column(i).fill_null(0)) for i in range(6))
            drop = np.zeros(len(shard), bool)
            for a, b in runs(shard, salt, kind):
                if kind[a] == 0:
                    arrays, at = _unpack(batch.column(6)[b - 1].as_py()), (shard[a], salt[a])
                elif at == (shard[a], salt[a]):
                    sizes, bits, prints, counts, keepers = arrays
                    s = mph_slots(sizes, bits, hi[a:b], lo[a:b])
                    frequent = counts >= min_docs
                    often = np.flatnonzero((s >= 0) & frequent[s] & (prints[s] == lo[a:b]))
                    keeper = keepers[(np.cumsum(frequent) - 1)[s[often]]]
                    drop[a + often[keeper != doc[a:b][often]]] = True
            both = np.column_stack([hi[drop], lo[drop]]).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(doc[drop]), pa.array([r.tobytes() for r in both], pa.binary())], ["doc_id", "key"])

    return run


def lines_to_drop(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, keys array<binary>): for each document that loses lines, the hashes of the lines it loses; min_docs is at most 255, where counts end."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs lies between 1 and 255")
    keys = staged(id_text(docs).where("doc_id IS NOT NULL").mapInArrow(_keys(min_chars), "doc_id long, hi long, lo long"), "line-keys")
    distinct = staged(keys.groupBy("hi", "lo").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")), "distinct-lines")
    shards = pieces(distinct.count(), SHARD_KEYS)
    shard = F.pmod("hi", F.lit(shards)).cast("int").alias("shard")
    arrays = distinct.select(shard, "hi", "lo", "n_docs", "keeper").groupBy("shard").applyInPandas(_shard(min_docs), "shard int, arrays binary")
    copies = distinct.groupBy(shard).agg(F.ceil(F.sum("n_docs") / PROBES).cast("int").alias("salts"))  # one row for each shard
    arrays = staged(arrays.join(copies, "shard"), "line-arrays")
    placed = arrays.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("hi", "lo", "doc_id")), "arrays")
    probes = keys.select(shard, "hi", "lo", "doc_id").join(arrays.select("shard", "salts"), "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "hi", "lo", "doc_id", F.lit(None).cast("binary").alias("arrays"))
    dealt = placed.union(probes).repartition(partitions(docs.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return dealt.mapInArrow(_probe(min_docs), "doc_id long, key binary").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the repeated lines gone from text, plus _n_lines and _n_dropped (long)."""

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def drop(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, keys):
            if gone is None:
                out.append((None, text.count("\n") + 1, 0))
                continue
            gone = {bytes(k) for k in gone}
            lines = text.encode().split(b"\n")
            kept = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in gone]
            out.append((b"\n".join(kept).decode() if len(kept) < len(lines) else None, len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    gone = lines_to_drop(docs, min_chars, min_docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so that none of docs' own clashes
    joined = rows.join(gone, F.col("row.doc_id").cast("long") == gone["doc_id"], "left")
    done = joined.select("row", drop(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "keys").alias("done"))
    field = lambda c: F.coalesce("done.text", "row.text").alias(c) if c == "text" else F.col("row").getField(c).alias(c)
    kept = [field(c) for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return done.select(*kept, F.col("done.n_lines").alias("_n_lines"), F.col("done.n_dropped").alias("_n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import read

    docs = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
