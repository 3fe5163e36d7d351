"""Many texts against many needles: which needle stands anywhere in a text, or as a whole word of it.

Equality of hashes instead of a search for each needle: every run of bytes as long as some needle, and every word, has a rolling hash; runs whose bit is set in
a bitmap of the needles' hashes go on to a join with the needles, and what the join finds is compared as text. A text is read once for each length that needles
have, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import tokens_of
from tidemark.session import work_dir

#: Bits of the bitmap for each needle, and the bits of one row of it on its way to the driver.
SPARSE, ROW_BITS = 16, 32_768
#: Bytes of text hashed at once (a longer text is hashed as a whole).
SLICE = 1 << 20
_BASE, _WORD = 0x9E3779B97F4A7C15, np.uint64(0xD1B54A32D192ED03)
_POWERS: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True


def _powers(n: int) -> list[np.ndarray]:
    """The base's powers and those of its inverse modulo 2^64, n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, SLICE) - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def _sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][: len(data)], dtype=np.uint64)))


def _runs(sums: np.ndarray, at: np.ndarray, length, word: bool = False) -> np.ndarray:
    """Hashes of the runs of `length` bytes that begin at `at`; a word's is another than that of a needle of the same bytes."""
    h = (sums[at + length] - sums[at]) * _powers(len(sums))[1][at] + np.asarray(length, np.uint64) * np.uint64(_BASE)
    return _mixed(h ^ _WORD if word else h)


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of about SLICE bytes."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        yield row, at[row : end + 1] - at[row], held[at[row] : at[end]]
        row = end


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Needles (low, secret, kind, word) with their key and their length in bytes."""
    for batch in batches:
        keys, word = [np.zeros(0, np.uint64)], batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        lengths = [np.zeros(0, np.int64)]
        for first, at, data in _slices(batch.column(0)):
            own, sums = word[first : first + len(at) - 1], _sums(data)
            lengths.append(np.diff(at))
            keys.append(np.where(own, _runs(sums, at[:-1], np.diff(at), True), _runs(sums, at[:-1], np.diff(at))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(lengths))], ["low", "secret", "kind", "word", "key", "length"])


def _candidates(bitmap, lengths: list[int], words: bool):
    """Texts (field, value, low) with the keys of their runs and words that the bitmap holds."""

    def held(h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(len(bitmap.value) * 8 - 1)
        return (bitmap.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, at, data in _slices(batch.column(2)):
                sums, size = _sums(data), np.diff(at)
                row = np.repeat(np.arange(len(size)), size)
                starts, left = np.arange(len(data)), np.repeat(at[1:], size) - np.arange(len(data))
                for n in lengths:
                    fits = left >= n
                    starts, left = starts[fits], left[fits]
                    if not len(starts):
                        break
                    h = _runs(sums, starts, n)
                    hit = held(h)
                    rows.append(first + row[starts[hit]])
                    keys.append(h[hit])
                if words and len(data):
                    inner = _ALNUM[data]
                    edge = np.zeros(len(data) + 1, bool)
                    edge[at] = True  # words end with their text
                    begins = np.flatnonzero(inner & (edge[:-1] | ~np.concatenate(([False], inner[:-1]))))
                    ends = np.flatnonzero(inner & (edge[1:] | ~np.concatenate((inner[1:], [False])))) + 1
                    h = _runs(sums, begins, ends - begins, True)
                    hit = held(h)
                    rows.append(first + row[begins[hit]])
                    keys.append(h[hit])
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(keys).view(np.int64))], ["field", "value", "key"])

    return run


def _bitmap(keyed: DataFrame, most_bytes: int) -> np.ndarray:
    """The bits of all keys, as bytes; a power of two of them that follows the needles' number up to most_bytes (beyond, it passes more on to the join)."""
    bits = max(ROW_BITS, 1 << min((SPARSE * keyed.count()).bit_length(), (most_bytes * 8).bit_length() - 1))
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = keyed.select(at.alias("at")).groupBy(F.expr(f"at DIV {ROW_BITS}").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % ROW_BITS).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():  # at most bits / ROW_BITS rows of 4 KB
        table[r.part * (ROW_BITS // 8) : (r.part + 1) * (ROW_BITS // 8)] = np.frombuffer(r.bits, np.uint8)
    return table


def found(texts: DataFrame, needles: DataFrame, most_bytes: int) -> DataFrame:
    """(field, value, secret, kind), each once, for texts (field, value) and needles (low: the secret in lower case, none empty; secret, kind; word: only as a whole word), without regard to case."""
    spark, path = texts.sparkSession, work_dir(texts.sparkSession, "needles")
    kinds = "low string, secret string, kind string, word boolean, key long, length long"
    needles.select("low", "secret", "kind", "word").mapInArrow(_keys, kinds).write.parquet(path)
    keyed = spark.read.schema(kinds).parquet(path)
    lengths = sorted(r.length for r in keyed.where("NOT word").select("length").distinct().collect())
    run = _candidates(spark.sparkContext.broadcast(_bitmap(keyed, most_bytes)), lengths, not keyed.where("word").isEmpty())
    near = texts.select("field", "value", F.lower("value").alias("low")).mapInArrow(run, "field string, value string, key long").distinct()
    stands = F.when(F.col("word"), F.array_contains(tokens_of(F.col("value")), F.col("low"))).otherwise(F.contains(F.lower("value"), F.col("low")))
    return near.join(keyed, "key").where(stands).select("field", "value", "secret", "kind")
