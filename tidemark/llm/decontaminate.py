"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over word positions; the positions it does not select are ignored, so two passages
that differ only there still share the seed's hash. Of 13 words that agree in 11, whichever they are, one of the three masks finds a place
(tests/llm tries all); items shorter than 13 words have masks of their length that leave out every choice of blocks. All windows of the documents are hashed under all masks; a
bitmap over the benchmark's hashes passes few of them on, and an exact join of the distinct ones with the benchmark's distinct
hashes gives pairs of document and item. A document's text then meets its items once: the places of the hashes they share give the
offsets between them, and along each offset the words are compared position by position; the item counts as leaked where WINDOW
consecutive words (the whole item if shorter) agree in at least 0.8 of the positions.

Defined results: null and empty texts, and items without words, match nothing; rows without doc_id or item_id are left out;
rows that repeat a doc_id or an item_id count as one if they are the same, else all of them count; empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, partitions, read, slices, staged
from tidemark.llm.words import mix, odd_numbers, word_hashes

#: The masks; 1 selects a position.
MASKS = ("11101111", "1111010011", "100100110111")
WINDOW, SHARE = 13, 0.8
#: Bits of the bitmap for each hash of the benchmark, and their bounds (the largest bitmap has 32 MB; beyond, it only passes more on to the join).
SPARSE, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Copies of the benchmark's hashes and items, so that a hot one is joined in several tasks; items that one copy of a document's text meets.
SALTS, FANOUT = 16, 256


def _seeds(words: np.ndarray, masks: list[tuple[int, tuple[int, ...]]]) -> Iterator[tuple[int, np.ndarray]]:
    """(mask number, hash of each window under it)."""
    factors = odd_numbers(64, 41)
    with np.errstate(over="ignore"):
        for number, at in masks:
            n = len(words) - at[-1]
            if n > 0:
                total = np.full(n, number, np.uint64)
                for k, i in enumerate(at):
                    total += words[i : i + n] * factors[k]
                yield number, mix(total)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for items of n < WINDOW words, of which m may differ: n in m + 2 blocks, without any m of them."""
    m = int(n * (1 - SHARE) + 1e-9)
    blocks = np.array_split(np.arange(n), m + 2) if m else [np.arange(n)]
    return [tuple(np.concatenate(own).tolist()) for own in itertools.combinations(blocks, len(blocks) - m)]


def _masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """The spaced masks, then those of each length of a short item (numbered from 100 times the length)."""
    spaced = [(i, tuple(j for j, c in enumerate(m) if c == "1")) for i, m in enumerate(MASKS)]
    return spaced + [(100 * n + k, at) for n in short for k, at in enumerate(short_masks(n))]


def _own_masks(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The masks of an item of n words."""
    return _masks([n] if 0 < n < WINDOW else [])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, seeds = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            words = word_hashes(text)
            for _, hashes in _seeds(words, _own_masks(len(words))):
                items += [item] * len(hashes)
                seeds.append(hashes.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(np.concatenate(seeds) if seeds else np.zeros(0, np.int64))], ["item_id", "seed"])


def _shifts(item: np.ndarray, words: np.ndarray, placed: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Every offset (place in the document minus place in the item) at which they share a seed; placed keeps the document's hashes, sorted, by mask."""
    found = np.zeros(len(item) + len(words) + 1, bool)
    for number, at in _own_masks(len(item)):
        if number not in placed:
            own = next((h for _, h in _seeds(words, [(number, at)])), np.zeros(0, np.uint64))
            order = np.argsort(own, kind="stable")
            placed[number] = own[order], order
        hashes, order = placed[number]
        for _, own in _seeds(item, [(number, at)]):
            lo, hi = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            for place in np.flatnonzero(hi > lo):
                found[order[lo[place] : hi[place]] - place + len(item)] = True
    return np.flatnonzero(found) - len(item)


def best_passage(item: np.ndarray, words: np.ndarray, placed: dict, window: int, share: float) -> tuple[int, int, int] | None:
    """(words that agree, words compared, first word in the document) of the best window, the earliest of equals, if it reaches the share."""
    best, size = None, min(window, len(item))
    for shift in _shifts(item, words, placed).tolist():
        lo, hi = max(0, -shift), min(len(item), len(words) - shift)
        if hi - lo < size:
            continue
        same = np.concatenate([[0], np.cumsum(item[lo:hi] == words[lo + shift : hi + shift])])
        inside = same[size:] - same[:-size]
        at = int(inside.argmax())
        if inside[at] >= share * size - 1e-9:
            found = (int(inside[at]), size, at + lo + shift)
            best = found if best is None or (-found[0], found[2]) < (-best[0], best[2]) else best
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_compared, doc_word): the best aligned passage of each leaked item in each document."""
    spark = docs.sparkSession
    bench = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    bench = bench.withColumn("item_key", F.xxhash64("text"))
    seeds = staged(bench.select("item_id", "text").mapInArrow(_item_seeds, "item_id long, seed long").distinct(), "item-seeds")
    lengths = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    short = sorted(r.n for r in bench.select(lengths.alias("n")).distinct().where(f"n > 0 AND n < {WINDOW}").collect())  # fewer than WINDOW rows
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (SPARSE * seeds.count()).bit_length()))
    cells = seeds.select(F.pmod("seed", F.lit(bits)).alias("at")).selectExpr("cast(at div 64 as int) cell", "shiftleft(1L, cast(at % 64 as int)) bit")
    cells = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.int64)
    table[cells["cell"].to_numpy(int)] = cells["bits"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(table.view(np.uint8))  # bits / 8 bytes

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, masks = held.value, _masks(short)
        for batch in slices(batches):
            ids, keys, n, found = batch.column(0), batch.column(1), [], []
            for text in batch.column(2).cast(pa.large_binary()).to_pylist():
                own = []
                for _, hashes in _seeds(word_hashes(text), masks):
                    at = hashes % np.uint64(bits)
                    own.append(hashes[(packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)])
                found.append(np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64))
                n.append(len(found[-1]))
            row = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([ids.take(row), keys.take(row), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["doc_id", "text_key", "seed"])

    texts = id_text(docs).where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    found = texts.mapInArrow(hits, "doc_id long, text_key long, seed long").select("*", salt)
    pairs = staged(found.join(seeds.select("*", salts), ["seed", "salt"]).select("doc_id", "text_key", "item_id").distinct(), "leak-pairs")
    fans = pairs.groupBy("doc_id", "text_key").agg(F.ceil(F.count("*") / FANOUT).cast("int").alias("fans"))
    own = texts.join(fans, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    own = own.select("doc_id", "text_key", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("item_id"), "text")
    items = pairs.select("*", salt).join(bench.select("item_id", "item_key", "text", salts), ["item_id", "salt"]).join(fans, ["doc_id", "text_key"])
    items = items.select("doc_id", "text_key", F.pmod(F.xxhash64("item_id", "item_key"), "fans").cast("int").alias("fan"), F.lit(1).alias("kind"), "item_id", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by document and fan, the document's own text first."""
        last, words, placed = None, np.zeros(0, np.uint64), {}
        for batch in batches:
            out = []
            for doc, key, fan, kind, item, text in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5).cast(pa.large_binary()).to_pylist()):
                if not kind:
                    last, words, placed = (doc, key, fan), word_hashes(text), {}
                elif last == (doc, key, fan) and (best := best_passage(word_hashes(text), words, placed, window, share)):
                    out.append((doc, item, *best))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_matched", "n_compared", "doc_word"])

    ordered = own.union(items).repartition(partitions(spark), "doc_id", "text_key", "fan").sortWithinPartitions("doc_id", "text_key", "fan", "kind")
    sure = ordered.mapInArrow(check, "doc_id long, item_id long, n_matched long, n_compared long, doc_word long")
    best = F.min_by(F.struct("n_matched", "n_compared", "doc_word"), F.struct(-F.col("n_matched"), "doc_word"))
    return sure.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_matched", "b.n_compared", "b.doc_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark passage; rows without doc_id stay."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so that none of docs' own clashes
    left = rows.join(gone, F.col("row.doc_id").cast("long") == F.col("leaked_id"), "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
