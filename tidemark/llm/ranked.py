"""Ranked lexical search: an inverted index in shards of documents, with posting blocks of variable length and exact block-skipping search.

A shard is the inverted index of the documents that one task read, so no posting is ever shuffled and a word that every document holds is
no hot key. Inside a shard documents lie by length, so that neighbours score alike. A posting list is cut into blocks by dynamic programming: the
boundaries minimise the sum, over all postings, of the difference between the block's largest impact and the posting's own, plus a fixed cost for
each block. Each block keeps its largest impact.

A search takes the queries in blocks. The largest impacts of the blocks that span a document, times the terms' weights, bound its score;
between two block boundaries the bound is the same. A document whose bound is under the k-th best score so far is skipped, and so is every
block without a document left; the others are decoded and scored exactly. The k-th best score is carried from shard to shard of a task. The best
of all tasks are ranked at last.

Defined results: a row without doc_id is no document; rows that repeat a doc_id are documents of their own; null texts and those
without terms are not counted and never found; a query's repeated rows are one query with all their terms; a row without item_id is no query; queries
without terms, or an empty table, give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, read, slices, staged

#: Bytes of text and documents of a shard at most; longest block, and its cost in units of impact.
SHARD_BYTES, SHARD_DOCS, LONGEST, BLOCK_COST = 8 << 20, 1 << 16, 64, 4_000_000
#: Bytes of the terms of a block of queries, and blocks of queries that are broadcast at a time.
QUERY_BYTES, AT_ONCE = 1 << 20, 16
#: The range of a length's m, and the scale and saturation of an impact.
M_LEAST, M_SLOPE, SCALE, TF_SCALE, M_SCALE = 50, 50, 1_000_000_000, 1000, 20

#: UTF-8 bytes of a text to those of its terms: A-Z lower-cased, what parts terms as blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "shard long, n_docs long, n_terms long, doc_ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary, large_tfs binary"
BLOCKED = f"{INDEX}, m binary, blocks binary, ends binary, largest binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def invert(ids: list[int], texts: list[list[bytes]]) -> dict[str, object]:
    """The inverted index of documents given as lists of terms: arrays by name (see INDEX)."""
    numbers = _Numbers()
    tokens = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    lengths = np.array([len(t) for t in tokens], np.int64)
    order = np.argsort(lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys = np.concatenate(tokens) * SHARD_DOCS + np.repeat(place, lengths)
    keys, tfs = np.unique(keys, return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(numbers) + 1) * SHARD_DOCS).astype("<i4")
    return {
        "n_docs": len(order),
        "n_terms": int(lengths.sum()),
        "doc_ids": np.array(ids, "<i8")[order].tobytes(),
        "lengths": lengths[order].astype("<i8").tobytes(),
        "terms": b" ".join(numbers),
        "starts": starts.tobytes(),
        "docs": (keys % SHARD_DOCS).astype("<u2").tobytes(),
        "tfs": np.minimum(tfs, 255).astype(np.uint8).tobytes(),
        "large_tfs": tfs[tfs >= 255].astype("<i8").tobytes(),
    }


def _invert(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part, n = [c.split()[0] for c in INDEX.split(", ")], TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def shard() -> pa.RecordBatch:
            row = {"shard": part + n, **invert(ids, texts)}
            return pa.RecordBatch.from_pydict({c: [row[c]] for c in names})

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                ids.append(doc), texts.append(terms)
                size += len(text)
                if size >= shard_bytes or len(ids) >= SHARD_DOCS:
                    yield shard()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield shard()

    return run


def frequencies(row: dict) -> np.ndarray:
    tfs = np.frombuffer(row["tfs"], np.uint8).astype(np.int64)
    tfs[tfs == 255] = np.frombuffer(row["large_tfs"], "<i8")
    return tfs


def impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a posting's score that no weight enters."""
    return SCALE * tfs // (TF_SCALE * tfs + M_SCALE * m)


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, end to end."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def cut_blocks(g: np.ndarray, starts: np.ndarray, cost: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks: each list's first block, one more than lists; ends: each block's end) that minimise the sum of length * largest - impacts, plus cost, over blocks.

    Step j of the dynamic programming handles the j-th posting of all lists at once; a list's state is the best sum before each of its last
    `longest` postings and the largest impact since. (The impacts' own sum is the same for any cut and left out.)
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, left = starts[:-1][order].astype(np.int64), sizes[order]
    most = int(left[0]) if len(left) else 0
    back = np.ones(len(g), np.uint16)
    held = int(np.searchsorted(-left, -1))  # lists of one posting are one block
    best, top = np.full((held, longest), np.iinfo(np.int64).max // 4), np.zeros((held, longest), np.int64)
    total, age = np.zeros(held, np.int64), np.arange(longest)
    for j in range(most if held else 0):
        n = int(np.searchsorted(-left[:held], -j))  # lists with a j-th posting
        if not n:
            break
        slot, now = j % longest, g[first[:n] + j]
        best[:n, slot], top[:n, slot] = total[:n], 0
        width = min(j + 1, longest)
        np.maximum(top[:n, :width], now[:, None], out=top[:n, :width])
        length = (slot - age[:width]) % longest + 1
        sums = best[:n, :width] + length * top[:n, :width]
        pick = sums.argmin(axis=1)
        total[:n] = sums[np.arange(n), pick] + cost
        back[first[:n] + j] = length[pick]
    marks = np.zeros(len(g) + 1, bool)
    at, low = starts[1:].astype(np.int64), starts[:-1].astype(np.int64)
    while len(at):
        marks[at] = True
        at = at - back[at - 1]
        going = at > low
        at, low = at[going], low[going]
    ends = np.flatnonzero(marks)
    return np.concatenate([[0], np.searchsorted(ends, starts[1:], "right")]).astype("<i4"), ends.astype("<i4")


def _block(n_docs: int, n_terms: int, cost: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BLOCKED.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                m = 100 - M_LEAST + M_SLOPE * np.frombuffer(row["lengths"], "<i8") * n_docs // n_terms
                starts, docs = np.frombuffer(row["starts"], "<i4"), np.frombuffer(row["docs"], "<u2")
                g = impacts(frequencies(row), m[docs])
                blocks, ends = cut_blocks(g, starts, cost, LONGEST)
                largest = np.maximum.reduceat(g, np.concatenate([[0], ends[:-1]])).astype("<i4")
                row |= {"m": m.astype("<i8").tobytes(), "blocks": blocks.tobytes(), "ends": ends.tobytes(), "largest": largest.tobytes()}
                yield pa.RecordBatch.from_pydict({c: [row[c]] for c in names})

    return run


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, cost: int = BLOCK_COST) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder: one row for each shard, see BLOCKED."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    shards = staged(rows.mapInArrow(_invert(shard_bytes), INDEX), "postings")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return staged(shards.mapInArrow(_block(n_docs or 0, n_terms or 1, cost), BLOCKED), "index")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            own = set(terms_of(text))
            ids.extend([item] * len(own))
            terms.extend(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])


def _dictionary(row: dict) -> dict[bytes, int]:
    terms = row["terms"].split(b" ")
    return dict(zip(terms, range(len(terms))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each shard hold each term asked for."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            numbers, sizes = _dictionary(row), np.diff(np.frombuffer(row["starts"], "<i4"))
            held = [(t, n) for t in row["asked"] if (n := numbers.get(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.binary()), pa.array(sizes[[n for _, n in held]].astype(np.int64) if held else [], pa.int64())], ["term", "df"])


def _in_turns(index: DataFrame, blocks: DataFrame, run) -> DataFrame:
    """run over index times the blocks of queries (block long, ...), a bounded number of blocks broadcast at a time."""
    n = blocks.agg(F.max("block")).first()[0]
    parts = [run(index.crossJoin(F.broadcast(blocks.where(F.col("block").between(a, a + AT_ONCE - 1))))) for a in range(0, (n if n is not None else 0) + 1, AT_ONCE)]
    return reduce(DataFrame.union, parts)


class Shard:
    """A shard's arrays, decoded."""

    def __init__(self, row: dict):
        view = lambda c, t: np.frombuffer(row[c], t)
        self.doc_ids, self.m, self.docs = view("doc_ids", "<i8"), view("m", "<i8"), view("docs", "<u2")
        self.tfs, self.numbers = frequencies(row), _dictionary(row)
        self.blocks, self.ends, self.largest = view("blocks", "<i4").astype(np.int64), view("ends", "<i4").astype(np.int64), view("largest", "<i4").astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.first, self.last = self.docs[self.starts].astype(np.int64), self.docs[self.ends - 1].astype(np.int64)

    def search(self, terms: list[bytes], weights: list[int], k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """best (scores, doc_ids) of at most k, updated with this shard's documents."""
        held = [(n, w) for t, w in zip(terms, weights) if (n := self.numbers.get(t)) is not None]
        if not held:
            return best
        numbers, w = np.array(held, np.int64).T
        size, n_blocks = len(self.doc_ids), self.blocks[numbers + 1] - self.blocks[numbers]
        b = spans(self.blocks[numbers], self.blocks[numbers + 1])
        w = np.repeat(w, n_blocks)
        bound, first, last = self.largest[b] * w, self.first[b], self.last[b]
        # sums of integers below 2^53, so exact in doubles
        bounds = np.cumsum(np.bincount(first, bound, size + 1) - np.bincount(last + 1, bound, size + 1))[:size]

        def least() -> int:
            return max(1, int(best[0].min())) if len(best[0]) == k else 1

        seen = np.zeros(size, bool)
        while True:
            some = np.flatnonzero((bounds >= least()) & ~seen)
            if not len(some):
                return best
            if not seen.any() and len(some) > 2 * k:  # first those of the highest bounds, for a high k-th best score
                some = some[np.argpartition(-bounds[some], k)[:k]]
            seen[some] = True
            marked = np.zeros(size + 1, np.int64)
            marked[some + 1] = 1
            marked = np.cumsum(marked)
            hit = marked[last + 1] > marked[first]
            at = spans(self.starts[b[hit]], self.ends[b[hit]])
            docs = self.docs[at]
            parts = impacts(self.tfs[at], self.m[docs]) * np.repeat(w[hit], self.ends[b[hit]] - self.starts[b[hit]])
            scores = np.bincount(docs, parts, size)[some].astype(np.int64)
            good = scores >= least()
            scores, ids = np.concatenate([best[0], scores[good]]), np.concatenate([best[1], self.doc_ids[some[good]]])
            keep = np.lexsort((ids, -scores))[:k]
            best = scores[keep], ids[keep]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best k of all shards of the task, for each query."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        queries: dict[int, list] = {}
        shard, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                number, block = one.column("shard")[0].as_py(), one.column("block")[0].as_py()
                if number != at:
                    shard, at = Shard(one.drop_columns(["items"]).to_pylist()[0]), number
                if block not in queries:
                    queries[block] = [(q["item_id"], [t["term"] for t in q["terms"]], [t["w"] for t in q["terms"]]) for q in one.column("items")[0].as_py()]
                for item, terms, weights in queries[block]:
                    best[item] = shard.search(terms, weights, k, best.get(item, none))
        for item, (scores, ids) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], ["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each query (item_id, text); equal scores by doc_id."""
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    pairs = staged(asked.mapInArrow(_query_terms, "item_id long, term binary").distinct(), "query-terms")
    n_blocks = pieces(pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 1, QUERY_BYTES)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).alias("block")
    terms = pairs.groupBy("term").count().groupBy(block("term")).agg(F.collect_list("term").alias("asked"))
    df = _in_turns(index.select("terms", "starts"), staged(terms, "asked-terms"), lambda rows: rows.mapInArrow(_count, "term binary, df long")).groupBy("term").agg(F.sum("df").alias("df"))
    n_docs = index.agg(F.sum("n_docs")).first()[0] or 0
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = pairs.join(df.select("term", weight.alias("w")), "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    items = staged(weighted.groupBy(block("item_id")).agg(F.collect_list(F.struct("item_id", "terms")).alias("items")), "queries")
    found = _in_turns(index.drop("n_docs", "n_terms", "lengths"), items, lambda rows: rows.mapInArrow(_search(k), "item_id long, doc_id long, score long"))
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
