"""LM scoring: a causal self-attention model over the subword ids of words, trained on the whole training fold.

A text is its words (A-Z lower-cased) and one end. Every word is spelled in ids of the byte-level tokenizer, once: the ids of all
texts are written down, and counting, training and scoring read them. A token enters the model as the sum of its ids' vectors. Long texts are cut into
windows of tokens that overlap by their context, and each token is scored once, in batches under a causal mask. The (at most) TOP most frequent tokens that occur
LEAST times or more are predicted whole, all others as rare words (see lm_model). A rare word is one met before, by its count c among the R rare tokens of
the training fold, or a new one, by its spelling: p(rare | context) * (seen * c / R + (1 - seen) * p(spelling | context)), where 1 - seen is the share of words met
once among the R (the Good-Turing estimate of new ones). A floor of SHARE * c / N, N being all tokens of the training fold, is mixed in.

All training texts are counted and learned from, each token once: texts are dealt to rounds by their id's hash; in a round each task trains
over its own texts from the same weights, and the next round starts from the mean of the tasks' weights and of their Adagrad sums, each counting by its
ids. Rounds grow with the logarithm of the corpus. The weights depend a little on how the input is cut into tasks. They (about 10 MB, a fixed number) travel
as changes, in blocks that are summed as streams, with more than SALTS tasks first by salt, then in all. The at most TOP most frequent words' counts (a fixed number) are broadcast; other words travel as
64-bit hashes of their ids to a join with the counts, so the table of counts is never held in one place and no hot word is shuffled.

Defined results: a null or empty text is the end alone; rows that repeat a doc_id are scored and counted each; a row without doc_id
is scored, not learned from, and has a null held_out; without training rows every word is spelled by the untrained model.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lm_model
from tidemark.llm.common import id_text, partitions, pieces, read, slices, staged
from tidemark.llm.quality import fold
from tidemark.llm.tokens import cuts, laid_out, together, tokenizer_path
from tidemark.llm.words import Kept, mix

SHARE, ROUNDS, TOP, LEAST = 0.02, 3, 1 << 19, 3
#: Bytes of ids that a training task of a round has at most, and those under which a corpus is not split over idle cores; ids trained on, counted or scored together.
TASK_BYTES, LEAST_BYTES, TRAINED, COUNTED, SCORED = 32_000_000, 2_000_000, 400_000, 3_000_000, 200_000
#: Floats in a block of weights; salts by which blocks are summed first.
BLOCK, SALTS = 1 << 14, 16
KEPT_WORDS = 250_000


class _Pieces(Kept):
    """A space and a word, or a piece of it (bytes) -> its ids, as unsigned 32-bit little-endian bytes; a space alone has none."""

    def __init__(self, tokenizer, spaced: np.ndarray):
        """spaced: of each id, whether it begins with a space."""
        super().__init__(KEPT_WORDS)
        self.tokenizer, self.spaced = tokenizer, spaced

    def make(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode_ordinary(word.decode("utf-8", "replace")) if word != b" " else []
        return struct.pack(f"<{len(ids)}I", *ids)

    def all(self, words: list[bytes]) -> list[bytes]:
        """New pieces after a space are spelled in one call, end to end: if an id begins with each space, the tokenizer cuts there, as between single words."""
        out = list(map(self.get, words))
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, map(self.older.get, map(words.__getitem__, left))):
            out[i] = x
        new = [i for i in left if out[i] is None]
        joined = [i for i in new if words[i][:1] == b" " and len(words[i]) > 1]
        ids = self.tokenizer.encode_to_numpy(b"".join([words[i] for i in joined]).decode("utf-8", "replace")) if joined else np.zeros(0, np.uint32)
        at = np.flatnonzero(self.spaced[ids])
        if joined and len(at) == len(joined):
            every, at = ids.astype("<u4").tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            for i, a, b in zip(joined, at[:-1], at[1:]):
                out[i] = every[a:b]
        for i in new:
            if out[i] is None:
                out[i] = self.make(words[i])
        self.keep({words[i]: out[i] for i in left if len(words[i]) < 64})
        return out

    def forget(self) -> None:
        self.clear()
        self.older = {}


class _Ids:
    """word (bytes) -> ids of the word after a space, as unsigned 32-bit little-endian bytes. The last id, which no text gives, is the end."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.size = len(self.ranks) + 1
        self.pieces = _Pieces(self.tokenizer, np.array([t.startswith(b" ") for t in self.spellings()]))

    def __getitem__(self, word: bytes) -> bytes:
        return self.pieces[b" " + word]

    def spellings(self) -> list[bytes]:
        out = [b""] * self.size
        for token, i in self.ranks.items():
            out[i] = token
        return out

    def starts(self) -> np.ndarray:
        """Of each id, whether a word or the end begins with it: words are spelled after a space, and no other id of a word begins with one."""
        own = self.pieces.spaced.copy()
        own[self.size - 1] = True
        return own


_IDS: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _IDS:
        _IDS.clear()
        _IDS[path] = _Ids(path)
    return _IDS[path]


def spelling_order(path: str) -> np.ndarray:
    """The tokenizer's ids by spelling."""
    table = _ids(path)
    names = table.spellings()
    return np.array(sorted(range(table.size), key=names.__getitem__))


class Vocabulary:
    """What training and scoring know of the counts: the most frequent words by hash, their counts and cells; the cells of ids and the stop."""

    def __init__(self, words: np.ndarray, n: np.ndarray, rest: float, of_ids: np.ndarray, order: np.ndarray):
        """words: hashes (uint64), n: their counts; rest: training tokens that are not among them; of_ids: counts of the ids; order: of the ids."""
        by = np.argsort(words)
        self.words, self.n = words[by], n[by].astype(np.float64)
        self.table = np.full(1 << max(4, (2 * len(by)).bit_length()), -1, np.int32)
        slot, left = self._slot(self.words), np.arange(len(by))
        while len(left):
            free = left[self.table[slot[left]] < 0]
            self.table[slot[free]] = free
            left = left[self.table[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
        whole = self.n >= LEAST
        self.rare = spelled = float(rest + self.n[~whole].sum())
        self.cells = lm_model.Cells(self.n[whole], spelled)
        self.cls, self.cell, self.share = np.full(len(by) + 1, lm_model.SPELLED, np.uint8), np.zeros(len(by) + 1, np.uint8), np.zeros(len(by) + 1, np.float32)
        self.cls[:-1][whole], self.cell[:-1][whole], self.share[:-1][whole] = self.cells.cls, self.cells.cell, self.cells.share
        mass = np.append(of_ids[order] + 0.5, max(spelled, 1.0))
        sorted_ids, place = lm_model.Cells(mass), np.empty(len(mass), np.int64)
        place[np.append(order, len(order))] = np.arange(len(mass))
        for part in ("cls", "cell", "share"):
            setattr(sorted_ids, part, getattr(sorted_ids, part)[place])
        self.ids = sorted_ids

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the words; len(words) for others."""
        out, slot = np.full(len(hashes), len(self.words)), self._slot(hashes)
        found = self.table.take(slot)
        left = np.flatnonzero(found >= 0)
        while len(left):  # slots are tried one after the other up to an empty one
            same = self.words.take(found[left]) == hashes[left]
            out[left[same]] = found[left[same]]
            left = left[~same]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
            found[left] = self.table.take(slot[left])
            left = left[found[left] >= 0]
        return out

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)

    def tokens(self, flat: np.ndarray, first: np.ndarray, at: np.ndarray) -> lm_model.Tokens:
        return lm_model.Tokens(flat, first, self.cls[at], self.cell[at], self.share[at])

    def init(self, size: int) -> dict[str, np.ndarray]:
        return lm_model.init(self.cells, self.ids, size)


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


#: A-Z lower-cased, white space of the contract as a space.
_FOLDED = bytes.maketrans(b"\t\n\r\x0b\x0c", b" " * 5)


def _spelled(texts: list[bytes], table: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, each after a space, end to end; place of each text's first id, and the end). The pieces of words that `cuts` finds are spelled once."""
    data = np.frombuffer(b" ".join([b"", *texts]).lower().translate(_FOLDED), np.uint8)
    edges = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    return laid_out(data, np.flatnonzero(cuts(data)), edges, table.pieces.all)


def _speller(path: str):
    """A row number, doc_id, held_out and the ids (with an end before and after) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = _ids(path), TaskContext.get().partitionId() << 40
        kind = _width(table.size)
        end = np.array([table.size - 1], kind).tobytes()
        for part in slices(batches):
            texts, ids = part.column(2).cast(pa.large_binary()).to_pylist(), []
            for a, b in together(list(map(len, texts))):
                flat, at = _spelled(texts[a:b], table)
                every, at = flat.astype(kind).tobytes(), (at * int(kind[-1])).tolist()
                ids.extend(end + every[s:e] + end for s, e in zip(at[:-1], at[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(ids))), *part.columns[:2], pa.array(ids, pa.binary())], ["row", "doc_id", "held_out", "ids"])
            row += len(ids)

    return run


def _laid(ids: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of texts end to end, number of ids of each text)."""
    return np.frombuffer(b"".join(ids), kind).astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids)) // int(kind[-1])


def _words(flat: np.ndarray, n: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: place of the first id of every token, the ends before the texts included, the tokens' hashes (of their ids), and the
    number of tokens of each text. ranks: of the ids that begin a token, their place by spelling, -1 for others; it is a hash's first 16 bits, so that
    words in the order of their hashes lie by spelling."""
    first = np.flatnonzero(ranks[flat] >= 0)
    if not len(first):
        return first, np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    last = np.append(first[1:], len(flat))
    place = np.arange(len(flat)) - np.repeat(first, last - first)
    with np.errstate(over="ignore"):
        of_place = mix(np.arange(int((last - first).max()), dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
        of_id = mix(np.arange(len(ranks), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(78))
        each = of_id.take(flat)
        each *= of_place.take(place)
        upto = np.append(np.uint64(0), np.cumsum(each))  # sums are modulo 2^64, so differences are exact
        hashes = mix(upto[last] - upto[first])
    hashes = ranks[flat[first]].astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16)
    return first, hashes, np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum(n)])))


def ranks_of(path: str) -> np.ndarray:
    """For _words."""
    table = _ids(path)
    ranks = np.empty(table.size, np.int64)
    ranks[spelling_order(path)] = np.arange(table.size) * (1 << 16) // max(table.size, 1 << 16)
    return np.where(table.starts(), ranks, -1)


def _counter(path: str):
    """Counts of words (kind 0, by hash) and of ids (kind 1), summed inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _ids(path)
        table.pieces.forget()  # the memory goes to the vocabulary and the weights
        kind, ranks = _width(table.size), ranks_of(path)
        seen, held, size = np.zeros(table.size, np.int64), [], 0

        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        for part in slices(batches):
            flat, n = _laid(part.column(0).to_pylist(), kind)
            seen += np.bincount(flat, minlength=len(seen)) - np.bincount(flat[np.cumsum(n) - n], minlength=len(seen))
            _, hashes, each = _words(flat, n, ranks)
            held.append(np.delete(hashes, np.cumsum(each) - each))
            size += len(held[-1])
            if size >= COUNTED:
                yield out(0, *np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield out(0, *np.unique(np.concatenate(held), return_counts=True))
        at = np.flatnonzero(seen)
        yield out(1, at, seen[at])

    return run


def _flat(state: dict) -> np.ndarray:
    return np.concatenate([*(x.ravel() for x in state["m"].values()), *(x.ravel() for x in state["s"].values())]).astype("<f4")


def _shaped(flat: np.ndarray, state: dict) -> dict:
    """flat (of _flat) as weights and sums shaped like those of state."""
    own = [*state["m"].values(), *state["s"].values()]
    parts = [x.reshape(w.shape).copy() for w, x in zip(own, np.split(flat, np.cumsum([w.size for w in own])[:-1]))]
    return {"m": dict(zip(state["m"], parts)), "s": dict(zip(state["s"], parts[len(state["m"]) :]))}


def _learner(held, kind: str):
    """Trains the weights on the task's texts, all of them: blocks of the changes of weights and sums (mostly zeros where few ids occur, so that they travel
    small), and the number of ids trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, vocabulary, ranks = held.value
        state, total, texts, size, salt = lm_model.begin(before["m"], sums=before["s"], n=before["n"]), 0, [], 0, TaskContext.get().partitionId() % SALTS

        def learn() -> None:
            flat, n = _laid(texts, kind)
            first, hashes, each = _words(flat, n, ranks)
            lm_model.train(state, vocabulary.ids, vocabulary.tokens(flat, first, vocabulary.at(hashes)), each - 1)

        for part in slices(batches):
            for ids in part.column(0).to_pylist():
                texts.append(ids)
                size += len(ids) // int(kind[-1]) - 1
                if size >= TRAINED:
                    learn()
                    total, texts, size = total + size, [], 0
        if texts:
            learn()
            total += size
        if total:
            flat = _flat(state) - _flat(before)
            for block, a in enumerate(range(0, len(flat), BLOCK)):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "n": pa.array([total]), "w": pa.array([flat[a : a + BLOCK].tobytes()], pa.binary())})

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; the mean of each block's rows, which count by n, held one at a time."""
    now, salt, n, total = None, 0, 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "salt": pa.array([salt], pa.int32()), "n": pa.array([n]), "w": pa.array([(total / n).astype("<f4").tobytes()], pa.binary())})

    for batch in batches:
        for r in batch.to_pylist():
            own = np.frombuffer(r["w"], "<f4").astype(np.float64) * r["n"]
            if (r["block"], r["salt"]) == (now, salt):
                n, total = n + r["n"], total + own
                continue
            if now is not None:
                yield out()
            now, salt, n, total = r["block"], r["salt"], r["n"], own
    if now is not None:
        yield out()


def rounds_of(amount: int) -> int:
    """Rounds for that many bytes of training ids: ROUNDS, and one more for each doubling beyond what they hold in eight tasks."""
    return ROUNDS + max(0, math.ceil(math.log2(max(amount, 1) / (8 * ROUNDS * TASK_BYTES))))


def learned(spelled: DataFrame, vocabulary: Vocabulary, ranks: np.ndarray) -> dict[str, np.ndarray]:
    """The weights after all rounds over all spelled texts (doc_id, ids)."""
    spark, kinds, size = spelled.sparkSession, "block int, salt int, n long, w binary", len(ranks)
    state = lm_model.begin(vocabulary.init(size))
    amount = spelled.agg(F.sum(F.length("ids"))).first()[0] or 0
    rounds = rounds_of(amount)
    tasks = max(min(spark.sparkContext.defaultParallelism, pieces(amount // rounds, LEAST_BYTES)), pieces(amount // rounds, TASK_BYTES))
    for k in range(rounds):
        held = spark.sparkContext.broadcast((state, vocabulary, ranks))
        each = spelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("ids").coalesce(tasks).mapInArrow(_learner(held, _width(size)), kinds)
        some = each
        if tasks > SALTS:
            some = each.repartition(min(tasks, partitions(spark)), "block", "salt").sortWithinPartitions("block", "salt").mapInArrow(_mean, kinds)
        mean = some.withColumn("salt", F.lit(0)).repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(_mean, kinds)
        rows = sorted(staged(mean, "lm-model").select("block", "w", "n").collect())  # the weights: about 10 MB
        if rows:
            state = _shaped(_flat(state) + np.frombuffer(b"".join(bytes(r.w) for r in rows), "<f4"), state) | {"n": state["n"] + rows[0].n // tasks}
        held.unpersist()
    return state["m"]


def _frequent(of_n: pa.Table) -> tuple[int, int, int, int]:
    """Of the number of words of each count (at most about as many rows as the root of twice the tokens): tokens, distinct words, words met once, and the
    least count of the most frequent words, which are TOP at most; words of equal counts are all among them or none."""
    n, words = (of_n.column(k).to_numpy().astype(np.int64) for k in ("n", "words"))
    by = np.argsort(-n)
    n, words = n[by], words[by]
    fits = int(np.count_nonzero(np.cumsum(words) <= TOP))
    least = int(n[fits - 1]) if fits else int(n[0]) + 1 if len(n) else 1
    return int(n @ words), int(words.sum()), int(words[n == 1].sum()), least


def score_texts(docs: DataFrame, tokenizer: str, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    size = _ids(tokenizer).size
    kind = _width(size)
    rows = id_text(docs).select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    spelled = staged(rows.mapInArrow(_speller(tokenizer), "row long, doc_id long, held_out boolean, ids binary"), "lm-ids")
    training = spelled.where("NOT held_out")
    counts = staged(training.select("ids").mapInArrow(_counter(tokenizer), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where("kind = 0").select(F.col("key").alias("word"), "n")
    total, distinct, once, least = _frequent(words.groupBy("n").agg(F.count("*").alias("words")).toArrow())
    of_ids = np.zeros(size)
    for key, n in counts.where("kind = 1").select("key", "n").collect():  # at most as many rows as ids
        of_ids[key] = n
    top = words.where(F.col("n") >= least).toArrow()
    top, top_n = (top.column(k).to_numpy() for k in ("word", "n"))
    ranks = ranks_of(tokenizer)
    vocabulary = Vocabulary(top.view(np.uint64), top_n.astype(np.float64), float(total - top_n.sum()), of_ids, spelling_order(tokenizer))
    model = learned(training.select("doc_id", "ids"), vocabulary, ranks)
    held = spark.sparkContext.broadcast((model, vocabulary, ranks))
    seen = min(max(1 - once / vocabulary.rare, 0.05), 0.95) if vocabulary.rare else 0.0
    of_rare = max(vocabulary.rare, 1.0)
    base_of = math.log10(total + distinct + 1)
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, logs array<float>, spells array<float>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary, ranks = held.value
        of_word = np.append(vocabulary.n, 0.0)
        base_of_word = np.where(of_word == 0, 0.0, np.log10(of_word + 1) - base_of)

        def part(rows: pa.RecordBatch) -> pa.RecordBatch:
            flat, n = _laid(rows.column(3).to_pylist(), kind)
            first, hashes, each = _words(flat, n, ranks)
            at = vocabulary.at(hashes)
            each = each - 1  # without the end before the text
            tokens = vocabulary.tokens(flat, first, at)
            logs, spells = lm_model.score(model, vocabulary.ids, tokens, each)
            keep = np.ones(len(at), bool)
            keep[np.cumsum(each + 1) - each - 1] = False
            keep = np.flatnonzero(keep)
            at, hashes = at.take(keep), hashes.take(keep)
            c, base = of_word.take(at), base_of_word.take(at)
            rare, doc = c == 0, np.repeat(np.arange(len(n)), each)
            p, spelled = np.exp(logs.astype(float)), np.flatnonzero(tokens.cls.take(keep) == lm_model.SPELLED)
            p[spelled] *= seen * c[spelled] / of_rare + (1 - seen) * np.exp(spells[spelled].astype(float))
            mixed = np.where(rare, 0.0, np.log10(np.maximum(share * c / max(total, 1) + (1 - share) * p, 1e-300)))
            edges = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(n)))]).astype(np.int32)
            sums = [pa.array(each), pa.array(np.bincount(doc[~rare], minlength=len(n))), pa.array(np.bincount(doc, base, len(n))), pa.array(np.bincount(doc, mixed, len(n)))]
            return pa.RecordBatch.from_arrays([*rows.columns[:3], *sums, pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes[rare].view(np.int64))), *(pa.ListArray.from_arrays(pa.array(edges), pa.array(x[rare])) for x in (logs, spells))], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "logs", "spells"])

        for batch in batches:
            upto = np.cumsum(np.asarray(pc.binary_length(batch.column(3))), dtype=np.int64)
            a = 0
            while a < batch.num_rows:  # rows of about SCORED ids
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SCORED * int(kind[-1]))))
                yield part(batch.slice(a, b - a))
                a = b

    each = staged(spelled.select("row", "doc_id", "held_out", "ids").mapInArrow(scored, kinds), "lm-scores")
    rare = each.select("row", F.explode(F.arrays_zip("words", "logs", "spells")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.logs").cast("double").alias("log"), F.col("w.spells").cast("double").alias("spell"))
    c = F.coalesce("n", F.lit(0))
    mixed = F.log10(F.greatest(F.lit(share / max(total, 1)) * c + F.lit(1 - share) * F.exp("log") * (F.lit(seen / of_rare) * c + F.lit(1 - seen) * F.exp("spell")), F.lit(1e-300)))
    sums = rare.join(words.where(F.col("n") < least), "word", "left").groupBy("row").agg(F.sum((c > 0).cast("long")).alias("known_r"), F.sum(F.log10(c + 1) - F.lit(base_of)).alias("base_r"), F.sum(mixed).alias("score_r"))
    done = each.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(sums, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return done.select("doc_id", "held_out", "n_tokens", add("n_known", "known_r").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), add("base", "base_r").alias("base_score"), add("score", "score_r").alias("score"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
