"""op2's model: every training text shapes it, its spellings form a distribution, and attention helps on held-out text."""

from __future__ import annotations

import zlib

import numpy as np

from tidemark.llm import lm_model, lm_score
from tidemark.llm.common import read
from tidemark.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


def spelled_ids(text: str) -> list[int]:
    """An end, the ids of every word after a space, an end."""
    table = lm_score._ids(PATH)
    own = [i for w in text.lower().split() for i in table.tokenizer.encode_ordinary(" " + w)]
    return [table.size - 1, *own, table.size - 1]


def vocabulary_of(ids: list[np.ndarray]):
    """The vocabulary of texts as ids with an end before and after."""
    flat, n = np.concatenate(ids), np.array([len(x) for x in ids])
    _, hashes, each = lm_score._words(flat, n, lm_score.ranks_of(PATH))
    words, counts = np.unique(np.delete(hashes, np.cumsum(each) - each), return_counts=True)
    of_ids = np.bincount(np.concatenate([x[1:] for x in ids]), minlength=lm_score._ids(PATH).size).astype(float)
    return lm_score.Vocabulary(words, counts, 0.0, of_ids, lm_score.spelling_order(PATH))


def test_all_training_texts_shape_vocabulary_and_weights(spark, monkeypatch):
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [(i, f"word{i} amber basin {'zephyr ' * (i % 5)}") for i in ids]
    seen = []
    real = lm_score.learned
    monkeypatch.setattr(lm_score, "learned", lambda *a: seen.append(a) or real(*a))
    lm_score.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), PATH)
    spelled, vocabulary, ranks = seen[0]
    want = [np.array(spelled_ids(t)) for _, t in texts]
    again = vocabulary_of(want)
    assert np.array_equal(vocabulary.words, again.words) and np.array_equal(vocabulary.n, again.n)
    for a, b in ((vocabulary.cells, again.cells), (vocabulary.ids, again.ids)):
        assert all(np.allclose(getattr(a, k), getattr(b, k)) for k in ("cls", "cell", "share", "bias", "cell_bias"))
    rows = spelled.collect()
    assert sorted(bytes(r.ids) for r in rows) == sorted(x.astype("<u2").tobytes() for x in want)
    held = spark.sparkContext.broadcast((lm_model.begin(vocabulary.init(len(ranks))), vocabulary, ranks))
    trained = spelled.coalesce(2).select("ids").mapInArrow(lm_score._learner(held, "<u2"), "block int, salt int, n long, w binary").where("block = 0").collect()
    assert sum(r.n for r in trained) == sum(len(x) - 1 for x in want)


def test_rounds_average_and_learn(spark):
    line = spelled_ids("the same words come again and again in this one line and no other does zzqxv ")[:-1]
    texts = [np.array(line + line[1:] * 40 + [line[0]]) for _ in range(60)]
    spelled = spark.createDataFrame([(i, x.astype("<u2").tobytes()) for i, x in enumerate(texts)], "doc_id long, ids binary").repartition(2)
    vocabulary, ranks = vocabulary_of(texts), lm_score.ranks_of(PATH)
    m = lm_score.learned(spelled, vocabulary, ranks)
    first, hashes, each = lm_score._words(texts[0], np.array([len(texts[0])]), ranks)
    t = vocabulary.tokens(texts[0], first, vocabulary.at(hashes))
    score = lambda x: sum(lm_model.score(x, vocabulary.ids, t, each - 1)).mean()
    assert score(m) > score(vocabulary.init(len(ranks))) + 1
    state = lm_model.begin(m)
    again = lm_score._shaped(lm_score._flat(state), state)
    assert all(np.array_equal(again[part][k], state[part][k]) for part in "ms" for k in state[part])


def test_rounds_grow_with_the_corpus():
    each = 8 * lm_score.ROUNDS * lm_score.TASK_BYTES
    assert [lm_score.rounds_of(x) - lm_score.ROUNDS for x in (0, each, each + 1, 4 * each, 1024 * each)] == [0, 0, 1, 2, 10]


def test_the_mean_counts_by_ids(spark):
    rows = [(0, 1, 10, np.full(4, 1, "<f4").tobytes()), (0, 2, 30, np.full(4, 5, "<f4").tobytes()), (1, 1, 7, np.full(2, 3, "<f4").tobytes())]
    df = spark.createDataFrame(rows, "block int, salt int, n long, w binary")
    some = df.repartition(2, "block", "salt").sortWithinPartitions("block", "salt").mapInArrow(lm_score._mean, df.schema)
    from pyspark.sql import functions as F

    got = some.withColumn("salt", F.lit(0)).repartition(2, "block").sortWithinPartitions("block").mapInArrow(lm_score._mean, df.schema).collect()
    assert {r.block: (r.n, np.frombuffer(r.w, "<f4").tolist()) for r in got} == {0: (40, [4.0] * 4), 1: (7, [3.0] * 2)}


def test_starts_are_the_first_ids_of_words():
    table = lm_score._ids(PATH)
    own = table.starts()
    words = "amber don't 漢字 \u3000x naïve 12a34 <|endoftext|> _x_ ... é\u00a0y zzxqj \u0120a".split(" ")
    for w in words:
        ids = np.frombuffer(table[w.encode()], "<u4")
        assert own[ids[0]] and not own[ids[1:]].any() and table.size - 1 not in ids


def test_tokens_are_cut_at_the_starts_and_hashed_by_their_ids():
    ranks = lm_score.ranks_of(PATH)
    own = [np.array(spelled_ids(t)) for t in ("amber basin amber", "", "basin 漢字 amber")]
    first, hashes, each = lm_score._words(np.concatenate(own), np.array([len(x) for x in own]), ranks)
    assert each.tolist() == [5, 2, 5]
    end, amber, basin = hashes[0], hashes[1], hashes[2]
    assert hashes[3] == amber and (hashes[[4, 5, 6, 7, 11]] == end).all() and hashes[8] == basin and hashes[10] == amber and len({end, amber, basin, hashes[9]}) == 4
    assert amber >> np.uint64(48) < basin >> np.uint64(48) < end >> np.uint64(48) or end < amber < basin
    assert lm_score._words(np.zeros(0, np.int64), np.zeros(0, np.int64), ranks)[2].tolist() == []


def test_pieces_of_words_are_spelled_as_the_words(texts):
    own = [(t or "").encode() for _, t in texts] + [b"", b" \t\x0b a.b,c  x.'s y'.S! ", "ÉA.b e\u0301.x İ a\u3000.b \u0130".encode(), b"\xff. a\xc3.b", b"zephyr. zephyr, Zephyr; zephyr"]
    table = lm_score._Ids(PATH)
    flat, at = lm_score._spelled(own, table)
    encode = table.tokenizer.encode_ordinary
    want = [[i for w in t.lower().split() for i in encode(" " + w.decode("utf-8", "replace"))] for t in own]
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert [w for w in table.pieces if w.startswith(b" zephyr") and not w[7:].isalnum()] == [b" zephyr"]


def test_inputs_sum_all_ids_of_a_token():
    size = np.array([1, 40, 2, 16, 17, 3, 1, 15])
    ids = np.random.default_rng(1).integers(0, 99, size.sum())
    t = lm_model.Tokens(ids, np.cumsum(size) - size, *(np.zeros(len(size)),) * 3)
    e = np.random.default_rng(2).standard_normal((99, lm_model.DIM)).astype(np.float32)
    at = np.array([3, 3, 1, 0, 7, 4, 2, 6, 5, 1])
    assert np.allclose(lm_model._inputs({"E": e}, t, at), [e[ids[t.first[i] : t.first[i] + size[i]]].sum(0) for i in at], atol=1e-4)


def test_places_of_words_are_found_in_slots():
    rng = np.random.default_rng(4)
    words = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.arange(300, dtype=np.uint64) << np.uint64(40)]))  # the latter share one slot
    known = lm_score.Vocabulary(words, np.ones(len(words)), 0.0, np.zeros(8), np.arange(8))
    asked = np.concatenate([rng.permutation(words), words + np.uint64(1), np.array([(1 << 64) - 1], np.uint64)])
    assert known.at(asked).tolist() == [int(np.searchsorted(words, x)) if x in set(words.tolist()) else len(words) for x in asked.tolist()]
    none = lm_score.Vocabulary(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros(8), np.arange(8))
    assert none.at(asked).tolist() == [0] * len(asked)


def test_new_pieces_are_spelled_in_one_call(texts):
    table, calls = lm_score._Ids(PATH), []

    class Counting:
        encode_ordinary = table.tokenizer.encode_ordinary

        def encode_to_numpy(self, text):
            calls.append(text)
            return table.tokenizer.encode_to_numpy(text)

    table.pieces.tokenizer = Counting()
    usual = sorted({b" " + w for _, t in texts for w in (t or "").lower().encode().split()})
    odd = [b" ", b".", b" x\xc3", b" a\xe3\x80\x80", b" \xe3\x80\x80b", b" \xc2\xa0", b" " + b"long" * 40, b" <|endoftext|>", b" don't"]
    for words in (usual, usual + odd, odd, []):
        got = table.pieces.all(words)
        want = [table.tokenizer.encode_ordinary(w.decode("utf-8", "replace")) if w != b" " else [] for w in words]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert len(calls) <= 3
    table.pieces.forget()
    assert not table.pieces and not table.pieces.older


def test_the_most_frequent_words_are_cut_at_a_count(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_score, "TOP", 5)
    of = lambda n, words: lm_score._frequent(pa.table({"n": pa.array(n, pa.int64()), "words": pa.array(words, pa.int64())}))
    assert of([1, 7, 3], [10, 2, 3]) == (33, 15, 10, 3)
    assert of([1, 7, 3], [10, 2, 4]) == (36, 16, 10, 7)
    assert of([2], [9]) == (18, 9, 0, 3)
    assert of([2, 1], [2, 3]) == (7, 5, 3, 1)
    assert of([], [])[:3] == (0, 0, 0)


def test_runs_are_summed():
    rng = np.random.default_rng(5)
    size = np.array([1, 40, 2, 16, 17, 3, 1, 15])
    grads, cut = rng.standard_normal((size.sum(), 16)).astype(np.float32), np.cumsum(size) - size
    assert np.allclose(lm_model._sums(grads, cut), np.add.reduceat(grads, cut), atol=1e-5)


def test_classes_are_scored_as_they_are_trained():
    rng = np.random.default_rng(6)
    shapes = {"A": (16, 64), "a": (64,), "B": (64, 16, 32), "b": (64, 32)}
    h, cls, cell = np.tanh(rng.standard_normal((5000, 16))).astype(np.float32), rng.integers(0, 64, 5000), rng.integers(0, 32, 5000)
    cls[:1500] = 7  # more rows than are predicted together
    for scale in (0.3, 9.0):
        m = {k: (rng.standard_normal(s) * scale).astype(np.float32) for k, s in shapes.items()}
        assert np.allclose(lm_model._logs(m, "AaBb", h, cls, cell), lm_model._Choice(m, "AaBb", h, cls, cell).logs, atol=1e-3)


def test_steps_grow_after_the_first_ids(monkeypatch):
    ids = [np.array(spelled_ids("amber basin cedar delta " * 400))] * 4
    vocabulary, ranks = vocabulary_of(ids), lm_score.ranks_of(PATH)
    flat, n = np.concatenate(ids), np.array([len(x) for x in ids])
    first, hashes, each = lm_score._words(flat, n, ranks)
    state, steps, real = lm_model.begin(vocabulary.init(len(ranks))), [], lm_model.forward
    monkeypatch.setattr(lm_model, "forward", lambda m, x: steps.append(len(x)) or real(m, x))
    for start in (0, lm_model.EARLY):
        state["n"] = start
        lm_model.train(state, vocabulary.ids, vocabulary.tokens(flat, first, vocabulary.at(hashes)), each - 1)
        assert state["n"] == start + len(flat)
    assert max(steps) > 128 and steps[0] == 128 and sum(steps) == 2 * int(np.ceil((each - 1) / lm_model.WINDOW).sum())


def test_tasks_send_what_changed(spark):
    texts = [np.array(spelled_ids("amber basin " * 50)) for _ in range(20)]
    vocabulary, ranks = vocabulary_of(texts), lm_score.ranks_of(PATH)
    held = spark.sparkContext.broadcast((lm_model.begin(vocabulary.init(len(ranks))), vocabulary, ranks))
    df = spark.createDataFrame([(x.astype("<u2").tobytes(),) for x in texts], "ids binary").coalesce(1)
    sent = np.concatenate([np.frombuffer(r.w, "<f4") for r in df.mapInArrow(lm_score._learner(held, "<u2"), "block int, salt int, n long, w binary").orderBy("block").collect()])
    assert len(sent) == len(lm_score._flat(held.value[0])) and 0 < np.count_nonzero(sent) < len(sent) / 10


def test_attention_helps_on_held_out_text(spark):
    """The same model trained with and without attention (V held at 0), over the documents of the smallest tables."""
    docs = [(r.doc_id, r.text or "") for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    table = lm_score._ids(PATH)

    def laid(own):
        return [np.array(spelled_ids(t)) for t in own]

    ids, held_ids = laid([t for i, t in docs if not fold(i)][:600]), laid([t for i, t in docs if fold(i)][:100])
    vocabulary, ranks = vocabulary_of(ids), lm_score.ranks_of(PATH)

    def tokens(own):
        flat, n = np.concatenate(own), np.array([len(x) for x in own])
        first, hashes, each = lm_score._words(flat, n, ranks)
        return vocabulary.tokens(flat, first, vocabulary.at(hashes)), each - 1

    t, n = tokens(ids)
    held, n_held = tokens(held_ids)
    with_it, without = lm_model.begin(vocabulary.init(table.size)), lm_model.begin(vocabulary.init(table.size))
    without["m"]["V"][:] = 0
    lm_model.train(with_it, vocabulary.ids, t, n)
    lm_model.train(without, vocabulary.ids, t, n, still="V")
    a, b = (sum(lm_model.score(x["m"], vocabulary.ids, held, n_held)).mean() for x in (with_it, without))
    counted = sum(lm_model.score(vocabulary.init(table.size), vocabulary.ids, held, n_held)).mean()
    assert a > b + 0.05 and b > counted + 0.3
