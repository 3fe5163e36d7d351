"""The two trained models: exact counts, causality, normalisation and held-out quality."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lm_model
from tidemark.llm.common import read
from tidemark.llm.lm_score import score_texts
from tidemark.llm.quality import score_quality
from tidemark.llm.tokens import tokenizer_path

from .test_dedup import words

BYTES = "byte_bpe_50k.tiktoken"


def test_counts_and_base_score(docs, texts, no_docs):
    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*words(t), None]) for i, t in texts]
    for i, own in tokens:
        if i is not None and not held(i):
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or 0, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n * 1 + v + 1)) for w in own), 6)) for i, own in tokens)
    got = score_texts(docs, tokenizer_path(BYTES)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.held_out == (None if r.doc_id is None else held(r.doc_id)) and math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_texts(no_docs, tokenizer_path(BYTES)).count() == 0


def test_windows_score_each_input_once():
    w, s = lm_model.WINDOW, lm_model.STRIDE
    lengths = np.array([0, 1, s, s + 1, w, w + 1, w + s, w + s + 1, 500])
    for stride in (s, w):
        first, text, context, scored = lm_model.windows(lengths, stride)
        seen, starts = np.zeros((lengths + 1).sum(), int), np.cumsum(lengths + 1) - lengths - 1
        for f, t, c, n in zip(first, text, context, scored):
            assert 0 < n and c + n <= w and starts[t] <= f and (c == w - stride or f == starts[t])
            seen[f + c : f + c + n] += 1
        inside = np.ones(len(seen), bool)
        inside[starts + lengths] = False  # a text's last token is no input
        assert (seen == inside).all()


#: Ids of the small models below, and words of the vocabulary, whose ids are (word, id) for a word.
IDS, VOCABULARY = 30, 12


def small_model(seed: int = 0, n_words: int = VOCABULARY, n_ids: int = IDS):
    """Random weights; cells of words and of ids with the stop."""
    rng = np.random.default_rng(seed)
    words, ids = lm_model.Cells(rng.integers(1, 50, n_words), 20.0), lm_model.Cells(rng.integers(1, 50, n_ids + 1))
    m = {k: (w + rng.standard_normal(w.shape) * 0.3).astype(np.float32) for k, w in lm_model.init(words, ids, n_ids).items()}
    return words, ids, m


def laid(words, own) -> lm_model.Tokens:
    """Tokens from (vocabulary word or None, its ids)."""
    size = np.array([len(x) for _, x in own])
    cls = np.array([lm_model.SPELLED if w is None else words.cls[w] for w, _ in own])
    cell, share = (np.array([0 if w is None else part[w] for w, _ in own], part.dtype) for part in (words.cell, words.share))
    return lm_model.Tokens(np.concatenate([x for _, x in own]), np.cumsum(size) - size, cls, cell, share)


def random_tokens(rng, n: int, n_words: int = VOCABULARY, n_ids: int = IDS) -> list:
    return [(w if w < n_words else None, rng.integers(0, n_ids, rng.integers(1, 5))) for w in rng.integers(0, n_words * 3 // 2, n)]


def test_untrained_model_gives_the_share_of_the_counts():
    counts = np.random.default_rng(2).integers(1, 1000, 3000).astype(float)
    words, ids = lm_model.Cells(counts, 5000.0), lm_model.Cells(np.ones(IDS + 1))
    m = lm_model.init(words, ids, IDS)
    t = laid(words, [(0, np.array([1])), *((i, np.array([2])) for i in range(3000)), (None, np.array([7]))])
    logs = sum(lm_model.score(m, ids, t, np.array([3001])))
    assert np.allclose(np.exp(logs[:-1]), counts / (counts.sum() + 5000), rtol=2e-3)
    assert abs(logs[-1] - math.log(5000 / (counts.sum() + 5000) / (IDS + 1) ** 2)) < 0.05  # spelled by one id and the stop
    none = lm_model.init(lm_model.Cells(np.zeros(0)), ids, IDS)
    assert abs(sum(lm_model.score(none, ids, laid(words, [(0, np.array([1])), (None, np.array([7]))]), np.array([1])))[0] - math.log(1 / (IDS + 1) ** 2)) < 0.05


def test_model_is_causal_and_normalised():
    words, ids, m = small_model()
    rng = np.random.default_rng(0)
    own = random_tokens(rng, 120)
    score = lambda x: sum(lm_model.score(m, ids, laid(words, x), np.array([len(x) - 1])))
    base = score(own)
    assert np.allclose(score(own[:80] + random_tokens(rng, 40))[:79], base[:79], atol=1e-5)
    total = sum(math.exp(score([*own, (w, np.array([0]))])[-1]) for w in range(VOCABULARY))
    ended, frontier = 0.0, [[i] for i in range(IDS)]
    for _ in range(2):  # spellings of up to two ids; the rest are longer
        texts = [[*own[-40:], (None, np.array(x))] for x in frontier]
        logs = sum(lm_model.score(m, ids, laid(words, [t for x in texts for t in x]), np.full(len(texts), 40))).reshape(len(texts), 40)[:, -1]
        ended += np.exp(logs.astype(float)).sum()
        frontier = [[*x, i] for x in frontier for i in range(IDS)]
    short = sum(math.exp(score([*own[-40:], (w, np.array([0]))])[-1]) for w in range(VOCABULARY))
    assert 0.1 < total < 1 and 0 < ended and short + ended <= 1.0001


def test_gradients_follow_the_loss():
    """A small step along each weight's gradient lowers the loss as the gradient says."""
    words, ids, m = small_model(5, 600, 500)
    t, n = laid(words, random_tokens(np.random.default_rng(5), 2 * lm_model.WINDOW + 2, 600, 500)), np.full(2, lm_model.WINDOW)
    loss = lambda x: -float(sum(lm_model.score(x, ids, t, n, 1)).astype(float).sum())
    state = lm_model.begin(m, spent=1e12)  # a huge sum: steps of rate / 1e6 along the plain gradient
    lm_model.train(state, ids, t, n, rate=1e6 * 1e-3)
    for name in m:
        step = state["m"][name] - m[name]
        moved = {**m, name: m[name] + step}
        expected = -(step.astype(float) ** 2).sum() / 1e-3
        assert expected < 0 and abs(loss(moved) - loss(m) - expected) < 0.15 * abs(expected) + 2e-3, name


def test_model_learns():
    words, ids, _ = small_model()
    m = lm_model.init(words, ids, IDS)
    own = [(w, np.array([w, 20])) for w in range(10)] + [(None, np.array([3, 5, 7]))]
    t = laid(words, [own[-1], *own * 300])
    lengths = np.array([len(t.first) - 1])
    state = lm_model.begin(m)
    before = sum(lm_model.score(state["m"], ids, t, lengths)).mean()
    for _ in range(6):
        lm_model.train(state, ids, t, lengths, batch=4)
    assert sum(lm_model.score(state["m"], ids, t, lengths)).mean() > before + 2


def test_scores_beat_the_counts_on_held_out_known_words(spark):
    """By 0.1 of a decimal digit a token or more, over texts of which 97 % of the tokens are known."""
    rows = score_texts(read(spark, "/root/testdata/sf0.01", "documents"), tokenizer_path(BYTES)).where("held_out AND n_known >= 0.97 * n_tokens").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert tokens > 3000 and sum(r.score - r.base_score for r in rows) > 0.1 * tokens


def test_quality_on_held_out_labels(spark):
    """Accuracy and ranking on the labelled documents that the fit may not use."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect() if r.quality is not None}
    got = {r.doc_id: r._score for r in score_quality(read(spark, sf, "documents"), read(spark, sf, "labels")).collect()}
    out = [i for i in labels if i in got and zlib.crc32(str(i).encode()) % 3 == 1]
    good, bad = ([got[i] for i in out if labels[i] == y] for y in (1, 0))
    assert min(len(good), len(bad)) > 10
    assert sum((got[i] >= 0.5) == (labels[i] == 1) for i in out) >= 0.9 * len(out)
    assert np.mean([a > b for a in good for b in bad]) >= 0.95


def test_quality(spark, docs, no_docs):
    rng = random.Random(3)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        y = i % 2
        own = good if y else bad
        rows.append((i, " ".join(rng.choice(own if rng.random() < 0.6 else good + bad) for _ in range(30))))
        labels.append((i, y, 0))
    labels += [(None, 1, 0), (3, None, 0), (7, 1, 1), (9999, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r._score for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == i % 2 for i in out) > 0.97 * len(out)
    scored = score_quality(docs, table.limit(0))
    assert scored.columns == [*docs.columns, "_score", "_predicted"]
    assert {r._score for r in scored.collect()} == {0.5}
    assert score_quality(no_docs, table).count() == 0


@pytest.mark.parametrize("what", ["labels", "lang", "source"])
def test_scores_need_the_text_alone(spark, docs, what):
    table = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    a = sorted((r.doc_id or 0, r._score) for r in score_quality(docs, table).collect())
    other = table.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1") if what == "labels" else table
    cut = docs if what == "labels" else docs.drop(what)
    assert a == sorted((r.doc_id or 0, r._score) for r in score_quality(cut, other).collect())
