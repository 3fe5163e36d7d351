"""Chat formatting, the embedding join and decontamination against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.chat import CLOSE, OPEN, format_chats, read_turns, unescape
from tidemark.llm.decontaminate import MASKS, decontaminate, leaks, short_masks
from tidemark.llm.embed_join import near_vectors

from .test_dedup import closed, words


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>\n<|turn|>user\n&lt; &amp; [INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "bye\n"), (2, None, None, "x"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "é漢"), (3, 0, "assistant", "🙂&")]
    out = format_chats(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, parts string")).withColumn("loss", unescape(F.substr("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))).withColumn("turns", read_turns(F.col("text"))).collect()
    for conv in (1, 2, 3, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        got = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.target)
        assert [(t.role, t.text) for t in got[-1].turns] == [x[2:] for x in own]
        assert [r.loss for r in got if r.loss_end > r.loss_start or own[r.target][2] == "assistant"] == [x[3] for x in own if x[2] == "assistant"]
        for r in got:
            assert r.text.count(OPEN) == r.text.count(CLOSE) == r.target + 1
            assert r.text[r.loss_start : r.loss_end] == "" or r.text[r.loss_end :] == CLOSE
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):
        centre = rng.standard_normal(16)
        rows += [(0, (centre + rng.standard_normal(16) * s).tolist(), f"l{g % 3}") for s in rng.uniform(0.05, 0.4, 40)]
    rows += [(0, rows[0][1], rows[0][2])] * 5 + [(0, [x * 3 for x in rows[0][1]], rows[0][2])]
    rows += [(0, None, "l0"), (0, [0.0] * 16, "l0"), (0, [float("nan")] * 16, "l0"), (0, [None, *[1.0] * 15], "l0"), (0, [float("inf")] * 16, "l0"), (0, rows[0][1], None), (0, [1.0, 0.0], "l0"), (0, [1.0, 0.01], "l0"), (0, [], "l0")]
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    fine = {i: (np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if v and label and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(fine, 2) if fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0]) and fine[a][0] @ fine[b][0] >= 0.93]
    n, part = Counter(x for p in links for x in p), closed([r[0] for r in rows], links)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, block int, rep int")
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == sorted((i, n[i], part[i], part[i] == i) for i, _, _ in rows)
    assert near_vectors(df.limit(0)).count() == 0


def leaked_by_force(doc: str | None, item: str | None) -> bool:
    d, w = words(doc), words(item)
    size = min(13, len(w))
    return bool(w) and any(sum(a == b for a, b in zip(w[i : i + size], d[j : j + size])) >= 0.8 * size for i in range(len(w) - size + 1) for j in range(len(d) - size + 1))


def test_decontamination(spark, docs, no_docs):
    rng = random.Random(9)
    fresh = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    items = [fresh(n) for n in (3, 8, 13, 14, 20, 40)]
    rows = []
    for k, item in enumerate(items):
        for subs in range(0, 8):
            own = list(item)
            for at in rng.sample(range(len(own)), min(subs, len(own))):
                own[at] = "changed"
            rows.append((len(rows), " ".join([*fresh(rng.randrange(30)), *own, *fresh(rng.randrange(30))])))
        rows.append((len(rows), " ".join(item[: len(item) // 2])))
    rows += [(5000, None), (5001, ""), (None, " ".join(items[4])), (3, rows[3][1])]
    bench = spark.createDataFrame([*((i, " ".join(x), "c") for i, x in enumerate(items)), (90, None, "c"), (91, " ", "c"), (None, "a b", "c"), (2, " ".join(items[2]), "c")], "item_id long, text string, seed string")
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, at int")
    want = {(i, k) for i, t in rows if i is not None for k, x in enumerate(items) if leaked_by_force(t, " ".join(x))}
    got = [(r.doc_id, r.item_id) for r in leaks(df, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = decontaminate(df, bench)
    assert left.columns == df.columns and Counter(r.doc_id for r in left.collect()) == Counter(i for i, _ in rows if i is None or i not in {d for d, _ in want})
    assert leaks(no_docs, bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0 and decontaminate(docs, bench).count() == docs.count()


def test_masks_find_every_choice_of_differing_words():
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    for gone in itertools.combinations(range(13), 2):
        assert any(not {p + i for i in m} & {*gone} for m in masks for p in range(13 - m[-1]))
    for n in range(1, 13):
        for gone in itertools.combinations(range(n), n // 5):
            assert any(not {*m} & {*gone} for m in short_masks(n))


def test_tiny_and_huge_vectors(spark):
    """Norms that would underflow or overflow; the links of other vectors stay."""
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1e-200, 0.0], 1), (4, [1e200, 1e198], 1), (5, [5e-324, 0.0], 1), (6, [-1e308, -1e308], 1), (7, [0.0, 1e-300], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (0, 6), 7: (0, 7)}


def test_a_session_without_a_checkpoint_folder(spark, monkeypatch):
    """In local mode one temporary folder for each application; on a cluster an error."""
    import pytest

    from tidemark.llm import common

    class Bare:
        """The session as it is, without spark.checkpoint.dir."""

        def __init__(self, master: str):
            self.conf = type("Conf", (), {"get": lambda _, key, default=None: default})()
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1", "getCheckpointDir": lambda _: None})()

    a, b = (common.shared_dir(Bare("local[2]"), "x") for _ in range(2))
    assert a != b and a.rsplit("/", 2)[0] == b.rsplit("/", 2)[0] and a.startswith("file:///")
    with pytest.raises(ValueError):
        common.shared_dir(Bare("spark://somewhere:7077"), "x")
    spark.range(3).write.parquet(a)
    assert spark.read.parquet(a).count() == 3
