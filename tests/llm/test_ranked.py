"""Ranked search against scoring every document, block boundaries against every cut."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.ranked import Shard, build_index, cut_blocks, impacts, op11_ranked_search, search, spans

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def ranked_by_force(docs, items, k: int = 50) -> list[tuple]:
    rows = [(i, Counter(t), len(t)) for i, text in docs if i is not None and (t := terms(text))]
    n_docs, n_terms, df = len(rows), sum(n for _, _, n in rows), Counter(t for _, c, _ in rows for t in c)
    asked: dict[int, set] = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, tf, n in rows:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if t in tf)
            if score > 0:
                scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def items(texts):
    rng = random.Random(3)
    some = [t for _, t in texts if t]
    out = [(i, " ".join(rng.choices(" ".join(rng.sample(some, 3)).split(), k=12))) for i in range(30)]
    return out + [(40, None), (41, " .,; "), (42, "Word WORD word"), (43, "nowhere"), (44, "漢字 ünïcode Ünïcode"), (45, "x" * 39), (42, "amber1 amber2"), (None, "word"), (46, some[-1]), (47, "a" * 5000)]


def test_ranking(spark, docs, texts, no_docs, items, tmp_path):
    asked = spark.createDataFrame([(i, t, "w", 1) for i, t in items], "item_id long, text string, term string, block int")
    want = ranked_by_force(texts, items)
    for size, cost in ((8 << 20, 4_000_000), (2_000, 100), (1, 10**9)):
        index = build_index(docs, size, cost)
        assert got(search(index, asked)) == want
        assert got(search(index, asked, 3)) == ranked_by_force(texts, items, 3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert got(op11_ranked_search(spark, str(tmp_path))) == want
    assert search(build_index(no_docs), asked).count() == 0
    assert search(index, asked.limit(0)).count() == 0


def test_many_documents_with_ties(spark, monkeypatch):
    """More documents than the k best, most of them with equal scores, queries in many blocks."""
    from tidemark.llm import ranked

    monkeypatch.setattr(ranked, "QUERY_BYTES", 200)
    monkeypatch.setattr(ranked, "AT_ONCE", 2)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((3, 5, 40))))) for i in range(4000)] + [(5000 + i, "the same text of all these w1 w2") for i in range(900)] + [(9000, "w1 " * 70_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(8)) + " w1 same") for i in range(40)]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 30_000)
    assert got(search(index, spark.createDataFrame(items, "item_id long, text string"))) == ranked_by_force(rows, items)


def test_blocks_are_the_best_cut():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 7, 1, 9, 30, 3]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    g = rng.integers(1, 1000, starts[-1])
    for cost, longest in ((0, 8), (500, 8), (3000, 5), (10**7, 64)):
        blocks, ends = cut_blocks(g, starts, cost, longest)
        begins = np.concatenate([[0], ends[:-1]])
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            own = range(blocks[i], blocks[i + 1])
            assert begins[own[0]] == a and ends[own[-1]] == b
            best = [0] + [10**18] * (b - a)
            for j in range(1, b - a + 1):
                best[j] = min(best[x] + cost + (j - x) * int(g[a + x : a + j].max()) for x in range(max(0, j - longest), j))
            assert sum(cost + int(ends[x] - begins[x]) * int(g[begins[x] : ends[x]].max()) for x in own) == best[-1]
            assert all(ends[x] - begins[x] <= longest for x in own)


def test_search_skips_blocks(spark, monkeypatch):
    """A rare term decides, so most postings of the common one are never decoded."""
    rows = [(i, "common " * (1 + i % 7) + f"filler{i} " * 20) for i in range(3000)] + [(7000 + i, "common rare") for i in range(60)]
    row = build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).first().asDict()
    shard, none, decoded = Shard(row), (np.zeros(0, np.int64),) * 2, []
    monkeypatch.setattr("tidemark.llm.ranked.impacts", lambda tfs, m: decoded.append(len(tfs)) or impacts(tfs, m))
    scores, ids = shard.search([b"common", b"rare"], [10, 4000], 50, none)
    assert sorted(ids.tolist()) == list(range(7000, 7050)) and sum(decoded) < 600
    assert spans(np.array([3, 9]), np.array([5, 12])).tolist() == [3, 4, 9, 10, 11]
    assert row["n_docs"] == 3060
