"""The pipeline's stages over the smallest tables, each held against its rule."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm.common import read

from .test_dedup import lower, near_by_force, words
from .test_tokens import ids, sound

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"


def leaked(doc: np.ndarray, item: np.ndarray) -> bool:
    """Whether some aligned 13 words (the whole item if shorter) agree in 0.8 of the places; every pair of places is looked at."""
    size = min(13, len(item))
    n, m = len(item) - size + 1, len(doc) - size + 1
    if not len(item) or m < 1:
        return False
    same = item[:, None] == doc[None]
    return bool((sum(same[k : n + k, k : m + k].astype(np.int8) for k in range(size)) >= 0.8 * size - 1e-9).any())


@pytest.fixture(scope="module")
def out(spark) -> dict[str, list]:
    """The rows after each stage; "" are the documents."""
    docs = read(spark, SF, "documents")
    rows = {"": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == read(spark, SF, "documents").columns
        rows[name] = docs.collect()
        docs = spark.createDataFrame(rows[name], docs.schema)
    return rows


def test_run_against_brute_force(spark, out):
    """run() from the documents that the classifier keeps: lines, near copies, leaks and token pieces over all of them by plain loops."""
    held, keeper = Counter(), {}
    keys = lambda t: {lower(x.strip(SPACE)) for x in (t or "").split("\n")}
    for r in out["quality"]:
        held.update(keys(r.text))
        keeper.update({k: max(keeper.get(k, r.doc_id), r.doc_id) for k in keys(r.text)})
    text = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if len(k := lower(x.strip(SPACE))) < 40 or held[k] < 5 or keeper[k] == r.doc_id) for r in out["quality"]}
    part = near_by_force(list(text.items()), 5)[1]
    text = {i: t for i, t in text.items() if part[i] == i}
    number: dict[str, int] = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], int)
    items = [coded(r.text) for r in read(spark, SF, "benchmark").collect()]
    kept = {i: t for i, t in text.items() if not any(leaked(d, x) for d in [coded(t)] for x in items)}
    assert 0 < len(kept) < len(text) and {r.doc_id for r in out["benchmark"]} == set(kept)
    want = Counter()
    for i, t in kept.items():
        own = ids("word_bpe_49k.json", t, 1)
        for k, a in enumerate(range(0, len(own), 4096)):
            piece = own[a : a + 4096]
            want[i, k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert sound(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_stages(spark, out):
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    gone = {r.doc_id for r in out[""]} - {r.doc_id for r in out["quality"]}
    judged = [i for i in labels if i in {r.doc_id for r in out[""]} and zlib.crc32(str(i).encode()) % 3 != 1]
    assert sum((i in gone) == (labels[i] == 0) for i in judged) >= 0.9 * len(judged)
    held = Counter()
    keeper: dict[str, int] = {}
    for r in out["quality"]:
        for k in {lower(x.strip(SPACE)) for x in (r.text or "").split("\n")}:
            held[k] += 1
            keeper[k] = max(keeper.get(k, r.doc_id), r.doc_id)
    want = {}
    for r in out["quality"]:
        want[r.doc_id] = "\n".join(x for x in (r.text or "").split("\n") if len(k := lower(x.strip(SPACE))) < 40 or held[k] < 5 or keeper[k] == r.doc_id)
    assert {r.doc_id: r.text or "" for r in out["lines"]} == want
    _, part = near_by_force([(r.doc_id, r.text) for r in out["lines"]], 5)
    assert {r.doc_id for r in out["near_copies"]} == {i for i in part if part[i] == i}
    total = sum(r.length for r in out["packing"])
    assert total == sum(len(ids("word_bpe_49k.json", r.text, 1)) for r in out["benchmark"])
    assert sound(out["packing"], 4096) <= -(-total // 4096) + 2


def test_registry():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
