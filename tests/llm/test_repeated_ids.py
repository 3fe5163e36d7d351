"""Two different texts under one doc_id: each counts on its own."""

from __future__ import annotations

import random

from tidemark.llm.minhash import near_documents

from .conftest import prose
from .test_dedup import near_by_force


def test_each_text_of_a_doc_id_has_its_links(spark):
    rng = random.Random(11)
    a, b, c, d, e = (prose(rng, 150) for _ in range(5))
    rows = [(90, a), (90, b), (91, a + " end"), (92, b + " end"), (80, b), (70, c), (71, c + " end"), (95, c), (95, prose(rng, 60))]
    rows += [(60, d), (60, e), (61, d + " end"), (62, e + " end")]  # 60 stands for both texts: with one set alone, one link is lost
    for order in (rows,):
        got = {r.doc_id: (r.component_id, r.kept) for r in near_documents(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()}
        assert got == {80: (80, True), 90: (80, False), 91: (80, False), 92: (80, False), 70: (70, True), 71: (70, False), 95: (70, False), 60: (60, True), 61: (60, False), 62: (60, False)}


def test_rows_that_repeat_keep_their_links(spark):
    """Pairs of near copies, every row twice or three times: the same components as with each row once."""
    rng = random.Random(13)
    rows = []
    for i in range(12):
        words = prose(rng, 120).split()
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[:118] + ["other", "end"]))]
    once = near_by_force(rows, 5)[1]
    for times in (1, 2, 3):
        got = near_documents(spark.createDataFrame(rows * times, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == times * len(rows)
        assert {(r.doc_id, r.component_id) for r in got} == set(once.items())


def test_groups_just_under_the_bound(spark):
    """A base, copies linked with it, and copies just under the bound: no link lost, none made up."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(700):
        own = list(base)
        for k in rng.sample(range(150), rng.choice((2, 3, 4))):
            own[k] = f"x{rng.randrange(9999)}"
        rows.append((i + 1, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_by_force(rows, 5)[1]
