"""Two equally long texts under one doc_id are both checked for benchmark passages."""

from __future__ import annotations

import random

from tidemark.llm.decontaminate import leaks

from .conftest import prose


def test_equally_long_texts_of_a_doc_id_are_both_checked(spark):
    rng = random.Random(12)
    item = prose(rng, 13)
    words = item.split()
    near = " ".join(words[:6] + ["x" * len(words[6])] + words[7:])
    # two texts of one length that share seeds with the item; one alone holds it
    broken = " ".join(w if i % 4 else "y" * len(w) for i, w in enumerate(words))
    tail = " " + prose(rng, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    far = " ".join(words[:5] + ["z" * len(w) for w in words[5:]]) + tail
    assert len(broken + tail) == len(near + tail) == len(far)
    for first in (broken + tail, far):
        for order in ([(5, first), (5, near + tail)], [(5, near + tail), (5, first)]):
            docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
            assert [(r.doc_id, r.item_id, r.n_matched) for r in leaks(docs, bench).collect()] == [(5, 1, 12)]
