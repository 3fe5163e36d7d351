"""Small documents with every hazard that the operators state a result for."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, salt int, rank int, a long, b long, h long"
WORDS = "amber basin cedar delta ember fjord grove heron inlet jetty kelp larch moss north otter pine quartz ridge slate tide umber vale willow yarrow zephyr".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, blanks, copies, near copies, shared lines, shared passages, a long text, a repeated id."""
    rng = random.Random(5)
    line, passage = f"  Shared Line {prose(rng, 9)} \t", prose(rng, 70)
    base = prose(rng, 120).split()
    out: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, "word"), (6, "é" * 39 + "\n" + "x" * 39)]
    out += [(10 + i, f"{prose(rng, 30)}\n{line if i % 2 else line.upper()}\n{prose(rng, 20)}\n") for i in range(6)]
    out += [(20, f"{line}\n{line}"), (21, " ".join(base)), (22, " ".join(base).upper())]
    out += [(23 + i, " ".join(base[: 118 - i] + [f"new{i}"] + base[119 - i :])) for i in range(4)]
    out += [(30, f"{prose(rng, 40)} {passage} {prose(rng, 10)}"), (31, f"{passage} {prose(rng, 300)}"), (32, "ab" * 400), (33, f"{passage[:199]}"), (34, passage[:200])]
    out += [(40, "naïve Ünïcode 漢字 <|endoftext|> </s>  two  spaces\n\n\nend "), (41, prose(rng, 9000)), (42, "one two three four"), (43, "one two three four")]
    out += [(None, " ".join(base)), (50, prose(rng, 15)), (50, prose(rng, 15)), (51, "same row"), (51, "same row")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src", None if t is None else len(t), "k", 1, 2, 3, 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
