"""Token files and packing: exact round trips and the packing's promises."""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm.common import shared_dir
from tidemark.llm.packing import pack, plan, token_pieces
from tidemark.llm.token_files import read_tokens, write_tokens
from tidemark.llm.tokens import Encoder, encoder, together, tokenizer_path


@functools.cache
def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(tokenizer_path(name))


def ids(name: str, text: str | None, end: int) -> np.ndarray:
    return np.array([*tokenizer(name).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_encoded_as_in_the_whole_text(name, texts):
    own, whole = encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    more = ["a  b", "a\nb", "a \nb", "\n", " a", "it's we'll a.b,c 12 345 é ñ", "tab\tx", "<|endoftext|>", "A<|x B", "x y", "don't\nDON'T stop... ok?!", "\x85a \x1cb", "¼ ² ª º ß µ"]
    for text in [*(t or "" for _, t in texts), *more]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_together_are_encoded_as_each_whole(name, texts):
    more = ["a  b", "a\nb", "a \nb", "\n", " a", "x ", "it's we'll a.b,c 12 345 é ñ", "tab\tx", "A<|x B", "a<", "|b", "x.'s y'.s,re d!ll? A;B:C.", "", "\xa0q", "café. CAFÉ, É", "x\xadx", "\x7f", "\x85a", "漢字 a. b", "İ. x", "¼ ² ª º ß µ", "A.\nB,\n.c"]
    own, whole = Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    every = [*(t or "" for _, t in texts), *more]
    want = [whole.encode(t, add_special_tokens=False).ids for t in every]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(pa.array(every))] == want
    assert [np.frombuffer(own.encode_all(pa.array([t]))[0], "<u4").tolist() for t in every] == want and own.encode_all(pa.array([], pa.string())) == []
    assert [x for a, b in together([3, 9, 1, 1, 1], 3) for x in range(a, b)] == [*range(5)] and together([3, 9, 1, 1, 1], 3) == [(0, 1), (1, 2), (2, 5)]


def test_words_before_marks_are_encoded_once():
    own = Encoder(tokenizer_path("word_bpe_49k.json"))
    own.encode_all(pa.array([f"zephyr{end} Zephyr{end} zephyr" for end in ".,;:!?"] * 50))
    assert len(own.pieces) == 8 and not own.spaced  # the word with and without a space, and the marks


def test_token_files(spark, docs, texts, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    folder = shared_dir(spark, "tokens")
    write_tokens(docs, folder, path, 0)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, folder).collect()), key=lambda x: x[2])
    want = {(i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, t in texts for x in [ids("byte_bpe_50k.json", t, 0)]}
    assert {(a, b, d, e) for a, b, _, d, e in got} == want and len(got) == len(texts)
    assert [x[:2] for x in got] == sorted(x[:2] for x in got)
    assert [x[2] for x in got] == [0, *np.cumsum([x[3] for x in got])[:-1].tolist()]
    empty = shared_dir(spark, "tokens")
    write_tokens(no_docs, empty, path, 0)
    assert read_tokens(spark, empty).count() == 0


def sound(rows, capacity: int) -> int:
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
        assert sum(n for _, n in own) <= capacity
    return len(held)


def test_packing(spark, docs, texts, no_docs):
    pieces = token_pieces(docs, tokenizer_path("word_bpe_49k.json"), 256)
    rows = pack(pieces, 256).collect()
    want = []
    for i, t in texts:
        x = ids("word_bpe_49k.json", t, 1)
        want += [(i, k, a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(x), 256))]
    order = lambda x: (x[0] is None, *(y or 0 for y in x))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    least = -(-sum(r.length for r in rows) // 256)
    assert least <= sound(rows, 256) <= least + 2
    assert pack(token_pieces(no_docs, tokenizer_path("word_bpe_49k.json"))).count() == 0


def best_fit(lengths: list[int]) -> int:
    """Sequences that best-fit decreasing over single pieces needs."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else 4096
        bisect.insort(rooms, room - n)
    return len(rooms)


def test_plan_is_near_best_fit():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 4097, 20_000), np.minimum(4096, rng.lognormal(5.5, 1.2, 50_000).astype(int) + 1), np.full(1000, 1366), np.full(999, 2049)):
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        runs = plan(histogram)
        assert sum(n * len(s) for n, _, s in runs) == len(lengths)
        assert sum(n for n, _, _ in runs) <= best_fit(lengths.tolist()) * 1.01 + 2
