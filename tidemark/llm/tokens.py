"""Token ids of whole texts by the public tokenizer files, with the ids of frequent pieces kept per worker.

Texts are cut only where the tokenizer itself always cuts: at single white space, and after the last ASCII letter of a word where one of
.,;:!? follows. The distinct pieces of some texts are found in Arrow, the tokenizer encodes each once, and their ids are laid out by
the pieces' numbers; any text for which that is not certain is encoded whole. Both give the tokenizer's own ids.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tidemark.llm.words import Kept

#: Words whose ids a worker keeps in each of two generations, about 75 MB each.
KEPT_WORDS = 350_000
#: Bytes of text whose pieces are found together.
TOGETHER = 4_000_000

#: Kinds of bytes: white space at which texts are cut, ASCII letters, marks before which they are cut after a letter; and which no text cut in pieces holds.
_BREAK, _LETTER, _MARK, _BAD = (np.zeros(256, bool) for _ in range(4))
_BREAK[list(b" \n")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
_BAD[[*range(10), *range(11, 32), 127, 0xC0, 0xC1, *range(0xC4, 256)]] = True
#: Each byte's kind: 1 for white space, 2 for letters, 3 for marks.
_KINDS = (_BREAK + 2 * _LETTER + 3 * _MARK).astype(np.uint8).tobytes()


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte: at white space, and at a mark after a letter."""
    kinds = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    out = kinds == 1
    out[1:] |= (kinds[1:] == 3) & (kinds[:-1] == 2)
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def laid_out(data: np.ndarray, begins: np.ndarray, edges: np.ndarray, ids_of: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces end to end, place of the first id of each text and the end). begins: places in data where pieces begin, every text's first byte
    among them; edges: where texts begin, and the end; ids_of: of pieces, each one's ids as unsigned 32-bit little-endian bytes."""
    offsets = np.append(begins, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    _, at, held = coded.dictionary.buffers()
    raw, at = bytes(held) if held else b"", np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1].tolist()
    own = ids_of([raw[a:b] for a, b in zip(at[:-1], at[1:])])
    size = np.fromiter(map(len, own), np.int64, len(own)) // 4
    at = np.asarray(coded.indices)
    sizes = size[at]
    ids = np.frombuffer(b"".join(own), "<u4")[spans((np.cumsum(size) - size)[at], sizes)]
    return ids, np.append(0, np.cumsum(sizes))[np.searchsorted(begins, edges)]


def together(sizes: list[int], most: int = TOGETHER) -> list[tuple[int, int]]:
    """(from, to) of runs of texts of at most that many bytes, or of one text."""
    out, a, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > a and held + n > most:
            out.append((a, i))
            a, held = i, 0
        held += n
    return [*out, (a, len(sizes))] if sizes else out


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(Kept):
    """word -> ids as bytes (unsigned 32-bit little-endian)."""

    def __init__(self, tokenizer, before: str):
        super().__init__(KEPT_WORDS)
        self.tokenizer, self.before = tokenizer, before

    def make(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(self.before + word, add_special_tokens=False).ids, "<u4").tobytes() if word else b""


def _byte_names() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*own}))}


class _Pieces(Kept):
    """piece (bytes, Latin-1 text) -> ids as bytes (unsigned 32-bit little-endian). A word of letters is one piece to the tokenizer too, so that its model alone
    encodes it, in the letters that stand for its bytes."""

    def __init__(self, tokenizer, lower: bool):
        super().__init__(KEPT_WORDS)
        self.tokenizer, self.model, self.lower, self.names = tokenizer, tokenizer.model, lower, _byte_names()

    def make(self, piece: bytes) -> bytes:
        text = piece.decode()
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            own = word.lower() if self.lower else text  # a vocabulary of lower-case words drops the space
            ids = [t.id for t in self.model.tokenize(own.encode().decode("latin-1").translate(self.names))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            head = f.read(200_000)
        self.byte_level, self.lower = b'"ByteLevel"' in head, b'"Lowercase"' in head
        self.plain, self.spaced = _Words(self.tokenizer, ""), _Words(self.tokenizer, " ")
        self.pieces = _Pieces(self.tokenizer, self.lower)
        self.newline = self.plain["\n"]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as unsigned 32-bit little-endian bytes."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<|" in text or not text.replace("\n", "").isprintable():
            return self.whole(text)
        if not self.byte_level:
            return b"".join(map(self.plain.__getitem__, text.split()))
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[:1] in " \n" or text[-1:] in " \n":
            return self.whole(text)
        out: list[bytes] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.newline)
            out.append(self.plain[first])
            out.extend(map(self.spaced.__getitem__, rest))
        return b"".join(out[1:])

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of each text of a string array without nulls."""
        if not self.byte_level:
            return [self.encode(t) for t in texts.to_pylist()]
        own = texts.cast(pa.large_binary()).to_pylist()
        return [ids for a, b in together(list(map(len, own))) for ids in self._some(own[a:b])]

    def _some(self, texts: list[bytes]) -> list[bytes]:
        joined = b"".join(texts)
        data = np.frombuffer(joined.lower() if self.lower else joined, np.uint8)
        edges = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        if not len(data):
            return [b""] * len(texts)
        first, whole = edges[:-1][edges[1:] > edges[:-1]], np.zeros(len(texts), bool)
        bad = _BAD[data]
        bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # <|
        wide = np.flatnonzero(data[:-1] == 0xC2)
        bad[wide] |= (data[wide + 1] <= 0xA0) | (data[wide + 1] == 0xAD)  # what is no printable character of Latin-1
        begins = cuts(data)
        broken = _BREAK[data]
        bad[1:] |= broken[1:] & broken[:-1]
        bad[first] |= broken[first]
        last = edges[1:][edges[1:] > edges[:-1]] - 1
        bad[last] |= broken[last]
        whole[np.searchsorted(edges, np.flatnonzero(bad), "right") - 1] = True
        begins[1:] |= data[:-1] == 10
        begins[first] = True
        if whole.any():
            keep = ~np.repeat(whole, np.diff(edges))
            data, sizes = data[keep], np.where(whole, 0, np.diff(edges))
            begins, edges = begins[keep], np.append(0, np.cumsum(sizes))
            if not len(data):
                return [self.whole(t.decode("utf-8", "replace")) for t in texts]
        ids, at = laid_out(data, np.flatnonzero(begins), edges, self.pieces.all)
        every, at = ids.tobytes(), (4 * at).tolist()
        return [self.whole(t.decode("utf-8", "replace")) if w and t else every[a:b] for t, w, a, b in zip(texts, whole, at[:-1], at[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file; a worker process keeps the last one alone."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
