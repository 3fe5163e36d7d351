"""A causal self-attention language model over the subword ids of words, in numpy.

A token is a word or an end, and enters as the sum of its subword ids' vectors. One layer of masked self-attention over a window of tokens gives h. The next
token is predicted from h by a two-level softmax: first its class, then its cell in the class; inside a cell, tokens keep the shares of their
counts. Words that are not in the vocabulary are one class; they are spelled id by id, each id and the final stop again predicted by a two-level
softmax, from h and the vector of the id before. Classes and cells have about equal counts, in the order given, so each frequent token has a
cell of its own. The biases start at the counts' logs: an untrained model gives every token the share of its count.

So p(token | context) sums to 1 over the vocabulary and all spellings.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.tokens import spans

DIM, WINDOW, STRIDE = 16, 32, 24
#: Classes, the last of which is for spelled tokens (among ids: is empty), and cells of a class.
CLASSES, CELLS = 64, 32
#: Windows of a training step, at first and after EARLY ids.
BATCHES, EARLY = (128, 512), 2_000_000
SPELLED = CLASSES - 1


class Cells:
    """Class and cell of each of n symbols, the log of its share in the cell, and the biases that give each class and cell its share of the counts."""

    def __init__(self, counts: np.ndarray, spelled: float = 0.0):
        """counts: of the symbols, in an order that puts like ones together; spelled: tokens that are spelled instead."""
        mass = np.asarray(counts, float)
        n, total = len(mass), float(mass.sum()) or 1.0
        self.cls = np.minimum((np.cumsum(mass) - mass / 2) / total * SPELLED, SPELLED - 1).astype(np.int64)
        of_class = np.bincount(self.cls, mass, CLASSES)
        before = np.concatenate([[0.0], np.cumsum(of_class)])[self.cls]
        self.cell = np.minimum((np.cumsum(mass) - mass / 2 - before) / np.maximum(of_class[self.cls], 1e-9) * CELLS, CELLS - 1).clip(0).astype(np.int64)
        of_cell = np.bincount(self.cls * CELLS + self.cell, mass, CLASSES * CELLS).reshape(CLASSES, CELLS)
        self.share = np.log(np.maximum(mass, 1e-30) / np.maximum(of_cell[self.cls, self.cell], 1e-30)).astype(np.float32) if n else np.zeros(0, np.float32)
        both = of_class.copy()
        both[SPELLED] = spelled
        # a class or cell that no symbol is in gets (almost) nothing; with no counts at all, all tokens are spelled
        self.bias = np.log(np.maximum(both, 1e-9 * max(both.sum(), 1.0)) / max(both.sum(), 1e-9)).clip(-30).astype(np.float32)
        if not both.sum():
            self.bias = np.where(np.arange(CLASSES) == SPELLED, 0.0, -30.0).astype(np.float32)
        self.cell_bias = np.log(np.maximum(of_cell, 1e-9 * np.maximum(of_class, 1e-9)[:, None]) / np.maximum(of_class, 1e-9)[:, None]).clip(-30).astype(np.float32)


def init(words: Cells, ids: Cells, size: int, seed: int = 3) -> dict[str, np.ndarray]:
    """E: vector of each id as input; P: of each place; Q, K, V: attention; A, a: classes of tokens; B, b: their cells; S: vector of the id before in a
    spelling (the last: of its beginning); C, c and D, d: classes and cells of ids."""
    rng = np.random.default_rng(seed)
    shapes = {"E": (size, DIM), "P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "S": (size + 1, DIM)}
    m = {k: (rng.standard_normal(s) * (0.2 if k in "EPS" else DIM**-0.5)).astype(np.float32) for k, s in shapes.items()}
    m |= {k: np.zeros(s, np.float32) for k, s in (("A", (DIM, CLASSES)), ("B", (CLASSES, DIM, CELLS)), ("C", (DIM, CLASSES)), ("D", (CLASSES, DIM, CELLS)))}
    return m | {"a": words.bias.copy(), "b": words.cell_bias.copy(), "c": ids.bias.copy(), "d": ids.cell_bias.copy()}


def windows(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of the given input lengths laid end to end (each with one token more): per window the place of its first token, its text, how many
    inputs at its beginning are context only, and how many it scores. Windows start stride apart and hold up to WINDOW inputs, so
    that WINDOW - stride of them overlap; every input is scored in one window."""
    n = np.maximum(1, -(-(lengths - (WINDOW - stride)) // stride)) * (lengths > 0)
    text = np.repeat(np.arange(len(lengths)), n)
    step = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride
    context = np.where(step > 0, WINDOW - stride, 0)
    first = np.repeat(np.cumsum(lengths + 1) - lengths - 1, n) + step
    return first, text, context, np.minimum(lengths[text] - step, WINDOW) - context


class Tokens:
    """Texts laid end to end as tokens, each text with an end before it: ids of all tokens, first id and number of ids of each, its class (SPELLED or the
    vocabulary's), cell and log share."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, cls: np.ndarray, cell: np.ndarray, share: np.ndarray):
        self.ids, self.first, self.size = ids, first, np.diff(np.append(first, len(ids)))
        self.cls, self.cell, self.share = cls, cell, share


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


#: Ids of a token that are added one place after the other, for all tokens at once; longer ones are summed by themselves.
_PLACES = 16


def _inputs(m: dict[str, np.ndarray], t: Tokens, at: np.ndarray) -> np.ndarray:
    """Sum of the ids' vectors of the tokens at `at`."""
    first, size = t.first[at], t.size[at]
    order = np.argsort(_PLACES - np.minimum(size, _PLACES).astype(np.uint8), kind="stable")  # tokens of more ids first
    first, more = first[order], len(at) - np.cumsum(np.bincount(np.minimum(size, _PLACES), minlength=_PLACES + 1))
    x = m["E"].take(t.ids.take(first), 0)
    for k in range(1, _PLACES):
        n = more[k]
        if not n:
            break
        x[:n] += m["E"].take(t.ids.take(first[:n] + k), 0)
    out = np.empty_like(x)
    out[order] = x
    longer = np.flatnonzero(size > _PLACES)
    if len(longer):
        own = size[longer]
        out[longer] = np.add.reduceat(m["E"].take(t.ids.take(spans(t.first[at[longer]], own)), 0), np.cumsum(own) - own)
    return out


def forward(m: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """x: windows x WINDOW x DIM inputs. Returns q, k, v, attention and h, in which each input has seen those before it and itself."""
    flat = x.reshape(-1, DIM)
    q, k, v = ((flat @ w).reshape(x.shape) for w in (m["Q"] * np.float32(DIM**-0.5), m["K"], m["V"]))
    a = np.matmul(q, k.transpose(0, 2, 1))
    np.minimum(a, 60, out=a)
    a += _MASK
    np.exp(a, out=a)
    a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(len(x), WINDOW, 1)
    h = np.matmul(a, v)
    h += x
    return q, k, v, a, np.tanh(h, out=h)


def _exp(z: np.ndarray, at: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp of each row, in place, its sums, ln p of the column `at`). steep: whether a value may be above 60."""
    if steep:
        np.minimum(z, 60, out=z)
    own = z.ravel().take(np.arange(len(z)) * z.shape[1] + at)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    return z, total, own - np.log(total)


class _Choice:
    """One two-level prediction for rows of h, which lie from -1 to 1: classes by (A, a), cells by (B, b); rows of the class SPELLED have no cell."""

    def __init__(self, m: dict[str, np.ndarray], names: str, h: np.ndarray, cls: np.ndarray, cell: np.ndarray):
        self.names, self.cls = names, cls
        A, a, B, b = (m[n] for n in names)
        self.A, self.B = np.concatenate([A, a[None]]), np.concatenate([B, b[:, None]], 1)  # with the biases as the weights of a last input, 1
        self.h = np.ones((len(h), DIM + 1), np.float32)
        self.h[:, :DIM] = h
        self.p, self.total, self.logs = _exp(self.h @ self.A, cls, np.abs(self.A).sum(0).max() > 60)
        self.order = np.argsort(cls.astype(np.uint8), kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(cls, minlength=CLASSES)))
        self.n = edges[SPELLED]
        order = self.order[: self.n]
        self.parts = [(c, s, e) for c, (s, e) in enumerate(zip(edges[:SPELLED].tolist(), edges[1 : SPELLED + 1].tolist())) if s < e]
        self.hs, self.cell = self.h.take(order, 0), cell[order]
        z = np.empty((len(order), CELLS), np.float32)
        for c, s, e in self.parts:
            np.dot(self.hs[s:e], self.B[c], out=z[s:e])
        self.p2, self.total2, logs = _exp(z, self.cell, np.abs(self.B).sum(1).max() > 60)
        self.logs[order] += logs

    def back(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of -ln p by h and by the weights."""
        self.p /= self.total[:, None]
        self.p2 /= self.total2[:, None]
        self.p.ravel()[np.arange(len(self.p)) * CLASSES + self.cls] -= 1
        self.p2.ravel()[np.arange(len(self.p2)) * CELLS + self.cell] -= 1
        own, gB = np.zeros((len(self.h), DIM), np.float32), np.zeros_like(self.B)
        for c, s, e in self.parts:
            np.dot(self.p2[s:e], self.B[c, :DIM].T, out=own[s:e])
            np.dot(self.hs[s:e].T, self.p2[s:e], out=gB[c])
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(place))
        dh, gA = own.take(place, 0), self.h.T @ self.p
        dh += self.p @ self.A[:DIM].T
        return dh, dict(zip(self.names, (gA[:DIM], gA[DIM], gB[:, :DIM], gB[:, DIM])))


#: Rows of a class that are predicted together in scoring; columns of a product that are its classes and its cells.
_ROWS = 1024
_BOTH = np.repeat(np.eye(2, dtype=np.float32), [CLASSES, CELLS], 0)


def _logs(m: dict[str, np.ndarray], names: str, h: np.ndarray, cls: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """ln p of each row's class and cell (see _Choice), class by class, each with one product for its classes and cells."""
    A, a, B, b = (m[n] for n in names)
    both = np.empty((CLASSES, DIM + 1, CLASSES + CELLS), np.float32)
    both[:, :DIM, :CLASSES], both[:, DIM, :CLASSES], both[:, :DIM, CLASSES:], both[:, DIM, CLASSES:] = A, a, B, b
    steep = np.abs(both).sum(1).max() > 60
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(cls, minlength=CLASSES))).tolist()
    own, cell = np.empty(len(h), np.float32), cell.take(order)
    x = np.ones((len(h), DIM + 1), np.float32)
    x[:, :DIM] = h.take(order, 0)
    place, space = np.arange(_ROWS) * (CLASSES + CELLS) + CLASSES, np.empty((_ROWS, CLASSES + CELLS), np.float32)
    for c in range(CLASSES):
        for s in range(edges[c], edges[c + 1], _ROWS):
            e = min(s + _ROWS, edges[c + 1])
            z = np.dot(x[s:e], both[c], out=space[: e - s])
            if steep:
                np.minimum(z, 60, out=z)
            got = z[:, c].copy()
            if c != SPELLED:
                got += z.ravel().take(place[: e - s] + cell[s:e])
            np.exp(z, out=z)
            total = np.log(z @ _BOTH)
            own[s:e] = got - total[:, 0]
            if c != SPELLED:
                own[s:e] -= total[:, 1]
    logs = np.empty_like(own)
    logs[order] = own
    return logs


def _spelling(t: Tokens, ids: Cells, rare: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For the tokens at `rare`: row (among them), id before (size for none), class, cell and log share of every symbol of their spellings, the stop (symbol size) included."""
    n = t.size[rare] + 1
    row = np.repeat(np.arange(len(rare)), n)
    begin = np.cumsum(n) - n
    symbol, before = np.full(len(row), size), np.full(len(row), size)
    inner = np.ones(len(row), bool)
    inner[begin + n - 1] = False
    symbol[inner] = t.ids[spans(t.first[rare], n - 1)]
    later = np.flatnonzero(inner) + 1
    before[later] = symbol[inner]
    return row, before, ids.cls[symbol], ids.cell[symbol], ids.share[symbol]


def score(m: dict[str, np.ndarray], ids: Cells, t: Tokens, lengths: np.ndarray, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """For every token but the ends before the texts: ln p of the token, or of being spelled, and ln p of its spelling, 0 for one of the vocabulary. lengths: inputs of
    each text, one less than its tokens."""
    size = len(m["E"])
    first, text, context, scored = windows(lengths, STRIDE)
    slots, n = np.arange(WINDOW), len(t.first)
    inputs, total = _inputs(m, t, np.arange(n)), int(lengths.sum())
    h, place, into, done = np.empty((total, DIM), np.float32), np.empty(total, np.int64), np.empty(total, np.int64), 0
    for i in range(0, len(first), batch):
        w = slice(i, i + batch)
        at = np.minimum(first[w][:, None] + slots, n - 1)
        x = inputs.take(at.ravel(), 0).reshape(*at.shape, DIM)
        x += m["P"]
        live = np.flatnonzero((slots >= context[w][:, None]) & (slots < (context[w] + scored[w])[:, None]))
        own = slice(done, done := done + len(live))
        h[own] = forward(m, x)[-1].reshape(-1, DIM).take(live, 0)
        place[own] = at.ravel().take(live)
        into[own] = place[own] - np.repeat(text[w], scored[w])
    logs, spells, target = np.empty(total, np.float32), np.zeros(total, np.float32), place + 1
    cls = t.cls[target]
    logs[into] = _logs(m, "AaBb", h, cls, t.cell[target]) + t.share[target]
    rare = np.flatnonzero(cls == SPELLED)
    if len(rare):
        row, before, cls, cell, share = _spelling(t, ids, target[rare], size)
        g = h.take(rare[row], 0)
        g += m["S"].take(before, 0)
        spells[into[rare]] = np.bincount(row, _logs(m, "CcDd", np.tanh(g, out=g), cls, cell) + share, len(rare))
    return logs, spells


def _sums(grads: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the rows of each run of grads; cut: where runs begin. Short runs are added one place after the other, for all at once."""
    n = np.diff(np.append(cut, len(grads)))
    out, left = grads.take(cut, 0), np.flatnonzero((n > 1) & (n <= _PLACES))
    for k in range(1, _PLACES):
        if not len(left):
            break
        out[left] += grads.take(cut.take(left) + k, 0)
        left = left[n.take(left) > k + 1]
    longer = np.flatnonzero(n > _PLACES)
    if len(longer):
        own = n[longer]
        out[longer] = np.add.reduceat(grads.take(spans(cut[longer], own), 0), np.cumsum(own) - own)
    return out


def _add_rows(w: np.ndarray, s: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """One Adagrad step of the rows (which may repeat) of w; s has each row's sum of mean squared gradients."""
    order = np.argsort(rows.astype(np.uint16) if len(w) <= 1 << 16 else rows, kind="stable")  # short numbers are sorted by their digits
    rows = rows[order]
    cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    g, own = _sums(grads.take(order, 0), cut), rows[cut]
    s[own] += (g * g) @ np.full(g.shape[1], 1 / g.shape[1], np.float32)
    w[own] -= g * (np.float32(rate) / np.sqrt(s[own] + np.float32(1e-8)))[:, None]


def train(state: dict, ids: Cells, t: Tokens, lengths: np.ndarray, rate: float = 0.1, batch: int = 0, seed: int = 3, still: str = "") -> dict[str, np.ndarray]:
    """One pass of Adagrad over all tokens of the texts (see score), in windows that do not overlap; returns the weights of state. batch: windows
    of a step, 0 for BATCHES; still: names of weights that stay as they are."""
    m, s, rng = state["m"], state["s"], np.random.default_rng(seed)
    size = len(m["E"])
    first, _, _, scored = windows(lengths, WINDOW)
    slots, scale, n = np.arange(WINDOW), np.float32(DIM**-0.5), len(t.first)
    order = rng.permutation(len(first))
    batch = batch or BATCHES[int(state["n"] >= EARLY)]
    state["n"] += len(t.ids)
    for i in range(0, len(order), batch):
        w = order[i : i + batch]
        at = np.minimum(first[w][:, None] + slots, n - 1)
        x = _inputs(m, t, at.ravel()).reshape(*at.shape, DIM)
        x += m["P"]
        q, k, v, a, h = forward(m, x)
        live = np.flatnonzero(slots < scored[w][:, None])  # slots behind a text's end take no part
        here = at.ravel().take(live)
        own, target = h.reshape(-1, DIM).take(live, 0), here + 1
        dh, grads = _Choice(m, "AaBb", own, t.cls[target], t.cell[target]).back()
        rare = np.flatnonzero(t.cls[target] == SPELLED)
        if len(rare):
            row, before, cls, cell, _ = _spelling(t, ids, target[rare], size)
            g = np.tanh(own.take(rare[row], 0) + m["S"].take(before, 0))
            dg, more = _Choice(m, "CcDd", g, cls, cell).back()
            dg *= 1 - g * g
            dh[rare] += _sums(dg, np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])))
            grads |= more
            if "S" not in still:
                _add_rows(m["S"], s["S"], before, dg, rate)
        back = np.zeros_like(h)
        back.reshape(-1, DIM)[live] = dh * (1 - own * own)
        da = np.matmul(back, v.transpose(0, 2, 1))
        dv = np.matmul(a.transpose(0, 2, 1), back)
        da *= a
        da -= a * (da.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(len(da), WINDOW, 1)
        dq, dk = np.matmul(da, k), np.matmul(da.transpose(0, 2, 1), q)
        flat_x, dq, dk, dv = x.reshape(-1, DIM), dq.reshape(-1, DIM) * scale, dk.reshape(-1, DIM), dv.reshape(-1, DIM)
        dx = back.reshape(-1, DIM) + dq @ m["Q"].T + dk @ m["K"].T + dv @ m["V"].T
        grads |= {"Q": flat_x.T @ dq, "K": flat_x.T @ dk, "V": flat_x.T @ dv, "P": dx.reshape(x.shape).sum(0)}
        for name, grad in grads.items():
            if name not in still:
                s[name] += grad * grad
                m[name] -= np.float32(rate) * grad / np.sqrt(s[name] + np.float32(1e-8))
        if "E" not in still:
            _add_rows(m["E"], s["E"], t.ids[spans(t.first[here], t.size[here])], dx.take(np.repeat(live, t.size[here]), 0), rate)
    return m


def begin(m: dict[str, np.ndarray], spent: float = 1e-3, sums: dict[str, np.ndarray] | None = None, n: int = 0) -> dict:
    """State of train() at the weights m, which are copied: weights, Adagrad's sums (spent at first, or those given), one for each row of E and S, and the
    number of ids trained on before."""
    fresh = {k: np.full(len(v) if k in "ES" else v.shape, spent, np.float32) for k, v in m.items()}
    return {"m": {k: v.copy() for k, v in m.items()}, "s": {k: v.copy() for k, v in (sums or fresh).items()}, "n": n}
