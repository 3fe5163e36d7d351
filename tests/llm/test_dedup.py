"""Line dedup, MinHash and suffix dedup against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.common import components
from tidemark.llm.line_dedup import build_mph, dedup_lines, mph_slots
from tidemark.llm.minhash import drop_near_documents, estimate, near_documents, odd_sketches, shingles, signatures
from tidemark.llm.substring import LENGTH, STARTS, drop_repeats, sort_bucket

SPACE = " \t\n\r\x0b\x0c"


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text: str | None) -> list[str]:
    out, now = [], ""
    for c in lower(text or "") + " ":
        if c in SPACE:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out


def closed(nodes, links) -> dict:
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_lines(docs, texts, no_docs):
    held = defaultdict(set)
    for i, t in texts:
        if i is not None:
            for line in (t or "").split("\n"):
                held[lower(line.strip(SPACE))].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    assert gone
    want = Counter()
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(lower(x.strip(SPACE)), i) == i]
        want[i, (t if len(kept) == len(lines) else "\n".join(kept)), len(lines), len(lines) - len(kept)] += 1
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    assert Counter((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in out.collect()) == want
    assert dedup_lines(no_docs).count() == 0
    named = docs.select("*", *(F.lit(7).alias(c) for c in ("row", "keys", "done", "_n_lines", "_done", "_gone_id")))
    out = dedup_lines(named)
    assert out.columns == [*(c for c in named.columns if c != "_n_lines"), "_n_lines", "_n_dropped"]
    assert Counter((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in out.collect()) == want


def test_a_line_that_most_documents_hold(spark, monkeypatch):
    """Shards of few keys, copied to several salts."""
    from tidemark.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    monkeypatch.setattr(line_dedup, "PROBES", 50)
    hot, rng = "the very same line in nearly every document of them", random.Random(3)
    rows = [(i, f"{hot}\nown {i} {'x' * 60}\nshared {rng.randrange(40)} {'y' * 50}") for i in range(300)]
    count = Counter(x for _, t in rows for x in t.split("\n"))
    last = {x: i for i, t in rows for x in t.split("\n")}
    want = {i: "\n".join(x for x in t.split("\n") if count[x] < 5 or last[x] == i) for i, t in rows}
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, (5000, 2))
    sizes, bits = build_mph(keys[:, 0], keys[:, 1])
    assert sorted(mph_slots(sizes, bits, keys[:, 0], keys[:, 1])) == list(range(5000))
    assert len(bits) < 8 * 5000
    assert not len(build_mph(keys[:0, 0], keys[:0, 1])[1])


def near_by_force(texts, n: int):
    sets = [(i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if (w := words(t)) else set()) for i, t in texts]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    return sets, closed({i for i, _ in sets if i is not None}, links)


def test_near_copies(docs, texts, no_docs):
    for n in (4, 5):
        sets, part = near_by_force(texts, n)
        want = Counter((i, len(s), part.get(i), None if i is None else part[i] == i) for i, s in sets)
        got = near_documents(docs, words=n)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == want
    assert near_documents(no_docs).count() == 0
    left = drop_near_documents(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, _ in texts if i is None or part[i] == i)


def test_many_near_copies(spark):
    """A group whose members are not all linked, over several blocks, and a chain."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(own)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(2000 + i, " ".join(chain[8 * i : 8 * i + 150])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_by_force(rows, 5)[1]


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for share in (0.6, 0.8, 0.95):
        both = round(1000 * 2 * share / (1 + share) / 1)
        other = np.concatenate([base[:both], rng.integers(0, 2**63, 1000 - both, dtype=np.uint64)])
        a, b = odd_sketches(signatures([base, other]))
        assert abs(estimate(np.array([np.unpackbits(a ^ b).sum()]))[0] - both / (2000 - both)) < 0.13
    assert len(shingles(b"a b", 5)) == 1 and not len(shingles(b" \n", 5))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closed({n for x in links for n in x if x[0] != x[1]}, links)
    assert got == want


def repeats_by_force(texts):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in texts]
    for i, b in data:
        if i is not None:
            seen.update(b[k : k + LENGTH] for k in range(len(b) - LENGTH + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - LENGTH + 1):
                if seen[b[k : k + LENGTH]] > 1:
                    gone[k : k + LENGTH] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), int(gone.sum()), spans))
    return Counter(out)


def test_repeats(docs, texts, no_docs):
    got = drop_repeats(docs)
    assert Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()) == repeats_by_force(texts)
    assert drop_repeats(no_docs).count() == 0


def test_repeats_of_a_hot_passage(spark, monkeypatch):
    """Many contexts of one passage, each cut at another place; with a low bound the buckets are split into pieces, and these into single suffixes."""
    from tidemark.llm import substring

    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(320)
    rows = [(i, letters(rng.randrange(200)) + passage[rng.randrange(100) : 320 - rng.randrange(100)] + letters(rng.randrange(200))) for i in range(150)]
    rows += [(900, "z" * 1000), (901, "zy" * 300), (902, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeats_by_force(rows)
    for hot in (1_000, 20):
        monkeypatch.setattr(substring, "HOT", hot)
        assert Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in drop_repeats(df).collect()) == want


def test_bucket_without_repeats():
    a, b = bytes(range(200)), bytes(range(1, 201))
    out = sort_bucket([a, b, a], np.array([1, 1, 2]), np.array([10, 10, 10]), np.array([10, 10, 10]), np.array([1, 1, 1]))
    assert not out.any()


def test_sorted_buckets_against_every_pair():
    """Suffixes at any places, with ties far longer than the cover's period, some of them periodic."""
    rng = np.random.default_rng(6)
    base = bytes(rng.integers(97, 99, 700).astype(np.uint8))
    for texts in ([base], [base, base[40:] + b"q" * 40, b"ab" * 350, b"z" * 700], [bytes(rng.integers(0, 256, 700).astype(np.uint8))]):
        contexts, left, right = [], [], []
        for _ in range(40):
            text, a, n = texts[rng.integers(len(texts))], int(rng.integers(0, 300)), int(rng.integers(1, STARTS + 1))
            left.append(int(rng.integers(n - 1, STARTS)))
            right.append(left[-1] - n + 1)
            contexts.append(text[a : a + n - 1 + LENGTH])
        bucket, counts = rng.integers(0, 4, 40), rng.integers(1, 3, 40)
        seen = Counter()
        for c, b, n in zip(contexts, bucket, counts):
            for k in range(len(c) - LENGTH + 1):
                seen[b, c[k : k + LENGTH]] += n
        out = sort_bucket(contexts, bucket, np.array(left), np.array(right), counts)
        for i, c in enumerate(contexts):
            want = np.zeros(STARTS, bool)
            for k in range(len(c) - LENGTH + 1):
                want[left[i] - k] = seen[bucket[i], c[k : k + LENGTH]] > 1
            assert (out[i] == want).all()
