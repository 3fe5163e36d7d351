"""Merkle manifest and WARC against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.common import shared_dir
from tidemark.llm.merkle import FIELDS, build_manifest, op12_merkle_manifest
from tidemark.llm.warc import chain_ends, op13_warc, read_warc, write_warc


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(tree: list[list[str]], i: int, now: str) -> tuple[str, str]:
    """Siblings end to end and the root that `now` at place i gives."""
    path = ""
    for level in tree[:-1]:
        a = i - i % 8
        run = level[a : a + 8]
        path += "".join(run[: i - a] + run[i - a + 1 :])
        now = h(*run[: i - a], now, *run[i - a + 1 :])
        i //= 8
    return path, now


def manifest_by_force(rows: list[dict]) -> Counter:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r: h(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in FIELDS))
    groups = defaultdict(list)
    for r in rows:
        other = r if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 or r["text"] is None else {**r, "text": r["text"].translate(lower)}
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(other), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = Counter()
    for at, g in enumerate(names):
        for i, (_, _, own, other, doc) in enumerate(sorted(groups[g])):
            path, below = climb(trees[g], i, other)
            more, root = climb(top, at, below)
            out[doc, own, trees[g][-1][0], top[-1][0], h(path + more), root, root == top[-1][0]] += 1
    return out


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def test_manifest(spark, docs, no_docs, tmp_path, monkeypatch):
    rng = random.Random(1)
    more = spark.createDataFrame([(1000 + i, None if i % 50 == 3 else f"Text {rng.random()}", rng.choice(["en"] * 6 + ["de", None, "zz", "", "é"]), None if i % 7 == 0 else "S", i if i % 5 else None) for i in range(700)], "doc_id long, text string, lang string, source string, n_chars int")
    many = docs.select("doc_id", "text", "lang", "source", "n_chars").union(more).union(spark.createDataFrame([(5, "alone", "only", "s", 5)], more.schema))
    for i, (df, held) in enumerate(((many, 50_000), (many.withColumns({"tree": F.lit(1), "idx": F.lit("x"), "leaf": F.lit("y"), "other": F.lit("z")}), 40), (many.where("lang = 'only'"), 50_000), (no_docs, 50_000))):
        monkeypatch.setattr(merkle, "HELD", held)  # with few nodes held, low levels are joined by shuffles
        df.repartition(5).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        got = op12_merkle_manifest(spark, f"{tmp_path}/{i}")
        assert Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == manifest_by_force(rows_of(df))


def test_a_run_of_one_is_hashed_alone(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(65)], "doc_id long, text string, lang string, source string, n_chars int")
    tree = build_manifest(docs)
    assert [level.count() for level in tree.levels] == [65, 9, 2, 1] and tree.n_trees == 1
    assert tree.root == manifest_by_force(rows_of(docs)).popitem()[0][3]


def record(page: int, payload: str) -> str:
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(payload.encode())}\r\n\r\n{payload}\r\n\r\n"


def pages_by_force(rows) -> Counter:
    first: dict[str, int] = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    out = Counter()
    for page, _, html in rows:
        to = first.get(html or "", page) if page is not None and len((html or "").encode()) >= 100 else page
        out[page, len((html or "").encode()), h(html or ""), "revisit" if to != page else "response", to if to != page else None] += 1
    return out


def hostile_pages() -> list[tuple]:
    rng = random.Random(2)
    inside = record(7, "a whole record that lies in a payload")
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://c\r\nWARC-Type: x", "short"), (4, "d", "é" * 50), (5, "e", "é" * 50), (6, "f", "x" * 99), (7, "g", "x" * 99), (None, "h", "y" * 200), (8, "i", "y" * 200), (9, "j", "y" * 200), (9, "j", "y" * 200)]
    rows += [(20, "k", inside * 40), (21, "l", "before " + inside + "WARC/1.1\r\n" * 9 + "\r\n\r\n"), (22, "m", record(1, "z" * 10**6)[:90]), (23, "n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (24, "o" * 200_000, "a long url " * 30)]
    rows += [(100 + i, f"http://x/{i}", rng.choice((inside, "q" * rng.randrange(400), inside[:60] + "\r\n\r\n" * 3, "the most common payload " * 9))) for i in range(300)]
    return rows


def test_warc(spark, tmp_path, monkeypatch):
    """Payloads that hold records and pieces of them, ranges far smaller than a record, a few files and many."""
    from tidemark.llm import warc

    rows = hostile_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_digest", F.lit("clash"))
    want = pages_by_force(rows)
    for parts, size, held in ((1, 700, 50_000), (1, 1 << 20, 2), (7, 10_000, 50_000)):
        monkeypatch.setattr(warc, "HELD", held)
        folder = shared_dir(spark, "test-warc")
        write_warc(pages.coalesce(1).repartition(parts), folder)
        got = read_warc(spark, folder, size).collect()
        assert Counter((r.page_id, r.full_bytes, r.digest, r.record_type, r.refers_to) for r in got) == want
        assert all(hashlib.sha256(r.payload).hexdigest() == r.digest and len(r.payload) == r.full_bytes for r in got if r.record_type == "response")
        assert {(r.page_id, r.url) for r in got} == {(i, u and u.replace("\r", "%0D").replace("\n", "%0A")) for i, u, _ in rows}
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = op13_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in out.collect()) == want
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op13_warc(spark, f"{tmp_path}/none").count() == 0


def test_chain_ends():
    import numpy as np

    places, after = np.array([0, 10, 15, 30, 40]), np.array([10, 30, 99, 50, 60])
    assert chain_ends(places, after).tolist() == [50, 50, 99, 50, 60]
    assert chain_ends(places[:0], after[:0]).tolist() == []


def test_a_cut_file_gives_its_whole_records(spark, tmp_path):
    data = "".join(record(i, "payload " * i) for i in range(20)).encode()
    for name, content in (("cut", data[:-3]), ("noise", data + b"noise WARC/1.1\r\n"), ("empty", b"")):
        (tmp_path / f"{name}.warc").write_bytes(content)
    got = Counter((r.path.rsplit("/", 1)[1], r.page_id) for r in read_warc(spark, str(tmp_path), 300).collect())
    assert got == Counter([*(("cut.warc", i) for i in range(19)), *(("noise.warc", i) for i in range(20))])
