"""Every query of the catalogue with SQL beside it gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans import endpoint_queries, team_queries  # noqa: F401  register their queries
from tidemark.plans import endpoints
from tidemark.plans.queries import ORACLE_SQL, QUERIES
from tidemark.plans.views import act_event, corpus

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(out.columns)
    want = Counter(tuple(map(plain, r)) for r in got.fetchall())
    assert Counter(tuple(plain(r[n]) for n in names) for r in out.collect()) == want


def test_every_query_has_sql_or_a_test_of_its_own():
    """path_ancestor_ladder is held against the rules one by one in test_grouping."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"model_lookup_fuzzy", "path_ancestor_ladder"}


def test_model_lookup(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    want = set()
    for r in parts:
        key = r.p_brand.replace("#", "-").lower()
        head, tail = (("", "-mini"), ("", "-20240101"), ("", ""), ("eu-", "-large"))[r.p_size % 4]
        if tail != "-mini":  # another tier is another model
            want.add((f"acme/{head}{key}{tail}", key, not head))  # a name that only contains the key is no exact one
    assert Counter(map(tuple, QUERIES["model_lookup_fuzzy"](spark, SF).select("model", "key", "exact").collect())) == Counter(want)


def test_fork_replay(spark):
    """A child's leading rows that repeat its parent's at the same places go; the first that differs ends the replay."""
    threads: dict[int, list] = {}
    for r in act_event(spark, SF).select("thread_id", "ts", "event_id", "input_tokens").collect():
        threads.setdefault(r.thread_id, []).append((r.ts, r.event_id, r.input_tokens % 20))
    usage = {k: [u for _, _, u in sorted(v)] for k, v in threads.items()}
    want = Counter()
    for k, own in usage.items():
        parent = k - k % 4
        if k == parent:
            continue
        n = 0
        for a, b in zip(own, usage.get(parent, [])):
            if a != b:
                break
            n += 1
        want.update((k, parent, at + 1, u) for at, u in enumerate(own) if at >= n)
    got = Counter((r.thread_id, r.parent_id, r["at"], r.usage) for r in QUERIES["fork_replay"](spark, SF).collect())
    assert got == want and sum(got.values()) < sum(len(v) for k, v in usage.items() if k % 4)


def test_endpoints_of_empty_tables(spark):
    c = corpus(spark, SF)
    empty = replace(c, events=c.events.limit(0))
    for name in endpoints.ENDPOINTS:
        out = endpoints.endpoint(name, empty)
        for part, df in (out if isinstance(out, dict) else {"": out}).items():
            rows = df.collect()
            if name in ("summary", "concurrency") or part == "totals":
                assert len(rows) == 1 and not any(rows[0])
            elif name != "meta":
                assert rows == []
    with pytest.raises(KeyError):
        endpoints.endpoint("other", c)


def test_timeline_above_its_limit(spark):
    c = corpus(spark, SF)
    rows = endpoints.timeline(c, limit=3).collect()
    widths = sorted((r.ended_at - r.started_at for r in endpoints.timeline(c).collect()), reverse=True)
    assert sorted((r.ended_at - r.started_at for r in rows), reverse=True) == widths[:3] and all(r.truncated for r in rows)
