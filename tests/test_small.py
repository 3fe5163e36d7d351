"""Scalar functions and small operators, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.filters import Filters
from tidemark.operators.grouping import abbreviate_home, anchorable, changes, find, worktree
from tidemark.operators.parents import cycles, depths, lanes
from tidemark.operators.pricing import clear_price, redundant_overrides, set_price
from tidemark.operators.redact import publish_spans, unclassified


def one(spark, make, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_paths(spark):
    paths = ["/a/b/../c/./d/", "C:\\Users\\Me\\x", "\\\\srv\\share\\d", "rel/../up", "/", "a\\b"]
    assert one(spark, S.path_key, paths) == ["/a/c/d", "c:/users/me/x", "//srv/share/d", "up", "/", "a/b"]
    assert one(spark, S.windows_path, paths) == [False, True, True, False, False, True]
    assert one(spark, S.basename, ["/a/b", "C:\\x\\y"]) == ["b", "y"]
    pairs = [("/a", "/a/b", True), ("/a", "/ab", False), ("/a", "/a", False), ("/", "/a", True)]
    df = spark.createDataFrame(pairs, "p string, c string, want boolean").select("want", S.is_ancestor(F.col("p"), F.col("c")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_roots_that_may_not_anchor(spark):
    no = ["/", ".", "/root", "/home", "/home/u", "/users/me", "c:/", "c:/users", "c:/users/me", "//srv/share"]
    yes = ["/srv", "/home/u/x", "/users/me/code", "c:/users/me/x", "c:/work", "//srv/share/x", "/root/x"]
    assert one(spark, anchorable, no + yes) == [False] * len(no) + [True] * len(yes)
    shapes = one(spark, worktree, ["/h/Repo/.claude/worktrees/w", "/h/.t3/worktrees/Lib/a/b", "/h/conductor/workspaces/x/y", "/h/.t3/worktrees/x", "/h/x"])
    assert [s and tuple(s) for s in shapes] == [("repo", "/h/Repo"), ("lib", None), ("x", None), None, None]
    assert one(spark, lambda c: abbreviate_home(c, "/home/u"), ["/home/u", "/home/u/x", "/home/user"]) == ["~", "~/x", "/home/user"]


def test_filters_from_a_query():
    f = Filters.from_query({"project": ["1", ""], "source": ["a", "b"], "from": ["5", "7"], "role": ["human"], "t": ["x"]})
    assert f == Filters(projects=("1",), sources=("a", "b"), ts_from=7, role="human")
    assert Filters.from_query({"role": ["all"], "to": [""]}) == Filters()
    for bad in ({"from": ["x"]}, {"role": ["robot"]}):
        with pytest.raises(ValueError):
            Filters.from_query(bad)


def test_depths(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 5), *((100 + i, 99 + i if i else 3) for i in range(20))]
    got = {r.id: r.depth for r in depths(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert {i: got[i] for i in range(1, 8)} == {1: 0, 2: 1, 3: 2, 4: 0, 5: None, 6: None, 7: None} and got[119] == 22


def test_upkeep(spark):
    kind = "model string, effective_from long, origin string, input double"
    prices = spark.createDataFrame([("a", 0, "litellm", 1.0), ("a", 5, "manual", 2.0), ("b", 0, "litellm", 3.0)], kind)
    manual = spark.createDataFrame([("a", 0, "manual", 9.0), ("c", 0, "manual", 4.0)], kind)
    done = set_price(prices, manual)
    assert sorted(map(tuple, done.collect())) == [("a", 0, "manual", 9.0), ("a", 5, "manual", 2.0), ("b", 0, "litellm", 3.0), ("c", 0, "manual", 4.0)]
    assert clear_price(done, "a").count() == 2 and clear_price(done, "a", 5).count() == 3 and clear_price(done, "b").count() == 4
    assert [r.model for r in redundant_overrides(spark.createDataFrame([("a", 0, "o", 7.0), ("a", 9, "o", 1.0), ("b", 0, "o", 8.0)], kind), prices.where("origin = 'litellm'"), ["input"]).collect()] == ["a"]
    names = spark.createDataFrame([(1, "Alpha", "/x/alpha"), (2, "Alphabet", "/x/100%_a"), (3, None, "/y")], "id int, name string, path string")
    ids = lambda spec: sorted(r.id for r in find(names, spec, "name", "path").collect())
    assert ids("ALPHA") == [1] and ids("alph") == [1, 2] and ids("100%_") == [2] and ids("nothing") == []
    assert changes(prices.select(F.col("input").alias("project_id"), F.col("model").alias("group_id")), prices.select(F.col("input").alias("project_id"), F.col("model").alias("group_id"))).first() == (0, 0, 0, 0, 0)


def test_publication(spark):
    spans = spark.createDataFrame([("s1", "x", "t", 0, 5, 2, 1, False, True), ("s2", "x", "t", 7, 9, 2, 2, True, False)], "span_id string, session_id string, thread_id string, started_at long, ended_at long, event_count long, project_id long, is_subagent boolean, attended boolean")
    out = publish_spans(spans, spark.createDataFrame([(1, "r"), (1, "r")], "project_id long, repo_id string")).collect()
    assert [(r.span_id, r.repo_id, r.role) for r in out] == [("s1", "r", "human")]
    assert unclassified(spans, {"span_id", "gone"}, set(spans.columns) - {"span_id", "attended"}) == ({"attended"}, {"gone"})


def test_deep_chains_and_cycles(spark):
    """A chain of 1,000, a cycle with threads below it, a thread that is its own parent."""
    rows = [(i, i - 1 if i else None) for i in range(1000)] + [(2000, 2002), (2001, 2000), (2002, 2001), (2003, 2002), (2004, 2003), (3000, 3000)]
    threads = spark.createDataFrame(rows, "id long, parent_id long").repartition(3)
    got = {r.id: r.depth for r in depths(threads).collect()}
    assert got == {**{i: i for i in range(1000)}, **{i: None for i in (2000, 2001, 2002, 2003, 2004, 3000)}}
    assert {r.id: r.cycle for r in cycles(threads).collect()} == {2000: 2000, 2001: 2000, 2002: 2000, 3000: 3000}


def test_lanes_follow_their_parents(spark):
    """Children under their parent, by first start; orphans after the roots and one level in; a parent of another session is none; a chain of 200."""
    threads = [(1, None, False, 7), (2, 1, True, 7), (3, 1, True, 7), (4, 2, True, 7), (5, None, False, 7), (6, 99, True, 7), (7, 6, True, 7), (8, 5, True, 8), (9, None, False, 7), (20, 21, True, 7), (21, 20, True, 7)]
    starts = {1: 10, 2: 30, 3: 20, 4: 25, 5: 5, 6: 1, 7: 2, 8: 3, 20: 1, 21: 2}
    threads += [(1000 + i, 999 + i if i else None, i > 0, 9) for i in range(200)]
    starts |= {1000 + i: 500 - i for i in range(200)}
    spans = spark.createDataFrame(list(starts.items()), "thread_id long, started_at long")
    got = lanes(spark.createDataFrame(threads, "id long, parent_id long, is_subagent boolean, session_id long"), spans).collect()
    order = lambda s: [(r.id, r.depth) for r in sorted((r for r in got if r.session_id == s), key=lambda r: r.lane)]
    assert order(7) == [(5, 0), (1, 0), (3, 1), (2, 1), (4, 2), (6, 1), (7, 2), (20, None), (21, None)]
    assert order(8) == [(8, 1)] and order(9) == [(1000 + i, i) for i in range(200)]
