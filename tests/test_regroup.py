"""Groups and projects after a plan: created, refreshed, kept, swept; pins hold."""

from __future__ import annotations

import pytest

from tidemark.operators import regroup as R

GROUP = "group_id string, name string, origin string, match_key string, remote_url string, forge string, owner string, repo string, web_url string, created_at long, updated_at long"


def _group(i, name="n", origin="remote", url=None):
    return (i, name, origin, "k", url, None, None, None, None, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    groups = spark.createDataFrame([_group("kept", "By Hand", url="u"), _group("stale", "Mine", url="old"), _group("empty"), _group("manual", origin="manual"), _group("pinned")], GROUP)
    projects = spark.createDataFrame([("p1", "kept", False), ("p2", "stale", False), ("p3", "empty", False), ("p4", "pinned", True), ("p5", None, False), ("p6", "kept", False)], "project_id string, group_id string, group_pinned boolean")
    plans = spark.createDataFrame([_group("kept", "other name", url="u"), _group("stale", "other name", url="new"), _group("new", "New", url="w"), _group("unused")], GROUP).drop("created_at", "updated_at")
    to = spark.createDataFrame([("p1", "kept"), ("p2", "stale"), ("p3", "new"), ("p5", "new")], "project_id string, group_id string")
    return groups, projects, plans, to


def test_a_plan_applied(world):
    groups, projects, plans, to = world
    g, p = R.applied(groups, projects, plans, to, 9)
    assert {r.group_id: (r.name, r.remote_url, r.created_at, r.updated_at) for r in g.collect()} == {"kept": ("By Hand", "u", 1, 1), "stale": ("Mine", "new", 1, 9), "new": ("New", "w", 9, 9), "manual": ("n", None, 1, 1), "pinned": ("n", None, 1, 1)}
    assert {r.project_id: r.group_id for r in p.collect()} == {"p1": "kept", "p2": "stale", "p3": "new", "p4": "pinned", "p5": "new", "p6": None}
    assert {r.group_id: r.action for r in R.actions(groups, plans, p).collect()} == {"kept": "keep", "stale": "refresh", "empty": "sweep", "manual": "keep", "pinned": "keep", "new": "create", "unused": "skip"}
    again, same = R.applied(g, p, plans, to, 99)
    assert sorted(again.collect()) == sorted(g.collect()) and sorted(map(str, same.collect())) == sorted(map(str, p.collect()))


def test_pins(world):
    groups, projects, plans, to = world
    bad = to.union(to.sparkSession.createDataFrame([("p4", "kept")], to.schema))
    with pytest.raises(R.Refused, match="p4"):
        R.applied(groups, projects, plans, bad, 9)
    g, p = R.by_hand(groups, projects, ["p1", "p5"], "Work", 7)
    (own,) = [r for r in g.collect() if r.name == "Work"]
    assert (own.origin, own.created_at) == ("manual", 7) and {r.project_id for r in p.where(p.group_id == own.group_id).collect()} == {"p1", "p5"}
    assert R.by_hand(g, p, ["p6"], "work", 8)[0].count() == g.count()  # the same group
    g, p = R.applied(g, p, plans, to.where("project_id NOT IN ('p1', 'p5')"), 9)
    assert {r.project_id: r.group_id for r in p.collect()}["p1"] == own.group_id
    free = R.released(p, ["p1", "p5"])
    after = R.applied(R.renamed(g, own.group_id, "Old work", 10), free, plans, to, 11)
    assert {r.project_id: r.group_id for r in after[1].collect()}["p1"] == "kept" and {r.name for r in after[0].where("origin = 'manual'").collect()} == {"n", "Old work"}
