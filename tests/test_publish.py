"""Provenance, the audit, and the refusal before the first write."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import publish as P
from tidemark.operators.lineage import origins

PATH, LOOSE = "/Users/alice/Coding/widget", "/Users/alice/Coding/BigClient-nda"


@pytest.fixture(scope="module")
def tables(spark):
    made = {
        "host": ("host_id string, account_id string, hostname string, os string", [("h1", "a", "alice-macbook", "mac"), ("h2", "a", "box", "linux")]),
        "project": ("project_id string, root_path string, name string, group_id string", [("p1aaa", PATH, "widget", "g1"), ("p2bbb", LOOSE, "BigClient-nda", "g2"), ("p3ccc", "/tmp/none", "none", None)]),
        "project_group": ("group_id string, name string, remote_url string", [("g1", "widget", "git@github.com:acme/widget.git"), ("g2", "client", None), ("g3", "empty", "")]),
        "session": (
            "id string, native_id string, source string, host_id string, project_id string, cwd string, git_branch string, cli_version string, started_at long, ended_at long, event_count long, active_ms long",
            [("s1", "n1", "src", "h1", "p1aaa", PATH, "main", "1", 0, 100, 5, 90), ("s2", "n2", "src", "h1", "p2bbb", LOOSE, "secret-branch", "1", 0, 50, 2, 50), ("s3", "n3", "src", "h2", "p1aaa", PATH + "/sub", "feat/x", "1", 0, 30, 2, 30), ("s4", "n4", "src", "h1", None, None, None, "1", 0, 7, 2, 7)],
        ),
        "thread": ("id string, session_id string, is_subagent boolean, agent_name string", [(f"t{i}", f"s{i}", i == 3, "codename") for i in range(1, 5)]),
        "span": ("id string, session_id string, thread_id string, started_at long, ended_at long, event_count long, attended boolean", [("x1", "s1", "t1", 0, 90, 5, True), ("x2", "s2", "t2", 0, 50, 2, True), ("x3", "s3", "t3", 0, 30, 2, None), ("x4", "s4", "t4", 0, 7, 2, False)]),
    }
    return {k: spark.createDataFrame(rows, kind) for k, (kind, rows) in made.items()}


@pytest.fixture(scope="module")
def known(tables):
    return P.secrets(tables, "/Users/alice", "alice")


def test_what_is_published_and_what_is_not(tables):
    out = P.publication(tables, "alice")
    assert [(r.remote_url, r.owner, r.repo, r.web_url, r.name) for r in out["repo"].collect()] == [("https://github.com/acme/widget", "acme", "widget", "https://github.com/acme/widget", "widget")]
    assert sorted((r.session_id, r.actor, r.git_branch) for r in out["session"].collect()) == [("s1", "alice", "main"), ("s3", "alice", "feat/x")]
    assert sorted((r.span_id, r.thread_role) for r in out["span"].collect()) == [("x1", "human"), ("x3", "autonomous")]
    assert tuple(P.withheld(tables, out).first()) == (120, 57, 2)
    one = P.publication(tables, "alice", "h2")
    assert [r.session_id for r in one["session"].collect()] == ["s3"] and tuple(P.withheld(tables, one, "h2").first()) == (30, 0, 2)


def test_origins(tables):
    s, p, x = tables["session"], tables["project"], tables["span"]
    of = lambda df: {c: (sorted(o.sources), o.computed) for c, o in origins(df, tables).items()}
    assert of(s.select(F.col("id").alias("a")).withColumnRenamed("a", "b").where("b <> ''").distinct()) == {"b": ([("session", "id")], False)}
    joined = s.join(p, "project_id").select("id", F.sha2(F.concat("root_path", F.lit("x")), 256).alias("h"), F.length("cwd").alias("n"))
    assert of(joined.groupBy("n").agg(F.max("h").alias("top"))) == {"n": ([("session", "cwd")], True), "top": ([("project", "root_path")], True)}
    assert of(s.select("id").union(p.select("root_path"))) == {"id": ([("project", "root_path"), ("session", "id")], False)}
    last = s.withColumn("w", F.last("cwd").over(W.partitionBy("source").orderBy("started_at"))).select("w")
    assert of(last)["w"][0][0] == ("session", "cwd") and of(last)["w"][1]
    both = s.alias("l").join(s.alias("r"), F.col("l.id") == F.col("r.native_id")).select(F.col("r.cwd").alias("other"), F.col("l.id").alias("own"))
    assert of(both) == {"other": ([("session", "cwd")], False), "own": ([("session", "id")], False)}
    parts = s.select(F.explode(F.split("cwd", "/")).alias("part"))
    assert of(parts) == {"part": ([("session", "cwd")], True)}
    by_python = s.select("id", "cwd").mapInPandas(lambda it: it, "a string, b string")
    assert of(by_python)["a"] == ([("session", "cwd"), ("session", "id")], True)
    inner = s.sparkSession.sql("SELECT id, (SELECT max(root_path) FROM {p}) AS m FROM {x}", p=p, x=x)
    assert of(inner) == {"id": ([("span", "id")], False), "m": ([("project", "root_path")], True)}
    assert of(s.sparkSession.range(3)) == {"id": ([("?", "id")], False)}


def test_private_columns_are_refused_through_anything(tables):
    out = P.publication(tables, "alice")
    assert P.faults(out, tables) == [] and P.unruled(tables) == []
    s, p = tables["session"], tables["project"]
    for bad, told in (
        (s.select(F.col("cwd").alias("session_id")), "copies session.cwd, which is private"),
        (s.join(p, "project_id").select(F.substring(F.sha2("root_path", 256), 1, 8).alias("repo_id")), "is computed from project.root_path, which is private"),
        (s.select("host_id"), "copies session.host_id, which is derived"),
        (s.sparkSession.range(2), "comes from ?.id, which has no verdict"),
    ):
        assert any(told in f for f in P.faults({**out, "session": bad}, tables)), told
    assert P.faults({"x": s.select(F.sha2("host_id", 256).alias("machine"))}, tables) == []


def _with_branch(out, text: str):
    return {**out, "session": out["session"].withColumn("git_branch", F.lit(text))}


def test_audit(tables, known):
    out = P.publication(tables, "bob")
    told = lambda pub, actor="bob", bytes_=1 << 22: {(r.severity, r.kind, r.field, r.secret) for r in P.audit(pub, known, actor, bytes_).collect()}
    assert told(out) == set()
    for size in (1 << 22, 70):  # one automaton, or one for each needle
        assert told(_with_branch(out, f"wip{LOOSE.upper()}x"), bytes_=size) >= {("leak", "path", "session.git_branch", LOOSE), ("leak", "path", "session.git_branch", "/Users/alice")}
    assert told(_with_branch(out, "x-p1aaa-y")) == {("leak", "path", "session.git_branch", "p1aaa")}
    assert ("leak", "identity", "session.git_branch", "macbook") in told(_with_branch(out, "alice-macbook"))
    assert told(_with_branch(out, "fix/widget")) == set()  # a repository's own name
    only = P.audit(_with_branch(out, "dash/rewrite"), tables["host"].sparkSession.createDataFrame([("name", "dash"), ("name", "main")], "kind string, secret string"), "bob").collect()
    assert [(r.severity, r.secret) for r in only] == [("warning", "dash")]
    assert told(P.publication(tables, "alice"), "alice") == set()  # the actor is named on purpose
    assert "nda" not in {r.secret for r in known.collect()} and "BigClient-nda" in {r.secret for r in known.where("kind = 'name'").collect()} and "widget" not in {r.secret for r in known.where("kind = 'name'").collect()}


def test_refusal_comes_before_the_first_write(tables, known):
    out, sent = P.publication(tables, "bob"), []
    send = lambda name, df: sent.append((name, df.count()))
    for bad, ruled in ((_with_branch(out, f"wip{PATH}"), tables), ({**out, "session": tables["session"].select("cwd")}, tables), (out, {**tables, "project": tables["project"].withColumn("client_codename", F.lit("x"))})):
        with pytest.raises(P.Unsafe):
            P.publish(ruled, bad, known, "bob", send)
        assert sent == []
    P.publish(tables, out, known, "bob", send)
    assert sent == [("repo", 1), ("session", 2), ("span", 2)]
