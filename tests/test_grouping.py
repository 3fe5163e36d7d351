"""The grouping ladder against the same rules taken one project at a time."""

from __future__ import annotations

import hashlib
import random

import pytest

from tidemark.operators.grouping import ladder
from tidemark.plans.queries import QUERIES

KIND = "project_id long, root_path string, git_remote string, git_common_dir string, group_pinned boolean, group_id string"


def made(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32]


def shape(path: str) -> tuple[str, str | None] | None:
    segs = path.strip("/").split("/")
    for i in range(len(segs) - 3, 0, -1):
        if segs[i : i + 2] == [".claude", "worktrees"]:
            return segs[i - 1], "/" + "/".join(segs[:i])
    for pair in ([".t3", "worktrees"], ["conductor", "workspaces"]):
        for i in range(len(segs) - 4, -1, -1):
            if segs[i : i + 2] == pair:
                return segs[i + 2], None
    return None


def may_anchor(path: str) -> bool:
    segs = [s for s in path.split("/") if s]
    return bool(segs) and not (segs == ["root"] or len(segs) <= 2 and segs[0] in ("users", "home"))


def one_by_one(rows: list[tuple]) -> dict[int, tuple[str | None, str]]:
    """project_id -> (group, origin), rung after rung and row after row."""
    out = {i: (g, "manual") for i, _, _, _, pinned, g in rows if pinned}
    path_of = {i: p for i, p, *_ in rows}
    at = {p: i for i, p, *_ in rows}
    group = lambda i: out.get(i, (None,))[0]
    for i, _, remote, *_ in rows:
        if i not in out and remote:
            out[i] = made("git_remote", remote), "git_remote"
    addressed = [(i, p, c) for i, p, _, c, *_ in rows if out.get(i, (0, ""))[1] == "git_remote"]
    for i, p, _, common, *_ in rows:
        if i not in out and common:
            main = common.removesuffix("/.git")
            own = [group(j) for j, q, _ in addressed if q == main] or sorted(group(j) for j, _, c in addressed if c == common)
            out[i] = (own[0] if own else made("git_common_dir", common)), "git_common_dir"
    waiting = [(i, p, shape(p)) for i, p, *_ in rows if i not in out and shape(p)]
    for i, p, (repo, up) in waiting:
        if up and may_anchor(up) and up in at and at[up] not in out:
            out[at[up]] = made("path_worktree", repo), "path_worktree"
    for i, p, (repo, up) in waiting:
        own = group(at[up]) if up and may_anchor(up) and up in at else None
        if own is None:
            pool = [(out[j][1] != "git_remote", len(q), q) for j, q in path_of.items() if group(j) and j not in [w[0] for w in waiting] and q.rsplit("/", 1)[-1] == repo and may_anchor(q) and not shape(q)]
            own = group(at[min(pool)[2]]) if pool else made("path_worktree", repo)
        out[i] = own, "path_worktree"
    pinned = {r[0] for r in rows if r[4]}
    for i, p, *_ in sorted(rows, key=lambda r: r[1].count("/")):
        if i in out:
            continue
        for j, q in sorted(((j, q) for j, q in path_of.items() if p.startswith(q.rstrip("/") + "/") and q != p and may_anchor(q)), key=lambda x: -len(x[1])):
            if group(j) is None:
                if j in pinned:
                    continue
                out[j] = made("path_ancestor", q), "path_ancestor"
            out[i] = group(j), "path_ancestor"
            break
    return {i: out.get(i, (None, "none")) for i in path_of}


PATHS = ["/", "/home", "/home/u", "/root", "/srv", "/srv/app", "/srv/app/web", "/srv/app/web/ui", "/srv/app/web/ui/x", "/srv/lib", "/srv/lib/core", "/home/u/app", "/home/u/app/.claude/worktrees/w1", "/home/u/app/.claude/worktrees/w2", "/home/u/.t3/worktrees/lib/a", "/home/u/conductor/workspaces/core/b", "/home/u/conductor/workspaces/none/c", "/srv/lib/.claude/worktrees/z/deep", "/opt/one", "/opt/one/two", "/opt/one/two/three", "/root/x", "/root/x/y"]


@pytest.mark.parametrize("seed", range(4))
def test_ladder_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i, p in enumerate(rng.sample(PATHS, len(PATHS) if seed else 12)):
        remote = f"https://host.example/team/{p.rsplit('/', 1)[-1]}" if rng.random() < 0.2 else None
        common = rng.choice(["/srv/app/.git", "/bare/store", "/opt/one/.git"]) if rng.random() < 0.2 else None
        pinned = rng.random() < 0.15
        rows.append((i, p, remote, common, pinned, rng.choice(["mine", None]) if pinned else None))
    got = {r.project_id: (r.group_id, r.origin) for r in ladder(spark.createDataFrame(rows, KIND)).collect()}
    assert got == one_by_one(rows)


def test_chain_of_bare_roots_is_one_group(spark):
    rows = [(i, p, None, None, False, None) for i, p in enumerate(["/srv/a/b/c", "/srv/a", "/srv/a/b", "/srv/z", "/home/u", "/home/u/p"])]
    got = {r.project_id: (r.group_id, r.origin) for r in ladder(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i] for i in (0, 1, 2)] == [(made("path_ancestor", "/srv/a"), "path_ancestor")] * 3 and got[3] == got[4] == got[5] == (None, "none")
    assert ladder(spark.createDataFrame([], KIND)).count() == 0


def test_registered_ladder(spark):
    out = {r.project_id: (r.group_id, r.origin) for r in QUERIES["path_ancestor_ladder"](spark, "/root/testdata/sf0.001").collect()}
    nations = {r.c_custkey: r.c_nationkey for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()}
    rows = []
    for k, n in nations.items():
        top = k % 25 == n
        rows.append((k, f"/srv/{n}" + ("" if top else f"/{k}"), f"https://host.example/team/{n}" if top else None, None, False, None))
    at: dict[str, tuple] = {}
    for r in rows:
        at.setdefault(r[1], r)
    want = one_by_one(list(at.values()))
    assert {k: out[k] for k in want} == want and len(out) == len(rows)
