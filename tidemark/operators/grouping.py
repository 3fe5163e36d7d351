"""Many paths, one project: the ladder from repository address to path ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import make_id, normalize_remote, path_key


def best_probe(probes: DataFrame, local_host: str) -> DataFrame:
    """One probe per project: the local host's, else the newest, else the least host id."""
    w = W.partitionBy("project_id").orderBy((F.col("host_id") == local_host).desc(), F.coalesce("detected_at", F.lit(0)).desc(), "host_id")
    return probes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def exists_anywhere(probes: DataFrame) -> DataFrame:
    """True if any host has the path, false if a host looked and none has it, null if none looked."""
    return probes.groupBy("project_id").agg(F.max("path_exists").alias("path_exists"))


def longest_ancestor(paths: DataFrame, anchors: DataFrame) -> DataFrame:
    """paths (project_id, key) with the project_id of their longest strict ancestor among anchors.

    Every path is joined by equality with its own prefixes, so the work grows with the depth of paths, not with pairs of them.
    """
    parts = F.split("key", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ups = paths.where(F.size(parts) > 1).select("project_id", F.explode(prefixes).alias("_up"))
    a = anchors.select(F.col("project_id").alias("anchor_id"), F.col("key").alias("_up"))
    found = ups.join(a, "_up").groupBy("project_id").agg(F.max_by("anchor_id", F.length("_up")).alias("anchor_id"))
    return paths.join(found, "project_id", "left")


def worktree(key: Column) -> Column:
    """struct(repo, ancestor) of a path (a key of path_key) in one of the known worktree layouts, else null: <ancestor>/<repo>/.claude/worktrees/<name>, where the ancestor
    is the main checkout itself, and .t3/worktrees/<repo>/<name> or conductor/workspaces/<repo>/<name>, which only tell the repository."""
    inner = F.regexp_extract(key, r"^(.*/([^/]+))/\.claude/worktrees/[^/]+", 1)
    name = F.regexp_extract(key, r"^(.*/([^/]+))/\.claude/worktrees/[^/]+", 2)
    other = F.coalesce(F.nullif(F.regexp_extract(key, r"(?:^|.*/)\.t3/worktrees/([^/]+)/[^/]+", 1), F.lit("")), F.nullif(F.regexp_extract(key, r"(?:^|.*/)conductor/workspaces/([^/]+)/[^/]+", 1), F.lit("")))
    shape = lambda repo, up: F.struct(F.lower(repo).alias("repo"), up.alias("ancestor"))
    return F.when(name != "", shape(name, inner)).when(other.isNotNull(), shape(other, F.lit(None).cast("string")))


def anchorable(key: Column) -> Column:
    """Whether a root (a key of path_key) may adopt what lies inside it: no filesystem root, no home directory and nothing above one, by their shape on any host."""
    root = key.rlike("^(/?|[.]|[a-z]:/?|//[^/]+(/[^/]+)?)$")
    home = F.lower(key).rlike("^(([a-z]:|//[^/]+/[^/]+)/users(/[^/]+)?|/(root|users(/[^/]+)?|home(/[^/]+)?))$")
    return ~root & ~home


def ladder(projects: DataFrame) -> DataFrame:
    """projects (project_id, root_path, git_remote, git_common_dir, group_pinned, group_id) -> project_id, group_id, origin.

    Rungs in order: pinned (manual); repository address; common directory, folded into the address's group of its main checkout or of another
    checkout of the same directory; worktree layout, folded into the checkout that it names or, by its name, into a known one; the longest
    ancestor that may anchor. An ancestor without a group founds one for itself and what lies inside, the shallowest first, so a chain is one group.
    """
    keyed = projects.select("project_id", "root_path", "group_pinned", F.when(F.col("group_pinned"), F.col("group_id")).alias("pinned_group"), path_key(F.col("root_path")).alias("key"), normalize_remote(F.col("git_remote")).alias("remote"), path_key(F.col("git_common_dir")).alias("common"))
    p = keyed.persist().select("*", F.lower(F.element_at(F.split("key", "/"), -1)).alias("name"), F.regexp_replace("common", r"(?i)/\.git$", "").alias("main"), worktree(F.col("key")).alias("shape"), anchorable(F.col("key")).alias("anchors"))
    free = ~F.col("group_pinned")
    own = F.when(F.col("group_pinned"), F.col("pinned_group")).when(F.col("remote").isNotNull(), make_id(F.lit("git_remote"), F.col("remote")))
    origin = F.when(F.col("group_pinned"), "manual").when(F.col("remote").isNotNull(), "git_remote")
    p = p.withColumn("group", own).withColumn("origin", origin)

    addressed = p.where("origin = 'git_remote'")
    by_path = addressed.groupBy(F.col("key").alias("main")).agg(F.min("group").alias("of_main"))
    by_common = addressed.where("common IS NOT NULL").groupBy("common").agg(F.min("group").alias("of_common"))
    p = p.join(by_path, "main", "left").join(by_common, "common", "left")
    second = free & F.col("origin").isNull() & F.col("common").isNotNull()
    p = p.withColumn("group", F.when(second, F.coalesce("of_main", "of_common", make_id(F.lit("git_common_dir"), F.col("common")))).otherwise(F.col("group")))
    p = p.withColumn("origin", F.when(second, "git_common_dir").otherwise(F.col("origin"))).drop("of_main", "of_common").persist()  # each rung reads the one before several times

    # worktrees: first the checkout that the path spells out, which founds the repository's group if it has none, then a known checkout of that name
    third = free & F.col("origin").isNull() & F.col("shape").isNotNull()
    founded = make_id(F.lit("path_worktree"), F.col("shape.repo"))
    named = p.where(third & F.col("shape.ancestor").isNotNull() & anchorable(F.col("shape.ancestor"))).select(F.col("shape.ancestor").alias("key"), founded.alias("founds")).distinct()
    p = p.join(named, "key", "left")
    founds = free & F.col("origin").isNull() & F.col("founds").isNotNull()
    p = p.withColumn("group", F.when(founds, F.col("founds")).otherwise(F.col("group"))).withColumn("origin", F.when(founds, "path_worktree").otherwise(F.col("origin"))).drop("founds").persist()
    main = p.where("anchors").groupBy(F.col("key").alias("up")).agg(F.min("group").alias("of_up"))
    best = F.min(F.struct((F.coalesce(F.col("origin"), F.lit("")) != "git_remote").alias("far"), F.length("root_path").alias("size"), "root_path", F.col("group").alias("of_name")))
    known = p.where("anchors AND shape IS NULL AND group IS NOT NULL").groupBy(F.col("name").alias("repo")).agg(best.alias("best")).select("repo", "best.of_name")
    p = p.withColumn("up", F.col("shape.ancestor")).withColumn("repo", F.col("shape.repo")).join(main, "up", "left").join(known, "repo", "left")
    p = p.withColumn("group", F.when(third, F.coalesce("of_up", "of_name", founded)).otherwise(F.col("group"))).withColumn("origin", F.when(third, "path_worktree").otherwise(F.col("origin")))

    # ancestors: a root that may anchor holds what is inside it; where it has no group itself, the group of the nearest grouped root above it or,
    # if there is none, that of the shallowest ungrouped root of its chain, which founds one
    p = p.select("project_id", "root_path", "key", "group_pinned", "anchors", "group", "origin").persist()
    roots = p.where("anchors AND (NOT group_pinned OR group IS NOT NULL)").select("key", F.col("group").alias("up_group"), F.col("root_path").alias("up_path")).groupBy("key").agg(F.min_by("up_group", F.struct(F.col("up_group").isNull(), "up_path")).alias("up_group"), F.min("up_path").alias("up_path"))
    parts = F.split("key", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = p.where("origin IS NULL").select("project_id", F.col("key").alias("own"), F.explode(F.when(F.size(parts) > 1, prefixes)).alias("key"))
    above = inside.join(roots, "key").groupBy("project_id", "own").agg(
        F.max(F.when(F.col("up_group").isNotNull(), F.struct(F.length("key").alias("depth"), F.col("up_group").alias("group")))).alias("near"),
        F.collect_list(F.when(F.col("up_group").isNull(), F.struct(F.length("key").alias("depth"), "up_path"))).alias("bare"),
    )  # a path has few ancestors
    below = F.array_sort(F.filter("bare", lambda x: F.col("near").isNull() | (x["depth"] > F.col("near.depth"))))
    found = above.select("project_id", F.col("near.group").alias("near_group"), F.get(below, F.lit(0))["up_path"].alias("first_path"))
    # the shallowest bare root below a grouped one follows the grouped one, as it is resolved first
    up = found.select("project_id", F.coalesce("near_group", F.when(F.col("first_path").isNotNull(), make_id(F.lit("path_ancestor"), F.col("first_path")))).alias("up_group"))
    holds = inside.join(roots.where("up_group IS NULL").select("key", "up_path"), "key").join(found.where("near_group IS NULL"), "project_id").where("up_path = first_path").select("key").distinct().withColumn("founds", F.lit(True))
    out = p.join(up, "project_id", "left").join(holds, "key", "left")
    fourth = F.col("origin").isNull() & ~F.col("group_pinned")
    group = F.when(fourth, F.coalesce("up_group", F.when(F.col("founds") & F.col("anchors"), make_id(F.lit("path_ancestor"), F.col("root_path"))))).otherwise(F.col("group"))
    return out.select("project_id", group.alias("group_id"), F.when(fourth, F.when(group.isNotNull(), "path_ancestor").otherwise("none")).otherwise(F.col("origin")).alias("origin"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a new run of the ladder would do, from (project_id, group_id) before and after: one row of counts. Nothing changes on a second run."""
    a, b = before.select("project_id", F.col("group_id").alias("old")), after.select("project_id", F.col("group_id").alias("new"))
    moved = a.join(b, "project_id", "full").agg(F.count_if(F.col("old").isNull() & F.col("new").isNotNull()).alias("grouped"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias("moved"), F.count_if(F.col("old").isNotNull() & F.col("new").isNull()).alias("ungrouped"))
    kinds = a.select(F.col("old").alias("g")).where("g IS NOT NULL").distinct().withColumn("was", F.lit(True)).join(b.select(F.col("new").alias("g")).where("g IS NOT NULL").distinct().withColumn("is", F.lit(True)), "g", "full")
    return moved.crossJoin(kinds.agg(F.count_if(F.col("was").isNull()).alias("created"), F.count_if(F.col("is").isNull()).alias("emptied")))  # one row each


def find(dimension: DataFrame, spec: str, *columns: str) -> DataFrame:
    """Rows whose columns hold the text, in any case; a single row that equals it wins alone. More than one row is for the caller to refuse."""
    low = spec.lower()
    some = lambda test: F.coalesce(F.greatest(*(test(F.lower(c)) for c in columns), F.lit(False)), F.lit(False))
    marked = dimension.where(some(lambda c: F.contains(c, F.lit(low)))).withColumn("_same", some(lambda c: c == low))
    alone = marked.agg((F.count_if("_same") == 1).alias("_alone"))
    return marked.crossJoin(F.broadcast(alone)).where("_same OR NOT _alone").drop("_same", "_alone")  # one row


def is_worktree(path: Column) -> Column:
    return path.rlike(r"/\.claude/worktrees/|/\.t3/worktrees/|/conductor/workspaces/")


def abbreviate_home(path: Column, home: str) -> Column:
    """For display: a path inside the home directory with ~ in its place."""
    return F.when(path == home, "~").when(path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substr(path, F.lit(len(home.rstrip("/")) + 1)))).otherwise(path)
