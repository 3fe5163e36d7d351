"""Merkle manifest of a dataset: a hash tree for each language, one over their roots, and coordinate lookup proofs.

A row's leaf is the hash of its columns, each with its length. Leaves are numbered inside their language by a sort over ranges:
a leaf's number is its place in its range plus the prefix sum of the ranges before it, so a language that holds most rows is
numbered by many tasks. Every eight consecutive nodes become one node of the next level; each level is written to the node table, keyed by
(tree, level, index). To prove a leaf, the coordinates of its siblings are computed from its index and the tree's size alone, exploded,
looked up in the node table, sorted, concatenated and folded.

A node of a high level is a sibling of very many leaves. The highest levels that together hold at most HELD nodes are therefore
broadcast; a node below them is asked for by few leaves (at most eight times as many as lie under it), so those lookups are plain shuffled joins.

Defined results: null columns are written `-`; rows that repeat a doc_id are leaves of their own, by hash, and a row without doc_id sorts first;
a language of one row has its leaf as root; one language's root is the root of all; a null language is a language; an empty
table gives no rows; other columns are no part of a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, read, staged

#: Children of a node, and nodes (about 100 bytes each) that a join may broadcast.
ARITY, HELD = 8, 50_000
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields, each as its UTF-8 byte count, a colon and its text, or `-` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """rows plus idx (0, 1, ... in order inside group, or over all) and n (rows of the group); only the columns of order sort, after the group."""
    by = [group] if group else []
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = staged(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")
    counts = placed.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = staged(counts.select("*", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_base"), F.sum("_own").over(W.partitionBy(*by)).alias("n")), "range-sums")
    side = counts.select(F.col("_part").alias("_p"), *(F.col(c).alias("_g") for c in by), "_first", "_base", "n")
    side = F.broadcast(side) if side.count() <= HELD else side  # a row for each range and each group in it
    same = reduce(lambda a, b: a & b, [F.col("_g").eqNullSafe(F.col(c)) for c in by], F.col("_part") == F.col("_p"))
    return placed.join(side, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_base")).alias("idx"), "n")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above nodes (tree, idx, n, hash), each written; n is the tree's count of nodes at that level."""
    out = [nodes]
    while nodes.agg(F.max("n")).first()[0] not in (None, 1):
        up = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {ARITY}").alias("idx"), F.ceil(F.col("n") / ARITY).alias("n"))
        runs = F.array_sort(F.collect_list(F.struct("idx", "hash")))  # at most ARITY of them
        nodes = staged(up.agg(F.sha2(F.concat_ws("", runs["hash"]), 256).alias("hash")).select("tree", "idx", "n", "hash"), "tree-level")
        out.append(nodes)
    return out


class Manifest:
    """The materialised tree: leaves (the rows with tree, idx, n and leaf), levels by tree, langs (tree, subroot) and the root."""

    def __init__(self, rows: DataFrame, group: str, order: list[str]):
        """rows hold `leaf` (hex) and the columns of group and order."""
        placed = numbered(rows, group, order)
        groups = staged(numbered(placed.select(group).distinct(), None, [group]).select(F.col(group).alias("_group"), F.col("idx").alias("tree"), F.col("n").alias("trees")), "trees")
        self.n_trees = groups.count()
        side = F.broadcast(groups) if self.n_trees <= HELD else groups
        self.leaves = staged(placed.join(side, F.col(group).eqNullSafe(F.col("_group"))).drop("_group"), "leaves")
        self.levels = _levels(self.leaves.select("tree", "idx", "n", F.col("leaf").alias("hash")))
        done = [level.where("n = 1").select("tree", F.col("hash").alias("subroot")) for level in self.levels]
        self.subroots = staged(reduce(DataFrame.union, done), "subroots")
        self.top = _levels(self.subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(self.n_trees).cast("long").alias("n"), F.col("subroot").alias("hash")))
        top = self.top[-1].where("n = 1").select("hash").first()
        self.root: str | None = top[0] if top else None

    def _lookup(self, asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
        """asked (tree, level, idx, ...) plus the hash of the node there, from the node table."""
        sizes = [level.count() for level in levels]
        cut = next((i for i in range(len(levels)) if sum(sizes[i:]) <= HELD), len(levels))
        out = []
        for these, hold in ((range(cut), False), (range(cut, len(levels)), True)):
            if len(these):
                nodes = reduce(DataFrame.union, [levels[i].select("tree", F.lit(i).alias("level"), "idx", "hash") for i in these])
                some = asked.where(F.col("level").between(these[0], these[-1]))
                out.append(some.join(F.broadcast(nodes) if hold else nodes, ["tree", "level", "idx"]))
        return reduce(DataFrame.union, out)

    def _paths(self, start: DataFrame, key: str, levels: list[DataFrame]) -> DataFrame:
        """For each row of start (key, tree, idx, n): path, its siblings as an array of (level, idx, own, hash) in order; rows without siblings are not there."""
        level = F.explode(levels_of(F.col("n"), len(levels) - 1)).alias("level")
        width = F.pow(F.lit(ARITY), F.col("level")).cast("long")
        at = start.select(key, "tree", "idx", "n", level).select(key, "tree", "level", F.floor(F.col("idx") / width).alias("own"), F.ceil(F.col("n") / width).alias("count"))
        first = F.expr(f"own - own % {ARITY}")
        run = F.sequence(first, F.least(first + (ARITY - 1), F.col("count") - 1))
        asked = at.select(key, "tree", "level", "own", F.explode(F.filter(run, lambda i: i != F.col("own"))).alias("idx"))
        found = self._lookup(asked, levels).select(key, F.struct("level", "idx", "own", F.unhex("hash").alias("hash")).alias("s"))
        return found.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("path"))

    def proofs(self, leaves: DataFrame, key: str) -> DataFrame:
        """leaves (of self.leaves, key unique) plus lang_path, top_path (arrays of siblings, empty for none) and subroot."""
        low = self._paths(leaves, key, self.levels)
        tops = self._paths(self.subroots.select("tree", F.col("tree").alias("at")).select(F.col("at"), F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(self.n_trees).cast("long").alias("n")), "at", self.top)
        tops = staged(self.subroots.join(tops, F.col("tree") == F.col("at"), "left").select("tree", "subroot", F.col("path").alias("top_path")), "top-proofs")
        side = F.broadcast(tops) if self.n_trees <= HELD // 10 else tops
        return leaves.join(low.withColumnRenamed("path", "lang_path"), key, "left").join(side, "tree")


def path_hash(*paths: str) -> Column:
    """Hash of all siblings, path by path and level by level, left to right."""
    return F.sha2(F.concat(*(F.coalesce(F.concat_ws("", F.transform(p, lambda s: F.lower(F.hex(s["hash"])))), F.lit("")) for p in paths)), 256)


def levels_of(n: Column, most: int) -> Column:
    """The levels (0, 1, ...) of a tree of n leaves that have a level above them; no tree has more than `most`."""
    return F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: n > F.pow(F.lit(ARITY), i).cast("long"))


def fold(start: Column, path: str, levels: Column) -> Column:
    """The root that start and the siblings of path give; a node without siblings is hashed alone."""
    siblings = F.coalesce(F.col(path), F.array().cast("array<struct<level:int,idx:bigint,own:bigint,hash:binary>>"))

    def up(now: Column, level: Column) -> Column:
        side = lambda left: F.concat_ws("", F.transform(F.filter(siblings, lambda s: (s["level"] == level) & ((s["idx"] < s["own"]) if left else (s["idx"] > s["own"]))), lambda s: F.lower(F.hex(s["hash"]))))
        return F.sha2(F.concat(side(True), now, side(False)), 256)

    return F.aggregate(levels, start, up)


def build_manifest(docs: DataFrame) -> Manifest:
    """The manifest of docs, one tree for each lang; its leaves also hold `other`, the leaf of the row as tampered with, where it is."""
    fields = {c: F.col(c) for c in FIELDS}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_hash([F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else fields[c] for c in FIELDS]))
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(list(fields.values())).alias("leaf"), tampered.alias("other"))
    return Manifest(rows, "lang", ["doc_id", "leaf"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = build_manifest(read(spark, sf_dir, "documents"))
    leaves = tree.leaves.withColumn("coordinate", F.struct("tree", "idx"))
    out = tree.proofs(leaves, "coordinate")
    folded = F.coalesce("other", "leaf")
    out = out.select("doc_id", "leaf", "subroot", F.lit(tree.root).alias("root"), path_hash("lang_path", "top_path").alias("proof_sha256"), "top_path", fold(folded, "lang_path", levels_of(F.col("n"), len(tree.levels) - 1)).alias("below"))
    out = out.withColumn("folded_root", fold(F.col("below"), "top_path", levels_of(F.lit(tree.n_trees), len(tree.top) - 1)))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
