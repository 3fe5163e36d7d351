"""The difference of two tables by trees of digests: only where digests differ does anything go down, and only the rows of leaves that differ are read.

A row belongs to the leaf that the first bits of its key's hash name; a leaf's digest is made of its rows' hashes, in any order; a node's, of its sixteen
children's leaves. A tree is kept beside its table, so that one changed row among any number is found by comparing sixteen digests a level, and equal tables by
comparing one. Rows are kept by leaf, so that reading some leaves does not read the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_dir

#: Bits of a level: children of a node as a power of two.
BITS = 4
TREE = "node long, rows long, sum decimal(38,0), xor long, level int"


def _leaf(keys: list[str], depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - BITS * depth)


def _kept(df: DataFrame) -> DataFrame:
    """df written and read back, so that the next level does not compare this one again."""
    path = work_dir(df.sparkSession, "digests")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Digested:
    """A table with its tree, at a path: rows by range of leaf, and (level, node, rows, sum, xor)."""

    rows: DataFrame
    tree: DataFrame
    keys: list[str]
    depth: int


def write(df: DataFrame, keys: list[str], path: str, depth: int = 4) -> Digested:
    """Write df (unique by keys) and its tree of 16^depth leaves below path. Depth follows the table: a leaf is read as a whole."""
    spark, columns = df.sparkSession, sorted(df.columns)
    placed = df.select(*df.columns, _leaf(keys, depth).alias("_leaf"), F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c)))).alias("_hash"))  # a null adds nothing to a hash, that it is one does
    placed.repartitionByRange("_leaf").sortWithinPartitions("_leaf").write.parquet(f"{path}/rows")  # sorted: footers tell which leaves a row group has
    level = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy(F.col("_leaf").alias("node")).agg(F.count("*").alias("rows"), F.sum(F.col("_hash").cast("decimal(28,0)")).cast("decimal(38,0)").alias("sum"), F.bit_xor("_hash").alias("xor"))
    for at in range(depth, -1, -1):
        level.withColumn("level", F.lit(at)).write.mode("append").partitionBy("level").parquet(f"{path}/tree")
        level = spark.read.schema(TREE).parquet(f"{path}/tree").where(F.col("level") == at).groupBy(F.shiftrightunsigned("node", BITS).alias("node")).agg(F.sum("rows").alias("rows"), F.sum("sum").cast("decimal(38,0)").alias("sum"), F.bit_xor("xor").alias("xor"))
    return read(spark, path, keys, depth, placed.schema)


def read(spark: SparkSession, path: str, keys: list[str], depth: int = 4, schema=None) -> Digested:
    """What write() left; schema: of the rows, needed only where there may be none."""
    rows = spark.read.schema(schema) if schema is not None else spark.read
    return Digested(rows.parquet(f"{path}/rows"), spark.read.schema(TREE).parquet(f"{path}/tree"), keys, depth)


def differing(a: Digested, b: Digested) -> tuple[DataFrame, int]:
    """(leaves (node) whose digests differ, how many nodes were compared)."""
    spark, compared, told = a.tree.sparkSession, 0, None
    for level in range(a.depth + 1):
        sides = []
        for side in (a, b):
            own = side.tree.where(F.col("level") == level).select("node", F.struct("rows", "sum", "xor").alias("digest"))
            sides.append(own if told is None else own.join(told, F.shiftrightunsigned(own["node"], BITS) == told["parent"], "left_semi"))
        both = sides[0].withColumnRenamed("digest", "x").join(sides[1].withColumnRenamed("digest", "y"), "node", "full").select("node", (~F.col("x").eqNullSafe(F.col("y"))).alias("differs")).transform(_kept)
        n, moved = both.agg(F.count("*"), F.count_if("differs")).first()
        compared += n
        told = both.where("differs").select(F.col("node").alias("parent"))
        if not moved:
            break
    leaves = told.withColumnRenamed("parent", "node") if moved else spark.createDataFrame([], "node long")
    return leaves, compared


def difference(a: Digested, b: Digested) -> DataFrame:
    """(keys, change): rows that only b has (added), only a has (removed), or that differ (changed)."""
    leaves, _ = differing(a, b)
    held = [(df.rows.join(leaves, df.rows["_leaf"] == leaves["node"], "left_semi")).select(*a.keys, F.col("_hash").alias(name)) for df, name in ((a, "x"), (b, "y"))]
    both = held[0].join(held[1], a.keys, "full").where("NOT x <=> y")
    return both.select(*a.keys, F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))
