"""Trees of digests: what they compare, and the differences that they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import digests


def test_one_row_among_many(spark, tmp_path):
    rows = spark.range(200_000).select("id", (F.col("id") * 3).alias("v"), F.when(F.col("id") % 2 == 0, "x").alias("t"))
    a = digests.write(rows, ["id"], f"{tmp_path}/a")
    same = digests.write(rows.repartition(7), ["id"], f"{tmp_path}/same")
    assert digests.differing(a, same)[1] == 1 and digests.difference(a, same).count() == 0
    b = digests.write(rows.withColumn("t", F.when(F.col("id") == 77_777, "y").otherwise(F.col("t"))), ["id"], f"{tmp_path}/b")
    leaves, compared = digests.differing(a, b)
    assert leaves.count() == 1 and compared == 1 + 16 * 4
    assert [tuple(r) for r in digests.difference(a, b).collect()] == [(77_777, "changed")]


def test_kinds_of_change(spark, tmp_path):
    """Values that move from one column to another, nulls, added and removed rows, empty tables."""
    kind = "k string, a string, b string"
    put = lambda name, rows: digests.write(spark.createDataFrame(rows, kind), ["k"], f"{tmp_path}/{name}", 2)
    a = put("a", [("1", "x", None), ("2", "x", "y"), ("3", None, None), ("4", "same", "same")])
    b = put("b", [("1", None, "x"), ("2", "x", "z"), ("5", None, None), ("4", "same", "same")])
    none = put("none", [])
    found = lambda x, y: {tuple(r) for r in digests.difference(x, y).collect()}
    assert found(a, b) == {("1", "changed"), ("2", "changed"), ("3", "removed"), ("5", "added")}
    assert found(none, a) == {(k, "added") for k in "1234"} and found(none, none) == set()
