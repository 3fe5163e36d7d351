"""Price catalogues: JSON of models with dated clauses, flattened to one row per model and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATES = ("input_mtok", "output_mtok", "cache_read_mtok", "cache_write_mtok", "cache_write_1h_mtok")


def rates(spark: SparkSession, path: str) -> DataFrame:
    """model, provider, effective_from (epoch ms) and the rates; a file of another shape gives no rows."""
    clause = "struct<start_date string, " + ", ".join(f"{r} double" for r in RATES) + ">"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", f"models map<string, struct<provider string, clauses array<{clause}>>>").alias("c"))
    models = read.select(F.explode("c.models").alias("model", "m")).select("model", "m.provider", F.explode("m.clauses").alias("p"))
    start = F.coalesce(F.unix_millis(F.try_to_timestamp("p.start_date")), F.lit(0))
    return models.select("model", "provider", start.alias("effective_from"), *(F.col(f"p.{r}") for r in RATES))
