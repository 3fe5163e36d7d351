"""List-price cost: carried models, dated rates, and two ledgers, so that what has no price stays visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import nano, ttl_split
from tidemark.schema import COMPONENTS

_PARTS = list(COMPONENTS)


def carry_model(events: DataFrame) -> DataFrame:
    """events plus carried (the thread's last named model so far) and attributed (own model is null)."""
    order = W.partitionBy("thread_id").orderBy("ts", F.col("ordinal").asc_nulls_first() if "ordinal" in events.columns else "event_id", "event_id")
    named = F.when(F.col("model") != "", F.col("model"))
    return events.withColumn("carried", F.last(named, True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("attributed", F.col("model").isNull())


def rate_periods(prices: DataFrame) -> DataFrame:
    """prices plus valid_to: the next effective_from of the model, exclusive."""
    return prices.withColumn("valid_to", F.lead("effective_from").over(W.partitionBy("model").orderBy("effective_from")))


def asof_rates(events: DataFrame, prices: DataFrame, model: str = "carried") -> DataFrame:
    """events with the newest rate not after ts (left). The price table is a small dimension: Spark broadcasts it below its own threshold."""
    p = rate_periods(prices).select(F.col("model").alias("_m"), F.col("effective_from").alias("price_from"), "valid_to", "currency", *(f"{c}_mtok" for c in _PARTS))
    at = (F.col(model) == F.col("_m")) & (F.col("ts") >= F.col("price_from")) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))
    return events.join(p, at, "left").drop("_m", "valid_to")


def priced(events: DataFrame, prices: DataFrame, every: bool = False) -> DataFrame:
    """Each token-bearing event (or every event) with its tokens and nano cost by component (null: no rate)."""
    five, hour, assumed = ttl_split(F.col("cache_write_tokens"), F.col("cache_write_1h_tokens"))
    t = carry_model(events).select("*", five.alias("t_cache_write"), hour.alias("t_cache_write_1h"), assumed.alias("assumed_5m"), *(F.greatest(F.coalesce(f"{c}_tokens", F.lit(0)), F.lit(0)).alias(f"t_{c}") for c in _PARTS[:3]))
    t = t if every else t.where(" OR ".join(f"t_{c} > 0" for c in _PARTS))
    r = asof_rates(t, prices)
    for c in _PARTS:
        r = r.withColumn(f"{c}_nano", F.when(F.col(f"t_{c}") > 0, nano(F.col(f"t_{c}"), F.col(f"{c}_mtok"))))
    return r


def has_price() -> Column:
    """Of a priced() row: whether at least one component has a price."""
    return reduce(lambda a, b: a | b, (F.col(f"{c}_nano").isNotNull() for c in _PARTS))


def total() -> Column:
    """Of a priced() row: what its priced components cost."""
    return sum((F.coalesce(f"{c}_nano", F.lit(0)) for c in _PARTS), F.lit(0))


def missing() -> Column:
    """Of a priced() row: its tokens without a price."""
    return sum((F.when((F.col(f"t_{c}") > 0) & F.col(f"{c}_nano").isNull(), F.col(f"t_{c}")).otherwise(0) for c in _PARTS), F.lit(0))


def cost_ledger(events: DataFrame, prices: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """event_cost: events of which at least one component has a price; keep: further columns of the events."""
    p = priced(events, prices).where(has_price())
    parts = [F.coalesce(f"{c}_nano", F.lit(0)).alias(f"{c}_nano") for c in _PARTS]
    return p.select("event_id", "session_id", "thread_id", "source", "ts", F.col("carried").alias("model"), "attributed", "price_from", "currency", *keep, *parts, total().alias("total_nano"))


def unpriced_ledger(events: DataFrame, prices: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """event_unpriced: tokens without a price, by reason (no_model, no_rate, no_component); keep: further columns of the events."""
    p = priced(events, prices)
    reason = F.when(F.col("carried").isNull(), "no_model").when(F.col("price_from").isNull(), "no_rate").otherwise("no_component")
    return p.select("event_id", "session_id", "thread_id", "source", "ts", F.col("carried").alias("model"), "attributed", *keep, missing().alias("tokens"), reason.alias("reason")).where("tokens > 0")
