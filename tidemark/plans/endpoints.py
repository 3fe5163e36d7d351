"""The questions an activity dashboard asks, each a function of a Corpus and Filters that returns DataFrames.

All of them select spans by one predicate (see Filters). Events and their costs count where their span survives: the gap pass gives events and
spans the same number in a thread, so they meet by an equality join and never by a range. Costs are in nano units of the currency.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cost as C
from tidemark.operators import intervals as I
from tidemark.operators import rollups as A
from tidemark.operators import spans as SP
from tidemark.operators.filters import Filters
from tidemark.schema import COMPONENTS, TOKENS

TIMELINE_LIMIT = 4000
_OF_SPAN = ("thread_id", "span_no")
NO_FILTER = Filters()


@dataclass(frozen=True)
class Corpus:
    """events (with session_id, thread_id, source, project_id, group_id, is_subagent, agent_name, model and tokens), prices, and the dimensions
    projects (project_id, name, root_path, group_id, group_pinned, path_exists) and groups (group_id, name, origin)."""

    events: DataFrame
    prices: DataFrame
    projects: DataFrame
    groups: DataFrame
    idle_ms: int = SP.IDLE_MS

    @cached_property
    def spans(self) -> DataFrame:
        return SP.spans(self.events, self.idle_ms, ("session_id", "source", "project_id", "group_id", "is_subagent", "agent_name"))

    @cached_property
    def numbered(self) -> DataFrame:
        """Events inside spans, with the number of their span."""
        return SP.with_span(self.events, self.idle_ms)

    @cached_property
    def ledger(self) -> DataFrame:
        return C.cost_ledger(self.numbered, self.prices, ("span_no", "project_id"))

    @cached_property
    def priced(self) -> DataFrame:
        """Every event in a span with its tokens and costs: one pass for all sums."""
        return C.priced(self.numbered, self.prices, every=True)

    @cached_property
    def unpriced(self) -> DataFrame:
        return C.unpriced_ledger(self.numbered, self.prices, ("span_no",))

    def selected(self, f: Filters) -> DataFrame:
        return self.spans.where(f.predicate())

    def within(self, rows: DataFrame, f: Filters) -> DataFrame:
        """rows (thread_id, span_no, ...) of the selected spans. Without a filter that is all of them, and nothing is joined."""
        if f == NO_FILTER:
            return rows
        return rows.join(self.selected(f).select(*_OF_SPAN), list(_OF_SPAN), "left_semi")


def _sum(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def meta(c: Corpus) -> dict[str, DataFrame]:
    """The choices of the filter controls, never filtered: bounds, sources, models, agents, and rosters of projects and groups, zeros kept."""
    sums = c.spans.groupBy("project_id", "group_id").agg(F.sum("ms").alias("ms"))
    named = lambda name: c.events.select(name).where(F.col(name).isNotNull()).distinct()
    return {
        "bounds": c.events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.lit(c.idle_ms).cast("long").alias("idle_ms")),
        "sources": named("source"),
        "models": named("model"),
        "unpriced_models": named("model").join(c.prices.select("model").distinct(), "model", "left_anti"),
        "agents": c.events.where("agent_name IS NOT NULL").select("source", "agent_name").distinct(),
        "projects": A.active_ms(c.projects.select("project_id", "name", "root_path"), sums, "project_id"),
        "groups": A.active_ms(c.groups.select("group_id", "name"), sums, "group_id"),
    }


def summary(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    """One row: counts, active time and its three parts, tokens and cost of the selected spans."""
    s = c.selected(f)
    part = lambda when: _sum(F.when(when, F.col("ms")))
    root, human = ~F.col("is_subagent"), F.coalesce("attended", F.lit(False))
    times = s.agg(
        F.countDistinct("session_id").alias("sessions"), F.countDistinct("thread_id").alias("threads"), _sum("event_count").alias("events"), F.count("*").alias("spans"), _sum("ms").alias("active_ms"),
        part(root & human).alias("human_initiated_ms"), part(~root).alias("autonomous_ms"), part(root & ~human).alias("unattended_root_ms"),
    )
    return times.crossJoin(c.within(c.priced, f).agg(*(_sum(t).alias(t) for t in TOKENS), *_money()))  # one row each


def by_source(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    return c.selected(f).groupBy("source").agg(F.sum("ms").alias("active_ms"))


def _money() -> list[Column]:
    """Aggregates of priced rows: cost in all and by component, priced and attributed events, unpriced tokens. Both ledgers are sums of the same rows."""
    return [
        _sum(C.total()).alias("cost_nano"), *(_sum(f"{k}_nano").alias(f"{k}_nano") for k in COMPONENTS), F.count_if(C.has_price()).alias("priced_events"), F.count_if(C.has_price() & F.col("attributed")).alias("attributed_events"),
        _sum(C.missing()).alias("unpriced_tokens"),
    ]


def _cost_totals(c: Corpus, f: Filters) -> DataFrame:
    return c.within(c.priced, f).agg(*_money())


def timeline(c: Corpus, f: Filters = NO_FILTER, limit: int = TIMELINE_LIMIT) -> DataFrame:
    """The selected spans with the names of project and group; above the limit the widest, and truncated says so."""
    names = c.projects.select("project_id", F.col("name").alias("project_name"))
    of = c.groups.select("group_id", F.col("name").alias("group_name"))
    out = A.widest(c.selected(f), limit).join(names, "project_id", "left").join(of, "group_id", "left")
    return out.select("span_id", "thread_id", "session_id", "project_id", "project_name", "group_id", "group_name", "source", "agent_name", "is_subagent", "attended", "started_at", "ended_at", "truncated")


def daily(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    """Every local day from the first to the last one with a span or a cost: active time, wall clock and cost, gaps as zeros."""
    money = c.within(c.ledger, f).groupBy(F.to_date(F.timestamp_millis("ts")).alias("day")).agg(F.sum("total_nano").alias("cost_nano"))
    days = I.daily(c.selected(f)).join(money, "day", "full")
    return I.fill_days(days, active_ms=F.lit(0), wall_ms=F.lit(0), cost_nano=F.lit(0))


def concurrency(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    """One row: peak, when it was first reached, wall clock, active time and their ratio; zeros without spans."""
    out = I.concurrency(c.selected(f))
    return out.select(F.coalesce("peak", F.lit(0)).alias("peak"), "peak_at", "wall_ms", "active_ms", "multiplier")


def time_at_level(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    return I.time_at_level(c.selected(f))


def projects(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    """Ranking of the projects that the selected spans reach; costs are summed apart and joined."""
    rank = A.ranking(c.selected(f).where("project_id IS NOT NULL"), "project_id", c.within(c.ledger, f))
    named = rank.join(c.projects, "project_id").join(c.groups.select("group_id", F.col("name").alias("group_name")), "group_id", "left")
    return named.select("project_id", "name", "root_path", "group_id", "group_name", "group_pinned", "path_exists", "active_ms", "sessions", "threads", "first_at", "last_at", "cost_nano")


def groups(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    """Ranking of the groups that the selected spans reach, and one row without group_id for the exact complement, so that active_ms sums to the summary's."""
    pinned = c.projects.where("group_pinned").select(F.col("project_id").alias("pinned_id"))
    s = c.selected(f).join(pinned, F.col("project_id") == F.col("pinned_id"), "left")
    rank = s.groupBy("group_id").agg(
        F.sum("ms").alias("active_ms"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("thread_id").alias("threads"),
        F.countDistinct("project_id").alias("projects"), F.countDistinct("pinned_id").alias("pinned_projects"), F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"),
    )
    return rank.join(c.groups, "group_id", "left").select("group_id", "name", "origin", "active_ms", "sessions", "threads", "projects", "pinned_projects", "first_at", "last_at")


def agents(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    return c.selected(f).where("agent_name IS NOT NULL").groupBy("agent_name", "source").agg(F.countDistinct("thread_id").alias("threads"), F.sum("ms").alias("active_ms"))


def heatmap(c: Corpus, f: Filters = NO_FILTER) -> DataFrame:
    return I.heatmap(c.selected(f)).withColumnRenamed("ms", "active_ms")


def cost(c: Corpus, f: Filters = NO_FILTER) -> dict[str, DataFrame]:
    """The list-price equivalent of the selected spans: totals, by model, by source, by day, and what had no price."""
    led = c.within(c.ledger, f)
    money = F.sum("total_nano").alias("cost_nano")
    return {
        "totals": _cost_totals(c, f),
        "by_model": led.groupBy("model").agg(money, F.count("*").alias("events"), F.count_if("attributed").alias("attributed")),
        "by_source": led.groupBy("source").agg(money),
        "daily": led.groupBy(F.to_date(F.timestamp_millis("ts")).alias("day")).agg(money),
        "unpriced": c.within(c.unpriced, f).groupBy("model", "reason").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("events")),
        "currency": led.select("currency").distinct(),
    }


FILTERED: dict[str, Callable] = {f.__name__: f for f in (summary, timeline, daily, concurrency, projects, groups, agents, heatmap, cost)}
ENDPOINTS = ("meta", *FILTERED)


def endpoint(name: str, c: Corpus, f: Filters = NO_FILTER) -> DataFrame | dict[str, DataFrame]:
    """One endpoint by name; KeyError if there is none. meta ignores filters."""
    return meta(c) if name == "meta" else FILTERED[name](c, f)


def stats(c: Corpus, top: int = 8) -> dict[str, DataFrame]:
    """What a terminal report shows: totals, sources, the `top` projects and agents with one row for all others, concurrency and the busiest days."""
    per_project = c.spans.groupBy("project_id").agg(F.sum("ms").alias("active_ms"))
    per_agent = c.spans.where("agent_name IS NOT NULL").groupBy("agent_name").agg(F.sum("ms").alias("active_ms"))
    return {
        "totals": A.totals(c.spans), "sources": A.share(by_source(c), "active_ms"),
        "projects": A.top_with_rest(per_project, "project_id", "active_ms", top), "agents": A.top_with_rest(per_agent, "agent_name", "active_ms", top),
        "concurrency": concurrency(c), "active_days": c.spans.select(F.to_date(F.timestamp_millis("started_at")).alias("day")).agg(F.countDistinct("day").alias("active_days")),
    }
