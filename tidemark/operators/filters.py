"""One predicate for every endpoint: projects or groups, sources, a half-open range on the span's start, and role."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = ("human", "autonomous")


@dataclass(frozen=True)
class Filters:
    projects: tuple = ()
    groups: tuple = ()
    sources: tuple = ()
    ts_from: int | None = None
    ts_to: int | None = None
    role: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if self.role not in (None, *ROLES):
            raise ValueError(f"unknown role {self.role!r}")

    @classmethod
    def from_query(cls, params: dict[str, list[str]]) -> Filters:
        """From a query string's lists: the last scalar wins, unknown names are ignored, a bad number raises."""
        last = {k: v[-1] for k, v in params.items() if v}
        number = lambda k: int(last[k]) if last.get(k) else None
        lists = {k: tuple(v for v in params.get(n, ()) if v) for k, n in (("projects", "project"), ("groups", "group"), ("sources", "source"))}
        role = last.get("role")
        return cls(**lists, ts_from=number("from"), ts_to=number("to"), role=None if role in (None, "", "all") else role)

    def predicate(self) -> Column:
        """On rows with project_id, group_id, source, started_at and is_subagent; pushed to the scan by Catalyst."""
        out = F.lit(True)
        if self.projects or self.groups:
            named = F.lit(False)
            if self.projects:
                named = named | F.coalesce(F.col("project_id").isin(*self.projects), F.lit(False))
            if self.groups:
                named = named | F.coalesce(F.col("group_id").isin(*self.groups), F.lit(False))
            out = out & named
        if self.sources:
            out = out & F.col("source").isin(*self.sources)
        if self.ts_from is not None:
            out = out & (F.col("started_at") >= self.ts_from)
        if self.ts_to is not None:
            out = out & (F.col("started_at") < self.ts_to)
        if self.role:
            out = out & (F.col("is_subagent") == (self.role == "autonomous"))
        return out
