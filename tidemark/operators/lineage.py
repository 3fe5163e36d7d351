"""From which columns of which tables each column of a DataFrame is made, read off its analysed plan.

Every attribute of a plan has an expression id. An output column is followed through aliases, joins, aggregates, windows, unions and subqueries to
the attributes of the given tables' own plans. An operator that the plan does not explain (a Python function over rows, a generator) makes its new
columns from all that it reads. An attribute that leads to no given table is of the unknown table `?`. What only decides which rows there are (a filter, the
other side of a join) is not followed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

UNKNOWN = "?"


@dataclass(frozen=True)
class Origin:
    """sources: (table, column) pairs; computed: whether anything but copies and renames lies between."""

    sources: frozenset[tuple[str, str]]
    computed: bool


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


class _Walk:
    def __init__(self, tables: dict[str, DataFrame]):
        self.plans = {name: df._jdf.queryExecution().analyzed() for name, df in tables.items()}

    def _attributes(self, expression) -> list[int]:
        """Ids of the attributes in an expression."""
        return [a.exprId().id() for a in _seq(expression.references().toSeq())]

    def _table(self, node) -> dict[int, Origin] | None:
        """Origins of a node that is one of the tables, also under new ids (as in a join of a table with itself)."""
        for name, plan in self.plans.items():
            if node.sameResult(plan):
                return {a.exprId().id(): Origin(frozenset({(name, p.name())}), False) for a, p in zip(_seq(node.output()), _seq(plan.output()))}
        return None

    def plan(self, node) -> dict[int, Origin]:
        """Origin of every output attribute of a node, by its expression id."""
        own = self._table(node)
        if own is not None:
            return own
        children = [self.plan(c) for c in _seq(node.children())]
        if not children:
            return {a.exprId().id(): Origin(frozenset({(UNKNOWN, a.name())}), False) for a in _seq(node.output())}
        known = {k: v for c in children for k, v in c.items()}
        if _name(node) in ("Union", "Intersect", "Except"):
            sides = [[self._of(c, a.exprId().id()) for a in _seq(n.output())] for c, n in zip(children, _seq(node.children()))]
            return {a.exprId().id(): self._both([s[i] for s in sides]) for i, a in enumerate(_seq(node.output()))}
        made = {}
        for e in _seq(node.expressions()):
            self._aliases(e, known, made)
        out = {}
        for a in _seq(node.output()):
            k = a.exprId().id()
            out[k] = made[k] if k in made else known[k] if k in known else self._opaque(node, known)
        return out

    def _of(self, known: dict[int, Origin], k: int) -> Origin:
        return known.get(k, Origin(frozenset({(UNKNOWN, str(k))}), True))

    @staticmethod
    def _both(origins: list[Origin], computed: bool = False) -> Origin:
        return Origin(frozenset().union(*(o.sources for o in origins)), computed or any(o.computed for o in origins))

    def _aliases(self, e, known: dict[int, Origin], made: dict[int, Origin]) -> None:
        """Adds the origin of every alias in an expression."""
        if _name(e) == "Alias":
            child = e.child()
            parts = [self._of(known | made, k) for k in self._attributes(child)]
            for q in self._subqueries(child):
                inner = self.plan(q)
                parts += [self._of(inner, a.exprId().id()) for a in _seq(q.output())]
            copy = _name(child) == "AttributeReference"
            made[e.exprId().id()] = self._both(parts, computed=not copy)
        for c in _seq(e.children()):
            self._aliases(c, known, made)

    def _subqueries(self, e) -> list:
        own = [e.plan()] if hasattr(e, "plan") and _name(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "DynamicPruningSubquery") else []
        return own + [q for c in _seq(e.children()) for q in self._subqueries(c)]

    def _opaque(self, node, known: dict[int, Origin]) -> Origin:
        """A new attribute that no alias makes: from what the node names, or from all that it reads."""
        named = [known[k] for k in self._attributes(node) if k in known] if _name(node) == "Generate" else []
        return self._both(named or list(known.values()), computed=True)


def origins(df: DataFrame, tables: dict[str, DataFrame]) -> dict[str, Origin]:
    """Origin of each column of df in the tables by name, of which df (or a part of it) is made."""
    plan = df._jdf.queryExecution().analyzed()
    found = _Walk(tables).plan(plan)
    return {a.name(): found[a.exprId().id()] for a in _seq(plan.output())}
