"""Enumerations as set algebra over tables of values."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import get_prefix, prefix_of
from termweave.operators.closure import closure, members
from termweave.sources.ontology import OntologyCatalog
from termweave.sources.schema import EnumExpression, EnumSpec, Reachable
from termweave.sources.storage import kept


class EnumCycle(ValueError):
    """Enumerations that inherit from each other in a circle."""


def inheritance_order(enums: dict[str, EnumSpec], names: list[str]) -> list[str]:
    """The names and all that they inherit from, parents first; names that aren't defined are passed over."""
    out: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise EnumCycle(" -> ".join([*above[above.index(name):], name]))
        if name in out or name not in enums:
            return
        for parent in enums[name].inherits:
            visit(parent, (*above, name))
        out.append(name)

    for name in names:
        visit(name, ())
    return out


def fingerprint(spec: EnumSpec) -> str:
    """Twelve hex digits that change whenever any clause of the definition does; the order within lists doesn't matter."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in sorted(x.items())}
        if isinstance(x, (list, tuple)):
            return sorted((plain(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True))
        return x

    clauses = {k: v for k, v in asdict(spec).items() if k != "name"}
    return hashlib.md5(json.dumps(plain(clauses), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


class EnumCompiler:
    """Turns definitions into tables (value). greedy: full expansion. progressive: membership of given values, which knows
    neither include nor minus nor matches and asks for a label before it walks the graph."""

    def __init__(self, catalog: OntologyCatalog, enums: dict[str, EnumSpec], match_patterns: bool = False):
        self.catalog, self.spark, self.enums, self.match_patterns = catalog, catalog.spark, enums, match_patterns
        self._reached: dict[Reachable, DataFrame] = {}

    def literal(self, values) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in sorted({v for v in values if v})], "value string")

    def _own(self, x: EnumExpression) -> DataFrame:
        return self.literal([v for pv in x.permissible_values for v in (pv.name, pv.meaning)])

    def _roots(self, q: Reachable) -> DataFrame:
        return self.spark.createDataFrame([(0, n, q.include_self) for n in q.source_nodes], "query_id int, node string, include_self boolean")

    def _walk_all(self, names: list[str]) -> None:
        """Walks the closures of all clauses that expanding the names needs: one walk for each ontology, direction and set of relations."""
        specs = [self.enums[n] for n in inheritance_order(self.enums, names)]
        clauses = {x.reachable_from for s in specs for x in (s, *s.include, *s.minus) if x.reachable_from} - set(self._reached)
        walks: dict[tuple, list[Reachable]] = {}
        for q in sorted(clauses, key=repr):
            adapter = self.catalog.options.adapter_for(get_prefix(q.source_nodes[0])) if q.source_nodes else None
            if adapter is None:
                self._reached[q] = self.literal([])
            else:
                walks.setdefault((adapter, q.relationship_types, q.traverse_up), []).append(q)
        for (adapter, relations, up), some in walks.items():
            roots = [(i, n, q.include_self) for i, q in enumerate(some) for n in q.source_nodes]
            roots = self.spark.createDataFrame(roots, "query_id int, node string, include_self boolean")
            found = kept(closure(self.catalog.tables(adapter)[1], roots, list(relations), up))
            for i, q in enumerate(some):
                self._reached[q] = found.where(F.col("query_id") == i).select(F.col("node").alias("value"))

    def reachable(self, q: Reachable) -> DataFrame:
        """All nodes of the closure, in the ontology of the first source node (see _walk_all)."""
        return self._reached[q]

    def _matching(self, x: EnumExpression) -> DataFrame | None:
        """Terms by pattern; off unless asked for, as definitions with patterns expand to nothing by default."""
        if not (self.match_patterns and x.matches and x.matches.identifier_pattern):
            return None
        prefixes = sorted(self.catalog.options.adapters or {})
        return self.catalog.terms(prefixes).where(F.col("curie").rlike(f"^(?:{x.matches.identifier_pattern})$")).select(F.col("curie").alias("value"))

    def _expression(self, x: EnumExpression, own: bool) -> list[DataFrame]:
        parts = [self.reachable(x.reachable_from)] if x.reachable_from else []
        parts += [m for m in [self._matching(x)] if m is not None]
        parts += [self.literal(x.concepts)] if x.concepts else []
        return parts + ([self._own(x)] if own and x.permissible_values else [])

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.literal([])

    def expand(self, name: str) -> DataFrame:
        """Reachable, matching and listed values and includes, less minus; then what is inherited and its own values, neither of which minus touches."""
        self._walk_all([name])
        done: dict[str, DataFrame] = {}
        for n in inheritance_order(self.enums, [name]):
            spec = self.enums[n]
            values = self._union([p for x in (spec, *spec.include) for p in self._expression(x, own=x is not spec)])
            for x in spec.minus:
                values = values.join(self._union(self._expression(x, own=True)), "value", "left_anti")
            parents = [done[p] for p in spec.inherits if p in done]
            done[n] = self._union([values, *parents, *([self._own(spec)] if spec.permissible_values else [])])
        return done.get(name, self.literal([]))

    def accepted(self, name: str, values: DataFrame) -> DataFrame:
        """(value): which of the given values are members, evaluated for those values only."""
        out, asked = [], values.select("value").where("value is not null").distinct()
        for n in inheritance_order(self.enums, [name]):
            spec = self.enums[n]
            listed = F.col("value").isin([v for v in {*spec.concepts, *(v for pv in spec.permissible_values for v in (pv.name, pv.meaning))} if v])
            out.append(asked.where(listed))
            if spec.reachable_from:
                out.append(self._walk(asked.where(~listed), spec.reachable_from))
        return self._union(out)

    def _walk(self, values: DataFrame, q: Reachable) -> DataFrame:
        """Each value is looked up in the ontology of its own prefix and must have a label there."""
        if self.catalog.options.adapters is not None:
            prefixes = sorted(self.catalog.options.adapters)
        else:
            prefixes = sorted(r[0] for r in values.select(prefix_of(F.col("value"))).distinct().collect() if r[0])
        by_adapter: dict[str, list[str]] = {}
        for p in prefixes:
            if adapter := self.catalog.options.adapter_for(p):
                by_adapter.setdefault(adapter, []).append(p)
        found = []
        for ps in by_adapter.values():
            labelled = self.catalog.terms(ps).where("label is not null and label <> ''").select(F.col("curie").alias("value"))
            mine = values.where(prefix_of(F.col("value")).isin(*ps)).join(labelled, "value", "left_semi")
            found.append(members(self.catalog.edges(ps[0]), mine, self._roots(q), list(q.relationship_types), q.traverse_up).select("value"))
        return self._union(found)

    def table(self, names: list[str], values: DataFrame, mode: str) -> DataFrame:
        """(enum_name, value) for the checks: values (enum_name, value) are those that occur in the data."""
        parts = []
        if mode == "greedy":
            self._walk_all(names)
        else:
            values = kept(values.select("enum_name", "value").where("value is not null").distinct())
        for n in names:
            got = self.expand(n) if mode == "greedy" else self.accepted(n, values.where(F.col("enum_name") == n))
            parts.append(got.select(F.lit(n).alias("enum_name"), "value"))
        return kept(reduce(DataFrame.unionByName, parts)) if parts else self.spark.createDataFrame([], "enum_name string, value string")
