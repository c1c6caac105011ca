"""Reachability in ontology graphs: breadth-first rounds over edges, safe on cycles and diamonds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.sources.storage import kept, lookup_side


def steps(edges: DataFrame, predicates: list[str], up: bool) -> DataFrame:
    """(here, there): one step over any of the predicates, towards descendants or, if up, ancestors."""
    here, there = ("subject", "object") if up else ("object", "subject")
    return edges.where(F.col("predicate").isin(*predicates)).select(F.col(here).alias("here"), F.col(there).alias("there")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, predicates: list[str], up: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """(query_id, source, node) of every node reachable from the seeds (query_id, source) in one step or more.

    A node that reaches itself over a cycle is left out. Each round joins only the nodes that the round before
    found, and drops those seen earlier, so a node is expanded once for each source; rounds are written to
    the shared folder. ends (node): a source that has reached one of these isn't followed any further.
    """
    step = lookup_side(kept(steps(edges, predicates, up)))
    ends = lookup_side(ends.select("node")) if ends is not None else None
    frontier = kept(seeds.select("query_id", "source").distinct().withColumn("node", F.col("source")))
    seen = [frontier]
    while True:
        known = seen[0]
        for part in seen[1:]:
            known = known.unionByName(part)
        found = frontier.join(step, F.col("node") == F.col("here")).select("query_id", "source", F.col("there").alias("node")).distinct()
        frontier = kept(found.join(known, ["query_id", "source", "node"], "left_anti"))
        if not frontier.take(1):
            return known.where(F.col("node") != F.col("source"))
        seen.append(frontier)
        if ends is not None:
            met = frontier.join(ends, "node", "left_semi").select("query_id", "source").distinct()
            frontier = frontier.join(met, ["query_id", "source"], "left_anti")
        if len(seen) > 8:  # long chains: keeps the plan of a round short
            whole = seen[0]
            for part in seen[1:]:
                whole = whole.unionByName(part)
            seen = [kept(whole)]


def closure(edges: DataFrame, roots: DataFrame, predicates: list[str], up: bool = False) -> DataFrame:
    """(query_id, node) reachable from any root (query_id, node, include_self); a root counts itself if its include_self says so."""
    seeds = roots.select("query_id", F.col("node").alias("source"))
    own = roots.where("include_self").select("query_id", "node")
    return reach(edges, seeds, predicates, up).select("query_id", "node").unionByName(own).distinct()


def members(edges: DataFrame, values: DataFrame, roots: DataFrame, predicates: list[str], up: bool = False) -> DataFrame:
    """(query_id, value): which of the distinct values (value) lie in the closure of a query's roots.

    Goal-directed: the walk starts at the values, against the direction of the query, so its cost follows the
    data's distinct values rather than the size of the ontology's closure. A value that has met a root of every
    query is decided and walks no further.
    """
    start = kept(values.select("value").where("value is not null").distinct())
    seeds = start.select(F.lit(0).alias("query_id"), F.col("value").alias("source"))
    roots = kept(roots.select("query_id", "node", "include_self"))
    n_queries = roots.select("query_id").distinct().count()
    shared = roots.groupBy("node").agg(F.countDistinct("query_id").alias("n")).where(F.col("n") == n_queries)
    met = reach(edges, seeds, predicates, not up, shared).select(F.col("source").alias("value"), "node")
    by_root = met.join(lookup_side(roots), "node").select("query_id", "value")
    own = start.join(lookup_side(kept(roots.where("include_self").select("query_id", F.col("node").alias("value")))), "value").select("query_id", "value")
    return by_root.unionByName(own).distinct()
