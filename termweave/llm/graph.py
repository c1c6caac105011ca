"""Connected components of link tables, by lowering labels in distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import common
from termweave.llm.common import discard, join_spread, stored

def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b); label is the smallest node reachable.

    In each round a node takes the least label of its neighbours and then the label of that label, which
    about halves the way to the smallest node. Rounds are written to the shared folder; only a count of
    changes reaches the driver. Nodes with very many neighbours are dealt over several tasks. Links of a node to
    itself, repeated links and an empty table are fine.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(links.select(a, b).union(links.select(b.alias("a"), a.alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n")).drop("n"))
    n = edges.count()
    labels = stored(edges.groupBy(a.alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = join_spread(edges, labels.withColumnRenamed("node", "b"), "b", "a", n).groupBy(a.alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        lowered = stored(lowered) if n > common.HUB else lowered
        new = join_spread(lowered, jump, "at", "node", n, "left").select("node", F.least("at", F.coalesce("further", "at")).alias("label"), "old")
        new = stored(new)
        changed = new.where(F.col("label") < F.col("old")).limit(1).count()
        discard(labels)
        labels = new.drop("old")
        labels.stored_at = new.stored_at
        if not changed:
            discard(edges)
            return labels
