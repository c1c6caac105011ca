"""Cleaning label snapshots: one row for each identifier, fresh labels, sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.sources.storage import kept, lookup_side

#: Row numbers of a file that one task compares at once.
BLOCK = 10_000


def latest(rows: DataFrame) -> DataFrame:
    """Of each (file, curie) the row of greatest retrieved_at, as text; of equals the first by row_no."""
    order = Window.partitionBy("file", "curie").orderBy(F.coalesce("retrieved_at", F.lit("")).desc(), "row_no")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame) -> DataFrame:
    """Of each (file, curie) the last row, as plain loading has it."""
    order = Window.partitionBy("file", "curie").orderBy(F.col("row_no").desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def relabelled(rows: DataFrame, terms: DataFrame, now: str) -> DataFrame:
    """Rows with the ontology's label where it has another one; those get a new time. Adds changed."""
    fresh = terms.where("label is not null and label <> ''").groupBy("curie").agg(F.min("label").alias("fresh"))
    joined = rows.join(fresh, "curie", "left")
    changed = F.col("fresh").isNotNull() & ~F.col("fresh").eqNullSafe(F.col("label"))
    return joined.select("file", "row_no", "curie", F.when(changed, F.col("fresh")).otherwise(F.col("label")).alias("label"), F.when(changed, F.lit(now)).otherwise(F.col("retrieved_at")).alias("retrieved_at"), changed.alias("changed"))


def unsorted(rows: DataFrame) -> DataFrame:
    """(file, unsorted): whether a curie stands before a smaller one.

    Neighbours are compared within blocks of BLOCK row numbers, and the blocks' first and last rows with each other, so
    no task sorts a whole file.
    """
    block = F.floor(F.col("row_no") / BLOCK)
    row = F.struct("row_no", "curie")
    blocks = rows.where("curie is not null").groupBy("file", block.alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    curies = F.transform("rows", lambda r: r["curie"])
    falls = F.exists(F.arrays_zip(F.slice(curies, 1, F.size("rows") - 1).alias("a"), F.slice(curies, 2, F.size("rows")).alias("b")), lambda p: p["b"] < p["a"])
    ends = blocks.select("file", "block", F.element_at("rows", 1)["curie"].alias("first"), F.element_at("rows", -1)["curie"].alias("last"), falls.alias("falls"))
    border = F.coalesce(F.col("first") < F.lag("last").over(Window.partitionBy("file").orderBy("block")), F.lit(False))
    return ends.select("file", (F.col("falls") | border).alias("falls")).groupBy("file").agg(F.bool_or("falls").alias("unsorted"))


def placed(rows: DataFrame) -> DataFrame:
    """rows with place, from 1 in order of curie within each file: ranges of rows are numbered each, and the ranges before are counted."""
    dealt = kept(rows.repartitionByRange("file", "curie").withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("file", "range").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("file", "range").orderBy("curie"))
    return dealt.join(lookup_side(counts), ["file", "range"]).withColumn("place", (F.col("base") + within).cast("int")).drop("range", "base")


def plan(rows: DataFrame, relabel: DataFrame | None = None) -> DataFrame:
    """(file, n_rows, n_duplicates, n_relabelled, unsorted, needs_rewrite). rows: (file, row_no, curie, label, retrieved_at)."""
    counts = rows.groupBy("file", "curie").agg(F.count("*").alias("n")).groupBy("file")
    out = counts.agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("curie")).alias("n_duplicates"))
    out = out.join(unsorted(rows), "file", "left").withColumn("unsorted", F.coalesce("unsorted", F.lit(False)))
    if relabel is not None:
        out = out.join(relabel.groupBy("file").agg(F.count_if("changed").alias("n_relabelled")), "file", "left")
    else:
        out = out.withColumn("n_relabelled", F.lit(0).cast("long"))
    todo = F.col("unsorted") | (F.col("n_duplicates") > 0) | (F.coalesce("n_relabelled", F.lit(0)) > 0)
    return out.select("file", "n_rows", "unsorted", "n_duplicates", "n_relabelled", todo.alias("needs_rewrite"))
