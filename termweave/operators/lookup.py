"""Looking identifiers up: labels, prefixes without an ontology, terms that don't exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import prefix_of


def labels(curies: DataFrame, terms: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(curie, label) for each distinct curie; a cached label wins over the ontology's, a missing one is null.

    Terms meet the curies before anything is grouped, so that only those asked for are.
    """
    keys = curies.select("curie").where("curie is not null").distinct()
    out = keys.join(terms.select("curie", "label"), "curie", "left").groupBy("curie").agg(F.min("label").alias("label"))
    if cache is not None:
        out = out.join(cache.select("curie", F.col("label").alias("cached")), "curie", "left").select("curie", F.coalesce("cached", "label").alias("label"))
    return out


def unknown_prefixes(curies: DataFrame, prefixes: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(prefix): prefixes of the curies that no configured ontology answers for, switched-off ones included; curies that the cache answered don't count."""
    keys = curies.select("curie").distinct()
    if cache is not None:
        keys = keys.join(cache.select("curie"), "curie", "left_anti")
    asked = keys.select(prefix_of(F.col("curie")).alias("prefix")).where("prefix is not null").distinct()
    return asked.join(prefixes.where("configured").select("prefix"), "prefix", "left_anti")


def not_found(curies: DataFrame, terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows of curies (column curie, others kept) whose prefix is configured and that are no labelled term."""
    asked = curies.withColumn("prefix", prefix_of(F.col("curie"))).join(prefixes.where("configured").select("prefix"), "prefix")
    return asked.join(terms.where("label is not null and label <> ''").select("curie"), "curie", "left_anti")
