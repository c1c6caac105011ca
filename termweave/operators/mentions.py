"""Mentions of terms in text, line by line."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import MENTION, lines_of


class PatternError(ValueError):
    """A pattern that doesn't compile or has too few groups."""


def checked_pattern(pattern: str, curie_group: int = 1, label_group: int = 2) -> re.Pattern:
    try:
        compiled = re.compile(pattern)
    except re.error as wrong:
        raise PatternError(f"Invalid regex pattern: {wrong}") from wrong
    for name, group in (("--curie-group", curie_group), ("--label-group", label_group)):
        if not 0 <= group <= compiled.groups:
            raise PatternError(f"{name} {group} is out of range (pattern has {compiled.groups} group(s))")
    return compiled


def text_lines(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line) of texts (doc_id, text)."""
    return texts.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("int").alias("line_no"), "line")


def mentions(texts: DataFrame, pattern: str = MENTION, curie_group: int = 1, label_group: int = 2) -> DataFrame:
    """(doc_id, location, curie, label) of every match in every line.

    The usual pattern runs as Spark's own expressions. Others are Python's, so they run in Python, over Arrow
    batches. An optional group that didn't take part gives a null.
    """
    compiled = checked_pattern(pattern, curie_group, label_group)
    lines = text_lines(texts)
    location = F.concat(F.lit("line:"), F.col("line_no").cast("string"))
    if pattern == MENTION:
        found = lambda group: F.regexp_extract_all("line", F.lit(pattern), F.lit(group))
        hits = lines.where(F.contains("line", F.lit("@term "))).select("doc_id", location.alias("location"), F.explode(F.arrays_zip(found(curie_group).alias("curie"), found(label_group).alias("label"))).alias("m"))
        return hits.select("doc_id", "location", "m.curie", "m.label")

    def match(batches):
        for batch in batches:
            rows = [(d, where, m[curie_group], m[label_group]) for d, where, line in zip(batch["doc_id"], batch["location"], batch["line"]) for m in compiled.finditer(line)]
            yield pd.DataFrame(rows, columns=["doc_id", "location", "curie", "label"])

    key = texts.schema["doc_id"].dataType.simpleString()
    return lines.select("doc_id", location.alias("location"), "line").mapInPandas(match, f"doc_id {key}, location string, curie string, label string")
