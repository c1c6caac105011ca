"""The label and membership checks over streams of values, joined with static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termweave.operators import checks


def mention_issues(stream: DataFrame, labels: DataFrame, prefixes: DataFrame, strict: bool = False) -> DataFrame:
    """Issues of a stream of pairs (location, curie, label). Rows are independent of each other, so nothing is kept between batches."""
    return checks.pair_issues(stream, labels, prefixes, strict)


def write_issues(issues: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends issues as Parquet, exactly once for each input row; once: takes what there is and ends."""
    writer = issues.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def issue_rates(issues: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Issues for each window of event time and severity; a window ends once the watermark has passed it."""
    return issues.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "severity").agg(F.count("*").alias("n"))
