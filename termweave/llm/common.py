"""What the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources.storage import scratch_dir

#: A side of a join is broadcast only if it was measured and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Paths of the tables that stored() has made within the innermost passing().
_PASSING: ContextVar[set[str] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/termweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if (passing_ := _PASSING.get()) is not None:
        passing_.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes a stored() table that nothing will read any more."""
    _delete(df.sparkSession, df.stored_at)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored() within are deleted at the end, but for those that the yielded function is given: what leaves must be among them."""
    held: set[str] = set()
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    token = _PASSING.set(held)
    try:
        yield keep
    finally:
        _PASSING.reset(token)
        if (outer := _PASSING.get()) is not None:
            outer |= kept
        for path in held - kept:
            _delete(spark, path)


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored() table has at most so many bytes (as text, and 8 for each value) and BROADCAST_ROWS rows, as measured."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        text = F.col(f.name) if f.dataType.simpleString() in ("string", "binary") else F.col(f.name).cast("string")
        width = width + F.coalesce(F.octet_length(text), F.lit(0)) + 8
    n, size = df.agg(F.count("*"), F.sum(width)).head()
    return n <= BROADCAST_ROWS and (size or 0) <= limit


def small(df: DataFrame) -> DataFrame:
    """A stored() table with a broadcast hint if it is measured to be small (see fits), else without: Spark then shuffles both sides."""
    return F.broadcast(df) if fits(df) else df


#: Rows of one key that a join brings to one task at most.
HUB = 50_000


def join_spread(left: DataFrame, right: DataFrame, key: str, spread: str, n_rows: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one row for each key. Keys of more than HUB rows of left are dealt over several parts by `spread`.

    n_rows: rows of left, or more. The keys that are dealt are at most n_rows / HUB. counts (key, n): left's rows of each
    key, if they are known.
    """
    if n_rows > HUB:
        counts = counts if counts is not None else left.groupBy(key).agg(F.count("*").alias("n"))
        hubs = stored(counts.where(F.col("n") > HUB).select(key, F.ceil(F.col("n") / HUB).cast("int").alias("parts")))
        if hubs.take(1):
            hubs = F.broadcast(hubs) if fits(hubs) else hubs
            parts = F.coalesce("parts", F.lit(1))
            left = left.join(hubs, key, "left").withColumn("part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("parts")
            right = right.join(hubs, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
            return left.join(right, [key, "part"], how).drop("part")
    return left.join(right, key, how)


def free_name(name: str, df: DataFrame) -> str:
    """The name, with underscores behind it if df has such a column (in either case) already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
