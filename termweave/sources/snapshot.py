"""Snapshots of labels and enumerations: sorted CSV files that make a validation repeatable offline.

Only the driver writes them, under a lock, beside the target, and then puts them in its place. A folder without a scheme lies on
the driver's machine if that is Spark's default file system; executors on other machines need a shared one.
"""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators import migrate
from termweave.operators.enums import fingerprint
from termweave.sources.schema import EnumSpec
from termweave.sources.storage import Files, kept

LABELS = "curie string, label string, retrieved_at string"
LOCK_SECONDS = 30.0
#: Rows that are written at once.
ROWS = 10_000


def _csv(rows: DataFrame) -> Iterator[bytes]:
    """A header and the rows in order of curie, LF at line ends. The driver holds one partition at a time."""
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(rows.columns)
    for n, row in enumerate(rows.orderBy("curie").toLocalIterator(), 1):
        out.writerow(["" if x is None else x for x in row])
        if n % ROWS == 0:
            yield text.getvalue().encode()
            text.seek(0)
            text.truncate()
    yield text.getvalue().encode()


def write_csv(df: DataFrame, path: str) -> None:
    """One sorted CSV file with a header and LF line ends, put in place at once. Values may hold line breaks."""
    Files(df.sparkSession).put(path, _csv(df))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows in file order, as row_no; columns that the file lacks are null."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(Files(spark).uri(path))
    wanted = [c.split()[0] for c in schema.split(", ")]
    columns = (F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in wanted)
    return found.select(*columns, F.monotonically_increasing_id().alias("row_no"))


class LabelCache:
    """<folder>/<prefix in lower case>/terms.csv with curie, label and retrieved_at."""

    def __init__(self, spark: SparkSession, folder: str, enabled: bool = True, lock_seconds: float = LOCK_SECONDS):
        self.spark, self.folder, self.enabled, self.files, self.lock_seconds = spark, folder, enabled, Files(spark), lock_seconds

    def path(self, prefix: str) -> str:
        return os.path.join(self.folder, prefix.lower(), "terms.csv")

    def _rows(self, path: str, name: str) -> DataFrame:
        rows = read_csv(self.spark, path, LABELS) if self.files.exists(path) else self.spark.createDataFrame([], LABELS + ", row_no long")
        return rows.select(F.lit(name).alias("file"), "row_no", "curie", "label", F.coalesce("retrieved_at", F.lit("")).alias("retrieved_at"))

    def rows(self, prefix: str) -> DataFrame:
        """Every row as written: (file, row_no, curie, label, retrieved_at), a missing time as empty text."""
        return self._rows(self.path(prefix), prefix)

    def load(self, prefixes: list[str]) -> DataFrame:
        """(curie, label, retrieved_at); of repeated curies the last row counts. Nothing if the cache is off."""
        parts = [migrate.last_wins(self.rows(p)).select("curie", "label", "retrieved_at") for p in prefixes] if self.enabled else []
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], LABELS)

    def save(self, prefix: str, labels: DataFrame, now: str | None = None) -> None:
        """Takes over (curie, label) of one prefix; a label that didn't change keeps its time. Nothing if the cache is off."""
        if not self.enabled:
            return
        now = now or datetime.now().isoformat()
        with self.files.locked(self.path(prefix), self.lock_seconds):
            old = self.load([prefix])
            new = labels.where("label is not null").groupBy("curie").agg(F.min("label").alias("new_label"))
            same = F.col("new_label").isNull() | F.col("new_label").eqNullSafe(F.col("label"))
            time = F.when(same, F.col("retrieved_at")).otherwise(F.lit(now)).alias("retrieved_at")
            merged = old.join(new, "curie", "full_outer").select("curie", F.coalesce("new_label", "label").alias("label"), time)
            write_csv(merged, self.path(prefix))

    def migrate(self, terms_of=None, sort_only: bool = False, dry_run: bool = False, now: str | None = None) -> Iterator[dict]:
        """Rewrites the files that have repeated or stale rows or the wrong order; yields a report for each file.

        terms_of(curies) gives fresh labels. changes in a report is a table (curie, old, label) or None.
        """
        for path in self.files.list(self.folder, "*/terms.csv"):
            rows, changes, fresh = self._rows(path, path), None, None
            best = migrate.latest(rows)
            if terms_of is not None and not sort_only:
                fresh = kept(migrate.relabelled(best, terms_of(best), now or datetime.now().isoformat()))
                old = best.select("curie", F.col("label").alias("old"))
                changes = kept(fresh.where("changed").join(old, "curie").select("curie", "old", "label"))
            todo = migrate.plan(rows, fresh).head()
            report = {
                "path": path, "rewrite": bool(todo and todo["needs_rewrite"]), "duplicates": todo["n_duplicates"] if todo else 0,
                "relabelled": changes.count() if changes is not None else 0, "changes": changes, "unsorted": bool(todo and todo["unsorted"]),
            }
            if report["rewrite"] and not dry_run:
                with self.files.locked(path, self.lock_seconds):
                    write_csv((fresh if fresh is not None else best).select("curie", "label", "retrieved_at"), path)
            yield report


class EnumCache:
    """<folder>/enums/<name>_<fingerprint>.csv with one value a line; a sibling .complete marks the whole closure."""

    def __init__(self, spark: SparkSession, folder: str, enabled: bool = True, lock_seconds: float = LOCK_SECONDS):
        self.spark, self.folder, self.enabled, self.files, self.lock_seconds = spark, folder, enabled, Files(spark), lock_seconds

    def path(self, spec: EnumSpec) -> str:
        return os.path.join(self.folder, "enums", re.sub(r"[^\w\-]", "_", spec.name.lower()) + f"_{fingerprint(spec)}.csv")

    def is_complete(self, spec: EnumSpec) -> bool:
        return self.files.exists(self.path(spec) + ".complete")

    def load(self, spec: EnumSpec) -> DataFrame | None:
        """(value), or None if nothing is kept for this definition or the cache is off."""
        path = self.path(spec)
        if not self.enabled or not self.files.exists(path):
            return None
        return read_csv(self.spark, path, "curie string").select(F.col("curie").alias("value")).where("value is not null").distinct()

    def save(self, spec: EnumSpec, values: DataFrame, complete: bool) -> None:
        """Replaces what is kept, or adds to it if the values are but some; the mark is set last, so a failed run leaves none."""
        if not self.enabled:
            return
        path = self.path(spec)
        with self.files.locked(path, self.lock_seconds):
            known = None if complete else self.load(spec)
            rows = values.select("value") if known is None else values.select("value").union(known)
            self.files.remove(path + ".complete")
            write_csv(rows.where("value is not null").distinct().select(F.col("value").alias("curie")), path)
            if complete:
                self.files.put(path + ".complete", [])
