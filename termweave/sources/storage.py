"""Tables kept between the steps of a plan, and single files, on this machine's disk or on any file system that Spark knows."""

from __future__ import annotations

import fcntl
import fnmatch
import glob
import os
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was measured and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16_000_000


def located(path: str) -> str:
    """A path as Spark needs it: one that exists beside the driver's working folder is made absolute, others are left to Spark."""
    return "file://" + os.path.abspath(path) if "://" not in path and os.path.exists(path) else path


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; one of our own only where neither is set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = held.get() if held.isDefined() else None
    if not known:
        one_machine = spark.sparkContext.master.split("[")[0] == "local"
        known = tempfile.mkdtemp(prefix="termweave-") if one_machine else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, written once and read back; a lost executor doesn't lose them."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a kept() table that nothing will read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is measured to be small, else without: Spark then shuffles both sides.

    What isn't kept yet is kept first, so that measuring doesn't run a plan twice. Columns count as text, with 8 bytes each.
    """
    df = df if hasattr(df, "kept_at") else kept(df)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0).cast("long"))
    n, size = df.agg(F.count("*"), F.sum(width)).head()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


class Files:
    """Whole files by path: local ones by the operating system, others by the file system of their path.

    A path without a scheme is local if Spark's default file system is this machine's, and lies there otherwise.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def local(self, path: str) -> str | None:
        """The path on this machine, or None."""
        if path.startswith("file:"):
            return "/" + path.removeprefix("file:").lstrip("/")
        default = self.spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        return os.path.abspath(path) if "://" not in path and default.startswith("file:") else None

    def uri(self, path: str) -> str:
        here = self.local(path)
        return f"file://{here}" if here else path

    def _remote(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        if here := self.local(path):
            return os.path.exists(here)
        fs, p = self._remote(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        if here := self.local(path):
            if os.path.exists(here):
                os.remove(here)
            return
        fs, p = self._remote(path)
        fs.delete(p, False)

    def list(self, folder: str, pattern: str) -> list[str]:
        """Paths below folder that match pattern (name or folder/name), in order."""
        if here := self.local(folder):
            return sorted(glob.glob(os.path.join(glob.escape(here), pattern)))
        fs, p = self._remote(f"{folder.rstrip('/')}/{pattern}")
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [] if fnmatch.fnmatch(s.getPath().getName(), os.path.basename(pattern)))

    def put(self, path: str, chunks: Iterable[bytes]) -> None:
        """Writes a file beside path and puts it in its place at once: readers see the old content or the new one."""
        name = f".{os.path.basename(path)}.{uuid.uuid4().hex}"
        if here := self.local(path):
            staged = os.path.join(os.path.dirname(here), name)
            os.makedirs(os.path.dirname(here), exist_ok=True)
            try:
                with open(staged, "wb") as f:
                    f.writelines(chunks)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(staged, here)
            finally:
                if os.path.exists(staged):
                    os.remove(staged)
            return
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        (fs, target), (_, staged) = self._remote(path), self._remote(f"{os.path.dirname(path)}/{name}")
        try:
            out = fs.create(staged, True)
            for chunk in chunks:
                out.write(bytearray(chunk))
            out.close()
            over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
            over[0] = hadoop.Options.Rename.OVERWRITE
            hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, target, over)
        finally:
            fs.delete(staged, False)

    @contextmanager
    def locked(self, path: str, timeout: float) -> Iterator[None]:
        """Holds the lock file beside path; TimeoutError if another process holds it too long.

        On this machine the operating system frees the lock of a process that ends. Elsewhere the lock is a file that only one
        process can create; one that is left over must be deleted by hand, and the error names it.
        """
        lock, until, here = path + ".lock", time.monotonic() + timeout, self.local(path)
        late = TimeoutError(f"{lock} is held by another process")
        if here:
            os.makedirs(os.path.dirname(here), exist_ok=True)
            with open(here + ".lock", "w") as f:
                while True:
                    try:
                        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                        break
                    except OSError as held:
                        if time.monotonic() >= until:
                            raise late from held
                        time.sleep(0.05)
                yield
            return
        fs, p = self._remote(lock)
        while not fs.createNewFile(p):
            if time.monotonic() >= until:
                raise late
            time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(p, False)
