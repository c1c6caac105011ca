"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.common import passing, scratch_dir, stored

#: Query rows that go to the tasks at once, at most so many bytes of them, and bins of a histogram.
QUERY_BLOCK, BLOCK_BYTES, BINS = 4096, 32_000_000, 1024
#: Numbers up to which 64-bit integers hold every sum, and up to which doubles do.
LONG, DOUBLE = 2**62, 2**53


def _integers(column: pa.ChunkedArray | pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of all components (as floats) and the vectors' sizes."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(np.float64(scale) * rows.flatten().to_numpy().astype(np.float64)), np.diff(rows.offsets.to_numpy())


def _matrix(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row for each vector; shorter vectors end in zeros."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def _pieces(flat: np.ndarray, sizes: np.ndarray):
    """(first row, matrix) of runs of vectors whose matrix has at most BLOCK_BYTES, unless it is one vector."""
    at, starts = 0, np.r_[0, np.cumsum(sizes)]
    while at < len(sizes):
        widest = np.maximum.accumulate(sizes[at:])
        n = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1) * 8, BLOCK_BYTES, side="right")))
        yield at, _matrix(flat[starts[at] : starts[at + n]], sizes[at : at + n])
        at += n


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of vectors of whole numbers, as 64-bit integers, or as Python's where those wouldn't hold them."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = max(1, d) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < DOUBLE:
        return np.rint(a @ b.T).astype(np.int64)
    if most < LONG:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return (whole(a) if a.size else a.astype(object)) @ (whole(b).T if b.size else b.T.astype(object)) + np.zeros((len(a), len(b)), object)


@dataclass
class Block:
    """Some query rows (several may share an id), and what is known of each id's kth score: it lies in a range from lo on.

    need: how many scores of that range are among the k best. An id is settled once all scores from lo on are.
    """

    ids: np.ndarray  # of the query ids, sorted
    row: np.ndarray  # of each query row, its id's place
    times: np.ndarray
    matrix: np.ndarray
    lo: np.ndarray
    need: np.ndarray
    settled: np.ndarray

    def scored(self, candidates: pa.RecordBatch, scale: float):
        """(query rows' id places, times, candidates' ids, scores, which count): a query's own rows don't."""
        flat, sizes = _integers(candidates.column(1), scale)
        keys = candidates.column(0).to_numpy()
        for at, matrix in _pieces(flat, sizes):
            mine = keys[at : at + len(matrix)]
            step = max(1, 2_000_000 // max(1, len(mine)))
            for q in range(0, len(self.row), step):
                row = self.row[q : q + step]
                yield row, self.times[q : q + step], mine, scores(self.matrix[q : q + step], matrix), self.ids[row][:, None] != mine[None, :]


def _histogram(batches, block: Block, span: int, width: int, scale: float):
    """(query_id, bin, n): for each unsettled id, the bins of width from lo up to lo + span, from the top down to the task's own kth score."""
    counts = np.zeros((len(block.ids), BINS), np.int64)
    for batch in batches:
        for row, times, _, s, other in block.scored(batch, scale):
            beyond = s - block.lo[row][:, None]
            inside = other & (beyond >= 0) & (beyond < span) & ~block.settled[row][:, None]
            place = (beyond // width).astype(np.int64) + (np.arange(len(row)) * BINS)[:, None] if beyond.dtype != object else None
            if place is None:  # numbers beyond 64 bits: their bins are small again
                q, c = np.nonzero(inside)
                found = q * BINS + (beyond[q, c] // width).astype(np.int64)
            else:
                found = place[inside]
            mine = np.bincount(found, minlength=len(row) * BINS).reshape(len(row), BINS)
            np.add.at(counts, row, mine * times[:, None])
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    q, b = np.nonzero((counts > 0) & (above < block.need[:, None]))
    for at in range(0, max(1, len(q)), 50_000):
        i, j = q[at : at + 50_000], b[at : at + 50_000]
        columns = [pa.array(x, pa.int64()) for x in (block.ids[i], j, counts[i, j])]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "bin", "n"])


def _best(batches, block: Block, scale: float, digits: int, offset: int):
    """(query_id, vec_id, score, place, n): scores above lo, and of those equal to it the smallest ids that a task can need at most.

    place orders scores of any size: they are written with as many digits, from the smallest possible on.
    """
    names, types = ["query_id", "vec_id", "score", "place", "n"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for row, times, keys, s, other in block.scored(batch, scale):
            lo = block.lo[row][:, None]
            q, c = np.nonzero(other & (s > lo))
            tied_q, tied_c = np.nonzero(other & (s == lo) & (block.need[row][:, None] > 0))
            order = np.lexsort((keys[tied_c], row[tied_q]))
            tied_q, tied_c = tied_q[order], tied_c[order]
            first = np.searchsorted(row[tied_q], row[tied_q], side="left")
            enough = np.arange(len(tied_q)) - first < block.need[row[tied_q]]
            q, c = np.r_[q, tied_q[enough]], np.r_[c, tied_c[enough]]
            if len(q):
                values = [int(x) for x in s[q, c]]
                shown = [x if -(2**63) <= x < 2**63 else None for x in values]
                places = [f"{x + offset:0{digits}d}" for x in values]
                out = (block.ids[row[q]], keys[c], shown, places, np.minimum(times[q], 2**31 - 1))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)


def _load(rows: pa.Table, scale: float, most: int, known: dict[int, tuple[int, int, bool]] | None, k: int) -> Block:
    ids, row = np.unique(rows["vec_id"].to_numpy(), return_inverse=True)
    flat, sizes = _integers(rows["v"], scale)
    matrix = _matrix(flat, sizes)
    state = [(known or {}).get(int(i), (-most, k, False)) for i in ids]
    kind = np.int64 if most < LONG else object
    lo = np.array([x[0] for x in state], dtype=kind)
    return Block(ids, row, rows["times"].to_numpy(), matrix, lo, np.array([x[1] for x in state], np.int64), np.array([x[2] for x in state], bool))


def exact_top_k(df: DataFrame, is_query: Column | None = None, k: int = 20, scale: float = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Components become floor(scale * x). Queries are the rows for which is_query holds (default: key divisible by 20),
    candidates all rows but those with the query's id. Candidates stay where they are; queries go to them in blocks of
    at most QUERY_BLOCK rows and BLOCK_BYTES, a job for each block and round. A task reports a histogram of each
    query's scores, down to its own kth; histograms are summed, and the bin with the kth score becomes the next
    round's range, until the bin is one score wide or all of it is wanted. So only histograms move between tasks and a
    row for each query of a block reaches the driver. The last round emits what lies above the threshold, and of
    those equal to it the smallest ids that a task needs at most. No task and no driver holds all scores of a query.

    Scores are exact whatever their size. Where one doesn't fit into a long, its rank is right and the score null.
    Rows with a null key, or a vector null or with null or non-finite components, take no part. Every other row
    is a candidate, repeated ones too; rows that share a query's id are queries of that id together, so their pairs
    are ranked in one list, and repeated ones count as often as they are there. Shorter vectors are taken to end in zeros;
    empty ones score 0. Other columns aren't looked at. Without queries or candidates the result is empty.
    """
    spark = df.sparkSession
    is_query = is_query if is_query is not None else F.col("vec_id") % 20 == 0
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    path = f"{scratch_dir(spark)}/termweave-{uuid.uuid4().hex}"
    schema = "query_id long, vec_id long, score long, place string, n long"
    spark.createDataFrame([], schema).write.parquet(path)
    with passing(spark):
        rows = stored(rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))))
        largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
        top = rows.agg(F.max(largest).alias("m"), F.max(F.size("v")).alias("d")).head()
        width = max(1, top["d"] or 0)
        most = (int(abs(scale) * (top["m"] or 0.0)) + 1) ** 2 * width
        size = max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * width)))
        queries = stored(rows.where(is_query).groupBy("vec_id", "v").agg(F.count("*").alias("times")))
        n_blocks = max(1, math.ceil(queries.count() / size))
        # All rows of an id are in one block; blocks with too many rows go to the tasks in several parts.
        queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
        parts = queries.groupBy("block").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
        queries = stored(queries.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("v", F.lit(1)), F.col("parts")).cast("int")))
        known_parts = sorted((r["block"], r["part"]) for r in queries.select("block", "part").distinct().collect())
        for block in sorted({b for b, _ in known_parts}):
            _select(spark, rows, queries, [p for b, p in known_parts if b == block], block, most, scale, k, path)
    found = spark.read.schema(schema).parquet(path)
    each = found.select("query_id", "vec_id", "score", "place", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    order = Window.partitionBy("query_id").orderBy(F.col("place").desc(), F.col("vec_id"))
    best = each.withColumn("rank", F.row_number().over(order).cast("int"))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _select(spark: SparkSession, rows: DataFrame, queries: DataFrame, parts: list[int], block: int, most: int, scale: float, k: int, path: str) -> None:
    """Finds the kth score of each query id of a block, round by round, and appends the scores from there on to the table at path."""

    def over_parts(known, run, schema: str, done) -> None:
        for part in parts:
            mine = queries.where((F.col("block") == block) & (F.col("part") == part)).select("vec_id", "v", "times").toArrow()
            sent = spark.sparkContext.broadcast(_load(mine, scale, most, known, k))
            done(rows.select("vec_id", "v").mapInArrow(lambda batches: run(batches, sent.value), schema))
            sent.unpersist()

    state: dict[int, tuple[int, int, bool]] = {}
    span = 2 * most + 1
    while True:
        width = -(-span // BINS)
        tables: list[DataFrame] = []
        run = lambda b, q, x=span, w=width: _histogram(b, q, x, w, scale)
        summed = lambda t: tables.append(stored(t.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))))
        over_parts(state, run, "query_id long, bin long, n long", summed)
        counts = tables[0]
        for t in tables[1:]:
            counts = counts.unionByName(t)
        needs = spark.createDataFrame([(i, n) for i, (_, n, _) in state.items()], "query_id long, need long")
        need = F.coalesce("need", F.lit(k))
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).join(F.broadcast(needs), "query_id", "left").withColumn("need", need)
        upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bin").desc()))
        counts = counts.withColumn("left", F.col("need") - upto + F.col("n")).where("left > 0")
        # The lowest bin from which scores are wanted; fewer than wanted in all means that all are.
        cut = counts.groupBy("query_id").agg(F.min_by(F.struct("bin", "left", "n"), "bin").alias("x"))
        for r in cut.select("query_id", "x.bin", "x.left", "x.n").collect():
            low, _, _ = state.get(r["query_id"], (-most, k, False))
            low += r["bin"] * width
            every = r["n"] <= r["left"]
            # A settled id takes all above the number before its bin and needs none equal to that.
            state[r["query_id"]] = (low - 1, 0, True) if every else (low, r["left"], width == 1)
        if width == 1 or all(settled for _, _, settled in state.values()):
            break
        span = width
    digits = len(str(2 * most + 1))
    run = lambda b, q: _best(b, q, scale, digits, most)
    over_parts(state, run, "query_id long, vec_id long, score long, place string, n long", lambda t: t.write.mode("append").parquet(path))
