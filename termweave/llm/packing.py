"""Packing documents into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import stored, text_of
from termweave.llm.tokens import Encoder

#: Rows of one length that a task ranks at most, on average: lengths are split into so many salts.
SALT_ROWS, MIN_SALTS = 60_000, 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(batches, path: str | None, size: int, end_id: int, specials: bool):
    encoder, end = Encoder(path, specials), np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encoder.ids(text.as_py()) + end
            n = len(ids) // 4
            for at in range(0, n, size):
                piece = ids[4 * at : 4 * (at + size)]
                for column, value in zip(out, (doc_id, at, len(piece) // 4, zlib.crc32(piece), n)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[c.split()[0] for c in PIECES.split(", ")])


def tokenize_and_cut(
    df: DataFrame, size: int, path: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text", specials: bool = False
) -> DataFrame:
    """Each document's ids and its end id, cut every `size` ids; only the last piece may be shorter. specials: see Encoder."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(lambda b: _pieces(b, path, size, end_id, specials), PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns that hold every length as often as the histogram says.

    Lengths are placed longest first. All pieces of a length are placed at once: into the patterns that have
    the most room left, as many copies of a pattern as pieces remain, and into new packs only where no open
    pattern has room. The work depends on the number of lengths, not on the number of pieces.
    """
    room: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            free = max((r for r in room if r >= length and room[r]), default=None)
            if free is None:
                each = size // length
                full, rest = divmod(left, each)
                grown += [(size - each * length, [full, (length,) * each])] * (full > 0) + [(size - rest * length, [1, (length,) * rest])] * (rest > 0)
                break
            count, lengths = room[free].pop()
            each = min(free // length, math.ceil(left / count))
            used = min(count, left // each)
            if used < count:
                room[free].append([count - used, lengths])
            grown.append((free - each * length, [used, lengths + (length,) * each]))
            left -= used * each
        for free, entry in grown:
            room[free].append(entry)
    return sorted((count, lengths) for entries in room.values() for count, lengths in entries)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of its runs; rank r in a run lies in sequence first + (r - first rank)."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            runs[length].append((ranks[length], sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for length, r in runs.items()}


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank, from 0 within each length. Lengths are split by salt, so that no task ranks all pieces of a frequent one."""
    salts = max(MIN_SALTS, math.ceil(pieces.count() / SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return salted.withColumn("place", F.row_number().over(within) - 1).join(offsets.drop("count"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place")).drop("salt", "place", "base")


PACKED = PIECES + ", sequence_id long, offset long"


def pack(
    df: DataFrame, size: int = 1024, path: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text", specials: bool = False
) -> DataFrame:
    """A row for each piece with its sequence and its offset there.

    Documents are cut into pieces of `size` ids and a rest; pieces are never cut again. The driver sees the
    histogram of lengths only (at most `size` rows) and makes the patterns; pieces find their place by their
    rank within their length. A null text is an empty one and yields the end id alone; very long texts are
    tokenized whole; repeated rows are packed each; null keys stay null; ties in rank are between equal rows; other
    columns aren't looked at; an empty table gives an empty one. Strings of special tokens in a text are ordinary text, or, with
    specials=True, those tokens.
    """
    pieces = stored(tokenize_and_cut(df, size, path, end_id, key, text, specials))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = slots(shortest_pack_first(histogram, size))

    def placed(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first, sequences, offsets = places[n]
                mine = np.flatnonzero(length == n)
                run = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = sequences[run] + rank[mine] - first[run], offsets[run]
            columns = [batch.column(batch.schema.get_field_index(c.split()[0])) for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[c.split()[0] for c in PACKED.split(", ")])

    return ranked(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(placed, PACKED)
