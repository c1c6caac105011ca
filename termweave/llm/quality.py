"""A quality classifier: n-gram indicators scaled by class log-count ratios under a linear hinge-loss model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import text_of

#: Hashed features, labelled rows of each class that are learned from at most, and texts whose words are remembered at once.
DIMENSIONS, PER_CLASS, MEMORY = 2**18, 2500, 300_000

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shape(word: str) -> str:
    """Letters as x (X if capital), digits as 9, others as they are; what repeats is written at most twice."""
    out = []
    for c in word:
        k = ("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        if out[-2:] != [k, k]:
            out.append(k)
    return "".join(out)


class Features:
    """Indices of the n-grams that a text has: words and pairs of words in lower case; one to three word shapes in a row, each
    with whether the word repeats the one before it."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self.words) >= MEMORY:
            self.words.clear()
        high = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) & 0xFFFFFFFFFFFF0000
        value = self.words[word] = high | (xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass"), 1) & 0xFFFF)
        return value

    def __call__(self, text: str) -> np.ndarray:
        known, make = self.words.get, self._word
        words = text.split()
        both = np.fromiter((known(w) or make(w) for w in words), np.uint64, len(words))
        word, form = both >> np.uint64(16), both & np.uint64(0xFFFF)
        form = form + np.uint64(1 << 20) * np.r_[False, word[1:] == word[:-1]].astype(np.uint64)[: len(form)]
        pair = word[:-1] * _ODD + word[1:]
        two = form[:-1] * _ODD + form[1:] if len(form) else form
        three = two[:-1] * _ODD + form[2:] if len(form) > 1 else form[:0]
        grams = [g * _MIX + np.uint64(tag << 56) for tag, g in enumerate((word, pair, form, two, three), 1)]
        x = np.concatenate(grams)
        x = (x ^ (x >> np.uint64(29))) * _ODD
        return np.unique((x >> np.uint64(40)) % np.uint64(DIMENSIONS)).astype(np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))), margin = bias + mean-scaled sum of weights of a text's features."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return self.bias + float(self.weights[features].sum(dtype=np.float64)) / max(1.0, len(features)) ** 0.5

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -700, 700))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Of each feature, the log of its share among the good texts' indicators over that among the bad ones'."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, label in zip(rows, y) if label == k)]), minlength=DIMENSIONS) + smoothing for k in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model, L2-regularised: one dual variable in [0, cost of the row] is optimised at a time.

    The bias is the weight of a constant feature. Ends early once the projected gradients' spread is small.
    """
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        spread = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            step = np.clip(alpha[i] - gradient / norm[i], 0, cost[i]) - alpha[i]
            if step:
                spread = max(spread, abs(step) * norm[i])
                alpha[i] += step
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
        if spread < 1e-3:
            break
    return w, bias


def calibrated(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over weighted margins, by Newton's method on softened targets."""
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, p = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -50, 50)))
        h = x.T @ (x * (weight * q * (1 - q))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (q - target)))
        p = p - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def _learned(rows: list[np.ndarray], y: np.ndarray, rounds: int = 20) -> Model:
    ratio = log_count_ratios(rows, y)
    scaled = [ratio[r] / max(1, len(r)) ** 0.5 for r in rows]
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias = dual_coordinate_descent(rows, scaled, y, cost, rounds)
    return Model((w * ratio).astype(np.float32), float(bias), 1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Calibrated on rows that a model didn't learn from: all five fifths in turn.

    weights says how many labelled rows one row of class 0, of class 1 stands for: scores are calibrated to the shares of these.

    A class of fewer than five rows makes as many parts as it has rows. One row of a class can't be held out of its own
    model, so all rows then calibrate with the margins of the model that learned from them. With one class only there
    is nothing to tell apart: scores are constant, the share of label 1, 0.5 without rows.
    """
    y = np.where(np.asarray(labels) > 0, 1, -1)
    weight = np.where(y > 0, weights[1], weights[0])
    fewest = min((y > 0).sum(), (y < 0).sum())
    if not fewest:
        share = np.clip(np.average(y > 0, weights=weight), 0.001, 0.999) if len(y) else 0.5
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    model, margins = _learned(rows, y), np.zeros(len(y))
    fold = np.zeros(len(y), int)
    for k in (1, -1):
        fold[y == k] = np.arange((y == k).sum()) % min(5, fewest)
    for held in np.unique(fold):
        partial = _learned([rows[i] for i in np.flatnonzero(fold != held)], y[fold != held]) if fewest > 1 else model
        for i in np.flatnonzero(fold == held):
            margins[i] = partial.margin(rows[i])
    model.slope, model.offset = calibrated(margins, y, weight)
    return model


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from at most per_class labelled rows of each class, those of least md5(key), none of them held out.

    Scores are calibrated to the classes' shares in all labels that could be learned from, so they don't depend on per_class.
    Null keys and labels other than 0 and 1 don't count; a key labelled both ways doesn't either. If a key has several
    texts, its label is taken to mean the one of least md5; empty and null texts are learned from like others. Texts of any
    length are read whole on the executors; the driver gets their indices, 4 * DIMENSIONS bytes of a text at most.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
    known = usable.groupBy(F.col(key).cast("long").alias("key")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    known = known.where("label = other")
    order = F.md5(F.col("key").cast("string").cast("binary"))
    sample = [r for k in (0, 1) for r in known.where(F.col("label") == k).orderBy(order).limit(per_class).select("key", "label").collect()]
    if not sample:
        return fit([], np.zeros(0))
    taken = [sum(r["label"] == k for r in sample) for k in (0, 1)]
    there = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = tuple(there[k] / taken[k] if taken[k] else 1.0 for k in (0, 1))
    chosen = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in sample], "key long, label int"))
    texts = df.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")).join(chosen, "key")

    def rows(batches):
        features = Features()
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(1)]
            columns = [batch.column(0), pa.array(found, pa.binary()), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "features", "label", "order"])

    found = texts.select("key", "text", "label", F.md5(F.col("text").cast("binary")).alias("order"))
    found = found.mapInArrow(rows, "key long, features binary, label int, order string")
    # One text of a key, chosen before anything reaches the driver: a key may be on any number of rows.
    got = found.groupBy("key", "label").agg(F.min_by("features", "order").alias("features")).toArrow().to_pylist()
    got.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["key"])), r["key"]))
    return fit([np.frombuffer(r["features"], np.int32) for r in got], np.array([r["label"] for r in got]), weights)


def with_score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """df with a score from 0 to 1 of each whole text (null: empty) in `column`, which replaces one of that name.

    Only the text is looked at, whole however long it is. Repeated rows score alike; rows without words have the score of
    the model's bias; an empty table gives an empty one.
    """
    df = df.drop(column) if column in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        features, m = Features(), shared.value
        for batch in batches:
            scores = [m.score(features(t.as_py() or "")) for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    return df.mapInArrow(rows, schema)
