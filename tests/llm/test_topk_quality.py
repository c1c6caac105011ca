import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from termweave.llm import quality, topk


def brute(rows, k):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {q for q, _ in rows if q % 20 == 0}:
        pairs = ((-sum(x * y for x, y in zip(a, b)), i) for j, a in rows if j == q for i, b in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(pairs)[:k])]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in topk.exact_top_k(df, **more).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 32)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # many ties
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [math.inf] * 8), (None, [1.0] * 8), (520, [0.0] * 8), (540, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got(df, k=5) == brute(rows, 5)


def test_few_rows_and_repeats(spark):
    schema = "vec_id long, embedding array<float>"
    assert got(spark.createDataFrame([], schema)) == [] and got(spark.createDataFrame([(0, [1.0])], schema)) == []
    rows = [(0, [1.0]), (0, [1.0]), (0, [-2.0]), (1, [2.0]), (1, [2.0]), (2, [-1.0])]
    assert got(spark.createDataFrame(rows, schema)) == brute(rows, 20) and len(brute(rows, 20)) == 9
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [-1.0])]
    assert got(spark.createDataFrame(rows, schema)) == brute(rows, 20) and len(brute(rows, 20)) == 3
    rows = [(0, [1.0])] * 5 + [(1, [2.0])] * 30 + [(3, [2.0])] * 30 + [(2, [3.0])] * 2
    assert got(spark.createDataFrame(rows, schema)) == brute(rows, 20)


def test_scores_of_any_size_are_exact(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in (
        [(0, [1e9, 3.0]), (1, [1e9, 5.0]), (2, [1e9, 4.0]), (3, [-1e9, 1.0])],
        [(0, [2.0**24]), (1, [2.0**25]), (2, [1.5 * 2.0**25])],
        [(0, [2.0**20, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 2.0]), (3, [-(2.0**20), 2.0])],
        [(0, [1e200, -3.0]), (1, [1e200, 5.0]), (2, [1e200, 4.0]), (3, [-1e-300]), (4, [1.0, 1e300])],
    ):
        want = [(q, rank, i, s if -(2**63) <= s < 2**63 else None) for q, rank, i, s in brute(rows, 20)]
        assert got(spark.createDataFrame(rows, schema)) == want


def test_blocks_in_parts(spark, monkeypatch):
    """Blocks of a few rows: the rows of one id go to the tasks in several parts."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = random.Random(8)
    rows = [(i % 25, [float(rng.randint(-3, 3)) for _ in range(rng.choice([3, 3, 1]))]) for i in range(90)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7) == brute(rows, 7)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.with_score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where(quality.held_out()).collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5) == 0 for r in rows) and len(rows) > 50
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_and_other_columns_dont_matter(spark):
    rows = [(i, ("good words run on " if i % 3 else "BAD!! BAD!! ") * (i % 7 + 1), i) for i in range(300)] + [(None, None, 1), (None, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(7, 0), (7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ([tuple(r) for r in quality.with_score(df, quality.train(df.drop("score"), x)).orderBy("doc_id", "text").collect()] for x in (labels, flipped))
    assert a == b and len(a) == len(rows)
    assert np.mean([(r[2] >= 0.3) == (r[0] % 3 > 0) for r in a if r[0] is not None]) == 1
    assert quality.with_score(df.limit(0), quality.train(df, labels)).count() == 0


def test_without_labels_scores_are_constant(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.with_score(df, quality.train(df, none)).collect()} == {0.5}


def test_scores_keep_the_labels_shares_beyond_the_cap(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(6))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(700)], "doc_id long, quality int")
    for per_class in (40, 2500):
        scores = [r.score for r in quality.with_score(df, quality.train(df, labels, per_class=per_class)).collect()]
        assert abs(np.mean(scores) - 6 / 7) < 0.08


def test_every_row_calibrates_and_whole_words_have_shapes(monkeypatch):
    learned, real, tried = [], quality._learned, []
    monkeypatch.setattr(quality, "_learned", lambda rows, y, *more: learned.append(len(y)) or real(rows, y, *more))
    calibrated = quality.calibrated
    monkeypatch.setattr(quality, "calibrated", lambda margins, *more: tried.append(len(margins)) or calibrated(margins, *more))
    quality.fit([np.array([i % 2, 2 + i % 5], np.int32) for i in range(1600)], np.arange(1600) % 2)
    assert sorted(learned) == [1280] * 5 + [1600] and tried == [1600]
    assert quality.shape("a" * 70 + "9-B") == "xx9-X"


def test_solver_finds_the_margin():
    rows, y = [np.array([0]), np.array([1])], np.array([1, -1])
    w, bias = quality.dual_coordinate_descent(rows, [np.array([1.0]), np.array([1.0])], y, np.array([10.0, 10.0]), rounds=500)
    assert abs(w[0] - 1) < 1e-2 and abs(w[1] + 1) < 1e-2 and abs(bias) < 1e-2


def test_a_key_on_many_rows_is_learned_from_once(spark, monkeypatch):
    """Cut before the driver: it gets as many texts as keys."""
    rows = [(1, f"spam {i}!!") for i in range(500)] + [(i, "good words run on" if i % 2 else "bad!! bad!!") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    got, real = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, y, *w: got.append(len(y)) or real(rows, y, *w))
    model = quality.train(df, labels)
    assert got == [sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(1, 60))]
    again = quality.train(df.repartition(3), labels)
    assert np.array_equal(model.weights, again.weights) and model.offset == again.offset


def test_few_rows_of_a_class(spark):
    for n in (1, 2, 3, 4, 5, 6):
        rows = [np.array([0, 9], np.int32)] * n + [np.array([1, 9], np.int32)] * 40
        model = quality.fit(rows, np.array([0] * n + [1] * 40))
        assert model.score(rows[0]) < model.score(rows[-1])


def plain_model(rows, y):
    """Log-count ratios, a hinge-loss model by projected gradients over the whole Gram matrix, and its margins, on dense arrays."""
    x = np.zeros((len(rows), 64))
    for i, r in enumerate(rows):
        x[i, r] = 1
    good, bad = 1 + x[y > 0].sum(axis=0), 1 + x[y < 0].sum(axis=0)
    extra = quality.DIMENSIONS - 64
    ratio = np.log(good / (good.sum() + extra)) - np.log(bad / (bad.sum() + extra))
    z = np.column_stack([x * ratio / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None], np.ones(len(x))])
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    gram = (z @ z.T) * y[:, None] * y[None, :]
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(30_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    w = z.T @ (alpha * y)
    return lambda r: w[-1] + (w[r] * ratio[r]).sum() / max(1, len(r)) ** 0.5


def test_model_against_a_plain_dense_one():
    rng = np.random.default_rng(4)
    y = np.where(rng.random(60) < 0.7, 1, -1)
    rows = [np.unique(rng.choice(64, 12, p=np.r_[np.full(32, 1.6 if k > 0 else 0.4), np.full(32, 0.4 if k > 0 else 1.6)] / 64)).astype(np.int32) for k in y]
    mine, plain = quality._learned(rows, y, rounds=3000), plain_model(rows, y)
    assert max(abs(mine.margin(r) - plain(r)) for r in rows) < 0.02
