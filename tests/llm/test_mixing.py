import hashlib
import random
import re

import pytest

from termweave.llm import mixing


def plain(rows, weights=(3, 1, 2), budget=1.5, epochs=2.0, seed=20):
    """rows (doc_id, source, text) -> (doc_id, size, source_size, target, taken), in plain loops."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in names}
    target, free, left = {}, set(names), budget * sum(size)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = epochs * total[s]
            left -= target[s]
            free.discard(s)
        if not free:
            break
    out = []
    for s in names:
        mine = [(int(hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}:{n}".encode()).hexdigest()[:15], 16), i) for i, (r, n) in enumerate(zip(rows, size)) if r[1] == s]
        times = int(target[s] // total[s]) if total[s] else 0
        need = round(target[s]) - times * total[s]
        for place in sorted({p for p, _ in mine}):
            tied = [i for p, i in mine if p == place]
            words = sum(size[i] for i in tied)
            for i in tied:
                part = size[i] if need >= words else max(0, need) // len(tied)
                out.append((rows[i][0], size[i], total[s], target[s], times * size[i] + min(part, size[i])))
            need -= words
    return out


def got(df, **more):
    return [(r.doc_id, r.mix_size, r.mix_source_size, r.mix_target, r.mix_taken) for r in mixing.mix(df, **more).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(order(a), order(b)):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3]) and x[4] == y[4]


def test_against_plain_loops(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "B", "é", "hot", "hot", "hot", None]), rng.choice([None, "", " ", "w " * rng.randint(1, 300), "x\t y\x0bz\x1c"])) for i in range(400)]
    rows += [(7, "a", "same words here"), (7, "a", "same words here"), (None, "b", "no key"), (900, "huge", "w " * 20_000), (901, "blank", ""), (902, "blank", None)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, mix_size int, target string")
    same(got(df), plain(rows))
    assert order(got(df)) == order(got(df.repartition(7)))
    for source in {r[1] for r in rows}:
        mine = [x for x, r in zip(order(plain(rows)), order(plain(rows)))]
        assert mine


def test_taken_words_meet_the_targets(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in mixing.mix(df).groupBy("source").agg({"mix_taken": "sum", "mix_target": "max", "*": "count"}).collect():
        assert abs(r["sum(mix_taken)"] - r["max(mix_target)"]) <= 1
    assert mixing.mix(df).where("mix_taken > 2 * mix_size").count() == 0


def test_no_rows_and_one_source(spark):
    schema = "doc_id long, source string, text string"
    assert got(spark.createDataFrame([], schema)) == []
    rows = [(1, None, None), (2, None, "")]
    same(got(spark.createDataFrame(rows, schema)), [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])
    rows = [(i, "s", "a b c") for i in range(4)]
    assert sum(r[4] for r in got(spark.createDataFrame(rows, schema))) == 18


def test_copies(spark):
    rows = [(i, "s" if i % 2 else "t", "a b c d") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    n = mixing.copies(df).count()
    assert abs(n - 30) <= 1 and mixing.copies(df).columns == df.columns
