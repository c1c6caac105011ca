import random

import numpy as np
import pyarrow as pa

from termweave.llm import neardup
from termweave.llm.graph import components


def brute(rows, n=4, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, len(sets[i]), least[root(i)], k == least[root(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 4, 8, 60, 200]))
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate([*rows, None, "", " \n ", "A b\tC", "a B c", "x", "X ", "é é é é é", "É é é é é", "a\x1cb c d e"], start=5))


def got(df, **options):
    return sorted(tuple(r) for r in neardup.near_duplicates(df, **options).collect())


def test_same_components_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in rows], "doc_id long, text string, node int, signature string")
    assert got(df, n=4) == brute(rows)
    assert got(df.limit(0), n=4) == []


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(df, n=4) == brute(rows)


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "q r s t u"), (2, None)], "doc_id long, text string")
    assert sorted(map(str, got_rows(df))) == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 2, None, True), (2, 0, 2, True)]))


def got_rows(df):
    return [tuple(r) for r in neardup.near_duplicates(df, n=4).collect()]


def near_copies(rng, base, n, words=120):
    out = []
    for i in range(n):
        copy = list(base)
        copy[rng.randrange(words)] = f"x{i}"
        out.append(" ".join(copy))
    return out


def test_large_groups_go_by_pivots(spark, monkeypatch):
    """Groups of every size above ten by way of pivots, in blocks of four: clusters that chains join, and texts between them."""
    metric = neardup.Metric
    monkeypatch.setattr(neardup, "Metric", lambda d, limit, links, whole, block: metric(d, limit, links, 10, 4))
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 3)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = near_copies(rng, base, 40)
    # Steps of nine words stay linked with the one before, steps of thirteen are candidates that aren't.
    for at in (9, 18, 27, 40, 53, 62, 75, 88, 101, 114):
        away = [f"v{i}" if i < at else w for i, w in enumerate(base)]
        texts += [" ".join(away), *near_copies(rng, away, rng.choice([0, 3, 12]))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 3 < len({w[2] for w in want}) < 40 and got(df, n=4) == want


def test_five_thousand_near_copies_are_walked_through_once(spark, monkeypatch):
    met, real = [], neardup._confirm

    def counted(batches, percent):
        def seen():
            for batch in batches:
                met.append(len(batch))
                yield batch

        return real(seen(), percent)

    rng = random.Random(2)
    base = [f"w{i}" for i in range(90)]
    rows = list(enumerate(near_copies(rng, base, 5000, 90) + [" ".join(rng.choices(base, k=90)) for _ in range(20)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(df, n=4)
    assert sum(r[2] == 0 for r in out) == 5000 and sum(r[3] for r in out) == 21
    # All are one cluster around the pivots, so none of them meet.
    sets = [(0, i, neardup.shingles(neardup.words_of(t), 4).astype("<u8").tobytes()) for i, t in rows[:5000]]
    links = neardup._linked(
        spark.createDataFrame(sets, "grp long, node long, payload binary"),
        spark.createDataFrame([(0, 5000, 0)], "grp long, n long, lead long"),
        neardup.Metric(neardup._jaccard_distances, 0.2, lambda b: counted(b, 80), 512, 256),
    )
    assert links.count() < 8 * 5000 and not met


def test_distances_are_metrics():
    rng = random.Random(7)
    sets = [np.unique(np.array(rng.choices(range(60), k=rng.randint(1, 50)), "<u8")) for _ in range(25)]
    far = neardup._jaccard_distances([s.tobytes() for s in sets], [s.tobytes() for s in sets])
    plain = [[1 - len(set(a) & set(b)) / len(set(a) | set(b)) for b in map(list, sets)] for a in map(list, sets)]
    assert np.allclose(far, plain) and all(far[i, k] <= far[i, j] + far[j, k] + 1e-9 for i in range(25) for j in range(25) for k in range(25))


def test_all_signatures_within_the_radius_meet():
    index, rng = neardup.Index(), np.random.default_rng(3)
    for errors in (0, 20, index.radius):
        a = rng.integers(0, 2**16, index.symbols, dtype=np.uint16)
        for _ in range(50):
            b = a.copy()
            b[rng.choice(index.symbols, errors, replace=False)] ^= 1
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["id", "signature"])
            entries = [x for e in neardup._entries([batch], index) for x in e.column(0).to_pylist()]
            assert len(set(entries)) < len(entries)


def test_hubs_are_dealt_out(spark, monkeypatch):
    from termweave.llm import common

    monkeypatch.setattr(common, "HUB", 5)
    links = [(100, i) for i in range(40)] + [(40 + i, 100) for i in range(20)] + [(200, 201), (201, 202)]
    out = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert out == {i: 0 for i in range(60)} | {100: 0, 200: 200, 201: 200, 202: 200}


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i != 20] + [(50, 60), (60, 50), (7, 7)]
    out = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert out == {i: 0 if i <= 20 else 21 for i in range(41)} | {50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
