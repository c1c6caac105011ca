import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from pyspark.sql import functions as F

from termweave.llm import neardup
from termweave.llm.common import stored
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and the output of the last."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()


def test_quality_keeps_rows_as_they_are(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert not Counter(after) - Counter(before) and 0.5 * len(before) < len(after) < len(before)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r[0] for r in after}
    assert len(good - kept) <= 0.05 * len(good)


def test_one_document_of_each_group_stays(stages):
    texts = [(r.doc_id, r.text) for r in stages[1].collect()]
    stay = {k for k, _, _, kept in brute(texts, n=5) if kept}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(stay)


PLAIN = [
    (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}", lambda m: True),
]


def plain_redacted(text):
    hidden = sorted((m.start(), m.end()) for p, good in PLAIN for m in re.finditer(p, text, re.A) if good(m))
    out, at = [], 0
    for start, end in hidden:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_secrets_are_hidden(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = stages[3].collect()
    assert len(after) == len(before)
    for r in after:
        assert r.text == plain_redacted(before[r.doc_id].text) and r.n_chars == len(r.text)


def test_mix_repeats_documents(stages):
    """Each document as often as the plain mix takes it."""
    from tests.llm.test_mixing import plain

    before, after = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    for doc_id, size, whole, target, taken in plain([(r.doc_id, r.source, r.text) for r in before]):
        times = int(taken / size + 0.5) if size else int(target // max(1, whole))
        assert after[doc_id] == times
    assert not set(map(tuple, stages[4].collect())) - set(map(tuple, before))


def test_every_copy_is_packed_whole(stages):
    from termweave.llm.tokens import Encoder

    encoder, held = Encoder(), Counter()
    for r in stages[4].collect():
        held[r.doc_id] += len(encoder.ids(r.text)) // 4 + 1
    packed, places = Counter(), {}
    for r in stages[5].collect():
        packed[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert packed == held
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_same_rows(spark, stages):
    key = lambda df: sorted(df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect())
    assert key(cp.run(spark, SF)) == key(stages[-1])


ODD_COLUMNS = ["_quality", "secret_spans", "mix_size", "mix_copy", "_set", "_SEVERAL", "row", "key", "body", "place", "part", "n", "kept"]


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and columns with names that stages use."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 9), (1, base, "en", "a", 9), (2, base + " end", "en", "a", 9), (3, None, "en", None, None), (3, None, "en", None, None), (4, "", None, "b", 0),
        (None, base + " end", None, None, 1), (None, "only here and nowhere else in this table", "en", "b", 2), (5, "unique text of an id on two rows", "en", "a", 3),
        (5, base + " end", "en", "b", 3), (6, "password = hunter22 " * 5, "en", "b", 100), (7, "long words " * 60_000, "en", "c", 660_000), (8, "x", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.concat(F.lit(c), F.col("n_chars").cast("string")).alias(c) for c in ODD_COLUMNS))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = odd_documents(spark)
    spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sides = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        sides[name] = out.collect()
        assert all(r[c] is None or r[c] == f"{c}{r.n_chars}" or name == "secret_scan" and r.doc_id == 6 for r in sides[name] for c in ODD_COLUMNS), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert len(sides["secret_scan"]) == docs.count() and {r.n_chars for r in sides["secret_scan"] if r.doc_id == 6} == {45}
    stay = Counter((r.doc_id, (r.text or "")[-20:]) for r in sides["minhash_near_dedup"])
    # Of the copies of the base text the least id stays, once; an id on two rows is judged for each of its texts.
    assert stay[1, "word57 word58 word59"] == 1 and sum("word5" in k[1] for k in stay.elements()) == 1
    assert stay[5, "f an id on two rows"[-20:]] + stay[5, "t of an id on two rows"[-20:]] == 1 and stay[3, ""] == 1 and stay[4, ""] == 1 and stay[None, "here else in this table"[-20:]] == 1
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id", "start").distinct().count() > 8 and packed.where("start = 0").count() == docs.count()


def test_sets_are_named_alike(spark):
    df = spark.createDataFrame([(1, "A b c d e f", "x"), (2, "a B c d e f", "y"), (3, None, "z"), (4, "other words", "x")], "doc_id long, text string, set string")
    names = {r.doc_id: r.set_ for r in neardup.with_set(df, "set_").collect()}
    assert names == {r.doc_id: r.set for r in neardup.near_duplicates(df, with_sets=True).collect()} and names[1] == names[2] != names[4] and names[3] is None
