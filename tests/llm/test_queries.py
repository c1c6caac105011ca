"""Every opN_ query over whole prepared tables: against its SQL, or, where SQL can't say it, against a plain version."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from termweave.llm import queries, tokens

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, con, name):
    mine, plain = queries.queries()[name](spark, SF).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(plain.columns) and len(mine) > 0 and rows(mine) == rows(plain)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_media(spark, texts):
    out = queries.op3_media_columns(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_quality(spark, texts):
    out = {r.doc_id: r for r in queries.op5_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(out) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in out.items())
    held = [r.predicted == labels[k] for k, r in out.items() if r.held_out and k in labels]
    assert np.mean(held) > 0.85


def test_pages(spark):
    from tests.llm.test_pages import articles

    out = queries.op6_extract_html(spark, SF).collect()
    assert {r.page_id: r.text for r in out} == articles(spark.read.parquet(f"{SF}/pages.parquet")) and all(r.n_chars == len(r.text) for r in out)


def test_packing(spark, texts):
    encoder, pieces, sequences = tokens.Encoder(), {}, {}
    for r in queries.op7_pack(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        ids, at = encoder.ids(texts[k]) + bytes(4), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_token_counts(spark, texts):
    encoder = tokens.Encoder()
    out = {r.doc_id: r for r in queries.op10_token_counts(spark, SF).collect()}
    assert set(out) == set(texts)
    for k, r in out.items():
        text = texts[k]
        n = len(text)
        for start, end, new in ((n // 3, n // 3, " (put in later) "), (n // 2, n // 2 + 40, ""), (n - 34, n - 24, "the end.")):
            start, end = min(max(0, start), len(text)), min(max(0, end), len(text))
            text = text[:start] + new + text[max(start, end) :]
        assert (r.n_tokens, r.tokens_after, r.chars_after) == (len(encoder.ids(texts[k])) // 4, len(encoder.ids(text)) // 4, len(text))
