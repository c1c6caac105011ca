import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.llm import chat, media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.sampled_from([255, 256, 1000, 4000, 70_000]))
def test_round_trip(data, packet):
    track = media.decode(media.encode(data, packet=packet))
    assert track.samples == data
    assert not data or track.times[-1] == pytest.approx(len(data) / media.RATE)


def slow_checksum(page):
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for page in (b"", b"OggS", bytes(range(256)) * 3):
        assert media.page_checksum(page) == slow_checksum(page)


def test_long_packets_span_pages_and_streams_are_parted():
    data = bytes(range(256)) * 900
    raw = media.encode(data, packet=200_000)
    streams = media.demultiplex(raw)
    assert set(streams) == {media.SAMPLES, media.CUES} and len(streams[media.SAMPLES].packets) == 3
    assert any(flags & media.CONTINUED for flags, *_ in media.pages(raw)) and any(granule == -1 for _, granule, *_ in media.pages(raw))
    track = media.decode(raw)
    assert track.times[:2] == [0, 25.0] and track.cues[1][0] == 1.0


def test_damage_is_found():
    raw = media.encode(b"some text" * 2000)
    for at in (5, 30, len(raw) // 2, len(raw) - 1):
        with pytest.raises(media.OggError):
            media.decode(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    with pytest.raises(media.OggError):
        media.decode(raw[:-20])
    whole = [media.HEADER.size]
    with pytest.raises(media.OggError):
        media.decode(raw + raw[: whole[0]])


def test_media_columns(spark):
    rows = [(1, "a" * 64, 1), (2, None, 1), (3, "", 1), (None, "é" * 3000, 1), (1, "a" * 64, 2), (4, "x" * 300_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    made = media.to_media(df)
    stored = {r.doc_id: r for r in made.collect()}
    out = media.read_media(made.withColumn("feature", F.lit(1))).collect()
    assert len(out) == len(rows)
    by_text = {}
    for r in out:
        raw = {1: b"a" * 64, 2: b"", 3: b"", None: ("é" * 3000).encode(), 4: b"x" * 300_000}[r.doc_id]
        payload = raw + bytes((-len(raw)) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        held = stored[r.doc_id].media
        assert media.decode(held).samples == payload and hashlib.sha256(held).hexdigest() == r.media_sha256 and len(held) == r.media_bytes
        assert by_text.setdefault(raw, r.feature) == r.feature and r.error is None
    assert media.read_media(media.to_media(df.limit(0))).count() == 0


def test_damaged_rows_have_a_reason_and_dont_end_the_job(spark):
    good = media.encode(b"some text" * 2000)
    damaged = [good[:35] + bytes([good[35] ^ 1]) + good[36:], good[:-20], b"", b"OggS", b"no media at all" * 50, None]
    foreign = media._Writer(7)
    foreign = b"".join([*foreign.add(b"another codec", 0), foreign.page(media.LAST)])
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate([good, *damaged, foreign])], "doc_id long, media binary")
    out = {r.doc_id: r for r in media.read_media(df).collect()}
    assert out[0].error is None and out[0].payload_bytes == 18_000 and out[0].n_bytes is None
    assert all(out[i].error and out[i].feature is None and out[i].payload_bytes is None for i in range(1, 8))
    assert "checksum" in out[1].error and out[2].media_bytes == len(good) - 20 and out[6].error == "null" and "samples with cues" in out[7].error


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "User", "=User", ""]), st.text(max_size=5)), st.text(alphabet="\\#<:/ \ntunr>A", max_size=12)), max_size=5))
def test_format_is_reversible(turns):
    formatted, segments = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [s.start for s in segments[1:]] == [s.end for s in segments[:-1]] and (not segments or segments[-1].end == len(formatted))
    learned = "".join(chat.PLAIN.unescape(formatted[s.start : s.end]) for s in segments if s.loss)
    assert learned == "".join(t for r, t in turns if r == "assistant")


def test_state_machine():
    good = ["u", "ua", "sua", "uaua", "s", "suau", "uata"]
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    assert all(chat.accepts([names[c] for c in g]) for g in good)
    assert not any(chat.accepts([names.get(c, c) for c in b]) for b in ["a", "uu", "su s", "us", "", "ssu", "ux"])
    with pytest.raises(ValueError):
        chat.parse("### User: never ends")


def test_conversations(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, 0, "user", None), (2, None, "assistant", "last"), (2, 1, None, "x"), (None, 0, "assistant", "a"), (3, 0, "user", "q"), (3, 0, "user", "q"), (4, 5, "assistant", "z" * 50_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (out[1].n_turns, out[1].turns_sha256, out[1].loss_chars, out[1].loss_sha256) == (2, digest(f"user\n{odd}\nassistant\n{odd}\n"), len(odd), digest(odd))
    assert out[2].turns_sha256 == digest("user\n\n\nx\nassistant\nlast\n") and not out[2].well_formed
    assert out[3].n_turns == 2 and out[None].loss_chars == 1 and out[4].loss_chars == 50_000 and out[1].well_formed
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
