"""Media columns in Ogg: writing, verified reading, demultiplexing, timestamps and features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import text_of

RATE = 8000
PACKET = 4000
MAX_SEGMENTS = 255
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES, CUES = 1, 2
HEADER = struct.Struct("<4sBBqIIIB")

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are not a whole, undamaged Ogg stream."""


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, most significant bit first, no inversion) of a page whose checksum field is zero.

    zlib's CRC is the mirror image with inversions, so the bytes and the result are mirrored and the inversions undone.
    """
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


@dataclass
class _Writer:
    """One logical stream: packets in, pages out."""

    serial: int
    sequence: int = 0
    laces: bytearray = field(default_factory=bytearray)
    body: list[bytes] = field(default_factory=list)
    granule: int = -1
    continued: bool = False

    def page(self, flags: int = 0) -> bytes:
        flags |= CONTINUED * self.continued | FIRST * (self.sequence == 0)
        table, data = bytes(self.laces), b"".join(self.body)
        head = HEADER.pack(b"OggS", 0, flags, self.granule, self.serial, self.sequence, 0, len(table)) + table
        crc = page_checksum(head + data)
        self.continued = bool(table) and table[-1] == 255
        self.sequence += 1
        self.laces, self.body, self.granule = bytearray(), [], -1
        return head[:22] + crc.to_bytes(4, "little") + head[26:] + data

    def add(self, packet: bytes, granule: int) -> Iterator[bytes]:
        """Pages that are full before the packet has ended; the packet's end stays in the open page."""
        laces, at = lacing(len(packet)), 0
        while True:
            part = laces[: MAX_SEGMENTS - len(self.laces)]
            laces = laces[len(part):]
            self.laces += part
            self.body.append(packet[at : at + sum(part)])
            at += sum(part)
            if not laces:
                self.granule = granule
                return
            yield self.page()


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Two multiplexed logical streams: unsigned 8-bit samples, and a cue for each second (its first sample and CRC-32)."""
    samples, cues, out = _Writer(SAMPLES), _Writer(CUES), []
    for stream, head in ((samples, b"PCMU8\0" + struct.pack("<IB", rate, 1)), (cues, b"CUES\0\0" + struct.pack("<IB", rate, 0))):
        out += stream.add(head, 0)
        out.append(stream.page())
    due = 0
    for at in range(0, len(payload), packet):
        while due <= at:
            out += cues.add(struct.pack("<QI", due, zlib.crc32(payload[due : due + rate])), due)
            out.append(cues.page())
            due += rate
        out += samples.add(payload[at : at + packet], min(at + packet, len(payload)))
    while due < len(payload):
        out += cues.add(struct.pack("<QI", due, zlib.crc32(payload[due : due + rate])), due)
        due += rate
    out.append(cues.page(LAST))
    out.append(samples.page(LAST))
    return b"".join(out)


@dataclass
class Packet:
    data: bytes
    granule: int | None
    page: int


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] | None = None


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, sequence, lacing values, body) of each page; raises OggError on damage."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError("cut off within a page header")
        magic, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        table = bytes(view[at + HEADER.size : at + HEADER.size + n])
        end = at + HEADER.size + n + sum(table)
        if len(table) < n or end > len(media):
            raise OggError("cut off within a page")
        page = bytes(view[at:end])
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        yield flags, granule, serial, sequence, table, view[at + HEADER.size + n : end]
        at = end


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, with whole packets; a page's granule position goes to the last packet that ends on it."""
    streams: dict[int, Stream] = {}
    for flags, granule, serial, sequence, table, body in pages(media):
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or sequence != s.pages:
            raise OggError(f"page {sequence} of stream {serial} is out of place")
        if bool(flags & CONTINUED) != (s._open is not None):
            raise OggError(f"a packet of stream {serial} is broken off")
        parts, at, size, last = s._open or [], 0, 0, None
        begun = s._open is not None
        for lace in table:
            size += lace
            begun = True
            if lace < 255:
                parts.append(bytes(body[at : at + size]))
                s.packets.append(last := Packet(b"".join(parts), None, sequence))
                parts, at, size, begun = [], at + size, 0, False
        if begun:
            parts.append(bytes(body[at:]))
        s._open = parts if begun else None
        if (granule >= 0) != (last is not None):
            raise OggError(f"page {sequence} of stream {serial} has a wrong granule position")
        if last:
            last.granule = granule
        s.pages += 1
        s.ended = bool(flags & LAST)
    if any(not s.ended or s._open is not None for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


@dataclass
class Track:
    rate: int
    samples: bytes
    #: Start of each packet and end of the last, in seconds, from granule positions.
    times: list[float]
    cues: list[tuple[float, int]]
    n_packets: int
    n_pages: int


def decode(media: bytes) -> Track:
    """The samples and their timeline. Packets without a granule position of their own are timed backwards from the next one that has."""
    streams = demultiplex(media)
    if set(streams) != {SAMPLES, CUES} or not streams[SAMPLES].packets or streams[SAMPLES].packets[0].data[:6] != b"PCMU8\0":
        raise OggError("not a stream of samples with cues")
    rate, _ = struct.unpack("<IB", streams[SAMPLES].packets[0].data[6:])
    if not rate:
        raise OggError("a sample rate of zero")
    data, ends, known = streams[SAMPLES].packets[1:], [], None
    for p in reversed(data):
        known = p.granule if p.granule is not None else known
        if known is None:
            raise OggError("packets without a time")
        ends.append(known)
        known -= len(p.data)
    ends.reverse()
    samples = b"".join(p.data for p in data)
    if data and (known != 0 or ends[-1] != len(samples)):
        raise OggError("granule positions don't agree with the samples")
    cues = []
    for p in streams[CUES].packets[1:]:
        first, crc = struct.unpack("<QI", p.data)
        if zlib.crc32(samples[first : first + rate]) != crc:
            raise OggError(f"the cue at sample {first} doesn't fit")
        cues.append((first / rate, crc))
    times = [(e - len(p.data)) / rate for e, p in zip(ends, data)] + [e / rate for e in ends[-1:]]
    return Track(rate, samples, times, cues, len(data), sum(s.pages for s in streams.values()))


def padded(data: bytes, multiple: int = 64) -> bytes:
    return data + bytes(-len(data) % multiple or (multiple if not data else 0))


def features(track: Track) -> str:
    """Duration, packets, pages, cues, mean, root mean square, zero crossings and peak second, as text of fixed precision."""
    x = np.frombuffer(track.samples, dtype=np.uint8).astype(np.int32) - 128
    if not len(x):
        return "empty"
    energy = np.add.reduceat(x.astype(np.int64) ** 2, np.arange(0, len(x), track.rate))
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return (
        f"duration={track.times[-1]:.6f};packets={track.n_packets};pages={track.n_pages};cues={len(track.cues)};mean={x.mean():.6f};"
        f"rms={np.sqrt(energy.sum() / len(x)):.6f};crossings={crossings};peak_second={int(energy.argmax())}"
    )


MEDIA = "doc_id long, n_bytes long, media binary"
READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, error string"
)
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text as a lossless Ogg column.

    The payload is the text's UTF-8 with bytes 0 up to a multiple of 64, at least one such multiple; a null text counts
    as empty. A very long text is one long stream and must fit in a row, as it does in df. Rows are independent of each
    other: equal texts give equal media, repeated rows repeat, null keys stay null, columns besides key and text aren't
    looked at, an empty table gives an empty one.
    """

    def rows(batches):
        for batch in batches:
            texts = (t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(1))
            yield _batch([(k.as_py(), len(raw), encode(padded(raw))) for k, raw in zip(batch.column(0), texts)], MEDIA)

    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(rows, MEDIA)


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Reads a binary column: payload, digests and features of each row, or, in error, why there are none.

    A checksum, lacing value, sequence number, granule position or cue that doesn't fit, foreign streams and cut-off bytes
    are such reasons, and so is null; the row then keeps its media's size and digest and has null besides. n_bytes is
    passed on if there is such a column. Repeated rows repeat, null keys stay null, other columns aren't looked at, an empty
    table gives an empty one.
    """

    def read(doc_id, size, raw: bytes | None) -> tuple:
        if raw is None:
            return doc_id, size, None, None, None, None, None, None, "null"
        whole = len(raw), hashlib.sha256(raw).hexdigest()
        try:
            track = decode(raw)
        except (OggError, struct.error) as wrong:
            return doc_id, size, None, None, None, *whole, None, str(wrong)
        back = track.samples
        return doc_id, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), *whole, features(track), None

    def rows(batches):
        for batch in batches:
            yield _batch([read(*(x.as_py() for x in r)) for r in zip(*(batch.column(i) for i in range(3)))], READ)

    size = F.col(n_bytes).cast("long") if n_bytes in df.columns else F.lit(None).cast("long")
    return df.select(F.col(key).cast("long").alias("doc_id"), size.alias("n_bytes"), F.col(media).cast("binary").alias("media")).mapInArrow(rows, READ)
