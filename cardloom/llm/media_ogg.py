"""Media columns in Ogg: pages with checksums, lacing, several logical streams, granule positions.

`mux` writes packets of several logical streams into one physical stream, `demux` reads it back: it verifies
each page's checksum, rebuilds packets from the lacing values, separates streams by serial number and derives
each packet's time from granule positions. `media_columns` applies both to a text column.

Null and empty texts have a payload of 64 zero bytes. Rows are handled one by one, so ties, repeated rows and
extra columns don't matter: only doc_id and text are read, an empty table gives an empty table. Memory is that
of one text's stored form.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

CAPTURE = b"OggS"
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES_A_PACKET = 4096
SAMPLE_RATE = 8000
UNIT = 64

_FLIPPED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The page checksum: polynomial 0x04C11DB7, most significant bit first, from 0, without a final inversion.
    It is zlib's polynomial over bit-reversed bytes, so zlib computes it."""
    reflected = zlib.crc32(data.translate(_FLIPPED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIPPED), "big")


@dataclass
class Packet:
    data: bytes
    granule: int  # position in the stream after this packet


@dataclass
class Stream:
    serial: int
    packets: list[Packet]


@dataclass
class Track:
    """What demux returns of a logical stream: packets and the granule position where each ends (-1: unknown)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False

    def seconds(self, rate: int) -> list[float]:
        return [g / rate if g >= 0 else float("nan") for g in self.granules]


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _pages(stream: Stream) -> Iterator[bytes]:
    """The stream's first packet has a page of its own; the others fill pages of up to 255 segments."""
    number, segments, body, done, kind = 0, bytearray(), [], -1, FIRST
    last = len(stream.packets) - 1
    for i, p in enumerate(stream.packets):
        lacing = b"\xff" * (len(p.data) // 255) + bytes([len(p.data) % 255])
        at = 0
        while lacing:
            room = 255 - len(segments)
            taken, lacing = lacing[:room], lacing[room:]
            n = sum(taken)
            segments += taken
            body.append(p.data[at : at + n])
            at += n
            if not lacing:
                done = p.granule
            if len(segments) == 255 or not lacing and i in (0, last):
                end = LAST if i == last and not lacing else 0
                yield _page(kind | end, done, stream.serial, number, bytes(segments), b"".join(body))
                number, segments, body, done, kind = number + 1, bytearray(), [], -1, CONTINUED if lacing else 0


def mux(streams: list[Stream]) -> bytes:
    """All first pages, then the others of the streams by turns."""
    rest = [_pages(s) for s in streams]
    out = [next(p) for p in rest]
    while rest:
        for p in list(rest):
            page = next(p, None)
            if page is None:
                rest.remove(p)
            else:
                out.append(page)
    return b"".join(out)


def demux(data: bytes) -> dict[int, Track]:
    """Logical streams by serial number. ValueError for a broken page, checksum, sequence or packet."""
    tracks: dict[int, Track] = {}
    open_packets: dict[int, list[bytes]] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise ValueError("cut page head")
        magic, version, kind, granule, serial, number, crc, count = HEAD.unpack_from(data, at)
        if magic != CAPTURE or version:
            raise ValueError(f"no page at byte {at}")
        lacing = bytes(view[at + HEAD.size : at + HEAD.size + count])
        start = at + HEAD.size + count
        end = start + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise ValueError("cut page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if bool(kind & FIRST) == (serial in tracks):
            raise ValueError(f"stream {serial} begins twice or not at all")
        t = tracks.setdefault(serial, Track())
        if number != t.pages or t.ended:
            raise ValueError(f"stream {serial}: page {number} where {t.pages} was due")
        parts = open_packets.pop(serial, None)
        if (parts is not None) != bool(kind & CONTINUED):
            raise ValueError(f"stream {serial}: packet not continued")
        t.pages, t.ended = t.pages + 1, bool(kind & LAST)
        parts, pos, run = parts or [], start, 0
        ended = []
        for n in lacing:
            run += n
            if n < 255:
                parts.append(view[pos : pos + run])
                ended.append(b"".join(parts))
                parts, pos, run = [], pos + run, 0
        if lacing and lacing[-1] == 255:
            open_packets[serial] = [*parts, view[pos : pos + run]]
        t.packets += ended
        t.granules += [-1] * (len(ended) - 1) + [granule] * bool(ended)
        at = end
    if open_packets or not all(t.ended for t in tracks.values()):
        raise ValueError("a stream doesn't end")
    return tracks


SOUND, NOTE = b"samples8", b"note\0\0\0\0"


def stored(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit samples in one logical stream, its length in another. Serial numbers come
    from the payload, so equal payloads have equal files."""
    serial = zlib.crc32(payload)
    frames = [payload[i : i + SAMPLES_A_PACKET] for i in range(0, len(payload), SAMPLES_A_PACKET)]
    sound = [Packet(SOUND + struct.pack("<IIQ", SAMPLE_RATE, 8, len(payload)), 0)]
    at = 0
    for f in frames:
        at += len(f)
        sound.append(Packet(f, at))
    note = [Packet(NOTE, 0), Packet(b"samples=%d;rate=%d" % (len(payload), SAMPLE_RATE), len(payload))]
    return mux([Stream(serial, sound), Stream((serial + 1) & 0xFFFFFFFF, note)])


def read_back(media: bytes) -> tuple[bytes, dict]:
    """The samples and facts of the streams. Packet times: a page's granule position is that of its last packet;
    those before it are counted back from their samples."""
    tracks = demux(media)
    by_kind = {t.packets[0][:8]: t for t in tracks.values()}
    sound = by_kind[SOUND]
    rate, _, n = struct.unpack("<IIQ", sound.packets[0][8:])
    payload = b"".join(sound.packets[1:])
    ends = list(sound.granules)
    for i in range(len(ends) - 2, 0, -1):
        if ends[i] < 0:
            ends[i] = ends[i + 1] - len(sound.packets[i + 1])
    if len(payload) != n or ends[-1] != n:
        raise ValueError("samples and granule positions disagree")
    return payload, {
        "streams": len(tracks), "pages": sum(t.pages for t in tracks.values()), "packets": len(sound.packets) - 1,
        "seconds": ends[-1] / rate, "starts": [(e - len(p)) / rate for e, p in zip(ends[1:], sound.packets[1:], strict=True)],
    }


def features(payload: bytes, facts: dict) -> str:
    """Fixed decimals, so equal samples give an equal string."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    share = np.bincount((x + 128) >> 5, minlength=8) / len(x)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    crossings = float(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) / len(x)
    rms = float(np.sqrt(np.mean(x.astype(np.int64) ** 2)))
    return (
        f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};seconds={facts['seconds']:.6f}"
        f";mean={x.mean():.6f};rms={rms:.6f};peak={int(np.abs(x).max())};crossings={crossings:.6f};entropy={entropy:.6f}"
    )


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string, n_pages long, seconds double"
)


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per document; with keep_media also the stored form as column `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    n, payload = padded(text)
                    media = stored(payload)
                    got, facts = read_back(media)
                    row = (doc_id, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(got, facts), facts["pages"], facts["seconds"])
                    rows.append((*row, media) if keep_media else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")] + ["media"] * keep_media
    of = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = [of[x.split()[1]] for x in MEDIA_SCHEMA.split(", ")] + [pa.binary()] * keep_media
    return docs.select("doc_id", "text").mapInArrow(run, MEDIA_SCHEMA + ", media binary" * keep_media)
