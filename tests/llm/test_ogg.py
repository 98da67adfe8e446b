import hashlib
import random

import pytest

from cardloom.llm import media_ogg as M


def bitwise(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_by_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 27, 300):
        data = rng.randbytes(n)
        assert M.checksum(data) == bitwise(data)


@pytest.mark.parametrize("sizes", [[0], [255], [254, 255, 256, 510], [65025, 65026, 200000], [0, 0, 5], list(range(0, 2000, 51))])
def test_two_streams_round_trip(sizes):
    rng = random.Random(2)
    streams = []
    for serial in (7, 8):
        at, packets = 0, [M.Packet(b"head", 0)]
        for n in sizes:
            at += n
            packets.append(M.Packet(rng.randbytes(n), at))
        streams.append(M.Stream(serial, packets))
    back = M.demux(M.mux(streams))
    for s in streams:
        assert back[s.serial].packets == [p.data for p in s.packets]
        assert back[s.serial].granules[-1] == s.packets[-1].granule
        assert all(g in (-1, p.granule) for g, p in zip(back[s.serial].granules, s.packets, strict=True))


def test_damage_is_found():
    good = M.stored(bytes(range(256)) * 40)
    rng = random.Random(3)
    for _ in range(100):
        i = rng.randrange(len(good))
        bad = good[:i] + bytes([good[i] ^ 1 << rng.randrange(8)]) + good[i + 1 :]
        with pytest.raises(ValueError):
            M.read_back(bad)
    with pytest.raises(ValueError):
        M.demux(good[:-1])


def test_times_follow_granules():
    payload, facts = M.read_back(M.stored(bytes(64 * 1000)))
    assert len(payload) == 64000 and facts["seconds"] == 8.0
    assert facts["starts"] == [i * 4096 / 8000 for i in range(16)]


def test_table(awkward, empty):
    rows = M.media_columns(awkward).collect()
    assert len(rows) == awkward.count() and not M.media_columns(empty).count()
    by_text = {}
    for doc, r in zip(sorted(awkward.collect(), key=str), [None] * 99, strict=False):
        raw = (doc.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        by_text[hashlib.sha256(payload).hexdigest()] = len(raw)
    for r in rows:
        assert by_text[r.payload_sha256] == r.n_bytes and r.payload_bytes % 64 == 0 and r.payload_bytes >= 64
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
