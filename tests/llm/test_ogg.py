import hashlib
import zlib

import pytest

from strandline.llm import ogg


def slow_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1)
    return c


def test_checksum():
    for d in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(d) == slow_crc(d)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 65_025, 200_000])
def test_round_trip(n):
    data = bytes((i * 7 + i // 256) % 256 for i in range(n))
    payload = ogg.padded(data)
    assert len(payload) % 576 == 0 and len(payload) >= max(576, n) and payload[:n] == data and set(payload[n:]) <= {255}
    got, k, facts = ogg.unpack(ogg.pack(payload, n))
    assert (got, k) == (payload, n)
    assert facts["seconds"] == len(payload) / ogg.RATE and facts["frames"] == len(payload) // 576


def test_packets_across_pages_and_streams_apart():
    one, two = [b"h", b"x" * 70_000, b"", b"y" * 255, b"z" * 65_025], [b"g", b"w" * 10]
    streams = ogg.read(ogg.write([(5, one, [0, 1, 2, 3, 4]), (9, two, [0, 2])]))
    assert streams[5]["packets"] == one and streams[9]["packets"] == two
    assert streams[5]["granules"][-1] == 4


def test_damage_is_found():
    media = bytearray(ogg.pack(ogg.padded(b"hello" * 1000), 5000))
    for at in (3, 100, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.unpack(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.unpack(bytes(media[:-1]))


def test_columns(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 100_000), (5, "héllo"), (None, "héllo")]
    df = spark.createDataFrame([(*r, b"z") for r in rows], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in ogg.load(ogg.store(df)).collect()}
    for i, t in rows:
        r, data = got[i], (t or "").encode()
        p = ogg.padded(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[1][1:] == got[5][1:] and got[2][1:] == got[3][1:]
    assert ogg.load(ogg.store(df.where("false"))).collect() == []


def test_damaged_containers_cost_only_their_rows(spark):
    good = ogg.pack(ogg.padded(b"abc"), 3)
    bad = bytearray(good)
    bad[-1] ^= 1
    rows = [(1, good), (2, bytes(bad)), (3, b""), (4, None), (5, good[:40]), (6, b"OggS")]
    got = {r.doc_id: r for r in ogg.load(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].n_bytes == 3 and got[1].error is None
    assert all(got[i].error and got[i].n_bytes is None for i in range(2, 7)) and "checksum" in got[2].error
    assert got[2].media_bytes == len(good) and got[4].media_bytes is None


def test_times_of_packets(spark):
    text = "x" * 576 * 1200  # several pages, several packets on each
    media = ogg.store(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.packet, r.n_bytes, r.begin, r.end) for r in ogg.packets(media).collect())
    assert got == [(1, k, 576, k * 576 / ogg.RATE, (k + 1) * 576 / ogg.RATE) for k in range(1200)] + [(2, 0, 576, 0.0, 576 / ogg.RATE)]


def test_timestamps_count_from_known_positions():
    assert ogg.timestamps([-1, 30, -1, 60, -1], [10, 20, 5, 25, 7], 10) == [(0.0, 1.0), (1.0, 3.0), (3.0, 3.5), (3.5, 6.0), (6.0, 6.7)]
