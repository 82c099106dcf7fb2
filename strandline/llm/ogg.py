"""Media columns: Ogg containers in a binary column, written and read back.

``write`` multiplexes logical streams of packets: pages carry at most 255 lacing values, a packet
longer than a page continues on the next, and every page has a sequence number, a granule position
and the checksum over its bytes. ``read`` finds the pages by their headers, verifies each checksum
and the sequence numbers, gathers packets from the lacing values, keeps the streams apart by their
serial numbers and turns granule positions into seconds by the sample rate of the stream's header.

A payload is 8-bit mono samples in an OggPCM stream (frames of 576 samples, one a packet); a second
logical stream holds the byte length before padding. Everything is a function of the text alone.

Defined results: null text counts as empty and gives one frame of padding; a container that does not
verify keeps its row, with nulls and the place of the damage in ``error`` (``read`` itself raises
``OggError``); a null container likewise; texts are stored whole, however long; repeated rows repeat their
results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filled, map_rows

FRAME = 576
RATE = 16000
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
PCM_SERIAL, LENGTH_SERIAL = 1, 2
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A page that does not verify."""


def checksum(data: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, no reflection, start and end zero): zlib's CRC of the
    bit-reversed bytes with its inversions undone, reversed."""
    plain = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(plain.to_bytes(4, "little").translate(REVERSED), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; the first packet, its header, has a page of its own.
    A page in which no packet ends has granule -1."""
    out: list[tuple[int, bytes]] = []
    runs = [(packets[:1], granules[:1]), (packets[1:], granules[1:])]
    flags = FIRST
    for k, (run, marks) in enumerate(runs):
        lacing, ends = bytearray(), []  # ends: lacing index after which a packet ends
        for p, g in zip(run, marks, strict=True):
            lacing += b"\xff" * (len(p) // 255) + bytes((len(p) % 255,))
            ends.append((len(lacing), g))
        body, at, e, spill = b"".join(run), 0, 0, False
        for begin in range(0, len(lacing), 255):
            part = bytes(lacing[begin : begin + 255])
            n, granule = sum(part), -1
            while e < len(ends) and ends[e][0] <= begin + len(part):
                granule = ends[e][1]
                e += 1
            last = begin + 255 >= len(lacing) and (k == 1 or not runs[1][0])
            out.append((granule, page(serial, len(out), flags | (CONTINUED if spill else 0) | (LAST if last else 0), granule, part, body[at : at + n])))
            spill, flags, at = part[-1] == 255, 0, at + n
    return out


def write(streams: list[tuple[int, list[bytes], list[int]]]) -> bytes:
    """One physical stream: all first pages, then the others in turn by granule position."""
    made = [pages_of(*s) for s in streams]
    rest = []
    for order, pages in enumerate(made):
        now = 0
        for granule, data in pages[1:]:
            now = max(now, granule)
            rest.append((now, order, len(rest), data))
    return b"".join([p[0][1] for p in made] + [x[3] for x in sorted(rest)])


def read(media: bytes) -> dict[int, dict]:
    """serial to {packets, granules (a page's position for the last packet that ends on it, -1 for the
    others), pages}."""
    streams: dict[int, dict] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise OggError(f"a page header is cut off at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        begin = at + PAGE.size
        lacing = media[begin : begin + n]
        end = begin + n + sum(lacing)
        if end > len(media) or len(lacing) < n:
            raise OggError(f"the page at byte {at} is cut off")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + bytes(view[at + 26 : end])) != crc:
            raise OggError(f"the checksum of the page at byte {at} does not match")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError(f"stream {serial} begins in a wrong way at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": b"", "ended": False})
        if number != s["pages"] or s["ended"] or bool(flags & CONTINUED) != bool(s["open"]):
            raise OggError(f"stream {serial} has a gap at byte {at}")
        sizes = np.frombuffer(lacing, np.uint8)
        closes = np.flatnonzero(sizes < 255)
        cuts = np.cumsum(sizes, dtype=np.int64)[closes].tolist()
        body = bytes(view[begin + n : end])
        start, whole = 0, len(s["packets"])
        for cut in cuts:
            s["packets"].append(s["open"] + body[start:cut])
            s["granules"].append(granule if cut == cuts[-1] and len(s["packets"]) == whole + len(cuts) else -1)
            s["open"], start = b"", cut
        s["open"] += body[start:]
        s["pages"] += 1
        s["ended"] = bool(flags & LAST)
        at = end
    for serial, s in streams.items():
        if s["open"] or not s["ended"]:
            raise OggError(f"stream {serial} does not end")
    return streams


def timestamps(granules: list[int], samples: list[int], rate: int) -> list[tuple[float, float]]:
    """Begin and end in seconds of each packet of a stream: a page's granule position is the end of the last
    packet that it closes; from there the packets' samples are counted back, and on where no later
    position is known."""
    ends: list[int | None] = [g if g >= 0 else None for g in granules]
    for k in range(len(ends) - 2, -1, -1):
        if ends[k] is None and ends[k + 1] is not None:
            ends[k] = ends[k + 1] - samples[k + 1]
    for k in range(len(ends)):
        if ends[k] is None:
            ends[k] = (ends[k - 1] if k else 0) + samples[k]
    return [((e - n) / rate, e / rate) for e, n in zip(ends, samples, strict=True)]


def pack(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """The container of a payload (a multiple of FRAME bytes)."""
    head = struct.pack(">8sHHIIBBHI", b"PCM     ", 0, 0, 1, rate, 0, 1, FRAME, 0)
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    marks = [0, *range(FRAME, len(payload) + 1, FRAME)]
    length = [b"length\0\0" + struct.pack(">I", rate), struct.pack("<Q", n_bytes)]
    return write([(PCM_SERIAL, [head, *frames], marks), (LENGTH_SERIAL, length, [0, len(payload)])])


def unpack(media: bytes) -> tuple[bytes, int, dict]:
    """Payload, byte length before padding, and what the pages say: rate, frames, pages, seconds."""
    streams = read(media)
    pcm = streams[PCM_SERIAL]
    magic, _, _, kind, rate, _, channels, _, extra = struct.unpack(">8sHHIIBBHI", pcm["packets"][0])
    if magic != b"PCM     " or (kind, channels, extra) != (1, 1, 0):
        raise OggError("the first stream is not 8-bit mono")
    payload = b"".join(pcm["packets"][1:])
    if pcm["granules"][-1] != len(payload):
        raise OggError("the last granule position is not the number of samples")
    n = struct.unpack("<Q", streams[LENGTH_SERIAL]["packets"][1])[0]
    return payload, n, {"rate": rate, "frames": len(pcm["packets"]) - 1, "pages": sum(s["pages"] for s in streams.values()), "seconds": pcm["granules"][-1] / rate}


def padded(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of FRAME."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE) -> DataFrame:
    """id_col, media: the Ogg container of each text's UTF-8 bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            media = [pack(padded(x := t or b""), len(x), rate) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["__id", "media"])

        return one

    out = map_rows(docs.select(docs[id_col], F.encode(filled(text_col), "UTF-8").alias("t")), make, f"__id {kind}, media binary")
    return out.withColumnRenamed("__id", id_col)


def features(payload: bytes, facts: dict) -> str:
    """Duration, level and crossings of the samples, and the container's counts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    energy = int((x * x).sum())
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"seconds={facts['seconds']:.4f};rate={facts['rate']};frames={facts['frames']};pages={facts['pages']};sum={int(x.sum())};energy={energy};crossings={crossings};peak={int(np.abs(x).max())}"


def load(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    seconds, n_pages, error: what the containers hold, read back and verified."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["i", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "n_pages", "error"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string()]

    def facts_of(data: bytes | None) -> tuple:
        if data is None:
            return (*[None] * 9, "no container")
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            payload, n, facts = unpack(data)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return (*[None] * 4, *stored, *[None] * 3, str(e) or type(e).__name__)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, features(payload, facts), facts["seconds"], facts["pages"], None

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*map(facts_of, batch.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]], names)

        return one

    out = map_rows(media.select(media[id_col], media_col), make, f"i {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, n_pages long, error string")
    return out.withColumnRenamed("i", id_col)


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id_col, stream (serial number), packet (from 0), n_bytes, begin and end (seconds): the packets after
    the header of each 8-bit stream. Containers that do not verify have none."""
    kind = media.schema[id_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for k, data in enumerate(batch.column(1).to_pylist()):
                try:
                    stream = read(data or b"")[PCM_SERIAL]
                    rate = struct.unpack_from(">I", stream["packets"][0], 16)[0]
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                sizes = [len(x) for x in stream["packets"][1:]]
                out += [(k, PCM_SERIAL, i, n, *t) for i, (n, t) in enumerate(zip(sizes, timestamps(stream["granules"][1:], sizes, rate), strict=True))]
            rows = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(c, t) for c, t in zip(rows[1:], kinds, strict=True)]], ["i", "stream", "packet", "n_bytes", "begin", "end"])

        return one

    return map_rows(media.select(media[id_col], media_col), make, f"i {kind}, stream long, packet long, n_bytes long, begin double, end double").withColumnRenamed("i", id_col)
