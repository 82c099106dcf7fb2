"""WARC archives: writing with an index, and reading selected records by coalesced byte ranges.

``write_archives`` writes one gzip member a record (so a record can be read by its byte range alone)
and returns the index: offset, length, URL and digest of every record, a written table. Equal payloads
of at least ``min_bytes`` are stored once, as the response of the largest identifier; the others
become revisit records that name it. The digests' groups are combined map-side, and only the digest
join deals rows; Spark splits a crowded digest there.

``read_records`` takes the index rows of the records wanted, deals them to tasks by file and stretch
of ``stretch`` bytes, sorts them by offset and reads neighbours (gap up to ``gap`` bytes) in one
request. Each record's block is checked against its digest.

Every attempt of a writing task makes files of its own; the index names those that count.

Defined results: null payload counts as empty; a null URL has no target field and reads back null;
CR, LF and % in URLs are percent-encoded and decoded again; rows that agree in identifier and payload
are each written as the row that stays; a null identifier never is the response of a group that has
another; empty tables give an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sink, arrow_map, filled, fresh_path, materialise, open_uri, partitions

#: A file is closed after so many bytes.
FILE_BYTES = 1 << 30
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset long, length long, url string, digest string, record_type string"


def _escape(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescape(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(record_id: str, url: str | None, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """One record: a response (a resource without HTTP headers) or, with refers_to, a revisit."""
    sha = hashlib.sha1(payload).digest()
    block = b"" if refers_to is not None else payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _escape(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha).decode()}"), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is None:
        fields.append(("WARC-Block-Digest", f"sha1:{base64.b32encode(sha).decode()}"))
    else:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has a wrong length")
    block = rest[:n]
    if (want := fields.get("WARC-Block-Digest")) and want != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"the digest of record {fields.get('WARC-Record-ID')} does not match")
    return fields, block


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes a record for each row; returns the index (path, offset, length, url, digest, record_type)."""
    folder = fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("string").alias("i"), F.col(id_col).alias("k"), F.col(url_col).cast("string").alias("u"), F.encode(filled(payload_col), "UTF-8").alias("p"))
    rows = rows.withColumn("d", F.sha1("p"))
    shared = rows.where(F.octet_length("p") >= min_bytes).groupBy("d").agg(F.max("k").alias("m"), F.count("*").alias("n")).where("n > 1").select("d", F.col("m").alias("first"))
    rows = rows.join(shared, "d", "left").select("i", "u", "p", F.when(F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        for batch in batches:
            out = []
            for i, u, p, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or sink.size >= FILE_BYTES:
                    if sink:
                        sink.close()
                    sink = Sink(folder, ".warc.gz")
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = squeeze.compress(record("" if i is None else i, u, p, date, r)) + squeeze.flush()
                out.append((sink.uri, sink.write(data), len(data), u, hashlib.sha1(p).hexdigest(), "response" if r is None else "revisit"))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["path", "offset", "length", "url", "digest", "record_type"]) if out else batch.slice(0, 0)
        if sink:
            sink.close()

    return materialise(arrow_map(rows, run, INDEX), "warc-index")


def read_records(index: DataFrame, stretch: int = 16 << 20, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """record_id, url, record_type, refers_to, payload_bytes, payload_digest (lower-case hex),
    block (binary: the payload of a response, empty for a revisit) of the index rows given.

    most: bytes of one request at most, unless a single record is longer."""
    wanted = (
        index.select("path", "offset", "length")
        .withColumn("s", F.floor(F.col("offset") / stretch))
        .repartition(partitions(index.sparkSession), "path", "s")
        .sortWithinPartitions("path", "offset")
        .select("path", "offset", "length")
    )

    def requests(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        run: list[tuple[int, int]] = []
        path = None
        for p, o, n in rows:
            if run and (p != path or o > run[-1][0] + run[-1][1] + gap or o + n - run[0][0] > most):
                yield path, run
                run = []
            path = p
            run.append((o, n))
        if run:
            yield path, run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "block"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for uri, ranges in requests(rows):
                fs, path = open_uri(uri)
                begin = ranges[0][0]
                with fs.open_input_file(path) as f:
                    data = f.read_at(ranges[-1][0] + ranges[-1][1] - begin, begin)
                out = []
                for o, n in ranges:
                    fields, block = parse(zlib.decompress(data[o - begin : o - begin + n], 31))
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    refers = fields.get("WARC-Refers-To")
                    url = fields.get("WARC-Target-URI")
                    out.append((fields["WARC-Record-ID"][10:-1], None if url is None else _unescape(url), fields["WARC-Type"], refers and refers[10:-1], int(fields["WARC-Payload-Length"]), digest, block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return arrow_map(wanted, run, "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, block binary")
