import hashlib

import pytest

from strandline.llm import warc

BIG, SMALL = "é" * 600, "small"
ROWS = [(1, "http://a/x?%20\r\n", BIG), (5, None, BIG), (3, "http://c", BIG), (4, "http://d", SMALL), (6, "http://e", SMALL), (7, "http://f", None), (8, "http://g", ""), (9, "h", "WARC/1.1\r\n\r\n" * 200), (9, "h", "y" * 200_000)]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, offset int").repartition(3)
    return warc.write_archives(df)


def test_round_trip(index):
    got = sorted((int(r.record_id), r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.block)) for r in warc.read_records(index).collect())
    want = []
    for i, u, h in ROWS:
        data = (h or "").encode()
        revisit = h == BIG and i != 5
        want.append((i, u, "revisit" if revisit else "response", "5" if revisit else None, len(data), hashlib.sha1(data).hexdigest(), b"" if revisit else data))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("stretch,gap,most", [(1, 0, 1), (1 << 30, 1 << 30, 1 << 30), (4096, 100, 2000)])
def test_selected_records_by_ranges(index, stretch, gap, most):
    some = index.where("url IN ('http://c', 'http://e', 'h')")
    got = warc.read_records(some, stretch, gap, most).collect()
    assert sorted(r.url for r in got) == ["h", "h", "http://c", "http://e"]


def test_index_is_whole(index):
    rows = index.collect()
    assert len(rows) == len(ROWS) and all(r.length > 0 for r in rows)
    assert sorted(r.digest for r in rows) == sorted(hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in ROWS)


def test_damage_and_odd_rows(spark):
    data = warc.record("1", "u", b"payload", "2020-01-01T00:00:00Z")
    fields, block = warc.parse(data)
    assert block == b"payload" and fields["WARC-Record-ID"] == "<urn:page:1>"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"payload\r\n", b"paylaod\r\n"))
    with pytest.raises(ValueError, match="length"):
        warc.parse(data[:-1])
    df = spark.createDataFrame([(None, "a", "z" * 2000), (2, "b", "z" * 2000), (None, "c", "q" * 2000), (None, "d", "q" * 2000)], "page_id long, url string, html string")
    got = {r.url: (r.record_id, r.record_type, r.refers_to) for r in warc.read_records(warc.write_archives(df)).collect()}
    assert got == {"a": ("", "revisit", "2"), "b": ("2", "response", None), "c": ("", "response", None), "d": ("", "response", None)}
    assert warc.write_archives(df.where("false")).collect() == []
    assert warc.read_records(warc.write_archives(df.where("false"))).collect() == []
