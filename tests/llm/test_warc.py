import gzip
import hashlib
import io

import pytest

from reelspark.llm.warc import OP1_SQL, ArcReader, arc_header, arc_record, archive_pages, base32, hex_digest, iso_date, op1_warc, read_warc_stream, warc_record

from .helpers import SF, duck, same_rows


def test_pages_match_sql(spark):
    columns, rows = duck(OP1_SQL, ["pages"])
    same_rows(op1_warc(spark, SF), columns, rows)


def test_odd_pages(spark):
    big, near = "é" * 600, "é" * 499
    rows = [(1, "http://a", big), (2, "http://a b\n", big), (3, None, None), (4, "x", ""), (None, "y", big), (-6, "z", near), (6, "z", near), (7, "w", "HTTP/1.1 200 OK\r\n\r\nbody"), (8, "v", "q" * 3_000_000)]
    df = spark.createDataFrame([(*r, "h", "p", 9) for r in rows], "page_id long, url string, html string, head string, payload string, version int")
    got = {r.page_id: r for r in archive_pages(spark, df).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.digest_ok) == (len(body), hashlib.sha1(body).hexdigest(), True)
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if r.record_type != "response"} == {1: ("revisit", 2), None: ("revisit", 2)}
    assert archive_pages(spark, df.limit(0)).collect() == []


def test_repeated_rows_leave_one_response(spark):
    df = spark.createDataFrame([(2, "u", "x" * 1000)] * 3 + [(1, "u", "x" * 1000)], "page_id long, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in archive_pages(spark, df).collect()]
    assert sorted(got, key=str) == sorted([(2, "response", None), (2, "revisit", 2), (2, "revisit", 2), (1, "revisit", 2)], key=str)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [False, True])
def test_both_versions_are_read(version, zipped):
    parts = [arc_header("a.arc", version, "20010203040506"), arc_record(version, "http://h/a b", "1.2.3.4", "20010203", "text/plain", b"line\nline"), arc_record(version, "", "-", "bad", "-", b"")]
    data = b"".join(gzip.compress(p) for p in parts) if zipped else b"".join(parts)
    got = list(ArcReader(io.BytesIO(data), "a.arc"))
    assert [(r.url, r.version, r.block, r.timestamp) for r in got] == [("http://h/a%20b", version, b"line\nline", "2001-02-03T00:00:00Z"), ("-", version, b"", "1970-01-01T00:00:00Z")]
    assert len({r.record_id for r in got}) == 2
    assert [r.record_id for r in ArcReader(io.BytesIO(data), "a.arc")] == [r.record_id for r in got]


def test_broken_archives():
    head = arc_header("a", 1, "20010203040506")
    cut = list(ArcReader(io.BytesIO(head + b"http://u 1.1.1.1 2001 text/html 100\nshort"), "a"))
    assert [(r.block, r.truncated) for r in cut] == [(b"short", True)]
    junk = list(ArcReader(io.BytesIO(head + b"no length here\n\n" + arc_record(1, "u", "-", "2001", "t", b"x")), "a"))
    assert [r.block for r in junk] == [b"x"]
    assert list(ArcReader(io.BytesIO(b""), "a")) == []


def test_dates_and_digests():
    assert iso_date("20240229235959") == "2024-02-29T23:59:59Z" and iso_date("20230229") == iso_date("") == "1970-01-01T00:00:00Z" and iso_date("1999") == "1999-01-01T00:00:00Z"
    sha = hashlib.sha1(b"x").hexdigest()
    assert hex_digest(base32(sha)) == sha


def test_records_round_trip():
    records = [([("WARC-Type", "response"), ("A", "b: c")], b"one\r\n\r\n"), ([("WARC-Type", "resource")], b"")]
    back = list(read_warc_stream(io.BytesIO(b"".join(gzip.compress(warc_record(h, b)) for h, b in records))))
    assert [(h["warc-type"], b) for h, b in back] == [("response", b"one\r\n\r\n"), ("resource", b"")] and back[0][0]["a"] == "b: c"
