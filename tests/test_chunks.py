"""Chunked sections read from bytes by hand."""

import struct

import pytest

from reelspark.operators import streams


def section(kind, payload, long=False):
    n = len(payload)
    return (bytes(3) + bytes([kind]) + struct.pack("<I", n) if long or not n else struct.pack("<I", n)[:3] + bytes([kind])) + payload


def sizes(*n):
    return section(3, struct.pack(f"<{len(n)}I", *n))


TABLE = section(2, b"\x0a\x0b") + sizes(3, 2)


@pytest.mark.parametrize(
    "payload, chunks, error",
    [
        (section(1, TABLE) + b"abcde", [(0, "raw", 22, 3), (1, "snappy", 25, 2)], None),
        (section(1, TABLE, long=True) + b"abcdefg", [(0, "raw", 26, 3), (1, "snappy", 29, 2)], None),
        (section(1, sizes(9) + section(4, bytes(8)) + sizes(1) + section(2, b"\x0a", long=True)) + b"x", [(0, "raw", 41, 1)], None),
        (section(1, TABLE) + b"abcd", None, "chunks beyond the payload"),
        (section(1, section(2, b"\x0a\x0c") + sizes(0, 1)) + b"x", None, "unknown packing"),
        (section(1, section(2, b"\x0a\x0a") + sizes(1)) + b"x", None, "kinds and sizes differ"),
        (section(1, sizes()), None, "kinds and sizes differ"),
        (section(1, TABLE[:-1]) + b"abcdef", None, "table truncated"),
        (section(1, TABLE + b"\x01\x02") + b"abcde", None, "table too small"),
        (section(5, TABLE) + b"abcde", None, "no table of chunks"),
        (section(1, TABLE)[:9], None, "truncated"),
        (b"", None, "too small"),
        (None, None, "too small"),
    ],
)
def test_tables_by_hand(spark, payload, chunks, error):
    got = streams.chunk_tables(spark.createDataFrame([(7, payload)], "kept int, payload binary")).first()
    assert (got.kept, got.chunks and [tuple(c) for c in got.chunks], got.error) == (7, chunks, error)


def test_chunks_are_whole_blocks_and_bad_frames_say_so(spark):
    rows = [(1, bytes(range(40)), 8, 3), (2, b"", 8, 4), (3, bytes(9), 8, 2), (4, bytes(8), 8, 1), (5, None, 16, 2), (6, bytes(8), 0, 2)]
    got = {r.k: r for r in streams.chunked_sections(spark.createDataFrame(rows, "k int, blocks binary, block_size int, chunks int")).collect()}
    assert bytes(got[1].section) == section(0xCB, section(1, section(2, b"\x0a" * 3) + sizes(8, 8, 24)) + bytes(range(40)))
    assert bytes(got[2].section) == bytes(got[5].section) == section(0xCB, section(1, section(2, b"\x0a") + sizes(0)))
    assert [got[k].error for k in (3, 4, 6)] == ["no whole blocks", "fewer than two chunks", "no whole blocks"]
