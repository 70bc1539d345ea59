"""Movie files: boxes by hand, and what was written read back."""

import struct

from reelspark import plans
from reelspark.operators import container, movfile


def box(kind, *parts, size=None, wide=False):
    body = b"".join(parts)
    if wide:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8 if size is None else size, kind) + body


def walked(spark, *contents):
    df = spark.createDataFrame(list(enumerate(contents)), "source_id long, content binary")
    return [(r.source_id, r.path, r.start, r.head, r["size"], r.error) for r in movfile.walk_boxes(df).orderBy("source_id", "start").collect()]


def test_sizes_of_all_kinds(spark):
    inner = box(b"trak", box(b"tkhd", b"abc"), wide=True)
    assert walked(spark, box(b"free") + box(b"moov", inner, box(b"udta")) + box(b"mdat", b"xyz", size=0)) == [
        (0, "/free", 0, 8, 8, None), (0, "/moov", 8, 8, 43, None), (0, "/moov/trak", 16, 16, 27, None), (0, "/moov/trak/tkhd", 32, 8, 11, None), (0, "/moov/udta", 43, 8, 8, None), (0, "/mdat", 51, 8, 11, None),
    ]


def test_overruns_end_their_range_alone(spark):
    late = box(b"moov", box(b"trak", box(b"tkhd", size=99)), box(b"udta"))
    got = walked(spark, late, box(b"wide", size=7) + box(b"moov"), b"short", None, b"", struct.pack(">I4sQ", 1, b"moov", 2**63) + b"12345678", struct.pack(">I4s", 1, b"moov"))
    assert [(s, p, e) for s, p, _, _, _, e in got] == [
        (0, "/moov", None), (0, "/moov/trak", None), (0, "/moov/trak/tkhd", "truncated"), (0, "/moov/udta", None), (1, "/wide", "truncated"), (5, "/moov", "truncated"), (6, "/moov", "truncated"),
    ]


def track(handler, code, tables=b"", w=0):
    stsd = box(b"stsd", bytes(4), struct.pack(">II4s", 1, 44, code), bytes(24), struct.pack(">HH", w, 5))
    return box(b"trak", box(b"tkhd", bytes(8), struct.pack(">II", 70 << 16, 6 << 16)), box(b"mdia", box(b"mdhd", bytes(12), struct.pack(">II", 600, 0), bytes(4)), box(b"hdlr", bytes(8), handler, bytes(4)), box(b"minf", box(b"stbl", stsd, tables))))


def test_probe_takes_the_first_video_track(spark):
    contents = [
        box(b"ftyp") + box(b"moov", track(b"soun", b"lpcm"), track(b"vide", b"Hap1"), track(b"vide", b"DXT1")),
        box(b"moov", track(b"soun", b"lpcm")),
        track(b"vide", b"DXT1"),
        box(b"moov", box(b"free", size=4), track(b"vide", b"DXT1")),
        None,
    ]
    df = spark.createDataFrame(list(enumerate(contents)), "source_id long, content binary")
    assert [r.fourcc for r in movfile.probe_fourcc(df).orderBy("source_id").collect()] == ["Hap1", None, None, None, None]


def test_tables_of_odd_shapes(spark):
    tables = box(b"stsz", bytes(4), struct.pack(">II", 512, 3)) + box(b"co64", bytes(4), struct.pack(">IQQ", 2, 2**33, 7)) + box(b"stsc", bytes(4), struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)) + box(b"stts", bytes(4), struct.pack(">III", 9, 1, 2))
    df = spark.createDataFrame([(1, box(b"moov", track(b"soun", b"lpcm", tables), track(b"vide", b"YG10", tables, 0)))], "source_id long, content binary")
    got = movfile.sample_tables(movfile.walk_boxes(df))
    assert [tuple(r) for r in container.resolve_dims(got["tracks"]).select("fourcc", "timescale", "w", "h").collect()] == [("YG10", 600, 70, 5)]
    sizes = container.sample_sizes(got["headers"], got["table"])
    index = container.frame_index(sizes, got["chunks"], got["runs"], got["deltas"], 600).orderBy("frame_no").collect()
    # the count of stts says more than it holds, so there are no durations
    assert [(r["size"], r.file_offset, r.delta) for r in index] == [(512, 2**33, 1), (512, 2**33 + 512, 1), (512, 7, 1)]


def test_written_files_are_read_back(spark):
    movies = spark.createDataFrame([(1, "DXT1", 64, 48, 15360, 512), (2, "Hap1", 1, 2, 30000, 1001), (3, "été1", 1, 1, 1, 1), (4, "abcd", 1, 1, 0, 1)], "source_id long, fourcc string, w int, h int, timescale long, delta long")
    data = [(1, 0, b"one"), (1, 2, b""), (1, 1, b"three"), (1, 3, None), (3, 0, b"x"), (9, 0, b"nobody's")]
    packets = spark.createDataFrame(data, "source_id long, frame_no long, packet binary")
    parts = movfile.mux(movies, packets)
    assert "ObjectHashAggregate" not in parts.where("file_offset between 1 and 40")._jdf.queryExecution().optimizedPlan().toString()
    files = {r.source_id: bytes(r.content) for r in movfile.assemble(parts).collect()}
    assert sorted(files) == [1, 2] and files[1][28:44] == struct.pack(">I4s", 16, b"mdat") + b"onethree"
    plan = {r.source_id: (r.frames, r.video_bytes, r.error) for r in movfile.layouts(movies, packets.selectExpr("*", "coalesce(octet_length(packet), 0) as size")).collect()}
    assert plan == {1: (4, 8, None), 2: (0, 0, None), 3: (1, 1, "invalid fourcc"), 4: (0, 0, "no timescale")}
    tables = movfile.sample_tables(movfile.walk_boxes(movfile.assemble(parts)))
    index = container.frame_index(container.sample_sizes(tables["headers"], tables["table"]), tables["chunks"], tables["runs"], tables["deltas"], 15360).orderBy("frame_no").collect()
    assert [(r.source_id, r["size"], r.file_offset, r.delta) for r in index] == [(1, 3, 36, 512), (1, 5, 39, 512), (1, 0, 44, 512), (1, 0, 44, 512)]
    big = spark.createDataFrame([(1, 0, 2**32)], "source_id long, frame_no long, size long")
    assert [r.error for r in movfile.layouts(movies.where("source_id = 1"), big).collect()] == ["mdat over 4 GB"]


def test_more_boxes_than_a_recursion_may_have(spark):
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "100")
    try:
        wide, deep = box(b"free") * 60, b""
        for _ in range(150):
            deep = box(b"udta", deep)
        assert [len(walked(spark, *contents)) for contents in ([wide, wide], [deep])] == [120, 150]
    finally:
        spark.conf.unset(limit)


def test_bodies_and_any_kind_of_id(spark, monkeypatch):
    monkeypatch.setattr(movfile, "BOXES_AT_ONCE", 3)
    content = box(b"\xa9swr", b"x" * 9) + box(b"free") + box(b"mdat", b"media") + box(b"moov", box(b"mvhd", b"\x00\xff"))
    df = spark.createDataFrame([("a", content), (None, content), ("b", None)], "source_id string, content binary")
    got = {(r.source_id, r.path): r.body for r in movfile.walk_boxes(df).collect()}
    want = {"/\xa9swr": b"x" * 9, "/free": b"", "/mdat": None, "/moov": None, "/moov/mvhd": b"\x00\xff"}
    assert got == {(s, p): b for s in ("a", None) for p, b in want.items()}


def under_a_low_limit(spark, key):
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "100")
    try:
        return plans.QUERIES[key](spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.unset(limit)


def test_demux_index_of_more_boxes_than_a_recursion_may_have(spark):
    assert under_a_low_limit(spark, "demux_index") > 100


def test_fourcc_probe_of_more_boxes_than_a_recursion_may_have(spark):
    assert under_a_low_limit(spark, "fourcc_probe") == 200


def test_sample_tables_read_contents_once(spark):
    content = box(b"moov", track(b"soun", b"lpcm"), track(b"vide", b"Hap1", box(b"stsz", bytes(4), struct.pack(">III", 0, 1, 9))))
    df = spark.createDataFrame([(k, content) for k in range(7)] + [(None, content)], "source_id long, content binary")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    tables = movfile.sample_tables(movfile.walk_boxes(df.mapInArrow(counted, df.schema)))
    assert {name: t.count() for name, t in tables.items()} == {"tracks": 7, "headers": 7, "table": 7, "chunks": 0, "runs": 0, "deltas": 0}
    assert read.value == 8
