"""Movie files as bytes: boxes written from sample tables (K1 of the blueprint), and boxes opened again (D1, D4).

A file is a row for each of its parts, at its offset: the head, every packet as it is,
and the tables behind them, whose bytes are grown from the leaves of the tree upwards
as hexadecimal digits, since a box begins with its own length. Packets are never
gathered; only assemble, for files of bounded size, puts parts together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from ..functions import Value, col, idiv, let, unused
from .container import stco_offsets, valid_fourcc

# Fixed values of the format: lengths in bytes, numbers big-endian.
HEAD = 36  # ftyp of 20, wide of 8, and the head of mdat
MOVIE_TIMESCALE = 1000
LONGEST = 0xFFFFFFFF
MATRIX = (0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Boxes that hold boxes.
CONTAINERS = ("moov", "trak", "edts", "mdia", "minf", "dinf", "stbl", "udta")


def be(v: Value, n: int = 4) -> Column:
    """An integer in n bytes, the highest first, as hexadecimal digits."""
    if isinstance(v, int):
        return F.lit(f"{v:0{2 * n}x}")
    return F.lower(F.lpad(F.hex(col(v).cast("long")), 2 * n, "0"))


def _digits(text: Value) -> Column:
    return F.lower(F.hex(F.encode(col(text), "utf-8")))


def _said(text: str) -> Column:
    return F.lit(text.encode("latin-1").hex())


def box(kind: str, *parts: Column) -> Column:
    """Length, four characters and the parts, as hexadecimal digits."""
    # bound once: each box around it needs its length and its digits
    return let(F.concat(*parts) if parts else F.lit(""), lambda body: F.concat(be(idiv(F.length(body), 2) + 8), _said(kind), body))


def _zeros(n: int) -> Column:
    return F.lit("00" * n)


def _handler(kind: str, subtype: str, name: str) -> Column:
    return box("hdlr", _zeros(4), _said(kind), _said(subtype), _zeros(12), _said(chr(len(name)) + name))


def _many(values: Column) -> Column:
    """Integers of an array in four bytes each."""
    return F.array_join(F.transform(values, lambda v: be(v)), "")


def _tables(sizes: Column, offsets: Column, fourcc: Value, w: Value, h: Value, delta: Value) -> Column:
    """The sample tables of packets, each a chunk of its own."""
    n, half, dpi = F.size(sizes), 0x200, 0x480000
    entry = [_digits(fourcc), _zeros(6), be(1, 2), _zeros(4), _said("FFMP"), be(half), be(half), be(w, 2), be(h, 2), be(dpi), be(dpi), _zeros(4), be(1, 2), _zeros(32), be(24, 2), F.lit("ffff")]
    return box(
        "stbl",
        box("stsd", _zeros(4), be(1), be(86), *entry),
        box("stts", _zeros(4), be(1), be(n), be(delta)),
        box("stsc", _zeros(4), be(1), be(1), be(1), be(1)),
        box("stsz", _zeros(8), be(n), _many(sizes)),
        box("stco", _zeros(4), be(n), _many(offsets)),
    )


def _moov(sizes: Column, offsets: Column, fourcc: Value, w: Value, h: Value, timescale: Value, delta: Value, writer: Value) -> Column:
    n = F.size(sizes).cast("long")
    ms = idiv(n * MOVIE_TIMESCALE * col(delta), timescale)
    matrix = F.lit("".join(f"{m:08x}" for m in MATRIX))
    media = box(
        "mdia",
        box("mdhd", _zeros(12), be(timescale), be(n * col(delta)), F.lit("7fff0000")),
        _handler("mhlr", "vide", "VideoHandler"),
        box("minf", box("vmhd", F.lit("00000001"), _zeros(8)), _handler("dhlr", "url ", "DataHandler"), box("dinf", box("dref", _zeros(4), be(1), be(12), _said("url "), be(1))), _tables(sizes, offsets, fourcc, w, h, delta)),
    )
    track = box(
        "trak",
        box("tkhd", be(3), _zeros(8), be(1), _zeros(4), be(ms), _zeros(16), matrix, be(col(w) * 65536), be(col(h) * 65536)),
        box("edts", box("elst", _zeros(4), be(1), be(ms), _zeros(4), be(0x10000))),
        media,
    )
    head = box("mvhd", _zeros(12), be(MOVIE_TIMESCALE), be(ms), be(0x10000), be(0x100, 2), _zeros(10), matrix, _zeros(24), be(2))
    made_by = _digits(writer)
    return box("moov", head, track, box("udta", box("\xa9swr", be(idiv(F.length(made_by), 2), 2), F.lit("55c4"), made_by)))


def layouts(movies: DataFrame, packets: DataFrame, writer: str = "reelspark") -> DataFrame:
    """movies (source_id, fourcc, w, h, timescale, delta) with frames, video_bytes, moov (binary) and error.

    packets: source_id, frame_no, size; a movie without any has empty tables. error
    (and no moov): a code that isn't four ASCII characters, no timescale, or media
    beyond 32 bits. Of a movie's packets only the sizes and offsets are gathered, as
    one list, eight bytes of the file for each. Columns of these names are replaced.
    """
    made = ("frames", "video_bytes", "moov", "error")
    entry = F.struct("frame_no", F.col("size").cast("long").alias("size"), F.col("file_offset").cast("long").alias("file_offset"))
    table, total = (unused(movies, c) for c in ("table", "total"))
    listed = stco_offsets(packets.select("source_id", "frame_no", "size"), HEAD).groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias(table), F.sum("size").cast("long").alias(total))
    rows = movies.drop(*made).join(listed, "source_id", "left")
    lists = F.coalesce(table, F.array().cast(f"array<{listed.schema[table].dataType.elementType.simpleString()}>"))
    rows = rows.withColumns({table: lists, "video_bytes": F.coalesce(total, F.lit(0).cast("long"))}).withColumn("frames", F.size(table).cast("long"))
    error = F.when(~valid_fourcc("fourcc"), "invalid fourcc").when(F.coalesce(F.col("timescale"), F.lit(0)) <= 0, "no timescale").when(F.col("video_bytes") + 8 > LONGEST, "mdat over 4 GB")
    moov = _moov(F.col(f"{table}.size"), F.col(f"{table}.file_offset"), "fourcc", "w", "h", "timescale", "delta", F.lit(writer))
    return rows.withColumn("error", error).withColumn("moov", F.when(F.col("error").isNull(), F.unhex(moov))).drop(table, total)


def mux(movies: DataFrame, packets: DataFrame, writer: str = "reelspark") -> DataFrame:
    """(source_id, file_offset, part): the parts of each movie's file, which joined in order of file_offset are the file.

    packets: source_id, frame_no, packet. Movies that layouts finds an error in have no
    parts; null packets are empty and leave none. Packets pass through as they are.
    """
    sized = packets.select("source_id", "frame_no", F.coalesce(F.col("packet"), F.lit(b"")).alias("packet")).withColumn("size", F.octet_length("packet").cast("long"))
    plan = layouts(movies, sized, writer).where("error is null")
    start = F.concat(box("ftyp", _said("qt  "), be(0x200), _said("qt  ")), box("wide"), be(F.col("video_bytes") + 8), _said("mdat"))
    heads = plan.select("source_id", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("file_offset"), F.unhex(start).alias("part")), F.struct((F.col("video_bytes") + HEAD).alias("file_offset"), F.col("moov").alias("part")))))
    media = stco_offsets(sized, HEAD).join(plan.select("source_id"), "source_id", "left_semi").where("size > 0")
    return heads.unionByName(media.select("source_id", F.col("file_offset").cast("long").alias("file_offset"), F.col("packet").alias("part")))


def assemble(parts: DataFrame) -> DataFrame:
    """source_id and content: each file in one value, which ends at two gigabytes, a fourth of that while it is built."""
    listed = parts.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("file_offset", "part"))).alias("parts"))
    return listed.select("source_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p.part)), "")).alias("content"))


#: Boxes, and bytes of their bodies, that a task hands on at once.
BOXES_AT_ONCE, BODIES_AT_ONCE = 10_000, 1 << 24


def _opened(data: memoryview) -> Iterator[tuple[str, str, int, int, int, bytes | None, str | None]]:
    """path, kind, start, head, size, body and error of the boxes in a content; each range's boxes in order."""
    ranges = [("", 0, len(data))]
    while ranges:
        parent, at, end = ranges.pop()
        while end - at >= 8:
            size, kind = int.from_bytes(data[at : at + 4]), str(data[at + 4 : at + 8], "latin-1")
            head, path = 16 if size == 1 else 8, f"{parent}/{kind}"
            size = int.from_bytes(data[at + 8 : min(at + 16, end)]) if size == 1 else size or end - at
            if size < head or size > end - at:
                yield path, kind, at, head, min(size, 2**63 - 1), None, "truncated"
                break
            if kind in CONTAINERS:
                ranges.append((path, at + head, at + size))
            yield path, kind, at, head, size, None if kind in CONTAINERS or kind == "mdat" else bytes(data[at + head : at + size]), None
            at += size


def walk_boxes(contents: DataFrame) -> DataFrame:
    """(source_id, path, kind, start, head, size, body, error) of every box in each content, of whichever kind.

    A length of 1 stands for one of 64 bits behind the kind, 0 for all that is left.
    A box that ends beyond what holds it, or within its own head, is an error, and
    what follows beside it isn't opened; fewer than eight bytes are no box. path leads
    through the boxes around it; body is null for boxes that hold boxes, for mdat and
    for errors. Each content is read once, from box to box, in Arrow batches; there
    may be any number of boxes, within each other to any depth.
    """
    asked = contents.select("source_id", "content")
    made = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("head", pa.int64()), ("size", pa.int64()), ("body", pa.binary()), ("error", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners, held = [], [], 0

            def rows() -> pa.RecordBatch:
                columns = zip(*found) if found else [[]] * len(made)
                return pa.record_batch([batch.column(0).take(pa.array(owners, pa.int64())), *[pa.array(list(c), f.type) for c, f in zip(columns, made)]], ["source_id", *made.names])

            for k, content in enumerate(batch.column(1)):
                for box_ in _opened(memoryview(content.as_buffer())) if content.is_valid else ():
                    found.append(box_)
                    owners.append(k)
                    held += len(box_[5] or b"")
                    if len(found) >= BOXES_AT_ONCE or held >= BODIES_AT_ONCE:
                        yield rows()
                        found, owners, held = [], [], 0
            yield rows()

    types = StructType([asked.schema["source_id"]])
    for f in made:
        types = types.add(f.name, {pa.string(): StringType(), pa.int64(): LongType(), pa.binary(): BinaryType()}[f.type])
    return asked.mapInArrow(walk, types)


def _uint(data: Value, at: Value, n: int) -> Column:
    """The big-endian integer in n bytes of a binary from byte at on; null where the data end before."""
    whole = F.octet_length(col(data)) >= col(at) + n
    return F.when(whole, F.conv(F.hex(F.substring(col(data), col(at) + 1, F.lit(n))), 16, 10).cast("long"))


def _trak(boxes: DataFrame) -> DataFrame:
    """Boxes within a trak, with track: where that trak starts."""
    order = Window.partitionBy("source_id").orderBy("start")
    track = F.last(F.when(F.col("path") == "/moov/trak", F.col("start")), ignorenulls=True).over(order)
    return boxes.withColumn("track", track).where("path like '/moov/trak/%'")


def probe_fourcc(contents: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """source_id and fourcc of every content: the code of the first track whose handler is vide; null where there is none.

    Only what stands before the first error of a range counts.
    """
    found = boxes if boxes is not None else walk_boxes(contents)
    one = lambda path, value: F.min_by(F.when(F.col("path") == path, value), F.when(F.col("path") == path, F.col("start")))
    text = lambda at: F.decode(F.substring("body", at + 1, 4), "iso-8859-1")
    tracks = _trak(found.where("error is null")).groupBy("source_id", "track").agg(one("/moov/trak/mdia/hdlr", text(8)).alias("handler"), one("/moov/trak/mdia/minf/stbl/stsd", F.when(F.octet_length("body") >= 16, text(12))).alias("fourcc"))
    first = tracks.where("handler = 'vide' and fourcc <> ''").groupBy("source_id").agg(F.min_by("fourcc", "track").alias("fourcc"))
    return contents.select("source_id").join(first, "source_id", "left")


_STBL = "/moov/trak/mdia/minf/stbl/"
#: Boxes that sample tables are read from.
_TABLE_PATHS = ("/moov/trak", "/moov/trak/tkhd", "/moov/trak/mdia/mdhd", "/moov/trak/mdia/hdlr", *(_STBL + k for k in ("stsd", "stts", "stsc", "stsz", "stco", "co64")))


def video_boxes(boxes: DataFrame) -> DataFrame:
    """(source_id, path, body) of the boxes that sample tables are read from, within each source's first video track: one pass over boxes, and one shuffle of what its tables hold."""
    inside = _trak(boxes.where("error is null and source_id is not null").where(F.col("path").isin(*_TABLE_PATHS)).select("source_id", "path", "start", "body"))
    vide = F.expr("path = '/moov/trak/mdia/hdlr' and octet_length(body) >= 12 and substring(body, 9, 4) = cast('vide' as binary)")
    first = F.min(F.when(vide, F.col("track"))).over(Window.partitionBy("source_id"))
    return inside.withColumn("video", first).where("track = video").select("source_id", "path", "body")


def sample_tables(boxes: DataFrame) -> dict[str, DataFrame]:
    """What frame_index and resolve_dims take, from the boxes of each source's first video track, which are kept in Spark's storage, so that boxes is read once and not for each table.

    tracks: source_id, fourcc, timescale, stsd_w, stsd_h, tkhd_w, tkhd_h. headers:
    constant and n of the sizes. table: frame_no and size. chunks, runs and deltas as
    frame_index has them; co64 stands for stco where it is there. A table that is
    shorter than its count says is left out.
    """
    kept, stbl = video_boxes(boxes).persist(), _STBL

    def rows(name: str, first: int, count: int, width: int, columns: dict[str, Column]) -> DataFrame:
        n = _uint("body", count, 4)
        whole = kept.where(F.col("path") == stbl + name).where(F.octet_length("body") >= first + n * width).where(n > 0)
        return whole.select("source_id", "body", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("nth")).select("source_id", *[v.alias(k) for k, v in columns.items()])

    at = lambda base, width, more=0: (F.lit(base + more) + F.col("nth") * width).cast("int")
    offset = lambda width: {"chunk": F.col("nth") + 1, "chunk_offset": _uint("body", at(8, width), width)}
    version1 = _uint("body", F.lit(0), 1) == 1
    value = lambda path, v: F.max(F.when(F.col("path") == path, v))
    dims = {f"stsd_{s}": value(stbl + "stsd", _uint("body", F.lit(40 + 2 * k), 2)) for k, s in enumerate("wh")} | {f"tkhd_{s}": value("/moov/trak/tkhd", _uint("body", F.octet_length("body") - 8 + 4 * k, 4)) for k, s in enumerate("wh")}
    tracks = kept.groupBy("source_id").agg(value(stbl + "stsd", F.decode(F.substring("body", 13, 4), "iso-8859-1")).alias("fourcc"), value("/moov/trak/mdia/mdhd", F.when(version1, _uint("body", F.lit(20), 4)).otherwise(_uint("body", F.lit(12), 4))).alias("timescale"), *[v.alias(k) for k, v in dims.items()])
    headers = kept.where(F.col("path") == stbl + "stsz").select("source_id", _uint("body", F.lit(4), 4).alias("constant"), _uint("body", F.lit(8), 4).alias("n"))
    return {
        "tracks": tracks,
        "headers": headers,
        "table": rows("stsz", 12, 8, 4, {"frame_no": F.col("nth"), "size": _uint("body", at(12, 4), 4)}),
        "chunks": rows("stco", 8, 4, 4, offset(4)).unionByName(rows("co64", 8, 4, 8, offset(8))),
        "runs": rows("stsc", 8, 4, 12, {"first_chunk": _uint("body", at(8, 12), 4), "per_chunk": _uint("body", at(8, 12, 4), 4)}),
        "deltas": rows("stts", 8, 4, 8, {"nth": F.col("nth"), "n": _uint("body", at(8, 8), 4), "delta": _uint("body", at(8, 8, 4), 4)}),
    }
