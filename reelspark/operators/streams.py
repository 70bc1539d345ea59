"""Byte streams as rows: runs, operation codes, packet and section headers, token sizes (Z rows of the blueprint)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import Value, ascii_at, col, idiv, le_bytes, le_int, let, lookup, unused
from .container import legacy_format

# Low and high halves of a section's type byte.
TEXTURES = {0xB: "dxt1", 0xE: "dxt5", 0xF: "ycocg", 0x1: "bc4"}
WRAPPINGS = {0xA: "raw", 0xB: "snappy", 0xC: "chunked"}
COMPOSITE = 0x0D
LONG_RUN = 258
RAW = 0x0A
#: Places of a stream that lie in one part, so that a long stream is shared out.
PART = 1 << 18


def last_matches(rows: DataFrame, key: str, *streams: str, order: str = "n") -> DataFrame:
    """distance: how far back in its stream the same key came last, null for the first."""
    return rows.withColumn("distance", F.col(order) - F.lag(order).over(Window.partitionBy(*streams, key).orderBy(order)))


def part_of(rows: DataFrame, order: str, size: int = PART) -> Column:
    """The part of its stream that a row lies in, if order is an integer; else a stream is one part."""
    return idiv(order, size) if isinstance(rows.schema[order].dataType, IntegralType) else F.lit(0)


def numbered(rows: DataFrame, counts: DataFrame, streams: Sequence[str], part: str, by: Sequence[str], into: str) -> DataFrame:
    """rows with their place from 0 in each stream, in order of by, told part by part. counts: streams, part and n, which add up to the rows of each part."""
    before = unused(rows, "before")
    along = Window.partitionBy(*streams).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy(*streams, part).agg(F.sum("n").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(along), F.lit(0)))
    # what comes before a part stands in front of its rows, so that no join is needed and null keys count
    inside = Window.partitionBy(*streams, part).orderBy(F.col(before).isNull(), *by)
    both = rows.unionByName(bases, allowMissingColumns=True)
    place = F.row_number().over(inside) + F.first(before).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 2
    return both.withColumn(into, place).where(F.col(before).isNull()).drop(before)


def islands(rows: DataFrame, value: str, *streams: str, order: str = "n", size: int = PART) -> DataFrame:
    """Runs of equal neighbours: streams, start_at, end_at, length and value. A task holds parts of a stream, and of all parts only their first and last runs meet."""
    keys = [f"s{i}" for i in range(len(streams))]
    found = rows.select(*[F.col(s).alias(k) for s, k in zip(streams, keys)], F.col(order).alias("n"), F.col(value).alias("value"), part_of(rows, order, size).alias("part"))
    inside = Window.partitionBy(*keys, "part").orderBy("n")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumns({"at": F.row_number().over(inside), "before": F.lag("value").over(inside), "left": F.lag("n").over(inside), "rows": F.count("*").over(whole), "last": F.max("n").over(whole)})
    heads = found.where((F.col("at") == 1) | ~F.col("value").eqNullSafe(F.col("before")))
    next_at = F.lead("at").over(inside)
    pieces = heads.select(*keys, F.col("n").alias("start_at"), F.when(next_at.isNull(), F.col("last")).otherwise(F.lead("left").over(inside)).alias("end_at"), (F.coalesce(next_at, F.col("rows") + 1) - F.col("at")).alias("length"), "value", (F.col("at") == 1).alias("first"), next_at.isNull().alias("open"))
    along = Window.partitionBy(*keys).orderBy("start_at")
    goes_on = F.col("first") & F.col("value").eqNullSafe(F.lag("value").over(along)) & (F.row_number().over(along) > 1)
    ends = pieces.where("first or open").withColumn("goes_on", goes_on).withColumn("id", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(along))
    joined = ends.groupBy(*keys, "id").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("length").alias("length"), F.first("value").alias("value")).drop("id")
    made = joined.unionByName(pieces.where("not first and not open").drop("first", "open"))
    return made.select(*[F.col(k).alias(s) for s, k in zip(streams, keys)], "start_at", "end_at", "length", "value")


def runs(rows: DataFrame, value: str, *streams: str, order: str = "n", size: int = PART) -> DataFrame:
    """Runs of equal neighbours: streams, run from 1, start_at, length and value."""
    found = islands(rows, value, *streams, order=order, size=size)
    part = unused(found, "part")
    found = found.withColumn(part, part_of(found, "start_at", size))
    placed = numbered(found, found.groupBy(*streams, part).agg(F.count("*").alias("n")), streams, part, ["start_at"], "run")
    return placed.select(*streams, (F.col("run") + 1).alias("run"), "start_at", "length", "value")


def block_ops(rows: DataFrame, value: str, *streams: str, order: str = "n") -> DataFrame:
    """Operations (block, op, covers, bytes) that write a stream of blocks, the first of which needs none: 3 is a new block of eight bytes, 0 repeats the one before 4 to 258 times, 1 once."""
    found = runs(rows, value, *streams, order=order)
    new = found.where("start_at > 0").select(*streams, F.col("start_at").alias("block"), F.lit(3).alias("op"), F.lit(1).alias("covers"), F.lit(8).alias("bytes"))
    again = found.where("length > 1").withColumns({"whole": idiv(F.col("length") - 1, LONG_RUN), "rest": (F.col("length") - 1) % LONG_RUN})
    long = F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda k: F.struct((F.col("start_at") + 1 + k * LONG_RUN).alias("block"), F.lit(0).alias("op"), F.when(k < F.col("whole"), LONG_RUN).otherwise(F.col("rest").cast("int")).alias("covers"), F.lit(1).alias("bytes")))
    single = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("rest") - 1)), lambda k: F.struct((F.col("start_at") + 1 + F.col("whole") * LONG_RUN + k).alias("block"), F.lit(1).alias("op"), F.lit(1).alias("covers"), F.lit(0).alias("bytes")))
    few = F.col("rest").between(1, 3)
    ops = F.concat(F.filter(long, lambda o: o.covers >= 4), F.when(few, single).otherwise(F.filter(single, lambda o: F.lit(False))))
    return new.unionByName(again.select(*streams, F.inline(ops)))


def run_bytes(run: Value) -> Column:
    """A run's count: one byte below 255, else ff and words of 16 bits, ffff going on, as hexadecimal digits."""
    more = col(run) - 255
    return F.when(more < 0, le_bytes(run, 1)).otherwise(F.concat(F.lit("ff"), F.repeat(F.lit("ffff"), idiv(more, 65_535).cast("int")), le_bytes(more % 65_535, 2)))


def op_streams(streams: DataFrame, ops: DataFrame, key: str = "stream_id") -> DataFrame:
    """bytes of each stream's operation codes (op, in order of n): 00 for none, 01 and the code where all are the same, else 00 and all of them."""
    by_stream = ops.groupBy(key).agg(F.min("op").alias("lo"), F.max("op").alias("hi"), F.array_sort(F.collect_list(F.struct("n", "op"))).alias("all"))
    rows = streams.join(by_stream, key, "left")
    raw = F.concat(F.lit("00"), F.concat_ws("", F.transform("all", lambda o: le_bytes(o.op, 1))))
    data = F.when(F.col("lo").isNull(), "00").when(F.col("lo") == F.col("hi"), F.concat(F.lit("01"), le_bytes("lo", 1))).otherwise(raw)
    return rows.select(*streams.columns, data.alias("bytes"))


def hq_budgets(frames: DataFrame, with_alpha: Value = "has_alpha") -> DataFrame:
    """tex and ctex sizes, and the four operation budgets, of coded_w x coded_h; budgets are one over the area's share."""
    area = F.col("coded_w").cast("long") * F.col("coded_h")
    tex = idiv("coded_w", 4) * idiv("coded_h", 4) * F.when(col(with_alpha), 16).otherwise(8)
    luma, chroma = idiv(area, 16) + 1, idiv(area, 32) + 1
    return frames.withColumns({"tex_size": tex, "ctex_size": idiv("coded_w", 8) * idiv("coded_h", 8) * 16, "ops_y": luma, "ops_co": chroma, "ops_cg": chroma, "ops_a": luma})


def legacy_headers(packets: DataFrame) -> DataFrame:
    """Older packets (data): payload_size, flags, version, format and raw of the four bytes of head, or error."""
    kind, data = le_int("data", 3, 1), F.col("data")
    size, short = le_int(data, 0, 3), F.octet_length(data) < 4
    texture = legacy_format(kind)
    error = F.when(short, "too small").when(texture.isNull(), "texture").when(size + 4 > F.octet_length(data), "truncated")
    head = {"payload_size": size, "flags": kind.bitwiseAND(0xF0), "version": F.pmod(kind.bitwiseAND(15) - 1, F.lit(256)), "format": texture, "raw": kind.bitwiseAND(0x80) != 0}
    return packets.withColumns(head | {"error": error})


def packet_headers(packets: DataFrame) -> DataFrame:
    """Packets (data) of twelve bytes of head: tag, major, minor, raw_flag, payload_size and payload, or error."""
    data = F.col("data")
    size = le_int(data, 8, 4)
    error = F.when(F.octet_length(data) < 12, "too small").when(size + 12 > F.octet_length(data), "truncated")
    payload = F.when(error.isNull(), F.substring(data, F.lit(13), size.cast("int")))
    fine = F.octet_length(data) >= 12
    head = {"tag": F.when(fine, F.coalesce(ascii_at(data, 0, 4, backwards=True), F.lit(""))), "major": le_int(data, 4, 1), "minor": le_int(data, 5, 1), "raw_flag": le_int(data, 6, 1), "payload_size": size, "payload": payload, "error": error}
    return packets.withColumns({k: v if k in ("error", "payload", "tag") else F.when(fine, v) for k, v in head.items()})


def packet_header(tag: Value, payload_size: Value, raw: Value = False) -> Column:
    """The twelve bytes of head that packet_headers reads, as hexadecimal digits: tag back to front, version 4.0, raw flag, zero, size."""
    return F.concat(F.lower(F.hex(F.reverse(col(tag)))), F.lit("0400"), F.when(col(raw), "01").otherwise("00"), F.lit("00"), le_bytes(payload_size, 4))


def hq_layouts(parts: DataFrame) -> DataFrame:
    """Where the parts of a packet of two planes groups lie: texture bytes (tex_y, tex_c), and encoded operation streams (enc_y, enc_a, enc_co, enc_cg). With alpha the first group has two streams and four more bytes of head."""
    head = F.when(F.col("has_alpha"), 12).otherwise(8)
    first = head + F.col("tex_y") + F.col("enc_y") + F.when(F.col("has_alpha"), F.col("enc_a")).otherwise(0)
    payload = first + 12 + F.col("tex_c") + F.col("enc_co") + F.col("enc_cg")
    return parts.withColumns({"op_offset_y": F.col("tex_y") + head, "op_offset_c": F.col("tex_c") + 12, "second_at": first + 12, "payload": payload, "packet": payload + 12})


def literal_cost(length: Value) -> Column:
    """Bytes of a literal token: its length and one to five bytes of head."""
    n = col(length).cast("long") - 1
    return n + 1 + F.when(n < 60, 1).when(n < 256, 2).when(n < 65_536, 3).when(n < 16_777_216, 4).otherwise(5)


def copy_cost(length: Value, offset: Value) -> Column:
    """Bytes of the tokens that copy length bytes from offset back; null for fewer than 4, and for offsets below 1 or above 65,535.

    Near copies take 64 bytes in three while 68 or more are left, then 60 in three
    and the rest in two for 65 to 67, three bytes for 12 to 64, and two below. Far
    ones take up to 64 bytes in three.
    """
    n = col(length).cast("long")
    whole = F.when(n >= 68, idiv(n - 68, 64) + 1).otherwise(0)
    rest = n - whole * 64
    near = whole * 3 + F.when(rest >= 65, 5).when(rest >= 12, 3).otherwise(2)
    far = idiv(n + 63, 64) * 3
    return F.when((n >= 4) & col(offset).between(1, 65_535), F.when(col(offset) < 2048, near).otherwise(far))


def section_header(size: Value, kind: Value) -> Column:
    """Head of a section as hexadecimal digits: 24 bits of size and the type, or zero, the type and 32 bits from 2 ** 24 on. A size of zero takes the long form, as zero means that."""
    n = col(size)
    return F.when((n > 0) & (n < 1 << 24), F.concat(le_bytes(n, 3), le_bytes(kind, 1))).otherwise(F.concat(F.lit("000000"), le_bytes(kind, 1), le_bytes(n, 4)))


def section_headers(packets: DataFrame) -> DataFrame:
    """kind, payload_at and payload_size of sections (data), or error."""
    data, have = F.col("data"), F.octet_length("data")
    short = le_int(data, 0, 3)
    long = short == 0
    at, size = F.when(long, 8).otherwise(4), F.when(long, le_int(data, 4, 4)).otherwise(short)
    error = F.when(have < 4, "too small").when(long & (have < 8), "long head cut off").when(at + size > have, "truncated")
    return packets.withColumns({k: F.when(error.isNull(), v) for k, v in (("kind", le_int(data, 3, 1)), ("payload_at", at), ("payload_size", size))} | {"error": error})


def chunk_split(frames: DataFrame) -> DataFrame:
    """(…, chunk, first_block, n_blocks) of frames with blocks and chunks: as many chunks as there are blocks at most, one at least, in equal shares, and the last takes what is left."""
    n = F.least("chunks", F.greatest(F.lit(1), "blocks")).cast("long")
    rows = frames.withColumn("n", n).withColumn("share", idiv("blocks", "n"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.struct(k.alias("chunk"), (k * F.col("share")).alias("first_block"), F.when(k == F.col("n") - 1, F.col("blocks") - k * F.col("share")).otherwise(F.col("share")).alias("n_blocks")))
    return rows.select(*frames.columns, F.inline(parts))


def chunked_sections(frames: DataFrame, blocks: str = "blocks", kind: Value = 0xCB) -> DataFrame:
    """section (binary) and error of frames with blocks (binary), block_size and chunks: a section of that kind whose payload is a table of chunks and then these, as they are.

    The table is a section 1 of a section 2, a byte for each chunk that tells it isn't
    packed, and a section 3, four bytes with each chunk's size; sizes are whole blocks
    as in chunk_split. error: fewer than two chunks, or blocks cut short.
    """
    have, size = F.coalesce(F.octet_length(blocks), F.lit(0)).cast("long"), F.col("block_size").cast("long")
    error = F.when(F.coalesce(F.col("chunks"), F.lit(0)) < 2, "fewer than two chunks").when((F.coalesce(size, F.lit(0)) < 1) | (have % size != 0), "no whole blocks")
    count = idiv(have, size)
    n = F.least(F.col("chunks").cast("long"), F.greatest(F.lit(1), count))

    def section(k: Column) -> Column:
        share = idiv(count, k) * size
        sizes = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), k), lambda i: le_bytes(F.when(i < k, share).otherwise(have - (k - 1) * share), 4)), "")
        table = F.concat(section_header(k, 2), F.repeat(F.lit(f"{RAW:02x}"), k.cast("int")), section_header(k * 4, 3), sizes)
        inner = let(table, lambda t: F.concat(section_header(idiv(F.length(t), 2), 1), t, F.lower(F.hex(F.coalesce(F.col(blocks), F.lit(b""))))))
        return let(inner, lambda x: F.concat(section_header(idiv(F.length(x), 2), kind), x))

    return frames.withColumn("error", error).withColumn("section", F.when(F.col("error").isNull(), F.unhex(let(n, section))))


def chunk_tables(sections: DataFrame, data: str = "payload") -> DataFrame:
    """chunks (array of chunk, packing, file_offset and size) and error of payloads of chunked sections.

    The table's sections may come in any order, and those of other kinds don't count;
    of two alike the last does. packing is raw or snappy; what is packed stays so.
    error: no table, one that is cut off, as many kinds as sizes missing, chunks beyond
    the payload, or a packing that isn't known; null data is too small.
    """
    outer = sections.withColumn("data", F.coalesce(F.col(data), F.lit(b""))) if data != "data" else sections
    rows = section_headers(outer).withColumnRenamed("error", "__head_error")
    body = F.when(F.col("__head_error").isNull() & (F.col("kind") == 1), F.substring(F.col("data"), F.col("payload_at") + 1, F.col("payload_size").cast("int")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kinds"), F.lit(b"").alias("sizes"), F.lit(None).cast("string").alias("error"))

    def read(t: Column) -> Column:
        """What a table's sections say, one after another; each has a head of four bytes at least."""
        have = F.octet_length(t).cast("long")

        def step(s: Column, _: Column) -> Column:
            byte = lambda k: F.conv(F.hex(F.substring(t, (s["at"] + k + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
            little = lambda first, n: sum((byte(first + k) * 256**k for k in range(1, n)), byte(first))

            def moved(h: Column) -> Column:
                content = F.substring(t, (s["at"] + h.head + 1).cast("int"), h["size"].cast("int"))
                fine = h.error.isNull()
                return F.struct((s["at"] + h.head + F.coalesce(h["size"], F.lit(0))).cast("long").alias("at"), F.when(fine & (h.kind == 2), content).otherwise(s.kinds).alias("kinds"), F.when(fine & (h.kind == 3), content).otherwise(s.sizes).alias("sizes"), h.error.alias("error"))

            def checked(h: Column) -> Column:
                wrong = F.when(s["at"] + 4 > have, "table too small").when(s["at"] + h.head > have, "table's long head cut off").when(s["at"] + h.head + h["size"] > have, "table truncated")
                return let(F.struct(h.head.alias("head"), h["size"].alias("size"), h.kind.alias("kind"), wrong.alias("error")), moved)

            sized = lambda short: F.struct(F.when(F.coalesce(short, F.lit(0)) == 0, 8).otherwise(4).cast("long").alias("head"), F.when(short == 0, little(4, 4)).otherwise(short).alias("size"), byte(3).alias("kind"))
            return F.when(s.error.isNotNull() | (s["at"] >= have), s).otherwise(let(let(little(0, 3), sized), checked))

        return F.aggregate(F.sequence(F.lit(0).cast("long"), idiv(have, 4)), empty, step)

    def listed(r: Column) -> Column:
        """The chunks behind the table, each at the end of the one before."""
        size = lambda k: F.conv(F.concat(*[F.hex(F.substring(r.sizes, (k * 4 + 4 - i).cast("int"), F.lit(1))) for i in range(4)]), 16, 10).cast("long")
        kind = lambda k: lookup({"0A": "raw", "0B": "snappy"}, F.hex(F.substring(r.kinds, (k + 1).cast("int"), F.lit(1))))
        chunks = F.transform(F.sequence(F.lit(0), F.octet_length(r.kinds) - 1), lambda k: F.struct(k.alias("chunk"), kind(k).alias("packing"), size(k).alias("size")))
        start = F.struct(F.col("__stop").alias("at"), F.array().cast("array<struct<chunk:int,packing:string,file_offset:bigint,size:bigint>>").alias("all"))
        return F.aggregate(chunks, start, lambda s, c: F.struct((s["at"] + c["size"]).alias("at"), F.concat(s["all"], F.array(F.struct(c.chunk.alias("chunk"), c.packing.alias("packing"), s["at"].alias("file_offset"), c["size"].alias("size")))).alias("all")))

    def told(r: Column) -> Column:
        wrong = F.coalesce(r.error, F.when((F.octet_length(r.kinds) == 0) | (F.octet_length(r.kinds) != idiv(F.octet_length(r.sizes), 4)), "kinds and sizes differ"))
        return F.when(wrong.isNotNull(), F.struct(wrong.alias("error"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("array<struct<chunk:int,packing:string,file_offset:bigint,size:bigint>>").alias("all"))).otherwise(let(listed(r), lambda p: F.struct(F.lit(None).cast("string").alias("error"), p["at"].alias("at"), p["all"].alias("all"))))

    # columns are bound before lambdas use them, as the optimizer would otherwise compute them again within
    rows = rows.withColumn("__stop", (F.col("payload_at") + F.col("payload_size")).cast("long")).withColumn("__told", let(let(body, read), told))
    error = F.coalesce(F.col("__head_error"), F.when(F.col("kind") != 1, "no table of chunks"), F.col("__told.error"), F.when(F.exists("__told.all", lambda c: c.packing.isNull()), "unknown packing"), F.when(F.col("__told.at") > F.octet_length("data"), "chunks beyond the payload"))
    return rows.withColumn("__error", error).select(*sections.columns, F.when(F.col("__error").isNull(), F.col("__told.all")).alias("chunks"), F.col("__error").alias("error"))


def dispatch_sections(sections: DataFrame, kind: Value = "kind") -> DataFrame:
    """texture and wrapping of a section's type byte; error for any but the twelve that are known."""
    k = col(kind)
    texture, wrapping = lookup(TEXTURES, k.bitwiseAND(15).cast("int")), lookup(WRAPPINGS, F.shiftright(k, 4).cast("int"))
    fine = texture.isNotNull() & wrapping.isNotNull()
    return sections.withColumns({"texture": F.when(fine, texture), "wrapping": F.when(fine, wrapping), "error": F.when(~fine, "unsupported section")})
