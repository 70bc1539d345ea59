"""Registered queries of movie files: written, opened again, and their sample tables read back."""

from pyspark.sql import functions as F

from ..operators import container as c
from ..operators import movfile as m
from .container_cases import _S
from .fixtures import view
from .registry import case

view(
    "movies",
    """select doc_id as source_id, case doc_id % 6 when 0 then 'DXT1' when 1 then 'DXT5' when 2 then 'Hap1' when 3 then 'YG10' when 4 then 'HapM' else 'YCG6' end as fourcc, 16 + doc_id * 37 % 4000 as w, 16 + doc_id * 91 % 2200 as h,
       case doc_id % 3 when 0 then 15360 when 1 then 30000 else 24000 end as timescale, case doc_id % 3 when 0 then 512 else 1001 end as delta from {documents}""",
)
# packets of some hundred bytes that cover a document's text; an empty one has none

_PACKETS = """(select source_id, idx as frame_no, substr(digits, 2 * idx * size + 1, 2 * size) as digits, length(substr(digits, 2 * idx * size + 1, 2 * size)) // 2 as size
    from (select *, unnest(range((length(digits) // 2 + size - 1) // size)) as idx from (select source_id, 200 + source_id % 100 as size, lower(hex(coalesce(content, ''::blob))) as digits from {contents})))"""


def _packets(t):
    return c.read_packets(c.entries_covering(t("contents"), 200 + F.col("source_id") % 100), t("contents")).where("actual > 0").select("source_id", F.col("idx").alias("frame_no"), "packet")


def _files(t):
    return m.assemble(m.mux(t("movies"), _packets(t)))


def _hex(kind: str, *parts: str) -> str:
    """A box in DuckDB: its parts are digits."""
    body = " || ".join(parts) or "''"
    return f"(printf('%08x', length({body}) // 2 + 8) || '{kind.encode('latin-1').hex()}' || {body})"


_32, _16 = (lambda v: f"printf('%08x', ({v})::bigint)"), (lambda v: f"printf('%04x', ({v})::bigint)")
_0 = lambda n: f"'{'00' * n}'"
_MATRIX = "'00010000" + "00" * 12 + "00010000" + "00" * 12 + "40000000'"
_TEXT = lambda s: f"'{s.encode().hex()}'"
_MS = _32("n * 1000 * delta // timescale")
_STBL = [
    _hex("stsd", _0(4), _32(1), _32(86), "lower(hex(encode(fourcc)))", _0(6), _16(1), _0(4), _TEXT("FFMP"), _32(512), _32(512), _16("w"), _16("h"), _32(4718592), _32(4718592), _0(4), _16(1), _0(32), _16(24), "'ffff'"),
    _hex("stts", _0(4), _32(1), _32("n"), _32("delta")),
    _hex("stsc", _0(4), _32(1), _32(1), _32(1), _32(1)),
    _hex("stsz", _0(8), _32("n"), "sizes"),
    _hex("stco", _0(4), _32("n"), "offsets"),
]
_MOOV = _hex(
    "moov",
    _hex("mvhd", _0(12), _32(1000), _MS, _32(65536), _16(256), _0(10), _MATRIX, _0(24), _32(2)),
    _hex(
        "trak",
        _hex("tkhd", _32(3), _0(8), _32(1), _0(4), _MS, _0(16), _MATRIX, _32("w * 65536"), _32("h * 65536")),
        _hex("edts", _hex("elst", _0(4), _32(1), _MS, _0(4), _32(65536))),
        _hex(
            "mdia",
            _hex("mdhd", _0(12), _32("timescale"), _32("n * delta"), "'7fff0000'"),
            _hex("hdlr", _0(4), _TEXT("mhlrvide"), _0(12), _TEXT("\x0cVideoHandler")),
            _hex("minf", _hex("vmhd", "'00000001'", _0(8)), _hex("hdlr", _0(4), _TEXT("dhlrurl "), _0(12), _TEXT("\x0bDataHandler")), _hex("dinf", _hex("dref", _0(4), _32(1), _32(12), _TEXT("url "), _32(1))), _hex("stbl", *_STBL)),
        ),
    ),
    _hex("udta", _hex("\xa9swr", _16(9), "'55c4'", _TEXT("reelspark"))),
)
_TABLES = f"""(select v.*, coalesce(n, 0) as n, coalesce(video_bytes, 0) as video_bytes, coalesce(media, '') as media, coalesce(sizes, '') as sizes, coalesce(offsets, '') as offsets from {{movies}} v left join
    (select source_id, count(*) as n, sum(size)::bigint as video_bytes, string_agg(digits, '' order by frame_no) as media, string_agg(printf('%08x', size), '' order by frame_no) as sizes, string_agg(printf('%08x', place), '' order by frame_no) as offsets
     from (select *, (36 + coalesce(sum(size) over (partition by source_id order by frame_no rows between unbounded preceding and 1 preceding), 0))::bigint as place from {_PACKETS}) group by source_id) p using (source_id))"""
_FILE = f"'{bytes([0, 0, 0, 20]).hex()}' || {_TEXT('ftypqt  ')} || '00000200' || {_TEXT('qt  ')} || '00000008' || {_TEXT('wide')} || {_32('video_bytes + 8')} || {_TEXT('mdat')} || media || {_MOOV}"
case(
    "mov_mux",
    _S + "frames long, bytes long, digest string, moov string",
    lambda t: _files(t).join(m.layouts(t("movies"), _packets(t).withColumn("size", F.octet_length("packet"))), "source_id").select("source_id", "frames", F.octet_length("content").alias("bytes"), F.md5("content").alias("digest"), F.md5("moov").alias("moov")),
    f"select source_id, n as frames, length(file) // 2 as bytes, md5(unhex(file)) as digest, md5(unhex(moov)) as moov from (select *, {_FILE} as file, {_MOOV} as moov from {_TABLES})",
)


def _cut(t):
    """Every fifth file ends within its moov."""
    return _files(t).withColumn("content", F.when(F.col("source_id") % 5 == 0, F.expr("substring(content, 1, octet_length(content) - 1 - cast(source_id % 600 as int))")).otherwise(F.col("content")))


# where each box stands: behind the moov's start, with the length of one without packets and what each packet adds to both
_INSIDE = [
    ("", 0, 672, 0, 8), ("/mvhd", 8, 108, 0, 0), ("/trak", 116, 527, 0, 8), ("/trak/tkhd", 124, 92, 0, 0), ("/trak/edts", 216, 36, 0, 0), ("/trak/edts/elst", 224, 28, 0, 0), ("/trak/mdia", 252, 391, 0, 8), ("/trak/mdia/mdhd", 260, 32, 0, 0),
    ("/trak/mdia/hdlr", 292, 45, 0, 0), ("/trak/mdia/minf", 337, 306, 0, 8), ("/trak/mdia/minf/vmhd", 345, 20, 0, 0), ("/trak/mdia/minf/hdlr", 365, 44, 0, 0), ("/trak/mdia/minf/dinf", 409, 36, 0, 0), ("/trak/mdia/minf/dinf/dref", 417, 28, 0, 0),
    ("/trak/mdia/minf/stbl", 445, 198, 0, 8), ("/trak/mdia/minf/stbl/stsd", 453, 102, 0, 0), ("/trak/mdia/minf/stbl/stts", 555, 24, 0, 0), ("/trak/mdia/minf/stbl/stsc", 579, 28, 0, 0), ("/trak/mdia/minf/stbl/stsz", 607, 20, 0, 4),
    ("/trak/mdia/minf/stbl/stco", 627, 16, 4, 4), ("/udta", 643, 29, 8, 0), ("/udta/\xa9swr", 651, 21, 8, 0),
]
_BOXES = f"""(with f as (select source_id, n, video_bytes, source_id % 5 = 0 as cut from {_TABLES}), inside(path, place, length, place_more, length_more) as (values {", ".join(map(str, _INSIDE))})
    select source_id, '/ftyp' as path, 0 as start, 20 as size, null as error from f union all select source_id, '/wide', 20, 8, null from f union all select source_id, '/mdat', 28, video_bytes + 8, null from f
    union all select source_id, '/moov' || path, 36 + video_bytes + place + n * place_more, length + n * length_more, if(cut, 'truncated', null) from f join inside on not cut or path = '')"""
case("atom_walk", _S + "path string, start long, size long, error string", lambda t: m.walk_boxes(_cut(t)), f"select * from {_BOXES}")
case("fourcc_probe", _S + "fourcc string", lambda t: m.probe_fourcc(_cut(t)), "select source_id, if(source_id % 5 = 0, null, fourcc) as fourcc from {movies}")


def _read_back(t):
    tables = m.sample_tables(m.walk_boxes(_files(t)))
    sizes = c.sample_sizes(tables["headers"], tables["table"])
    index = c.frame_index(sizes, tables["chunks"], tables["runs"], tables["deltas"], F.lit(1))
    dims = c.resolve_dims(tables["tracks"])
    return index.join(dims, "source_id").withColumn("pts", F.col("pts") / F.col("timescale"))


case(
    "demux_index",
    _S + "frame_no long, size long, file_offset long, pts double, fourcc string, w long, h long",
    _read_back,
    f"select p.source_id, frame_no, p.size, 36 + coalesce(sum(p.size) over (partition by p.source_id order by frame_no rows between unbounded preceding and 1 preceding), 0) as file_offset, frame_no * delta / timescale::double as pts, fourcc, w, h from {_PACKETS} p join {{movies}} v on v.source_id = p.source_id",
)
