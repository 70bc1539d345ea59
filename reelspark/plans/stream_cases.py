"""Registered queries of byte streams, headers and token sizes."""

from pyspark.sql import functions as F

from ..operators import lzblocks
from ..operators import streams as s
from .container_cases import _S
from .fixtures import view
from .registry import case

view("keyed", "select source_id, frame_no as n, size div 90 as key from {packets_meta}", "select source_id, frame_no as n, size // 90 as key from {packets_meta}")
view("levels", "select frame_no, y * 8 + x as n, luma div 64 as v from {px_luma}", "select frame_no, y * 8 + x as n, luma // 64 as v from {px_luma}")
view("block_stream", "select source_id, 0 as channel, frame_no as n, hex(cast(size div 700 as string)) as v from {packets_meta}", "select source_id, 0 as channel, frame_no as n, hex((size // 700)::varchar) as v from {packets_meta}")
view("block_streams", "select * from {block_stream} union all select source_id, 1 as channel, frame_no as n, hex(cast(event_id * 11 % 50 div 40 as string)) as v from {packets_meta}", "select * from {block_stream} union all select source_id, 1 as channel, frame_no as n, hex((event_id * 11 % 50 // 40)::varchar) as v from {packets_meta}")
view("long_streams", "select case when event_id < 700 then 1 else 2 end as source_id, 0 as channel, event_id as n, case when event_id % 700 < 430 then 'a' else 'b' end as v from {events}")
view("op_rows", "select source_id as stream_id, frame_no as n, case when source_id % 3 = 0 then 3 else size % 4 end as op from {packets_meta} where source_id % 4 <> 1")
view("op_owners", "select distinct source_id as stream_id from {packets_meta}")
view("coded_frames", "select geom_id, name, (src_w + 15) div 16 * 16 as coded_w, (src_h + 15) div 16 * 16 as coded_h, geom_id % 2 = 0 as has_alpha from {geom}", "select geom_id, name, (src_w + 15) // 16 * 16 as coded_w, (src_h + 15) // 16 * 16 as coded_h, geom_id % 2 = 0 as has_alpha from {geom}")
_LE = "printf('%02x%02x%02x', {0} % 256, {0} {d} 256 % 256, {0} {d} 65536 % 256)"
_OLD = "select event_id, unhex(concat(" + _LE.format("event_id % 7", d="{d}") + ", printf('%02x', event_id * 37 % 256), '0102030405')) as data from {{events}} where event_id % 50 > 0 union all select event_id, unhex('0102') as data from {{events}} where event_id % 50 = 0"
view("old_packets", _OLD.format(d="div"), _OLD.format(d="//"))
_NEW = """select event_id, unhex(concat(case event_id % 5 when 0 then '31545844' when 1 then '35545844' when 2 then '36474359' when 3 then '30314759' else 'ff545844' end, '0400', case when event_id % 3 = 0 then '01' else '00' end, '00', """ + _LE.format("event_id % 12", d="{d}") + """, '00', case when event_id % 11 = 0 then '' else '00010203040506070809' end)) as data from {{events}} where event_id % 40 > 0
    union all select event_id, unhex('31545844040000') as data from {{events}} where event_id % 40 = 0"""  # fmt: skip
view("new_packets", _NEW.format(d="div"), _NEW.format(d="//"))
view("built", "select source_id, frame_no, case size % 3 when 0 then 'DXT1' when 1 then 'DXT5' else 'YG10' end as tag, size * 70001 as size, size % 2 = 0 as raw from {packets_meta}")
view("hq_parts", "select event_id, event_id % 2 = 0 as has_alpha, 1000 + event_id as tex_y, 500 + event_id * 3 as tex_c, event_id % 91 as enc_y, event_id % 17 as enc_a, event_id % 33 as enc_co, event_id % 29 as enc_cg from {events}")
view("tokens", "select event_id, 1 + event_id * 7 % 400 as n, case when event_id % 3 = 0 then 40000 else event_id * 31 % 2100 end as dist, case event_id % 5 when 0 then event_id % 70 + 1 when 1 then 250 + event_id % 10 when 2 then 65530 + event_id % 10 when 3 then 16777210 + event_id % 10 else event_id + 1 end as literal from {events}")
view("sections", "select source_id, frame_no, case when size % 9 = 0 then 0 else size * 40000 end as size, case size % 4 when 0 then 187 when 1 then 206 else 13 end as kind from {packets_meta}")
_SEC = """select event_id, unhex(concat(case event_id % 6 when 0 then '050000bb' when 1 then '000000ce03000000' when 2 then '000000bf0000' when 3 then 'ff0000af' when 4 then '0a' else '000000a1ff000000' end, case when event_id % 6 in (2, 4) then '' else '0102030405' end)) as data from {events}"""
view("section_bytes", _SEC)
view("chunked", "select source_id, frame_no, case when size % 7 = 0 then 0 else size % 50 end as blocks, 1 + frame_no % 8 as chunks from {packets_meta}")
view("kinds", "select event_id, event_id % 256 as kind from {events}")

_SF = "source_id long, frame_no long, "
case("lz_last_match", "source_id long, n long, key long, distance long", lambda t: s.last_matches(t("keyed"), "key", "source_id"),
     "select a.source_id, a.n, a.key, a.n - max(b.n) as distance from {keyed} a left join {keyed} b on b.source_id = a.source_id and b.key = a.key and b.n < a.n group by a.source_id, a.n, a.key")
case(
    "alpha_runs",
    "frame_no long, run long, start_at long, length long, value long",
    lambda t: s.runs(t("levels"), "v", "frame_no"),
    """with h as (select a.frame_no, a.n, a.v from {levels} a left join {levels} b on b.frame_no = a.frame_no and b.n = a.n - 1 where b.v is distinct from a.v)
       select frame_no, row_number() over (partition by frame_no order by n) as run, n as start_at, coalesce(lead(n) over (partition by frame_no order by n), 64) - n as length, v as value from h""",
)


def _ops(stream: str) -> str:
    return f"""with c as (select *, v is distinct from lag(v) over (partition by source_id, channel order by n) as new from {stream}), r as (select *, sum(new::int) over (partition by source_id, channel order by n) as run from c),
        g as (select source_id, channel, min(n) as first, count(*) - 1 as again from r group by source_id, channel, run),
        w as (select *, unnest(range(again // 258)) as k from g), z as (select *, again % 258 as rest, first + 1 + again // 258 * 258 as tail from g)
        select source_id, channel, first as block, 3 as op, 1 as covers, 8 as bytes from g where first > 0 union all select source_id, channel, first + 1 + 258 * k, 0, 258, 1 from w
        union all select source_id, channel, tail, 0, rest, 1 from z where rest > 3 union all select source_id, channel, tail + j, 1, 1, 0 from (select *, unnest(range(rest)) as j from z where rest < 4)"""


_OPS = "source_id long, channel long, block long, op long, covers long, bytes long"
case("cgo_ops", _OPS, lambda t: s.block_ops(t("block_stream"), "v", "source_id", "channel"), _ops("{block_stream}"))
case("cgo_ops2", _OPS, lambda t: s.block_ops(t("block_streams"), "v", "source_id", "channel"), _ops("{block_streams}"))
case("cgo_ops_long", _OPS, lambda t: s.block_ops(t("long_streams"), "v", "source_id", "channel"), _ops("{long_streams}"))
case("run_count_bytes", "event_id long, bytes string", lambda t: t("events").withColumn("bytes", s.run_bytes(F.col("event_id") * 37 % 200000)),
     """with r as (select event_id, event_id * 37 % 200000 as run from {events})
        select event_id, case when run < 255 then printf('%02x', run) else 'ff' || repeat('ffff', (run - 255) // 65535) || printf('%02x%02x', (run - 255) % 65535 % 256, (run - 255) % 65535 // 256) end as bytes from r""")  # fmt: skip
case("opcode_stream", "stream_id long, bytes string", lambda t: s.op_streams(t("op_owners"), t("op_rows")),
     """select o.stream_id, case when count(op) = 0 then '00' when min(op) = max(op) then printf('01%02x', min(op)) else '00' || string_agg(printf('%02x', op), '' order by n) end as bytes from {op_owners} o left join {op_rows} r on r.stream_id = o.stream_id group by o.stream_id""")  # fmt: skip
case("hq_budgets", "geom_id long, name string, tex_size long, ctex_size long, ops_y long, ops_co long, ops_cg long, ops_a long", lambda t: s.hq_budgets(t("coded_frames")),
     "select geom_id, name, coded_w * coded_h // 16 * if(has_alpha, 16, 8) as tex_size, coded_w * coded_h // 64 * 16 as ctex_size, coded_w * coded_h // 16 + 1 as ops_y, coded_w * coded_h // 32 + 1 as ops_co, coded_w * coded_h // 32 + 1 as ops_cg, coded_w * coded_h // 16 + 1 as ops_a from {coded_frames}")
case(
    "dxv1_tag",
    "event_id long, payload_size long, flags long, version long, format string, raw boolean, error string",
    lambda t: s.legacy_headers(t("old_packets")),
    """with k as (select event_id, event_id * 37 % 256 as kind, event_id % 50 = 0 as short from {events}), f as (select *, case when kind & 64 > 0 then 'dxt5' when kind & 32 > 0 or kind & 15 = 2 then 'dxt1' end as texture from k)
       select event_id, if(short, null, event_id % 7) as payload_size, if(short, null, kind - kind % 16) as flags, if(short, null, (kind % 16 + 255) % 256) as version, if(short, null, texture) as format, if(short, null, kind >= 128) as raw, case when short then 'too small' when texture is null then 'texture' when event_id % 7 > 5 then 'truncated' end as error from f""",
)
case(
    "dxv3_header",
    "event_id long, tag string, major long, minor long, raw_flag long, payload_size long, payload string, error string",
    lambda t: s.packet_headers(t("new_packets")).withColumn("payload", F.lower(F.hex("payload"))),
    """with k as (select event_id, event_id % 40 = 0 as short, event_id % 12 as size, if(event_id % 11 = 0, 0, 10) as have from {events})
       select event_id, if(short, null, ['DXT1', 'DXT5', 'YCG6', '01GY', ''][event_id % 5 + 1]) as tag, if(short, null, 4) as major, if(short, null, 0) as minor, if(short, null, (event_id % 3 = 0)::int) as raw_flag, if(short, null, size) as payload_size, if(short or size > have, null, left('00010203040506070809', (2 * size)::int)) as payload, case when short then 'too small' when size > have then 'truncated' end as error from k""".replace("'01GY'", "'YG10'"),
)
case("dxv3_build", _SF + "head string", lambda t: t("built").withColumn("head", s.packet_header("tag", "size", "raw")),
     "select source_id, frame_no, lower(hex(reverse(tag))) || '0400' || if(raw, '01', '00') || '00' || printf('%02x%02x%02x%02x', size & 255, (size >> 8) & 255, (size >> 16) & 255, size >> 24) as head from {built}")
case("hq_packet_layout", "event_id long, op_offset_y long, op_offset_c long, second_at long, payload long, packet long", lambda t: s.hq_layouts(t("hq_parts")),
     """with p as (select *, if(has_alpha, tex_y + enc_y + enc_a + 12, tex_y + enc_y + 8) as one from {hq_parts}) select event_id, tex_y + if(has_alpha, 12, 8) as op_offset_y, 12 + tex_c as op_offset_c, 12 + one as second_at, one + 12 + tex_c + enc_co + enc_cg as payload, one + 24 + tex_c + enc_co + enc_cg as packet from p""")  # fmt: skip
case(
    "snappy_token_cost",
    "event_id long, literal long, copy long",
    lambda t: t("tokens").select("event_id", s.literal_cost("literal").alias("literal"), s.copy_cost("n", "dist").alias("copy")),
    """with recursive w as (select distinct n, dist < 2048 as near, n as left_, 0 as bytes from {tokens} where n >= 4 and dist > 0
         union all select n, near, left_ - case when left_ >= 12 or not near then if(near and left_ > 64 and left_ < 68, 60, least(left_, 64)) else least(left_, 11) end, bytes + if(left_ >= 12 or not near, 3, 2) from w where left_ > 0)
       select t.event_id, literal + case when literal <= 60 then 1 when literal <= 256 then 2 when literal <= 65536 then 3 when literal <= 16777216 then 4 else 5 end as literal, w.bytes as copy from {tokens} t left join w on w.n = t.n and w.near = (t.dist < 2048) and w.left_ = 0 and t.dist > 0""",
)
case("hap_section", _SF + "head string", lambda t: t("sections").withColumn("head", s.section_header("size", "kind")),
     "select source_id, frame_no, if(size between 1 and 16777215, printf('%02x%02x%02x%02x', size % 256, size // 256 % 256, size // 65536, kind), printf('000000%02x%02x%02x%02x%02x', kind, size % 256, size // 256 % 256, size // 65536 % 256, size // 16777216)) as head from {sections}")
case("hap_section_parse", "event_id long, kind long, payload_at long, payload_size long, error string", lambda t: s.section_headers(t("section_bytes")),
     "select event_id, [187, 206, null, null, null, null][event_id % 6 + 1] as kind, [4, 8, null, null, null, null][event_id % 6 + 1] as payload_at, [5, 3, null, null, null, null][event_id % 6 + 1] as payload_size, [null, null, 'long head cut off', 'truncated', 'too small', 'truncated'][event_id % 6 + 1] as error from {events}")
case("hap_chunk_split", _SF + "chunk long, first_block long, n_blocks long", lambda t: s.chunk_split(t("chunked")),
     """with n as (select *, least(chunks, greatest(1, blocks)) as n from {chunked}), u as (select *, unnest(range(n)) as chunk from n)
        select source_id, frame_no, chunk, chunk * (blocks // n) as first_block, if(chunk + 1 = n, blocks - chunk * (blocks // n), blocks // n) as n_blocks from u""")  # fmt: skip
case("hap_dispatch", "event_id long, texture string, wrapping string, error string", lambda t: s.dispatch_sections(t("kinds")),
     """with d as (select * from (values (171, 'dxt1', 'raw'), (187, 'dxt1', 'snappy'), (203, 'dxt1', 'chunked'), (174, 'dxt5', 'raw'), (190, 'dxt5', 'snappy'), (206, 'dxt5', 'chunked'), (175, 'ycocg', 'raw'), (191, 'ycocg', 'snappy'), (207, 'ycocg', 'chunked'), (161, 'bc4', 'raw'), (177, 'bc4', 'snappy'), (193, 'bc4', 'chunked')) as t(kind, texture, wrapping))
        select event_id, texture, wrapping, if(texture is null, 'unsupported section', null) as error from {kinds} k left join d on d.kind = k.kind""")  # fmt: skip

# each user's events, and all of them as one long stream, as blocks whose parts come again at various distances


def _lz_rows(d: str) -> str:
    row = "select {id} as source_id, {n} as n, concat(printf('%016x', {n} {d} 3 % 4 + {n} % 1000 {d} 997), printf('%08x', event_id * 7 % {k} + event_id * 3 % 5), printf('%08x', event_id {d} 2 % {m})) as block from {rows}"
    return row.format(id="source_id", n="frame_no", d=d, k=3, m=2, rows="{packets_meta}") + " union all " + row.format(id="-1", n="event_id", d=d, k=450, m=40, rows="{events}")


view("lz_blocks", _lz_rows("div"), _lz_rows("//"))


def _lz(alpha: bool) -> str:
    """The stream in SQL: last equal parts by lag, runs as islands, operations numbered and packed."""
    back = lambda d, literal: f"case when {d} is null then {literal} when {d} >= 258 then printf('%02x%02x', ({d} - 258) % 256, ({d} - 258) // 256) when {d} >= 2 then printf('%02x', {d} - 2) else '' end"
    op = lambda d: f"case when {d} is null then 0 when {d} >= 258 then 3 when {d} >= 2 then 2 else 1 end"
    far = lambda c: f"case when n - lag(n) over (partition by source_id, {c} order by n) <= 65793 then n - lag(n) over (partition by source_id, {c} order by n) end as d_{c}"
    runs = "case when run < 255 then printf('%02x', run) else 'ff' || repeat('ffff', (run - 255) // 65535) || printf('%02x%02x', (run - 255) % 65535 % 256, (run - 255) % 65535 // 256) end"
    alphas = f"""select source_id, n, 0 as k, 1 as op, {runs} as operand from (select source_id, n, len - 2 as run from i where place = 2)
        union all select source_id, n, 0, case when d_alpha <= 65537 then 2 else 3 end, case when d_alpha <= 65537 then printf('%02x%02x', (d_alpha - 2) % 256, (d_alpha - 2) // 256) else alpha end from i where place = 1 and n > 0 union all """
    return f"""with b as (select source_id, n, block[1:16] as alpha, block[{17 if alpha else 1}:{32 if alpha else 16}] as colour, block[{17 if alpha else 1}:{24 if alpha else 8}] as ends, block[{25 if alpha else 9}:{32 if alpha else 16}] as codes, block from {{lz}}),
        d as (select *, {far("alpha")}, {far("colour")}, {far("ends")}, {far("codes")}, (alpha is distinct from lag(alpha) over (partition by source_id order by n))::int as new from b),
        r as (select *, sum(new) over (partition by source_id order by n) as island from d), i as (select *, count(*) over (partition by source_id, island) as len, row_number() over (partition by source_id, island order by n) as place from r),
        o as ({alphas if alpha else ""} select source_id, n, 1 as k, {op("d_colour")} as op, {back("d_colour", "''")} as operand from i where n > 0
            union all select source_id, n, 2, {op("d_ends")}, {back("d_ends", "ends")} from i where n > 0 and d_colour is null union all select source_id, n, 3, {op("d_codes")}, {back("d_codes", "codes")} from i where n > 0 and d_colour is null),
        s as (select *, row_number() over (partition by source_id order by n, k) - 1 as seq from o),
        w as (select source_id, seq // 16 as word, sum(op * 4 ** (seq % 16))::bigint as bits, string_agg(operand, '' order by seq) as operands from s group by all),
        t as (select source_id, string_agg(printf('%02x%02x%02x%02x', bits % 256, bits // 256 % 256, bits // 65536 % 256, bits // 16777216) || operands, '' order by word) as words from w group by source_id)
        select b.source_id, b.block || coalesce(words, '') as data from b left join t on t.source_id = b.source_id where n = 0"""


view("lz_colours", "select source_id, n, substring(block, 17) as block from {lz_blocks}", "select source_id, n, block[17:] as block from {lz_blocks}")
case("dxt1_lz", "source_id long, data string", lambda t: lzblocks.encode_stream(t("lz_colours"), "source_id"), _lz(False).replace("{lz}", "{lz_colours}"))
case("dxt5_lz", "source_id long, data string", lambda t: lzblocks.encode_stream(t("lz_blocks"), "source_id", alpha=True), _lz(True).replace("{lz}", "{lz_blocks}"))

view(
    "block_frames",
    "select source_id, unhex(rpad(hex(content), cast(ceil(octet_length(content) / 8.0) * 16 as int), '0')) as blocks, 8 as block_size, 2 + source_id % 7 as chunks from {contents} where content is not null",
    "select source_id, unhex(rpad(hex(content), (ceil(octet_length(content) / 8.0) * 16)::int, '0')) as blocks, 8 as block_size, 2 + source_id % 7 as chunks from {contents} where content is not null",
)
_CHUNKED = """(select *, least(chunks, greatest(1, size // 8)) as n, size // 8 // least(chunks, greatest(1, size // 8)) * 8 as share from (select *, octet_length(blocks) as size from {block_frames}))"""
_SECTION_HEAD = lambda v, kind: f"case when {v} between 1 and 16777215 then printf('%02x%02x%02x{kind:02x}', {v} % 256, {v} // 256 % 256, {v} // 65536) else printf('000000{kind:02x}%02x%02x%02x%02x', {v} % 256, {v} // 256 % 256, {v} // 65536 % 256, {v} // 16777216) end"
_CHUNK_SIZES = "list_transform(range(n), lambda k: if(k < n - 1, share, size - (n - 1) * share))"
case(
    "hap_chunked",
    _S + "n long, bytes long, digest string, start string",
    lambda t: s.chunked_sections(t("block_frames")).select("source_id", F.least("chunks", F.greatest(F.lit(1), F.expr("octet_length(blocks) div 8"))).alias("n"), F.octet_length("section").alias("bytes"), F.md5("section").alias("digest"), F.lower(F.hex(F.expr("substring(section, 1, 40)"))).alias("start")),
    f"""with t as (select *, {_SECTION_HEAD("n", 2)} || repeat('0a', n) || {_SECTION_HEAD("n * 4", 3)} || array_to_string(list_transform({_CHUNK_SIZES}, lambda v: printf('%02x%02x%02x%02x', v::bigint % 256, v::bigint // 256 % 256, v::bigint // 65536 % 256, v::bigint // 16777216)), '') as tab from {_CHUNKED}),
       i as (select *, {_SECTION_HEAD("(length(tab) // 2)", 1)} || tab || lower(hex(blocks)) as inside from t), o as (select *, {_SECTION_HEAD("(length(inside) // 2)", 0xCB)} || inside as section from i)
       select source_id, n, length(section) // 2 as bytes, md5(unhex(section)) as digest, section[1:80] as start from o""",
)


def _read_chunks(t):
    # kept once, as a file of sections would be; else each byte that is read would build its section again
    written = s.section_headers(s.chunked_sections(t("block_frames")).select("source_id", F.col("section").alias("data")).persist())
    read = s.chunk_tables(written.select("source_id", F.expr("substring(data, payload_at + 1)").alias("payload")).persist())
    return read.select("source_id", "payload", F.inline("chunks")).select("source_id", "chunk", "packing", "size", F.md5(F.expr("substring(payload, cast(file_offset as int) + 1, cast(size as int))")).alias("digest"))


case(
    "hap_chunk_tables",
    _S + "chunk long, packing string, size long, digest string",
    _read_chunks,
    f"select source_id, k as chunk, 'raw' as packing, sizes[k + 1] as size, md5(unhex(hex(blocks)[2 * k * share + 1:2 * (k * share + sizes[k + 1])])) as digest from (select *, {_CHUNK_SIZES} as sizes, unnest(range(n)) as k from {_CHUNKED})",
)
