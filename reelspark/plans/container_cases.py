"""Registered queries of container metadata, packets and muxing rules."""

from pyspark.sql import functions as F

from ..operators import container as c
from .fixtures import view
from .registry import case

_S = "source_id long, "
view("samples", "select source_id, frame_no, size from {packets_meta}")
view("chunks", "select source_id, frame_no div 3 + 1 as chunk, 36 + frame_no * 1000 as chunk_offset from {packets_meta} where frame_no % 3 = 0", "select source_id, frame_no // 3 + 1 as chunk, 36 + frame_no * 1000 as chunk_offset from {packets_meta} where frame_no % 3 = 0")
view("runs", "select source_id, chunk as first_chunk, case chunk when 1 then 1 + source_id % 4 when 3 then 4 else 1 end as per_chunk from {chunks} where chunk in (1, 3, 9)")
view("delta_runs", "select source_id, frame_no as nth, case frame_no when 1 then 0 else 4 + source_id % 6 end as n, 500 + frame_no * 6 as delta from {packets_meta} where frame_no < 3 and source_id % 7 <> 0")
view("size_headers", "select source_id, case when source_id % 3 = 0 then 512 else 0 end as constant, count(*) as n from {packets_meta} group by source_id")
_HEAD = """case event_id % 8 when 0 then '31545844' when 1 then '35545844' when 2 then '36474359' when 3 then '30314759' when 4 then '0a000040' when 5 then '0a000021' when 6 then 'ff00c382' else '0a0000f1' end"""
view("first_packets", f"select event_id as source_id, case when event_id % 8 < 4 or event_id % 8 = 6 then 'dxv3' else 'dxv1' end as generation, unhex(concat({_HEAD}, case when event_id % 5 = 0 then '0400' else '0400000000000000' end)) as head, case when event_id % 2 = 0 then 'dxt1' else 'dxt5' end as described from {{events}}")
view("headers", "select geom_id, name, case when geom_id % 4 = 0 then 0 else src_w end as stsd_w, case when geom_id % 6 = 0 then 0 else src_h end as stsd_h, dst_w * 65536 + geom_id % 65536 as tkhd_w, dst_h * 65536 + 7 as tkhd_h from {geom}")
view("contents", "select doc_id as source_id, cast(text as binary) as content from {documents}", "select doc_id as source_id, encode(text) as content from {documents}")
view("tracks", """select event_id, case when event_id % 5 = 0 then 0 else 30000 end as timescale, case event_id % 3 when 0 then 1001 when 1 then 1000 else 0 end as value, 25.0e0 as nominal, case when event_id % 4 = 0 then 0 else 44100 end as primary_rate, case when event_id % 3 = 0 then 48000 else 0 end as nominal_rate, event_id % 2 = 0 as has_pcm, event_id % 70 as channels,
     event_id * 977 % 96001 as rate, (event_id % 1000) / 8.0e0 as duration from {events}""")  # fmt: skip
view("flagged", "select stream_id, fourcc, case stream_id % 6 when 0 then true when 1 then false end as contains_alpha from {streams}")
view("dropped", "select page_id, concat(url, case page_id % 6 when 0 then '/clip.MOV' when 1 then '/a.mp4' when 2 then '/b.m4v' when 3 then '/c.png' when 4 then '/movie' else '/d.com' end) as path from {pages}")
view("rates", "select event_id, case event_id % 7 when 0 then 30.0e0 when 1 then 29.97e0 when 2 then 23.976e0 when 3 then 29.5e0 when 4 then 60.0e0 when 5 then 59.94e0 else 25.0000001e0 end as fps from {events}")
view("muxed", "select source_id, count(*) as frames, case source_id % 3 when 0 then 512 else 1001 end as delta, case source_id % 3 when 0 then 15360 else 30000 end as timescale, case when source_id % 2 = 0 then 2100 end as audio_ms, sum(size) * 130000 + source_id * 100000000 as video_bytes, case when source_id % 4 <> 0 then source_id * 1000 end as audio_bytes, 36 as first from {packets_meta} group by source_id")
view("encoders", "select event_id, case when event_id % 2 = 0 then 'quality' else 'bitrate' end as mode, (event_id % 101) / 100.0e0 as quality, (event_id % 50) / 4.0e0 as megabits, event_id % 30 as interval, case event_id % 3 when 0 then 'h264' when 1 then 'hevc' else 'mjpeg' end as codec, 'high' as profile from {events}".replace("interval", "gop"), None)

case("hap_filter", "stream_id long, fourcc string", lambda t: c.hap_streams(t("streams")), "select stream_id, fourcc from {streams} where fourcc like 'Hap_'")
case("route_reader", "stream_id long, fourcc string, reader string", lambda t: c.route_readers(t("streams")),
     "select stream_id, fourcc, case when fourcc in ('Hap1', 'Hap5', 'HapY', 'HapM') then 'hap' when fourcc in ('DXT1', 'DXT5', 'YCG6', 'YG10') or fourcc like 'DXD%' then 'dxv' else 'platform' end as reader from {streams}")
_INDEX = """(with r as (select *, lead(first_chunk) over (partition by source_id order by first_chunk) as next from {runs}),
    c as (select k.*, per_chunk, coalesce(sum(per_chunk) over (partition by k.source_id order by chunk rows between unbounded preceding and 1 preceding), 0) as first from {chunks} k join r on r.source_id = k.source_id and chunk >= first_chunk and (next is null or chunk < next)),
    e as (select source_id, delta, row_number() over (partition by source_id order by nth, i) - 1 as frame_no from (select *, unnest(range(n)) as i from {delta_runs})),
    l as (select source_id, max(frame_no) as last_no, arg_max(delta, frame_no) as last_delta from e group by source_id),
    d as (select s.source_id, s.frame_no, s.size, coalesce(e.delta, l.last_delta, 1) as delta from {samples} s left join e on e.source_id = s.source_id and e.frame_no = s.frame_no left join l on l.source_id = s.source_id)
    select d.source_id, d.frame_no, size, delta, chunk_offset + coalesce(sum(size) over (partition by d.source_id, chunk order by d.frame_no rows between unbounded preceding and 1 preceding), 0) as file_offset, coalesce(sum(delta) over (partition by d.source_id order by d.frame_no rows between unbounded preceding and 1 preceding), 0)::double / 15360 as pts
    from d join c on c.source_id = d.source_id and d.frame_no >= c.first and d.frame_no < c.first + c.per_chunk)"""


def _index(t):
    return c.frame_index(t("samples"), t("chunks"), t("runs"), t("delta_runs"), 15360)


case("frame_index", _S + "frame_no long, size long, file_offset long, pts double", _index, f"select * from {_INDEX}")
case("stts_expand", _S + "frame_no long, delta long", lambda t: c.expand_deltas(t("delta_runs")), "select source_id, row_number() over (partition by source_id order by nth, i) - 1 as frame_no, delta from (select *, unnest(range(n)) as i from {delta_runs})")
case("stsz_expand", _S + "frame_no long, size long", lambda t: c.sample_sizes(t("size_headers"), t("samples")), "select source_id, frame_no, if(source_id % 3 = 0, 512, size) as size from {packets_meta}")
case("movie_rate", _S + "frames long, duration double, fps double", lambda t: c.movie_rate(_index(t), 15360),
     f"select source_id, count(*) as frames, max(pts) + arg_max(delta, frame_no)::double / 15360 as duration, count(*) / (max(pts) + arg_max(delta, frame_no)::double / 15360) as fps from {_INDEX} group by source_id")
case("dims_resolve", "geom_id long, name string, w long, h long", lambda t: c.resolve_dims(t("headers")), "select geom_id, name, coalesce(nullif(stsd_w, 0), tkhd_w // 65536) as w, coalesce(nullif(stsd_h, 0), tkhd_h // 65536) as h from {headers}")
case(
    "packet_slice",
    "source_id long, idx long, file_offset long, expected long, actual long, packet string, short_read boolean",
    lambda t: c.read_packets(c.entries_covering(t("contents"), 256 + F.col("source_id") % 3), t("contents")).withColumn("packet", F.lower(F.hex("packet"))),
    """with d as (select source_id, 256 + source_id % 3 as size, lower(hex(coalesce(content, ''::blob))) as digits from {contents}), e as (select *, unnest(range(greatest(1, (length(digits) // 2 + size - 1) // size))) as idx from d)
       select source_id, idx, idx * size as file_offset, size as expected, length(substr(digits, 2 * idx * size + 1, 2 * size)) // 2 as actual, substr(digits, 2 * idx * size + 1, 2 * size) as packet, length(substr(digits, 2 * idx * size + 1, 2 * size)) < 2 * size as short_read from e""",
)
case("frame_count_est", "event_id long, frames long", lambda t: t("tracks").withColumn("frames", c.estimate_frames("duration", "nominal")), "select event_id, floor(duration * 25 + 0.5) as frames from {tracks}")
case("rational_fps", "event_id long, fps double", lambda t: c.rational_fps(t("tracks")), "select event_id, case when least(timescale, value) > 0 then timescale::double / value else 25.0 end as fps from {tracks}")
case("alpha_probe", "stream_id long, has_alpha boolean", lambda t: c.probe_alpha(t("flagged")),
     "select stream_id, case when contains_alpha is not null then contains_alpha when fourcc in ('ap4h', 'Hap5', 'HapM', 'HapA') then true when fourcc in ('apcn', 'HapY', 'Hap1') then false end as has_alpha from {flagged}")
case("audio_rate_resolve", "event_id long, channels_ok boolean, rate long, error string", lambda t: c.resolve_audio_rates(t("tracks").withColumnsRenamed({"nominal": "n", "primary_rate": "primary", "nominal_rate": "nominal"})),
     """with r as (select *, coalesce(nullif(primary_rate, 0), nullif(nominal_rate, 0), if(has_pcm, null, 48000)) as rate from {tracks} t(event_id, timescale, value, nominal, primary_rate, nominal_rate, has_pcm, channels, track_rate, duration))
        select event_id, channels > 0 and channels < 65 as channels_ok, rate, if(rate is null, 'unknown rate', null) as error from r""")  # fmt: skip
case("variant_peek", _S + "variant string, peeked boolean", lambda t: c.peek_variants(t("first_packets")),
     """with h as (select *, lower(hex(head)) as x from {first_packets}), p as (select *, case when generation = 'dxv3' then case when length(x) >= 24 then case left(x, 8) when '31545844' then 'dxt1' when '35545844' then 'dxt5' when '36474359' then 'ycg6' when '30314759' then 'yg10' end end
          when substr(x, 7, 1) in ('4', '5', '6', '7', 'c', 'd', 'e', 'f') then 'dxt5' when substr(x, 7, 1) in ('2', '3', 'a', 'b') or substr(x, 8, 1) = '2' then 'dxt1' end as found from h)
        select source_id, coalesce(found, described) as variant, found is not null as peeked from p""")  # fmt: skip
case("first_frame", _S + "frame_no long, size long", lambda t: c.first_frames(t("packets_meta").where("frame_no % 5 >= 2")), "select distinct on (source_id) source_id, frame_no, size from {packets_meta} where frame_no % 5 >= 2 order by source_id, frame_no")
case("movie_filter", "page_id long, path string", lambda t: c.movies(t("dropped")), "select page_id, path from {dropped} where page_id % 6 < 3")
case("movies_skipped", "dropped long, skipped long", lambda t: c.skipped_movies(t("dropped")), "select count(*) as dropped, count(*) filter (page_id % 6 >= 3) as skipped from {pages}")
case("stco_offsets", _S + "frame_no long, file_offset long", lambda t: c.stco_offsets(t("packets_meta")), "select a.source_id, a.frame_no, 36 + sum(a.size) over (partition by a.source_id order by a.frame_no) - a.size as file_offset from {packets_meta} a")
case("derive_timescale", "event_id long, timescale long, delta long, error string", lambda t: c.derive_timescale(t("rates")),
     "select event_id, case event_id % 7 when 0 then 15360 when 1 then 30000 when 2 then 24000 when 4 then 30720 when 6 then 12800 end as timescale, case event_id % 7 when 1 then 1001 when 2 then 1001 when 3 then null when 5 then null else 512 end as delta, if(event_id % 7 in (3, 5), 'unsupported rate', null) as error from {events}")
case("movie_duration_ms", _S + "video_ms long, ms long", lambda t: c.movie_durations(t("muxed")), "select source_id, frames * delta * 1000 // timescale as video_ms, case when audio_ms > frames * delta * 1000 // timescale then audio_ms else frames * delta * 1000 // timescale end as ms from {muxed}")
case("audio_entry_kind", "event_id long, entry string, layout string", lambda t: c.audio_entries(t("tracks").withColumn("channels", F.col("channels") % 5)), "select event_id, if(rate < 65536, 'in32', 'lpcm') as entry, case channels % 5 when 1 then 'mono' when 2 then 'stereo' else 'discrete' end as layout from {tracks}")
case("mux_guard", _S + "error string", lambda t: c.guard_muxes(t("muxed")),
     "select source_id, case when video_bytes + coalesce(audio_bytes, 0) > 4294967287 then 'mdat over 4 GB' when audio_bytes > 0 and video_bytes > 4294967259 then 'audio offset over 4 GB' end as error from {muxed}")
case("fourcc_guard", "stream_id long, fine boolean", lambda t: t("streams").withColumn("fine", c.valid_fourcc("fourcc")), "select stream_id, fourcc is not null and length(fourcc) = 4 and octet_length(encode(fourcc)) = 4 as fine from {streams}")
case("compression_props", "event_id long, quality double, bit_rate long, key_frame long, profile string", lambda t: c.compression_properties(t("encoders").withColumnRenamed("gop", "interval")),
     "select event_id, if(mode = 'quality', quality, null) as quality, if(mode = 'bitrate', (event_id % 50) * 250000, null) as bit_rate, nullif(gop, 0) as key_frame, if(codec = 'h264', profile, null) as profile from {encoders}")
case("densest_window", _S + "last_frame long, bytes long", lambda t: c.densest_window(t("packets_meta")),
     """with w as (select a.source_id, a.frame_no, sum(b.size) as bytes from {packets_meta} a join {packets_meta} b on b.source_id = a.source_id and b.frame_no between a.frame_no - 29 and a.frame_no where a.frame_no >= 29 group by all)
        select distinct on (source_id) source_id, frame_no as last_frame, bytes from w order by source_id, bytes desc, frame_no""")  # fmt: skip
