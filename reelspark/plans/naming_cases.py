"""Registered queries of names, parsers, jobs and the queue."""

from pyspark.sql import functions as F

from ..operators import naming as n
from ..operators import queue as q
from .fixtures import view
from .registry import case

_CODECS = ("dxt1", "dxt5", "ycg6", "yg10", "hap1", "hap5", "hapy", "hapa", "hapm", "prores422", "prores422hq", "prores422lt", "prores422proxy", "prores4444", "h264", "hevc", "mjpeg")
_CODEC = "case event_id % 17 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_CODECS)) + " end"

view(
    "name_jobs",
    f"""select event_id as job_id, concat('/clips/set ', cast(event_id % 5 as varchar(9)), '/', case event_id % 4 when 0 then 'Clip' when 1 then 'a.b' when 2 then '.hidden' else 'take_2' end, case event_id % 6 when 0 then '' when 1 then '.' else '.mov' end) as path,
              {_CODEC} as codec, case when event_id % 17 in (14, 15) and event_id % 2 = 0 then 'mp4' else 'mov' end as container, case when event_id % 3 = 0 then null else event_id * 7 % 2000 end as in_frame, case when event_id % 4 = 0 then null else event_id * 13 % 2500 end as out_frame,
              case event_id % 5 when 0 then 24.0e0 when 1 then 30.0e0 when 2 then 29.97e0 when 3 then 0.0e0 else 59.94e0 end as fps, case when event_id % 6 = 0 then 0 when event_id % 6 = 1 then null else 2400 end as total,
              case when event_id % 7 = 0 then 640.5e0 when event_id % 7 = 1 then 1279.4e0 end as crop_w, case when event_id % 7 < 2 then 360.0e0 end as crop_h, case when event_id % 2 = 0 then 'time' else 'frames' end as trim_format from {{events}}""",
)
view("frames_at", "select event_id, event_id * 7919 % 300000 - 10 as frame, case event_id % 6 when 0 then 24.0e0 when 1 then 29.97e0 when 2 then 59.94e0 when 3 then 0.3e0 when 4 then 0.0e0 else 30.0e0 end as fps from {events}")
view(
    "codes",
    """select event_id, fps, concat(case when event_id % 11 = 0 then '  ' when event_id % 13 = 0 then '+' when event_id % 17 = 0 then '-' else '' end, cast(event_id % 30 as varchar(9)), ':', cast(event_id % 70 as varchar(9)), case when event_id % 9 = 0 then ': ' else ':' end, cast(event_id % 65 as varchar(9)),
         case when event_id % 10 = 0 then '' else concat(':', cast(event_id % 61 as varchar(9))) end) as text, case when event_id % 3 = 0 then 100 else 20000000 end as total from {frames_at}""",
)
view(
    "files",
    """select '/out' as dir, concat(source, case doc_id % 7 when 0 then '.mov' when 1 then '_take.mov' when 2 then '_02.mov' when 3 then concat('_', cast(doc_id % 90 as varchar(9)), '.mov') when 4 then '' when 5 then '_99999999999999999999.mov' else concat('_', cast(doc_id % 40 as varchar(9))) end) as name from {documents} where doc_id % 3 < 2""",
)
view("wanted", "select distinct '/out' as dir, source as stem, ext from {documents} cross join (values ('mov'), (''), ('mp4')) as t(ext)")
view(
    "request_args",
    f"""select event_id, case when event_id % 23 = 0 then 'vp9' else upper({_CODEC}) end as codec, case event_id % 5 when 0 then 'mp4' when 1 then 'MOV' when 2 then 'avi' else 'mov' end as container, event_id % 70 as chunks,
              case when event_id % 4 < 2 then event_id % 1000 - 5 end as width, case when event_id % 4 in (1, 2) then event_id % 700 - 5 end as height,
              case event_id % 6 when 0 then null when 1 then '1:2:x:4' when 2 then '1::2:3:4' when 3 then '1:2:3' else concat(cast(event_id % 9 as varchar(9)), ':-2:+3:', cast(event_id % 7 as varchar(9))) end as crop,
              case event_id % 5 when 0 then null when 1 then '5:3' when 2 then '-1:7' when 3 then concat(cast(event_id % 50 as varchar(9)), ':', cast(event_id % 97 as varchar(9))) else ':4:9' end as trim from {{events}}""",
)
view("badges", """select geom_id, name, geom_id % 2 = 0 as editing, case when geom_id % 3 <> 0 then 1 end as shown, src_w + (case when geom_id % 4 = 0 then 0.5e0 else 0.25e0 end) as w, src_h + 0.0e0 as h, geom_id % 100 + 0.5e0 as x, geom_id % 70 + 0.0e0 as y from {geom}""")
view("job_events", "select user_id as job_id, event_id as seq, case event_id * 7 % 13 when 0 then 'cancel' when 1 then 'finish' when 2 then 'fail' when 3 then 'start' when 4 then 'start' else 'queue' end as kind from {events}")
view(
    "collisions",
    """select o_custkey as session_id, o_orderkey as position, o_orderkey % 3 < 2 as taken, case o_orderkey % 4 when 0 then 'overwrite' when 1 then 'rename' else 'ask' end as policy, case o_orderkey * 7 % 11 when 0 then 'cancel' when 1 then 'skip' when 2 then 'rename' else 'overwrite' end as decision, o_orderkey % 5 = 0 as for_all from {orders}""".replace("o_custkey", "o_orderkey % 40").replace("as position", "as position"),
)
view("formats", "select event_id, case event_id % 5 when 0 then 'normal' when 1 then 'hq' when 2 then 'hap' when 3 then 'hap_q' end as tier, event_id % 2 = 0 as alpha, case event_id % 10 when 0 then 'dxt1' when 1 then 'dxt5' when 2 then 'ycg6' when 3 then 'yg10' when 4 then 'hap1' when 5 then 'hap5' when 6 then 'hapy' when 7 then 'hapa' when 8 then 'hapm' end as format from {events}")
view("prores", "select event_id, case event_id % 3 when 0 then true when 1 then false end as has_alpha, format, case event_id % 7 when 0 then null when 1 then 'ap4h' when 2 then 'apch' else 'apcn' end as variant from {formats}")
view("sounds", "select event_id, case event_id % 3 when 0 then 48000 when 1 then 96000 end as requested, case event_id % 2 when 0 then 44100 else 192000 end as source_rate, case when event_id % 5 < 2 then 'mp4' else 'mov' end as container from {events}")
view("held_presets", "select min(doc_id) as id, source as name, 640 as width, 360 as height from {documents} group by source")
view("fresh_presets", "select doc_id as id, concat(case when doc_id % 3 = 0 then '  ' else '' end, case doc_id % 4 when 0 then upper(source) when 1 then source when 2 then concat(source, ' ', lang) else '' end, case when doc_id % 5 = 0 then ' ' else '' end) as name, 16 + doc_id % 400 as width, 16 + doc_id % 300 as height, doc_id as seq from {documents}")
view("queue_jobs", "select job_id, status, job_id as position, priority as queue_id, case when job_id % 3 = 0 then 640 end as width, case when job_id % 3 < 2 then 360 end as height, case when job_id % 4 = 0 then 24.0e0 end as fps, cast(null as bigint) as frame_count from {jobs}")
view("probes", "select job_id, 1920 as width, 1080 as height, 25.0e0 as fps, 100 + job_id % 50 as frame_count, case job_id % 7 when 0 then 'empty' when 1 then 'gone' end as error, job_id % 7 = 0 as typed from {jobs} where job_id % 5 <> 0")
view("edits", "select event_id, case when event_id % 4 = 0 then null else event_id % 100 end as in_frame, case when event_id % 5 = 0 then null else event_id * 3 % 120 end as out_frame, event_id * 7 % 130 as current, case event_id % 3 when 0 then 'set_in' when 1 then 'set_out' else case when event_id % 2 = 0 then 'clear' else 'none' end end as action, 120 as total, event_id % 2 = 0 as playing, event_id % 6 < 3 as looping from {events}")
view("ticks", "select user_id as player_id, event_id as seq, (event_id * 13 % 1100) / 100.0e0 as time, 10.0e0 as duration, case user_id % 3 when 0 then 24.0e0 when 1 then 0.0e0 else 29.97e0 end as fps, 240 as total, user_id % 2 = 0 as looping from {events}")
view("opened", "select user_id as session_id, event_id as seq from {events}")
view("receivers", "select distinct user_id as session_id, 300 + user_id % 400 as installed_at from {events} where user_id % 6 <> 0")
view("renames", "select event_id, case event_id % 5 when 0 then '  ' when 1 then ' clip ' when 2 then 'take' when 3 then chr(10) else 'take ' end as text, case when event_id % 2 = 0 then 'take' else 'clip' end as current from {events}")


def _time(frame: str, fps: str, pattern: str, unknown: str) -> str:
    total = f"greatest(0.0, ({frame})::double / {fps})"
    minutes = f"(trunc({total})::bigint // 60)"
    part = f"({total} - ({minutes} * 60)::double)"
    return f"case when {fps} > 0 then printf('{pattern}', {minutes}, trunc({part})::bigint, trunc(({part} - trunc({part})) * 100)::bigint) else '{unknown}' end"


_DOTS = "%02d.%02d.%02d"
_TOKEN = "case codec " + " ".join(f"when '{c}' then '{t}'" for c, t in n.CODEC_TOKENS.items()) + " end"
case("path_parts", "job_id long, dir string, stem string, ext string", lambda t: n.path_parts(t("name_jobs")),
     """with p as (select job_id, list_last(string_split(path, '/')) as name, left(path, length(path) - length(list_last(string_split(path, '/'))) - 1) as dir from {name_jobs}),
        d as (select *, length(name) - strpos(reverse(name), '.') + 1 as dot from p)
        select job_id, dir, case when strpos(name, '.') = 0 or dot <= 1 or dot = length(name) then name else left(name, dot - 1) end as stem, case when strpos(name, '.') = 0 or dot <= 1 or dot = length(name) then '' else substr(name, dot + 1) end as ext from d""")  # fmt: skip
case("format_mmsscc", "event_id long, label string", lambda t: t("frames_at").withColumn("label", n.mmsscc("frame", "fps")), f"select event_id, {_time('frame', 'fps', _DOTS, '00.00.00')} as label from {{frames_at}}")
case(
    "auto_name",
    "job_id long, name string",
    lambda t: n.auto_name(t("name_jobs")),
    f"""with e as (select *, coalesce(in_frame, 0) as lo, case when out_frame is not null then out_frame when total > 0 then total - 1 else coalesce(in_frame, 0) end as hi from {{name_jobs}}),
        s as (select *, least(lo, hi) as a, greatest(lo, hi) as b, regexp_replace(list_last(string_split(path, '/')), '(.)[.][^.]+$', '\\1') as stem from e)
        select job_id, stem || '_' || {_TOKEN} || case when crop_w is null then '' else ' [' || round(crop_w)::bigint || 'x' || round(crop_h)::bigint || ']' end
          || case when in_frame is null and out_frame is null then '' when trim_format = 'frames' then ' [' || a || '-' || b || ']' else ' [' || {_time("a", "fps", _DOTS, "00.00.00")} || '-' || {_time("b", "fps", _DOTS, "00.00.00")} || ']' end || '.' || container as name from s""",
)
case(
    "collision_free_name",
    "dir string, stem string, ext string, name string",
    lambda t: n.collision_free(t("wanted"), t("files")),
    """with w as (select *, stem || case when ext = '' then '' else '.' || ext end as base from {wanted}),
       m as (select w.dir, w.stem, w.ext, max(try_cast(substr(name, length(w.stem) + 2, length(name) - length(base) - 1) as bigint)) as top from w join {files} f on f.dir = w.dir and starts_with(name, w.stem || '_') and ends_with(name, case when ext = '' then '' else '.' || ext end)
              and regexp_full_match(substr(name, length(w.stem) + 2, length(name) - length(base) - 1), '[0-9]+') group by all)
       select w.dir, w.stem, w.ext, case when base in (select name from {files}) then w.stem || '_' || (greatest(1, coalesce(top, 1)) + 1) || case when w.ext = '' then '' else '.' || w.ext end else base end as name from w left join m on m.stem = w.stem and m.ext = w.ext""",
)
case("timecode_format", "event_id long, timecode string", lambda t: t("frames_at").withColumn("timecode", n.timecode("frame", "fps")),
     """with f as (select event_id, fps, greatest(frame, 0) as f, greatest(1, round(fps)::bigint) as r from {frames_at})
        select event_id, case when fps > 0 then printf('%02d:%02d:%02d:%02d', f // (r * 3600), f // (r * 60) % 60, f // r % 60, f % r) else '—:—:—:—' end as timecode from f""")  # fmt: skip
_PARSED = """(select event_id, fps, total, string_split(trim(text), ':') as p, case when fps > 0 and len(string_split(trim(text), ':')) = 4 and len(list_filter(string_split(trim(text), ':'), lambda x: not regexp_full_match(x, '[+]?[0-9]+|-0+'))) = 0
    then (p[1]::bigint * 3600 + p[2]::bigint * 60 + p[3]::bigint) * greatest(1, round(fps)::bigint) + p[4]::bigint end as frame from {codes})"""
case("timecode_parse", "event_id long, frame long", lambda t: t("codes").withColumn("frame", n.frame_of_timecode("text", "fps")), f"select event_id, frame from {_PARSED}")
case("timecode_commit", "event_id long, frame long, error string", lambda t: q.commit_timecodes(t("codes")),
     f"select event_id, case when frame < total then frame end as frame, case when fps <= 0 then 'rate' when frame is null then 'format' when frame >= total then 'range' end as error from {_PARSED}")
case(
    "crop_badge",
    "geom_id long, name string, badge string",
    lambda t: n.crop_badge(t("badges").withColumn("pending", F.when(F.col("shown") == 1, F.struct("x", "y", "w", "h"))).withColumn("committed", F.col("pending"))),
    """select geom_id, name, case when editing and shown is null then '—  (no crop yet)' when shown is null then '—  (no crop)' when editing then round(w)::bigint || 'x' || round(h)::bigint || ' @ (' || round(x)::bigint || ', ' || round(y)::bigint || ')' else round(w)::bigint || 'x' || round(h)::bigint end as badge from {badges}""",
)
_COLON = "%02d:%02d.%02d"
case(
    "card_time",
    "job_id long, card string",
    lambda t: n.card_time(t("name_jobs")),
    f"""select job_id, case when in_frame is null and out_frame is null then '—  (full clip)' when trim_format = 'frames' then 'frame ' || coalesce(in_frame, 0) || ' → ' || coalesce(out_frame::varchar, 'end')
          else coalesce(case when in_frame is not null then {_time("in_frame", "fps", _COLON, "?")} end, 'start') || ' → ' || coalesce(case when out_frame is not null then {_time("out_frame", "fps", _COLON, "?")} end, 'end') end as card from {{name_jobs}}""",
)
case(
    "parse_request",
    "event_id long, codec string, container string, crop_x long, crop_y long, crop_w long, crop_h long, lo long, hi long, error string",
    lambda t: n.parse_requests(t("request_args")),
    """with p as (select event_id, lower(codec) as codec, lower(container) as container, chunks, width, height, crop, trim, list_filter(string_split(crop, ':'), lambda x: x <> '') as c, list_filter(string_split(trim, ':'), lambda x: x <> '') as r from {request_args}),
       v as (select *, case when len(c) = 4 and len(list_filter(c, lambda x: try_cast(x as bigint) is null)) = 0 then list_transform(c, lambda x: x::bigint) end as cv, case when len(r) = 2 and try_cast(r[1] as bigint) >= 0 and try_cast(r[2] as bigint) > try_cast(r[1] as bigint) then [r[1]::bigint, r[2]::bigint] end as rv from p)
       select event_id, codec, container, cv[1] as crop_x, cv[2] as crop_y, cv[3] as crop_w, cv[4] as crop_h, rv[1] as lo, rv[2] as hi,
         case when codec = 'vp9' then 'codec' when container = 'avi' or (container = 'mp4' and codec not in ('h264', 'hevc')) then 'container' when chunks < 1 or chunks > 64 then 'chunks' when (width is null) <> (height is null) or least(width, height) <= 0 then 'size' when crop is not null and cv is null then 'crop' when trim is not null and rv is null then 'trim' end as error from v""",
)
case(
    "enqueue_jobs",
    "page_id long, url string, position long, format string, audio boolean, chunks long, status string",
    lambda t: q.enqueue(t("pages").withColumn("queue_id", F.col("page_id") % 4), 3, order="page_id", format="dxt1", audio=True, chunks=1),
    "select page_id, url, (select count(*) from {pages} b where b.page_id % 4 = a.page_id % 4 and b.page_id < a.page_id) + 3 as position, 'dxt1' as format, true as audio, 1 as chunks, 'queued' as status from {pages} a",
)
case(
    "job_state",
    "job_id long, status string, error string",
    lambda t: q.job_states(t("job_events")),
    """with f as (select job_id, min(seq) as seq from {job_events} where kind in ('finish', 'fail', 'cancel') group by job_id)
       select j.job_id, case when e.kind = 'finish' then 'done' when e.kind is not null then 'failed' when j.job_id in (select job_id from {job_events} where kind = 'start') then 'encoding' else 'queued' end as status, if(e.kind = 'cancel', 'Cancelled', null) as error
       from (select distinct job_id from {job_events}) j left join f on f.job_id = j.job_id left join {job_events} e on e.seq = f.seq""",
)
case(
    "collision_decision",
    "session_id long, position long, action string",
    lambda t: q.collision_actions(t("collisions")),
    """with h as (select session_id, min(position) as held_from from {collisions} where taken and policy = 'ask' and for_all and decision <> 'cancel' group by session_id),
       c as (select c.*, if(c.position > h.held_from, d.decision, null) as held from {collisions} c left join h on h.session_id = c.session_id left join {collisions} d on d.session_id = h.session_id and d.position = h.held_from),
       x as (select session_id, min(position) as over_from from c where taken and policy = 'ask' and held is null and decision = 'cancel' group by session_id)
       select c.session_id, c.position, case when c.position > x.over_from then 'not_run' when not taken then 'proceed' else case coalesce(held, if(policy = 'ask', decision, policy)) when 'overwrite' then 'proceed' else coalesce(held, if(policy = 'ask', decision, policy)) end end as action
       from c left join x on x.session_id = c.session_id""",
)
case(
    "tier_alpha_format",
    "event_id long, picked string, tier_back string, alpha_back boolean",
    lambda t: t("formats").withColumns({"picked": q.format_of("tier", "alpha"), "tier_back": q.lookup(q.TIERS, "format"), "alpha_back": q.lookup(q.ALPHA, "format")}),
    """with d as (select * from (values ('dxt1', 'normal', false), ('dxt5', 'normal', true), ('ycg6', 'hq', false), ('yg10', 'hq', true), ('hap1', 'hap', false), ('hap5', 'hap', true), ('hapy', 'hap_q', false), ('hapm', 'hap_q', true), ('hapa', 'hap', true)) as t(f, t, a))
       select event_id, p.f as picked, b.t as tier_back, b.a as alpha_back from {formats} e left join d p on p.t = e.tier and p.a = e.alpha and p.f <> 'hapa' left join d b on b.f = e.format""",
)
case("prores_steer", "event_id long, steered string, flattens boolean", lambda t: q.steer_prores(t("prores")),
     """with a as (select *, coalesce(has_alpha, format in ('dxt5', 'yg10', 'hap5', 'hapa', 'hapm')) as alpha from {prores}) select event_id, if(alpha, 'ap4h', 'apcn') as steered, coalesce(alpha and variant in ('apcn', 'apch'), false) as flattens from a""")  # fmt: skip
case("audio_clamp", "event_id long, rate long, warned boolean", lambda t: q.clamp_audio(t("sounds")),
     "select event_id, case when container = 'mp4' and coalesce(requested, source_rate) > 48000 then 48000 else coalesce(requested, source_rate) end as rate, container = 'mp4' and coalesce(requested, source_rate) > 48000 as warned from {sounds}")
case(
    "preset_upsert",
    "id long, name string, width long, height long",
    lambda t: q.upsert_presets(t("held_presets"), t("fresh_presets")),
    """with f as (select id, trim(name) as name, width, height, seq from {fresh_presets} where trim(name) <> ''), k as (select lower(name) as k, min(seq) as first_seq, max(seq) as last_seq from f group by all), h as (select *, lower(trim(name)) as k from {held_presets})
       select coalesce(h.id, a.id) as id, coalesce(z.name, h.name) as name, coalesce(z.width, h.width) as width, coalesce(z.height, h.height) as height from h full outer join k on k.k = h.k left join f a on a.seq = k.first_seq left join f z on z.seq = k.last_seq""",
)
case("preset_delete", "id long, name string", lambda t: q.remove_presets(t("held_presets"), t("fresh_presets").where("id % 2 = 0")), "select id, name from {held_presets} where id % 2 <> 0")
case("select_after_remove", "job_id long, selected long", lambda t: q.selected_after_removal(t("queue_jobs")),
     "select job_id, coalesce((select min(b.job_id) from {queue_jobs} b where b.queue_id = a.queue_id and b.position > a.position), (select max(b.job_id) from {queue_jobs} b where b.queue_id = a.queue_id and b.position < a.position)) as selected from {queue_jobs} a")
case(
    "probe_merge",
    "job_id long, width long, height long, fps double, frame_count long, status string, message string",
    lambda t: q.merge_probes(t("queue_jobs"), t("probes")),
    """select j.job_id, if(error is null, coalesce(j.width, p.width), j.width) as width, if(error is null, coalesce(j.height, p.height), j.height) as height, if(error is null, coalesce(j.fps, p.fps), j.fps) as fps, if(error is null, coalesce(j.frame_count, p.frame_count), j.frame_count) as frame_count,
         if(error = 'empty', 'failed', status) as status, if(error = 'empty', 'Unusable source: empty', null) as message from {queue_jobs} j left join {probes} p on p.job_id = j.job_id""",
)
case("trim_marker", "event_id long, in_frame long, out_frame long", lambda t: q.edit_trim(t("edits")),
     """select event_id, case action when 'set_in' then current when 'set_out' then if(in_frame is null, null, least(in_frame, current)) when 'none' then in_frame end as in_frame, case action when 'set_out' then current when 'set_in' then if(out_frame is null, null, greatest(out_frame, current)) when 'none' then out_frame end as out_frame from {edits}""")  # fmt: skip
case("trim_playhead", "event_id long, seek long, paused boolean", lambda t: q.snap_playhead(t("edits")),
     """with b as (select *, case when in_frame is null and out_frame is null then 'in' when current > coalesce(out_frame, 119) then 'beyond' when current < coalesce(in_frame, 0) then 'before' else 'in' end as place from {edits})
        select event_id, case when place = 'in' then null when place = 'beyond' and playing and not looping then least(119, coalesce(out_frame, 119)) else least(119, coalesce(in_frame, 0)) end as seek, place = 'beyond' and playing and not looping as paused from b""")  # fmt: skip
case(
    "scrub_map",
    "event_id long, frame long, x double",
    lambda t: t("events").withColumns({"total": (F.col("event_id") % 300).cast("long"), "at": F.col("event_id") % 1100 - 50.0}).select("event_id", q.frame_at_x("at", F.lit(1000.0), "total").alias("frame"), q.x_of_frame(F.col("event_id") % 400, F.lit(1000.0), "total").alias("x")),
    """with e as (select event_id, event_id % 300 as total, least(1000.0, greatest(0.0, event_id % 1100 - 50.0))::double / 1000 as share from {events})
       select event_id, if(total > 1, round(share * (total - 1)), 0) as frame, if(total > 1, least(1.0, (event_id % 400)::double / (total - 1)) * 1000, 0.0) as x from e""",
)
case("checker_parity", "frame_no long, y long, x long, dark boolean", lambda t: t("px_luma").withColumn("dark", q.checker_dark("x", "y", 3)), "select frame_no, y, x, (x // 3) & 1 = (y // 3) & 1 as dark from {px_luma}")
case(
    "audio_master_frame",
    "player_id long, seq long, frame long",
    lambda t: q.audio_master_frames(t("ticks")),
    """with f as (select player_id, seq, case when not looping and time >= duration - 0.5::double / fps then 239 else least(239, greatest(0, round(time * fps)::bigint)) end as frame from {ticks} where fps > 0),
       n as (select *, row_number() over (partition by player_id order by seq) as n from f) select a.player_id, a.seq, a.frame from n a left join n b on b.player_id = a.player_id and b.n = a.n - 1 where b.frame is distinct from a.frame""",
)
case(
    "buffered_open",
    "session_id long, seq long, delivered_at long, nth long",
    lambda t: q.deliver_opened(t("opened"), t("receivers")),
    "select o.session_id, o.seq, if(installed_at is null, null, greatest(o.seq, installed_at)) as delivered_at, if(installed_at is null, null, (select count(*) from {opened} b where b.session_id = o.session_id and b.seq <= o.seq)) as nth from {opened} o left join {receivers} r on r.session_id = o.session_id",
)
case("text_commit", "event_id long, value string, changed boolean", lambda t: q.commit_names(t("renames")),
     "with r as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as cut from {renames}) select event_id, if(cut = '', current, cut) as value, cut not in ('', current) as changed from r")
case("preview_loadable", "job_id long, loadable boolean, writer string", lambda t: q.previewable(t("jobs").withColumn("version", F.when(F.col("job_id") % 2 == 0, "1.1"))),
     "select job_id, status in ('queued', 'encoding', 'done') as loadable, if(job_id % 2 = 0, 'reelspark 1.1', 'reelspark') as writer from {jobs}")

view(
    "queued_runs",
    """select o_orderkey as job_id, o_custkey % 40 as queue_id, row_number() over (partition by o_custkey % 40 order by o_orderkey) as position, (o_orderkey * 7919) % 90000 as arrival_ms, 100 + o_orderkey % 700 as cost_ms, o_orderkey % 9 = 0 as cancelled,
       case when o_orderkey % 5 = 0 then o_orderkey % 500 end as stopped_ms, o_orderkey % 11 = 0 as fails, case when o_custkey % 40 % 4 = 1 then 100000 + o_custkey % 40 * 50 end as stop_all_ms from {orders}""",
)
case(
    "serial_run",
    "job_id long, start_ms long, end_ms long, status string, error string",
    lambda t: q.serial_runs(t("queued_runs")),
    # one job after another, as the queue would run them
    """with recursive j as (select *, not cancelled as runs, if(coalesce(stopped_ms, cost_ms) < cost_ms, stopped_ms, cost_ms) as takes from {queued_runs}),
       r as (select queue_id, 0::bigint as position, 0::bigint as free, null::bigint as began, null::bigint as ended from j group by queue_id
             union all select j.queue_id, j.position, if(runs, greatest(free, arrival_ms) + takes, free), if(runs, greatest(free, arrival_ms), null), if(runs, greatest(free, arrival_ms) + takes, null) from r join j on j.queue_id = r.queue_id and j.position = r.position + 1),
       f as (select j.*, if(began < coalesce(stop_all_ms, 9e15), began, null) as b, ended from r join j on j.queue_id = r.queue_id and j.position = r.position)
       select job_id, b as start_ms, if(b is null, null, least(ended, coalesce(stop_all_ms, ended))) as end_ms, if(b is null or ended > coalesce(stop_all_ms, 9e15) or takes < cost_ms or fails, 'failed', 'done') as status,
         case when b is null or ended > coalesce(stop_all_ms, 9e15) or takes < cost_ms then 'Cancelled' when fails then 'Failed' end as error from f""",
)
