"""Registered queries of colours and metrics."""

from pyspark.sql import functions as F

from ..operators import colour as c
from ..operators import metrics as m
from .fixtures import view
from .registry import case

_P = "frame_no long, y long, x long, "
_INFO = "case frame_no % 6 when 0 then 'premultiplied' when 1 then 'straight' when 2 then 'none' when 3 then 'alpha_only' when 4 then 'other' end"
view("alpha_frames", f"select vec_id as frame_no, {_INFO.replace('frame_no', 'vec_id')} as alpha_info from {{embeddings}}")
view("px_moded", f"select *, {_INFO} as alpha_info, case frame_no % 3 when 0 then 'unpremultiply' when 1 then 'pass' else 'opaque' end as mode from {{px_rgba}}")
view("px_small", "select * from {px_rgb} where x < 7 and y < 5")
view("packed", "select frame_no, y, x, r * 256 + g as v from {px_rgb}")

_YCC = "(r + 2 * g + b + 2) >> 2 as luma, (r - b) >> 1 as co, (2 * g - r - b) >> 2 as cg"
case("ycocg_forward", _P + "luma long, co long, cg long", lambda t: c.ycocg_forward(t("px_rgb")), "select frame_no, y, x, floor((r + 2 * g + b + 2) / 4) as luma, floor((r - b) / 2) as co, floor((2 * g - r - b) / 4) as cg from {px_rgb}")
_CHROMA = f"""(with k as (select frame_no, y // 2 as y, x // 2 as x, avg(co) as co, avg(cg) as cg from (select *, {_YCC} from {{px_small}}) group by all)
    select f.frame_no, i // 4 as y, i % 4 as x, greatest(0, least(255, coalesce(round(co), 0) + 128)) as co, greatest(0, least(255, coalesce(round(cg), 0) + 128)) as cg from {{alpha_frames}} f cross join range(16) r(i) left join k on k.frame_no = f.frame_no and k.y = i // 4 and k.x = i % 4)"""
_LUMA = "(select f.frame_no, i // 8 as y, i % 8 as x, coalesce((r + 2 * g + b + 2) >> 2, 0) as luma from {alpha_frames} f cross join range(64) q(i) left join {px_small} k on k.frame_no = f.frame_no and k.y = i // 8 and k.x = i % 8)"
_W = (7, 5, 8, 8)
case("chroma_subsample", _P + "co long, cg long", lambda t: c.chroma_planes(t("px_small"), *_W), f"select * from {_CHROMA}")
case("luma_plane", _P + "luma long", lambda t: c.luma_plane(t("px_small"), *_W), f"select * from {_LUMA}")
case(
    "ycocg_inverse",
    _P + "r long, g long, b long",
    lambda t: c.ycocg_inverse(c.luma_plane(t("px_small"), *_W), c.chroma_planes(t("px_small"), *_W)),
    f"""select l.frame_no, l.y, l.x, least(255, greatest(0, luma + co - cg)) as r, least(255, greatest(0, luma + cg - 128)) as g, least(255, greatest(0, luma - co - cg + 256)) as b
        from {_LUMA} l join {_CHROMA} k on k.frame_no = l.frame_no and k.y = l.y // 2 and k.x = l.x // 2""",
)
case("alpha_mode", "frame_no long, mode string, error string", lambda t: c.alpha_modes(t("alpha_frames")),
     "select frame_no, case frame_no % 6 when 0 then 'unpremultiply' when 2 then 'opaque' when 3 then null else 'pass' end as mode, if(frame_no % 6 = 3, 'unsupported alpha', null) as error from {alpha_frames}")
_UN = "case when mode <> 'unpremultiply' then {0} when a = 0 then 0 else least(255, floor(({0} * 255 + floor(a / 2)) / a)) end as {0}"
case("unpremultiply", _P + "r long, g long, b long, a long", lambda t: c.unpremultiply(t("px_moded")), f"select frame_no, y, x, {', '.join(_UN.format(k) for k in 'rgb')}, if(mode = 'opaque', 255, a) as a from {{px_moded}}")
_PRE = "case when alpha_info in ('premultiplied', 'none') then {0} else ({0} * a + 127) // 255 end as {0}"
case("premultiply", _P + "r long, g long, b long, a long", lambda t: c.premultiply(t("px_moded")), f"select frame_no, y, x, {', '.join(_PRE.format(k) for k in 'rgb')}, if(alpha_info = 'none', 255, a) as a from {{px_moded}}")
case("swizzle", _P + "c0 long, c1 long, c2 long, c3 long", lambda t: c.swizzle(t("px_rgba")), "select frame_no, y, x, b as c0, g as c1, r as c2, a as c3 from {px_rgba}")
case(
    "scaled_ycocg",
    _P + "co8 long, cg8 long, scale_byte long, luma long",
    lambda t: c.scaled_ycocg(t("px_rgb")),
    f"""with p as (select *, {_YCC} from {{px_rgb}}), k as (select frame_no, y // 4 as by, x // 4 as bx, max(greatest(abs(co), abs(cg))) as top from p group by all)
        select p.frame_no, y, x, least(255, greatest(0, co * if(top < 32, 4, if(top < 64, 2, 1)) + 128)) as co8, least(255, greatest(0, cg * if(top < 32, 4, if(top < 64, 2, 1)) + 128)) as cg8, if(top < 32, 24, if(top < 64, 8, 0)) as scale_byte, luma
        from p join k on k.frame_no = p.frame_no and k.by = p.y // 4 and k.bx = p.x // 4""",
)
case(
    "scaled_ycocg_inverse",
    _P + "red long, green long, blue long",
    lambda t: c.scaled_ycocg_inverse(t("px_rgba")),
    """with s as (select frame_no, y, x, 1.0::double / ((255.0::double / 8) * (b::double / 255) + 1) as s, r::double / 255 as r, g::double / 255 as g, a::double / 255 as a from {px_rgba}), k as (select frame_no, y, x, a, (r - 0.5::double) * s as co, (g - 0.5::double) * s as cg from s)
       select frame_no, y, x, least(255, greatest(0, floor((a + co - cg) * 255 + 0.5))) as red, least(255, greatest(0, floor((a + cg) * 255 + 0.5))) as green, least(255, greatest(0, floor((a - co - cg) * 255 + 0.5))) as blue from k""",
)
case("luma_bt709", _P + "luma long", lambda t: t("px_rgb").withColumn("luma", c.luma_bt709()), "select frame_no, y, x, (13933 * r + 46871 * g + 4732 * b + 32768) // 65536 as luma from {px_rgb}")
case("rgb565_pack", _P + "rgb565 long", lambda t: t("px_rgb").withColumn("rgb565", c.rgb565()), "select frame_no, y, x, round(r * 31 / 255.0)::bigint * 2048 + round(g * 63 / 255.0)::bigint * 32 + round(b * 31 / 255.0)::bigint as rgb565 from {px_rgb}")
case("rgb565_expand", _P + "r long, g long, b long", lambda t: t("packed").select("frame_no", "y", "x", *[e.alias(k) for k, e in zip("rgb", c.expand565("v"))]),
     "with k as (select *, v // 2048 as r5, v // 32 % 64 as g6, v % 32 as b5 from {packed}) select frame_no, y, x, (r5 << 3) | (r5 >> 2) as r, (g6 << 2) | (g6 >> 4) as g, (b5 << 3) | (b5 >> 2) as b from k")
case("lerp13", _P + "r long", lambda t: t("px_rgb").withColumn("r", c.lerp13("r", "g")), "select frame_no, y, x, floor((r + r + g) / 3) as r from {px_rgb}")
_LEVELS = "(select h, l, (2 * ((h << {s}) | (h >> {d})) + ((l << {s}) | (l >> {d}))) // 3 as third from range({n}) a(h) cross join range({n}) b(l))"
_MATCH = "(select distinct on (v) v, h, l from range(256) q(v) cross join " + _LEVELS + " order by v, abs(third - v), l, h)"
case("match_levels", _P + "high5 long, low5 long, high6 long, low6 long", lambda t: t("px_rgb").select("frame_no", "y", "x", c.matched("r", 5, False).alias("high5"), c.matched("r", 5, True).alias("low5"), c.matched("g", 6, False).alias("high6"), c.matched("g", 6, True).alias("low6")),
     f"select frame_no, y, x, five.h as high5, five.l as low5, six.h as high6, six.l as low6 from {{px_rgb}} join {_MATCH.format(n=32, s=3, d=2)} five on five.v = r join {_MATCH.format(n=64, s=2, d=4)} six on six.v = g")

view("px_two", """select frame_no, inline(transform(l, (v, i) -> named_struct('y', cast(i div 8 as int), 'x', cast(i % 8 as int), 'a_r', v, 'b_r', next[i], 'a_g', l[cast((i div 8 + 3) % 8 * 8 + i % 8 as int)], 'b_g', next[cast((i div 8 + 3) % 8 * 8 + i % 8 as int)], 'a_b', l[cast(i div 8 * 8 + (i % 8 + 5) % 8 as int)], 'b_b', next[cast(i div 8 * 8 + (i % 8 + 5) % 8 as int)])))
     from (select p.*, n.l as next from {planes} p join {planes} n on n.frame_no = p.frame_no + 1)""",
     "select a.frame_no, a.y, a.x, a.r as a_r, b.r as b_r, a.g as a_g, b.g as b_g, a.b as a_b, b.b as b_b from {px_rgb} a join {px_rgb} b on b.frame_no = a.frame_no + 1 and b.y = a.y and b.x = a.x")
view("decodes", "select user_id as player_id, event_id * 0.05e0 as seconds, (event_id * 37) % 40 / 2.0e0 as ms, event_id % 3 as dropped from {events}")
view("requests", "select user_id as player_id, cast(event_id as double) as seconds, event_id * 7 % 240 as frame from {events} where event_id % 4 < 3")
view("services", "select user_id as player_id, cast(event_id as double) as seconds from {events} where event_id % 4 = 3")
view("shown", "select user_id as player_id, event_id as seq, event_id * 3 % 500 as frame from {events}")
view("clocks", "select event_id, event_id % 130 as start, (event_id % 977) / 100.0e0 as elapsed, case event_id % 4 when 0 then 29.97e0 when 1 then 0.0e0 else 24.0e0 end as fps, case when event_id % 9 = 0 then 0 else 120 end as total, event_id % 2 = 0 as looping from {events}")
view("encodes", "select source_id, size as bytes from {packets_meta}")
view("baselines", "select source_id, case when source_id % 5 = 0 then 0 else size + 100 end as bytes from {packets_meta} where source_id % 4 <> 0")

_SSIM = """(with k as (select frame_no, avg(a) as ma, avg(b) as mb, var_pop(a) as va, var_pop(b) as vb, covar_pop(a, b) as cov from {px_pairs} group by frame_no)
    select frame_no, ((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)) as ssim from k)"""
case("ssim_8x8", "frame_no long, ssim double", lambda t: m.ssim(t("px_pairs")).withColumn("ssim", F.round("ssim", 9)), f"select frame_no, round(ssim, 9) as ssim from {_SSIM}")
case("worst_frame", "frame_no long, score double", lambda t: m.worst_frames(m.ssim(t("px_pairs")).withColumn("ssim", F.round("ssim", 9)), "ssim"), f"select frame_no, round(ssim, 9) as score from {_SSIM} order by round(ssim, 9), frame_no limit 1")
case("channel_delta", "frame_no long, mean_r double, mean_g double, mean_b double, max_r long, max_g long, max_b long", lambda t: m.channel_deltas(t("px_two"), list("rgb")),
     "select frame_no, " + ", ".join(f"sum(abs(a_{k} - b_{k})) / 64 as mean_{k}, max(greatest(a_{k}, b_{k}) - least(a_{k}, b_{k})) as max_{k}" for k in "rgb") + " from {px_two} group by frame_no")
_MSE = "(sum((a_r - b_r) * (a_r - b_r)) + sum((a_g - b_g) * (a_g - b_g)) + sum((a_b - b_b) * (a_b - b_b)))::double / 192"
case("psnr", "frame_no long, db double", lambda t: m.psnr(t("px_two"), list("rgb")).withColumn("db", F.round("db", 6)), f"select frame_no, round(20 * log10(255 / sqrt(nullif({_MSE}, 0))), 6) as db from {{px_two}} group by frame_no")
case("psnr_alpha", "db double", lambda t: m.mean_psnr(m.psnr(t("px_two"), ["r"])).withColumn("db", F.round("db", 6)),
     "select round(avg(db), 6) as db from (select 20 * log10(255 / sqrt(nullif(sum((a_r - b_r) * (a_r - b_r))::double / 64, 0))) as db from {px_two} group by frame_no)")
case("size_ratio", "source_id long, ratio double", lambda t: m.size_ratios(t("encodes"), t("baselines"), "source_id"), "select source_id, sum(bytes) / (select nullif(sum(bytes), 0) from {baselines} b where b.source_id = e.source_id) as ratio from {encodes} e group by source_id")
case(
    "decode_stats_1s",
    "player_id long, seconds double, frames long, mean_ms double, max_ms double, dropped long",
    lambda t: m.decode_stats(t("decodes")),
    """with recursive s as (select player_id, min(seconds) as seconds from {decodes} group by player_id union all select s.player_id, (select min(d.seconds) from {decodes} d where d.player_id = s.player_id and d.seconds - s.seconds >= 1.0) from s where s.seconds is not null),
       r as (select player_id, seconds, coalesce(lag(seconds) over (partition by player_id order by seconds), -1) as before from s where seconds is not null)
       select r.player_id, r.seconds, count(*) as frames, avg(ms) as mean_ms, max(ms) as max_ms, sum(dropped) as dropped from r join {decodes} d on d.player_id = r.player_id and d.seconds > r.before and d.seconds <= r.seconds group by r.player_id, r.seconds""",
)
case(
    "drop_intermediate",
    "player_id long, service double, served long, dropped long",
    lambda t: m.drop_intermediate(t("requests"), t("services")),
    "select player_id, service, arg_max(frame, seconds) as served, count(*) - 1 as dropped from (select r.*, (select min(s.seconds) from {services} s where s.player_id = r.player_id and s.seconds >= r.seconds) as service from {requests} r) where service is not null group by player_id, service",
)
case("skipped_frames", "player_id long, skipped long", lambda t: m.skipped_frames(t("shown")),
     "with n as (select *, row_number() over (partition by player_id order by seq) as n from {shown}) select a.player_id, coalesce(sum(case when a.frame - b.frame > 1 then a.frame - b.frame - 1 else 0 end), 0) as skipped from n a left join n b on b.player_id = a.player_id and b.n = a.n - 1 group by a.player_id")
case("frame_at_time", "event_id long, frame long, paused boolean", lambda t: m.frames_at(t("clocks")),
     """with k as (select *, start + floor(elapsed * fps)::bigint as target, fps > 0 and total > 0 as runs from {clocks})
        select event_id, case when not runs then start when looping then target % total when target > total - 1 then total - 1 else target end as frame, runs and not looping and target > total - 2 as paused from k""")  # fmt: skip
case("job_progress", "job_id long, progress double", lambda t: m.job_progress(t("jobs")),
     "select job_id, case when status = 'done' then 1.0 when status = 'encoding' then least(1.0::double, written::double / greatest(total, 1)) else 0.0 end as progress from {jobs}")
case("queue_progress", "priority string, progress double", lambda t: m.overall_progress(t("jobs"), "priority"),
     "select priority, sum(case when status = 'done' then 1.0::double when status = 'encoding' then least(1.0::double, written::double / if(total < 1, 1, total)) else 0.0 end) / count(*) as progress from {jobs} group by priority")
