"""Registered queries of frame filters and geometry."""

from ..operators import geometry as g
from .fixtures import view
from .registry import case

view("trim_jobs", "select job_id, total, case when job_id % 7 = 0 then null else (job_id * 31) % 330 - 20 end as in_frame, case when job_id % 5 = 0 then null else (job_id * 17) % 330 - 20 end as out_frame from {jobs}")
view(
    "crops",
    """select geom_id, name, src_w, src_h, cast((geom_id * 7) % 300 - 3 + (case when geom_id % 13 = 0 then 0.5 else 0 end) as double) as x, cast((geom_id * 11) % 200 as double) as y,
              cast((geom_id * 4) % 1999 as double) as w, cast((geom_id * 6) % 1100 as double) as h, case when geom_id % 2 = 0 then 2 else 1 end as align from {geom}""",
)
view("sized", "select geom_id, name, src_w, src_h, case when geom_id % 4 = 0 then null when geom_id % 7 = 0 then dst_w + 1 else dst_w end as dst_w, case when geom_id % 4 = 0 then null else dst_h end as dst_h, case when geom_id % 3 = 0 then src_w // 2 end as crop_w, case when geom_id % 3 = 0 then src_h // 2 end as crop_h, case when geom_id % 5 = 0 then 1 else 2 end as align from {geom}".replace("//", "div"),
     "select geom_id, name, src_w, src_h, case when geom_id % 4 = 0 then null when geom_id % 7 = 0 then dst_w + 1 else dst_w end as dst_w, case when geom_id % 4 = 0 then null else dst_h end as dst_h, case when geom_id % 3 = 0 then src_w // 2 end as crop_w, case when geom_id % 3 = 0 then src_h // 2 end as crop_h, case when geom_id % 5 = 0 then 1 else 2 end as align from {geom}")
_DRAGS = """select geom_id, name, src_w, src_h, src_w {d} 16 * 4 as x, src_h {d} 16 * 4 as y, greatest(4, src_w {d} 8 * 4) as w, greatest(4, src_h {d} 8 * 4) as h, (geom_id * 7) % 4300 - 60 + (case when geom_id % 3 = 0 then 0.5 else 0 end) as to_x, (geom_id * 11) % 2400 - 50 as to_y,
    (geom_id * 3) % 900 - 400 as dx, (geom_id * 5) % 700 - 350 as dy, case geom_id % 4 when 0 then 'top_left' when 1 then 'top_right' when 2 then 'bottom_left' else 'bottom_right' end as corner, case geom_id % 3 when 0 then 1 when 1 then 2 else 4 end as align from {{geom}}"""
view("drags", _DRAGS.format(d="div"), _DRAGS.format(d="//"))
view(
    "nudges",
    """select geom_id, name, src_w, src_h, case when geom_id % 5 = 0 then null else x end as x, case when geom_id % 5 = 0 then null else y end as y, case when geom_id % 5 = 0 then null else w end as w, case when geom_id % 5 = 0 then null else h end as h,
              case when geom_id % 2 = 0 then corner end as corner, align, geom_id % 3 = 0 as shift, case geom_id % 6 when 0 then 'up' when 1 then 'down' when 2 then 'left' when 3 then 'right' when 4 then 'left' else 'tab' end as key from {drags}""",
)
view("typed_fields", "select geom_id, name, src_w, src_h, x, y, w, h, align, case geom_id % 7 when 0 then 'x' when 1 then 'y' when 2 then 'w' when 3 then 'h' when 4 then 'w' when 5 then 'x' else 'h' end as field, (geom_id * 13) % 5000 - 40 as typed from {drags}")
view("views", "select geom_id, name, case when geom_id % 19 = 0 then 0 else src_w end as src_w, src_h, 10 as view_x, 20 as view_y, dst_w as view_w, case when geom_id % 23 = 0 then 0 else dst_h end as view_h, geom_id % 500 as px, geom_id % 300 as py from {geom}")
view("probed", """select event_id, (event_id * 7919) % 70000 - 100 as w, (event_id * 104729) % 70000 - 50 as h, case event_id % 11 when 0 then 0.0e0 when 1 then cast('NaN' as double) when 2 then cast('Infinity' as double) else 25.0e0 end as fps,
              case event_id % 13 when 0 then -1.0e0 when 1 then cast('NaN' as double) when 2 then cast('Infinity' as double) else 4.0e0 end as duration from {events}""")  # fmt: skip

_ID, _RECT = "geom_id long, name string", "x long, y long, w long, h long"

case("trim_frames", "source_id long, frame_no long, size long", lambda t: g.trim_frames(t("packets_meta"), 3, 12, 10), "select * from {packets_meta} where frame_no between 3 and 9")
case(
    "resolve_trim",
    "job_id long, first_frame long, last_frame long",
    lambda t: g.resolve_trim(t("trim_jobs")),
    """select job_id, case when total <= 0 then 0 else list_min([a, b]) end as first_frame, case when total <= 0 then 0 else list_max([a, b]) end as last_frame
       from (select *, case when in_frame is null or in_frame < 0 then 0 when in_frame >= total then total - 1 else in_frame end as a, case when out_frame is null or out_frame >= total then total - 1 when out_frame < 0 then 0 else out_frame end as b from {trim_jobs})""",
)
case(
    "validate_crop",
    f"{_ID}, error string",
    lambda t: g.validate_crop(t("crops")),
    """select geom_id, name, case when x <> trunc(x) or y <> trunc(y) or least(w, h) < 1 or (w::bigint % align) + (h::bigint % align) > 0 then 'misaligned' when least(x, y) < 0 or w > src_w - x or h > src_h - y then 'outside' end as error from {crops}""",
)
case("crop_pixels", "frame_no long, y long, x long, r long, g long, b long", lambda t: g.crop(t("px_rgb"), 1, 2, 5, 4), "select frame_no, y - 2 as y, x - 1 as x, r, g, b from {px_rgb} where x in (1, 2, 3, 4, 5) and y in (2, 3, 4, 5)")
case(
    "resolve_output_dims",
    f"{_ID}, out_w long, out_h long, error string",
    lambda t: g.resolve_output_dims(t("sized")),
    """select geom_id, name, out_w, out_h, case when dst_w > 0 and align > 1 and (out_w & 1 = 1 or out_h & 1 = 1) then 'misaligned' end as error
       from (select *, case when dst_w is not null then dst_w when crop_w is not null then crop_w else src_w end as out_w, case when dst_h is not null then dst_h when crop_h is not null then crop_h else src_h end as out_h from {sized})""",
)
case(
    "resize_nearest",
    "frame_no long, y long, x long, luma long",
    lambda t: g.resize_nearest(t("px_luma"), 8, 8, 12, 5),
    "select p.frame_no, b.y, a.x, p.luma from range(12) a(x) cross join range(5) b(y) join {px_luma} p on p.x = a.x * 8 // 12 and p.y = b.y * 8 // 5",
)
case(
    "resize_bilinear",
    "frame_no long, y long, x long, luma long",
    lambda t: g.resize_bilinear(t("px_luma"), ["luma"], 8, 8, 12, 5),
    """with a as (select t, greatest(0, (t + 0.5) * 8 / n - 0.5) as c, n from (select unnest([12, 5]) as n) s, lateral (select unnest(range(n)) as t) r),
       k as (select t, n, least(7, floor(c))::int as lo, least(7, floor(c) + 1)::int as hi, round((c - floor(c)) * 2 * n)::int as part from a)
       select frame_no, v.t as y, h.t as x, ((10 - v.part) * ((24 - h.part) * l[v.lo * 8 + h.lo + 1] + h.part * l[v.lo * 8 + h.hi + 1]) + v.part * ((24 - h.part) * l[v.hi * 8 + h.lo + 1] + h.part * l[v.hi * 8 + h.hi + 1]) + 120) // 240 as luma
       from {planes} cross join k h cross join k v where h.n = 12 and v.n = 5""",
)
case(
    "resize_lanczos",
    "frame_no long, y long, x long, luma long",
    lambda t: g.resize_lanczos(t("px_luma"), ["luma"], 8, 8, 4, 4),
    """with o as (select o, (o - 0.5::double) / 2 as d from range(-5, 7) q(o)), w as (select o, round(4096 * 3 * sin(pi() * d) * sin(pi() * d / 3) / (pi() * pi() * d * d))::bigint as weight from o),
       k as (select t, least(7, greatest(0, 2 * t + o)) as s, sum(weight)::bigint as weight from range(4) r(t) cross join w group by all), n as (select (sum(weight) * sum(weight))::bigint as whole from w),
       f as (select p.frame_no, v.t as y, h.t as x, sum(v.weight * h.weight * p.luma)::bigint as total from k v cross join k h join {px_luma} p on p.y = v.s and p.x = h.s group by all)
       select frame_no, y, x, least(255, (greatest(0, total) * 2 + whole) // (2 * whole)) as luma from f cross join n""",
)
case("resize_auto", f"{_ID}, filter string", lambda t: g.resize_filter(t("geom")), "select geom_id, name, if(dst_w > src_w or dst_h > src_h or (dst_w = src_w and dst_h = src_h), 'bilinear', 'lanczos') as filter from {geom}")
case(
    "letterbox_rect",
    f"{_ID}, {_RECT}",
    lambda t: g.letterbox_rect(t("geom")),
    """select geom_id, name, (dst_w - w) // 2 as x, (dst_h - h) // 2 as y, w, h from (select *, case when src_w * dst_h < src_h * dst_w then least(dst_w, greatest(1, (src_w * dst_h // src_h + 2) // 4) * 4) else dst_w end as w,
         case when src_w * dst_h > src_h * dst_w then least(dst_h, greatest(1, (src_h * dst_w // src_w + 2) // 4) * 4) else dst_h end as h from {geom})""",
)
case(
    "letterbox_pixels",
    "frame_no long, y long, x long, luma long, a long",
    lambda t: g.letterbox(t("px_luma"), ["luma"], 8, 8, 12, 9),
    "select f.frame_no, c.i // 12 as y, c.i % 12 as x, coalesce(p.luma, 0) as luma, 255 as a from (select distinct frame_no from {px_luma}) f cross join range(108) c(i) left join {px_luma} p on p.frame_no = f.frame_no and p.y = c.i // 12 and p.x = c.i % 12 - 2",
)
case(
    "aspect_fit_map",
    f"{_ID}, scale double, fit_x double, fit_y double, fit_w double, fit_h double, source_x double, source_y double, source_w double, back_x double, back_y double",
    lambda t: g.to_view(g.to_source(g.aspect_fit(t("views")), "px", "py", "view_w", "view_h"), "source_x", "source_y", into="back"),
    """with s as (select *, case when src_w > 0 and src_h > 0 and view_w > 0 and view_h > 0 then 1 else 0 end as shown from {views}),
       f as (select *, case when shown = 0 then 0.0 when view_w::double / view_h > src_w::double / src_h then view_h * (src_w::double / src_h) else view_w::double end as fit_w, case when shown = 0 then 0.0 when view_w::double / view_h > src_w::double / src_h then view_h::double else view_w / (src_w::double / src_h) end as fit_h from s),
       p as (select *, case when shown = 1 then fit_w / src_w else 0.0 end as scale, case when shown = 1 then view_x + (view_w - fit_w) / 2 else 0.0 end as fit_x, case when shown = 1 then view_y + (view_h - fit_h) / 2 else 0.0 end as fit_y from f),
       q as (select *, case when shown = 1 then (px - fit_x) / scale else 0.0 end as source_x, case when shown = 1 then (py - fit_y) / scale else 0.0 end as source_y, case when shown = 1 then view_w / scale else 0.0 end as source_w from p)
       select *, case when shown = 1 then fit_x + source_x * scale else 0.0 end as back_x, case when shown = 1 then fit_y + source_y * scale else 0.0 end as back_y from q""",
)
# a coordinate c on a grid of a, the last step of the source e, and one side of a dragged rectangle: start s, size z, low end or not
_SNAP = "(case when {a} = 1 then greatest(0, round({c})::bigint) when round({c}) <= 1 then 0 else (round({c})::bigint + {a} // 2) // {a} * {a} end)"


def _side(s: str, z: str, c: str, edge: str, low: str) -> str:
    at = f"least({edge} // align * align, {_SNAP.format(c=c, a='align')})"
    return f"case when {low} then [greatest(0, least({at}, {s} + {z} - align)), {s} + {z}] else [{s}, least({edge} // align * align, greatest({at}, {s} + align))] end"


def _dragged(to_x: str, to_y: str, source: str) -> str:
    return f"""select * exclude (x, y, w, h), xs[1] as x, ys[1] as y, xs[2] - xs[1] as w, ys[2] - ys[1] as h
       from (select *, {_side("x", "w", to_x, "src_w", "corner in ('top_left', 'bottom_left')")} as xs, {_side("y", "h", to_y, "src_h", "corner in ('top_left', 'top_right')")} as ys from {source})"""


_TO_X, _TO_Y = "if(corner in ('top_left', 'bottom_left'), x, x + w) + dx", "if(corner in ('top_left', 'top_right'), y, y + h) + dy"
case("crop_drag", f"{_ID}, {_RECT}", lambda t: g.crop_drag(t("drags"), align="align"), _dragged("to_x", "to_y", "{drags}"))
case("crop_resize", f"{_ID}, {_RECT}", lambda t: g.crop_resize(t("drags"), align="align"), _dragged(_TO_X, _TO_Y, "{drags}"))


def _moved(source: str) -> str:
    return f"select * exclude (x, y), greatest(0, least({_SNAP.format(c='x + dx', a='align')}, src_w // align * align - w)) as x, greatest(0, least({_SNAP.format(c='y + dy', a='align')}, src_h // align * align - h)) as y from {source}"


case("crop_translate", f"{_ID}, {_RECT}", lambda t: g.crop_translate(t("drags"), align="align"), _moved("{drags}"))
case("crop_seed", f"{_ID}, {_RECT}", lambda t: g.crop_seed(t("geom")), "select geom_id, name, 0 as x, 0 as y, src_w - src_w % 4 as w, src_h - src_h % 4 as h from {geom}")
_NUDGED = """(select geom_id, name, src_w, src_h, align, corner, key, coalesce(x, 0) as x, coalesce(y, 0) as y, coalesce(w, src_w - src_w %% align) as w, coalesce(h, src_h - src_h %% align) as h,
    case key when 'left' then -1 when 'right' then 1 else 0 end * if(shift, 16, 4) as dx, case key when 'up' then -1 when 'down' then 1 else 0 end * if(shift, 16, 4) as dy from {nudges} where key <> 'tab' and corner is %s)"""
case(
    "crop_nudge",
    f"{_ID}, {_RECT}",
    lambda t: g.crop_nudge(t("nudges")),
    f"""select geom_id, name, x, y, w, h from {{nudges}} where key = 'tab' union all select geom_id, name, x, y, w, h from ({_moved(_NUDGED % "null")}) union all select geom_id, name, x, y, w, h from ({_dragged(_TO_X, _TO_Y, _NUDGED % "not null")})""",
)
case(
    "crop_field_commit",
    f"{_ID}, field string, value long, corrected boolean, {_RECT}",
    lambda t: g.crop_field_commit(t("typed_fields"), align="align"),
    """with r as (select *, case field when 'w' then greatest(align, (src_w - x) // align * align) when 'h' then greatest(align, (src_h - y) // align * align) when 'x' then greatest(0, (src_w - w) // align * align) else greatest(0, (src_h - h) // align * align) end as room,
         greatest(case when field in ('w', 'h') then align else 0 end, case when typed <= 0 then 0 when align = 1 then typed else (typed + align // 2) // align * align end) as near from {typed_fields}),
       v as (select * exclude (x, y, w, h), least(near, room) as value, if(field = 'x', least(near, room), x) as x, if(field = 'y', least(near, room), y) as y, if(field = 'w', least(near, room), w) as w, if(field = 'h', least(near, room), h) as h from r)
       select *, value <> typed as corrected from v""",
)
case(
    "round_multiple",
    f"{_ID}, by4 long, by16 long, by1 long",
    lambda t: t("geom").withColumns({"by4": g.round_to_multiple("src_w", 4), "by16": g.round_to_multiple("src_w", 16), "by1": g.round_to_multiple("src_w", 1)}),
    "select geom_id, name, greatest(4, src_w + 2 - (src_w + 2) % 4) as by4, greatest(16, src_w + 8 - (src_w + 8) % 16) as by16, greatest(1, src_w) as by1 from {geom}",
)
case(
    "coded_dims",
    f"{_ID}, w16 long, h16 long, w4 long, h4 long",
    lambda t: g.coded_dims(g.coded_dims(t("geom"), 16).withColumnsRenamed({"coded_w": "w16", "coded_h": "h16"}), 4).withColumnsRenamed({"coded_w": "w4", "coded_h": "h4"}),
    "select geom_id, name, ceil(src_w / 16.0) * 16 as w16, ceil(src_h / 16.0) * 16 as h16, ceil(src_w / 4.0) * 4 as w4, ceil(src_h / 4.0) * 4 as h4 from {geom}",
)
case(
    "validate_geometry",
    "event_id long, error string",
    lambda t: g.validate_geometry(t("probed")),
    """select event_id, case when least(w, h) < 1 then 'empty' when greatest(w, h) > 65535 then 'side' when w::bigint * h > 268435456 then 'area' when not isfinite(fps) or fps <= 0 then 'rate' when not isfinite(duration) or duration < 0 then 'duration' end as error from {probed}""",
)
case("jobs_pending", "job_id long", lambda t: g.jobs_pending(t("jobs")), "select o_orderkey as job_id from {orders} where o_orderstatus not in ('F', 'P') and o_orderkey % 5 <> 0")
case("jobs_clear", "job_id long, status string", lambda t: g.jobs_cleared(t("jobs")), "select job_id, status from {jobs} where status = 'queued' or status = 'encoding'")
case("jobs_remove", "job_id long, status string", lambda t: g.jobs_without(t("jobs"), t("jobs").where("job_id % 3 = 0")), "select job_id, status from {jobs} where job_id % 3 <> 0 or status = 'encoding'")
