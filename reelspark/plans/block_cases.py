"""Registered queries of block codecs."""

from pyspark.sql import functions as F

from ..operators import blocks as b
from ..operators import colour
from ..operators.clusterfit import encode_colours_by_clusters
from .colour_cases import _MATCH
from .fixtures import view
from .registry import case

_AT = "frame_no long, block_y long, block_x long"
_KEY = "frame_no, block_y, block_x"
_CORNER = "cast(i div 32 * 32 + i % 8 div 4 * 4 as int)"
view(
    "px_flat",
    f"""select frame_no, inline(transform(l, (v, i) -> named_struct('y', cast(i div 8 as int), 'x', cast(i % 8 as int), 'r', if(frame_no % 2 = 0, l[{_CORNER}], v), 'g', if(frame_no % 2 = 0, 255 - l[{_CORNER}], v), 'b', if(frame_no % 2 = 0, l[{_CORNER}] div 3, v)))) from {{planes}}""",
    """select frame_no, (i // 8)::int as y, (i % 8)::int as x, if(frame_no % 2 = 0, l[k], l[i + 1]) as r, if(frame_no % 2 = 0, 255 - l[k], l[i + 1]) as g, if(frame_no % 2 = 0, l[k] // 3, l[i + 1]) as b
       from (select *, i // 32 * 32 + i % 8 // 4 * 4 + 1 as k from (select frame_no, l, unnest(range(64)) as i from {planes}))""",
)


def _codes(at: str, wide: str) -> str:
    at_ = lambda k: at.format(k=k)
    sum_ = lambda first, n: " + ".join(wide.format(v=at_(first + k), f=256**k) for k in range(n))
    return f"{at_(0)} * 256 + {at_(1)} as c0, {at_(2)} * 256 + {at_(3)} as c1, {sum_(4, 4)} as mask, {at_(8)} as a0, {at_(9)} as a1, {sum_(10, 6)} as indices"


view(
    "coded_blocks",
    f"select frame_no, n div 2 as block_y, n % 2 as block_x, {_codes('l[n * 16 + {k}]', 'cast({v} as bigint) * {f}')} from (select frame_no, l, explode(sequence(0, 3)) as n from {{planes}})",
    f"select frame_no, n // 2 as block_y, n % 2 as block_x, {_codes('l[n * 16 + {k} + 1]', '{v}::bigint * {f}')} from {{planes}} cross join range(4) q(n)",
)


def _scalars(px: str, v: str) -> str:
    """Blocks as lists, with their extremes and both palettes."""
    return f"""(select *, {_pal8("hi", "lo", 3)} as e8, {_pal6("mid_lo", "mid_hi", 2)} as e6 from (select frame_no, y // 4 as block_y, x // 4 as block_x, list({v} order by y, x) as px, max({v}) as hi, min({v}) as lo, min({v}) filter ({v} > 0 and {v} < 255) as mid_lo, max({v}) filter ({v} > 0 and {v} < 255) as mid_hi from {px} group by all))"""


def _pal8(a: str, c: str, half: int) -> str:
    return f"list_concat([{a}, {c}], list_transform(range(1, 7), lambda k: ({a} * (7 - k) + {c} * k + {half}) // 7))"


def _pal6(a: str, c: str, half: int) -> str:
    return f"list_concat([{a}, {c}], list_transform(range(1, 5), lambda k: ({a} * (5 - k) + {c} * k + {half}) // 5), [0, 255])"


def _gaps(entries: str) -> str:
    return f"list_transform({entries}, lambda e: abs(e - v))"


def _list_codes(entries: str) -> str:
    return f"list_transform(px, lambda v: list_position({_gaps(entries)}, list_min({_gaps(entries)})) - 1)"


def _bits(codes: str, bits: int) -> str:
    return f"list_sum(list_transform(range(16), lambda i: {codes}[i + 1] * (2 ** (i * {bits}))::bigint))"


def _encoded(px: str, v: str) -> str:
    return f"""with k as (select *, {_list_codes("e8")} as k8, {_list_codes("e6")} as k6, list_sum(list_transform(px, lambda v: list_min({_gaps("e8")}))) as s8, if(mid_lo < mid_hi, list_sum(list_transform(px, lambda v: list_min({_gaps("e6")}))), null) as s6 from {_scalars(px, v)})
        select {_KEY}, if(s6 < s8, mid_lo, hi) as a0, if(s6 < s8, mid_hi, lo) as a1, {_bits("if(s6 < s8, k6, k8)", 3)} as indices, least(s8, coalesce(s6, s8)) as error from k"""


def _scalar(t):
    return b.blocks(t("px_luma").withColumnRenamed("luma", "v"), ["v"])


def _colour(t, name="px_rgb"):
    return b.blocks(t(name), list("rgb"))


_STRING = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
_ENC = _AT + ", a0 long, a1 long, indices long, error long"
case("plane_blocks", _AT + ", i long, v long", lambda t: _scalar(t).select(*b.AT, F.posexplode("v").alias("i", "v")), "select frame_no, y // 4 as block_y, x // 4 as block_x, y % 4 * 4 + x % 4 as i, luma as v from {px_luma}")
case("plane_of_blocks", "frame_no long, y long, x long, v long", lambda t: b.pixels(_scalar(t), ["v"]), "select frame_no, y, x, luma as v from {px_luma}")
case(
    "bc1_constant",
    _AT + ", c0 long, c1 long, mask long",
    lambda t: b.constant_colours(_colour(t, "px_flat")),
    f"""with k as (select frame_no, y // 4 as block_y, x // 4 as block_x, min(r) as r, min(g) as g, min(b) as b from {{px_flat}} group by all having min(r) = max(r) and min(g) = max(g) and min(b) = max(b))
        select {_KEY}, m.h * 2048 + n.h * 32 + o.h as c0, m.l * 2048 + n.l * 32 + o.l as c1, 2863311530 as mask from k join {_MATCH.format(n=32, s=3, d=2)} m on m.v = r join {_MATCH.format(n=64, s=2, d=4)} n on n.v = g join {_MATCH.format(n=32, s=3, d=2)} o on o.v = b""",
)
_PAIRS = [(a, c) for i, a in enumerate("rgb") for c in "rgb"[i:]]


def _stats(px: str) -> str:
    means = "select frame_no, y // 4 as block_y, x // 4 as block_x, " + ", ".join(f"min({c}) as min_{c}, max({c}) as max_{c}, (sum({c})::bigint + 8) // 16 as mean_{c}" for c in "rgb") + f" from {px} group by all"
    return f"""(with m as ({means}) select m.*, {", ".join(f"sum((p.{a} - mean_{a}) * (p.{c} - mean_{c}))::bigint as cov_{a}{c}" for a, c in _PAIRS)} from m join {px} p on p.frame_no = m.frame_no and p.y // 4 = block_y and p.x // 4 = block_x group by all)"""


case("bc1_block_stats", _AT + "".join(f", {k}_{c} long" for k in ("min", "max", "mean") for c in "rgb") + "".join(f", cov_{a}{c} long" for a, c in _PAIRS), lambda t: b.colour_stats(_colour(t)), f"select * from {_stats('{px_rgb}')}")


def _turn(n: int) -> str:
    fused = lambda s, v, k: f"({s}::double + {v}::double * {k}::double)::real"
    axis = {"r": ("rr", "rg", "rb"), "g": ("rg", "gg", "gb"), "b": ("rb", "gb", "bb")}
    return ", ".join(f"{fused(fused(f'(vg * k_{y})::real', 'vr', f'k_{x}'), 'vb', f'k_{z}')} as v{c}" for c, (x, y, z) in axis.items())


_KEEP = f"{_KEY}, " + ", ".join(f"k_{a}{c}" for a, c in _PAIRS)
_565 = "(round({0}r * 31 / 255.0)::bigint * 2048 + round({0}g * 63 / 255.0)::bigint * 32 + round({0}b * 31 / 255.0)::bigint)"


def _ends(px: str) -> str:
    return f"""with v0 as (select {_KEY}, {", ".join(f"(cov_{a}{c}::real / 255.0::real)::real as k_{a}{c}" for a, c in _PAIRS)}, {", ".join(f"(max_{c} - min_{c})::real as v{c}" for c in "rgb")} from {_stats(px)}),
        {", ".join(f"v{n + 1} as (select {_KEEP}, {_turn(n)} from v{n})" for n in range(4))},
        s as (select *, greatest(abs(vr), abs(vg), abs(vb))::double as size from v4),
        a as (select {_KEY}, {", ".join(f"if(size < 4, {w}, trunc(v{c}::double * (512.0::double / size))::bigint) as a{c}" for c, w in (("r", 299), ("g", 587), ("b", 114)))} from s),
        d as (select a.frame_no, block_y, block_x, p.y % 4 * 4 + p.x % 4 as i, r, g, b, r * ar + g * ag + b * ab as dot from a join {px} p on p.frame_no = a.frame_no and p.y // 4 = block_y and p.x // 4 = block_x),
        t as (select distinct on ({_KEY}) {_KEY}, r, g, b from (select a.frame_no, block_y, block_x, i, r, g, b, dot from d a) order by {_KEY}, dot desc, i), u as (select distinct on ({_KEY}) {_KEY}, r, g, b from d order by {_KEY}, dot, i)
        select t.frame_no, t.block_y, t.block_x, {_565.format("t.")} as c0, {_565.format("u.")} as c1 from t join u on u.frame_no = t.frame_no and u.block_y = t.block_y and u.block_x = t.block_x"""


case("bc1_endpoints", _AT + ", c0 long, c1 long", lambda t: b.colour_endpoints(_colour(t)), _ends("{px_rgb}"))
_X = {c: f"({c}{{0}} * {8 if c != 'g' else 4} + {c}{{0}} // {4 if c != 'g' else 16})" for c in "rgb"}
case(
    "bc1_match",
    _AT + ", c0 long, c1 long, mask long",
    lambda t: b.colour_indices(_colour(t).withColumns({k: colour.rgb565(*[f(c) for c in "rgb"]) for k, f in (("c0", F.array_max), ("c1", F.array_min))})),
    f"""with e as (select frame_no, y // 4 as block_y, x // 4 as block_x, {", ".join(f"round({f}({c}) * {63 if c == 'g' else 31} / 255.0)::bigint as {c}{n}" for n, f in enumerate(("max", "min")) for c in "rgb")} from {{px_rgb}} group by all),
        w as (select {_KEY}, r0 * 2048 + g0 * 32 + b0 as c0, r1 * 2048 + g1 * 32 + b1 as c1, {", ".join(f"{_X[c].format(n)} as {c}{n}" for n in (0, 1) for c in "rgb")} from e), d as (select *, r0 - r1 as dr, g0 - g1 as dg, b0 - b1 as db from w),
        s as (select *, r0 * dr + g0 * dg + b0 * db as s0, r1 * dr + g1 * dg + b1 * db as s1, (2 * r0 + r1) // 3 * dr + (2 * g0 + g1) // 3 * dg + (2 * b0 + b1) // 3 * db as s2, (2 * r1 + r0) // 3 * dr + (2 * g1 + g0) // 3 * dg + (2 * b1 + b0) // 3 * db as s3 from d),
        m as (select s.frame_no, block_y, block_x, c0, c1, p.y % 4 * 4 + p.x % 4 as i, p.r * dr + p.g * dg + p.b * db as dot, floor((s1 + s3) / 2) as low, floor((s3 + s2) / 2) as half, floor((s2 + s0) / 2) as high from s join {{px_rgb}} p on p.frame_no = s.frame_no and p.y // 4 = block_y and p.x // 4 = block_x)
        select {_KEY}, c0, c1, sum(case when dot < low and dot < half then 1 when dot < half then 3 when dot < high then 2 else 0 end * (4 ** i)::bigint) as mask from m group by all""",
)


def _sum16(value: str) -> str:
    return f"list_sum(list_transform(range(16), lambda i: {value}))::bigint"


def _encoded_colours(px: str, flat: str, more: str = "") -> str:
    """CTEs up to done: c0, c1 and mask of each block of pixels, larger end first; flat tells blocks of one colour, more adds columns to blocks."""
    expand = ", ".join(f"{e.format(f'c{n}')} as {c}{n}" for n in (0, 1) for c, e in (("r", "({0} // 2048) * 8 + {0} // 8192"), ("g", "({0} // 32 % 64) * 4 + {0} // 512 % 4"), ("b", "({0} % 32) * 8 + {0} % 32 // 4")))
    dot = lambda f: " + ".join(f"({f(c)}) * (k.{c}0 - k.{c}1)" for c in "rgb")

    def codes(source: str) -> str:
        stops = ", ".join(f"{dot(f)} as s{n}" for n, f in enumerate((lambda c: f"k.{c}0", lambda c: f"k.{c}1", lambda c: f"(2 * k.{c}0 + k.{c}1) // 3", lambda c: f"(2 * k.{c}1 + k.{c}0) // 3")))
        dots = f"list_transform(range(16), lambda i: {dot(lambda c: f'k.{c}s[i + 1]')})"
        place = "case when d < floor((s3 + s2) / 2) then if(d < floor((s1 + s3) / 2), 1, 3) when d < floor((s2 + s0) / 2) then 2 else 0 end"
        return f"select * exclude (s0, s1, s2, s3, dots, r0, r1, g0, g1, b0, b1), list_transform(dots, lambda d: {place}) as ks from (select k.*, {stops}, {dots} as dots from (select *, {expand} from {source}) k)"

    w = "[3, 0, 2, 1][ks[i + 1] + 1]"
    sums = {"xx": f"{w} * {w}", "yy": f"(3 - {w}) * (3 - {w})", "xy": f"{w} * (3 - {w})"} | {f"{c}p": f"{w} * {c}s[i + 1]" for c in "rgb"} | {f"{c}q": f"(3 - {w}) * {c}s[i + 1]" for c in "rgb"}
    level = lambda v, c: f"least({63 if c == 'g' else 31}, greatest(0, trunc((({v})::double * {'fg' if c == 'g' else 'f'}::double + 0.5)::real)::bigint))"
    packed = lambda f: f"{f('r')} * 2048 + {f('g')} * 32 + {f('b')}"
    fit0 = packed(lambda c: level(f"{c}p * yy - {c}q * xy", c))
    fit1 = packed(lambda c: level(f"{c}q * xx - {c}p * xy", c))
    means = " ".join(f"join {_MATCH.format(n=n, s=s_, d=d)} m{c} on m{c}.v = ({_sum16(f'{c}s[i + 1]')} + 8) // 16" for c, n, s_, d in (("r", 32, 3, 2), ("g", 64, 2, 4), ("b", 32, 3, 2)))
    return f"""blk as (select frame_no, y // 4 as block_y, x // 4 as block_x, {", ".join(f"list({c} order by y, x) as {c}s" for c in "rgb")}, {flat} as flat{more} from {px} group by all),
        means as (select {_KEY}, {packed(lambda c: f"m{c}.h")} as mean0, {packed(lambda c: f"m{c}.l")} as mean1 from blk {means}),
        first as ({codes(f"(select * from blk join means using ({_KEY}) join ({_ends(px)}) e using ({_KEY}))")}),
        sums as (select *, {", ".join(f"{_sum16(v)} as {n}" for n, v in sums.items())} from first),
        unit as (select *, ((93.0::real / 255.0::real)::real / nullif(xx * yy - xy * xy, 0)::real)::real as f from sums), units as (select *, ((f * 63.0::real)::real / 31.0::real)::real as fg from unit),
        fitted as (select * exclude (c0, c1, ks), if(f is null, mean0, {fit0}) as c0, if(f is null, mean1, {fit1}) as c1 from units),
        second as ({codes("fitted")}),
        chosen as (select * exclude (c0, c1), if(flat, mean0, c0) as c0, if(flat, mean1, c1) as c1, if(flat, 2863311530, {_sum16("ks[i + 1] * (4 ** i)::bigint")}) as mask from second),
        done as (select * exclude (c0, c1, mask), greatest(c0, c1) as c0, least(c0, c1) as c1, if(c0 < c1, xor(mask, 1431655765::bigint), mask) as mask from chosen)"""


_COLOUR_BYTES = "printf('%02x%02x%02x%02x%02x%02x%02x%02x', c0 % 256, c0 // 256, c1 % 256, c1 // 256, mask & 255, (mask >> 8) & 255, (mask >> 16) & 255, (mask >> 24) & 255)"
_ALPHA_BYTES = "printf('%02x%02x', a0, a1) || " + " || ".join(f"printf('%02x', (indices >> {8 * k}) & 255)" for k in range(6))
_ONE = " and ".join(f"min({c}) = max({c})" for c in "rgb")
# every fourth frame of single colours, every fourth of few and near ones, and alpha of one value in every third
_PLANES_A = "(select p.*, n.l as alpha from {planes} p join {planes} n on n.frame_no = (p.frame_no + 1) % (select count(*) from {embeddings}))"
view(
    "px_coded",
    f"""select frame_no, y, x, if(frame_no % 4 = 0, k, if(frame_no % 4 = 1, 100 + r div 64, r)) as r, if(frame_no % 4 = 0, 255 - k, if(frame_no % 4 = 1, 90 + g div 100, g)) as g, if(frame_no % 4 = 0, k div 3, if(frame_no % 4 = 1, 90, b)) as b, if(frame_no % 3 = 0, 200, a) as a
        from (select frame_no, inline(transform(l, (v, i) -> named_struct('y', cast(i div 8 as int), 'x', cast(i % 8 as int), 'k', l[{_CORNER}], 'r', v, 'g', l[cast((i div 8 + 3) % 8 * 8 + i % 8 as int)], 'b', l[cast(i div 8 * 8 + (i % 8 + 5) % 8 as int)], 'a', alpha[i]))) from {_PLANES_A})""",
    f"""select frame_no, y, x, if(frame_no % 4 = 0, k, if(frame_no % 4 = 1, 100 + r // 64, r)) as r, if(frame_no % 4 = 0, 255 - k, if(frame_no % 4 = 1, 90 + g // 100, g)) as g, if(frame_no % 4 = 0, k // 3, if(frame_no % 4 = 1, 90, b)) as b, if(frame_no % 3 = 0, 200, a) as a
        from (select frame_no, (i // 8)::int as y, (i % 8)::int as x, l[i // 32 * 32 + i % 8 // 4 * 4 + 1] as k, l[i + 1] as r, l[(i // 8 + 3) % 8 * 8 + i % 8 + 1] as g, l[i // 8 * 8 + (i % 8 + 5) % 8 + 1] as b, alpha[i + 1] as a from (select *, unnest(range(64)) as i from {_PLANES_A}))""",
)
case("bc1_encode", _AT + ", c0 long, c1 long, mask long, block string", lambda t: b.colour_bytes(b.encode_colours(_colour(t, "px_coded"))), f"with {_encoded_colours('{px_coded}', _ONE)} select *, {_COLOUR_BYTES} as block from done")
_BC3 = f"join (%s) a using ({_KEY})"
case("bc3_encode", _AT + ", block string", lambda t: b.encode_colours_alpha(b.blocks(t("px_coded"), list("rgba"))),
     f"with {_encoded_colours('{px_coded}', _ONE + ' and min(a) = max(a)')} select {_KEY}, {_ALPHA_BYTES} || {_COLOUR_BYTES} as block from done {_BC3 % _encoded('{px_coded}', 'a')}")


def _clustered(px: str, flat: str) -> str:
    """The search over ordered clusters, in single precision: runs of the ordered colours are added up in a list of 17 x 17."""
    real = lambda v: f"({v})::real"
    add = lambda f: real(f"{real(f('r') + ' + ' + f('g'))} + {f('b')}")
    fold = lambda values: f"list_reduce(list_concat([0::real], {values}), lambda s, v: (s + v)::real)"
    turns = []
    for n in range(8):
        turned = {c: add(lambda o, c=c: real(f"c{''.join(sorted(c + o, key='rgb'.index))} * a{o}")) for c in "rgb"}
        turns.append(f"u{n} as (select *, {', '.join(f'{v} as t{c}' for c, v in turned.items())} from {f'p{n}'})")
        turns.append(f"z{n} as (select *, sqrt({add(lambda c: real(f't{c} * t{c}'))})::real as size from u{n})")
        turns.append(f"p{n + 1} as (select * exclude (ar, ag, ab, still, tr, tg, tb, size), still or size <= 1e-10::real as still, " + ", ".join(f"if(still or size <= 1e-10::real, {w}::real, (t{c} / size)::real) as a{c}" for c, w in (("r", 0.2126), ("g", 0.7152), ("b", 0.0722))) + f" from z{n})")
    pairs = [(x, y) for n, x in enumerate("rgb") for y in "rgb"[n:]]
    ninths = lambda n: f"({n}::real / 9::real)::real"
    thirds = lambda n: f"({n}::real / 3::real)::real"
    run = lambda c, a, b: f"runs{c}[{a} * 17 + {b} + 1]"
    last = lambda c: real(f"{real(real(run(c, 0, 16) + ' - ' + run(c, 0, 'i')) + ' - ' + run(c, 'i', 'j'))} - {run(c, 'j', 'k')}")
    mix = lambda c, own, m, n: real(f"{real(f'{own} + {real(f'{thirds(m)} * ' + run(c, 'i', 'j'))}')} + {real(f'{thirds(n)} * ' + run(c, 'j', 'k'))}")
    solve = lambda a, b, m: real(f"{real(f'{real(f'{a} * {m}')} - {real(f'{b} * nab')}')} * inverse")
    cut = lambda v, c: f"round((least(1::real, greatest(0::real, {v})) * {63 if c == 'g' else 31}::real)::real::double)::bigint"
    grow = lambda q, c: real(f"({q} * {4 if c == 'g' else 8} + {q} // {16 if c == 'g' else 4})::real / 255::real")
    square = lambda c: real(f"{real(f'{real(f's{c} * s{c}')} * naa')} + {real(f'{real(f'e{c} * e{c}')} * nbb')}")
    cross = lambda c: real(f"{real(f'{real(f'{real(f's{c} * e{c}')} * nab')} - {real(f's{c} * ax{c}')}')} - {real(f'e{c} * bx{c}')}")
    each = lambda c: real(f"{real('2::real * ' + cross(c))} + {square(c)}")
    luma = {"r": "0.2126::real", "g": "0.7152::real", "b": "0.0722::real"}
    level = lambda side: f"{side}qr * 2048 + {side}qg * 32 + {side}qb"
    return f"""blk as (select frame_no, y // 4 as block_y, x // 4 as block_x, {", ".join(f"list({c} order by y, x) as {c}i" for c in "rgb")}, {flat} as flat from {px} group by all),
        means as (select {_KEY}, mr.h * 2048 + mg.h * 32 + mb.h as mean0, mr.l * 2048 + mg.l * 32 + mb.l as mean1 from blk {" ".join(f"join {_MATCH.format(n=n, s=s_, d=d)} m{c} on m{c}.v = (list_sum({c}i)::bigint + 8) // 16" for c, n, s_, d in (("r", 32, 3, 2), ("g", 64, 2, 4), ("b", 32, 3, 2)))} where flat),
        lit as (select * exclude (ri, gi, bi), {", ".join(f"list_transform({c}i, lambda v: (v::real / 255::real)::real) as {c}s" for c in "rgb")} from blk where not flat),
        mid as (select *, {", ".join(f"({fold(f'{c}s')} / 16::real)::real as m{c}" for c in "rgb")} from lit),
        p0 as (select *, 1::real as ar, 1::real as ag, 1::real as ab, false as still, {", ".join(f"{fold(f'list_transform(range(16), lambda n: ((({x}s[n + 1] - m{x})::real) * (({y}s[n + 1] - m{y})::real))::real)')} as c{x}{y}" for x, y in pairs)} from mid),
        {", ".join(turns)},
        dotted as (select *, list_transform(range(16), lambda n: {add(lambda c: real(f"{c}s[n + 1] * a{c}"))}) as dots from p8),
        placed as (select *, list_transform(list_sort(list_transform(range(16), lambda n: {{'d': dots[n + 1], 'n': n}})), lambda q: q.n) as places from dotted),
        sums as (select {_KEY}, places, {", ".join(f"list_transform(range(289), lambda q: {fold(f'list_transform(range(q // 17, greatest(q // 17, q % 17)), lambda n: {c}s[places[n + 1] + 1])')}) as runs{c}" for c in "rgb")} from placed),
        counts as (select i, j, k, i::real as n0, (j - i)::real as n1, (k - j)::real as n2, (16 - k)::real as n3 from (select unnest(range(17)) as i), lateral (select unnest(range(i, 17)) as j) q, lateral (select unnest(range(j, 17)) as k) r),
        factors as (select *, {real(f"{real('n0 + ' + real(ninths(4) + ' * n1'))} + {real(ninths(1) + ' * n2')}")} as naa, {real(f"{real('n3 + ' + real(ninths(1) + ' * n1'))} + {real(ninths(4) + ' * n2')}")} as nbb, {real(f"{ninths(2)} * (n1 + n2)::real")} as nab from counts where n0 < 16 and n3 < 16),
        solvable as (select *, (1::real / det)::real as inverse from (select *, ((naa * nbb)::real - (nab * nab)::real)::real as det from factors) where det > 1e-9::real),
        sides as (select {_KEY}, i, j, k, naa, nbb, nab, inverse, {", ".join(f"{mix(c, run(c, 0, 'i'), 2, 1)} as ax{c}, {mix(c, last(c), 1, 2)} as bx{c}" for c in "rgb")} from sums cross join solvable),
        levels as (select *, {", ".join(f"{cut(solve(f'ax{c}', f'bx{c}', 'nbb'), c)} as sq{c}, {cut(solve(f'bx{c}', f'ax{c}', 'naa'), c)} as eq{c}" for c in "rgb")} from sides),
        ends as (select *, {", ".join(f"{grow(f'sq{c}', c)} as s{c}, {grow(f'eq{c}', c)} as e{c}" for c in "rgb")} from levels),
        errors as (select {_KEY}, i, j, k, {level("s")} as c0, {level("e")} as c1, {add(lambda c: real(f"{luma[c]} * {each(c)}"))} as error from ends),
        best as (select {_KEY}, arg_min({{'i': i, 'j': j, 'k': k, 'c0': c0, 'c1': c1}}, (error, i, j, k)) as w from errors group by all),
        chosen as (select {_KEY}, w.c0 as c0, w.c1 as c1, list_sum(list_transform(range(16), lambda n: (case when n < w.i then 0 when n < w.j then 2 when n < w.k then 3 else 1 end) * (4 ** places[n + 1])::bigint))::bigint as mask from best join sums using ({_KEY})
            union all select {_KEY}, mean0, mean1, 2863311530 from means),
        done as (select * exclude (c0, c1, mask), greatest(c0, c1) as c0, least(c0, c1) as c1, if(c0 < c1, xor(mask, 1431655765::bigint), mask) as mask from chosen)"""


case("bc1_clusterfit", _AT + ", c0 long, c1 long, mask long, block string", lambda t: b.colour_bytes(encode_colours_by_clusters(_colour(t, "px_coded"))), f"with {_clustered('{px_coded}', _ONE)} select *, {_COLOUR_BYTES} as block from done")
view("px_hapy_small", "select * from {px_rgb} where x < 7 and y < 5")
_HAPY = """(with s as (select f.frame_no, i // 8 as y, i % 8 as x, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b from {alpha_frames} f cross join range(64) q(i) left join {px_hapy_small} k on k.frame_no = f.frame_no and k.y = i // 8 and k.x = i % 8),
    d as (select frame_no, y, x, least(255, (r + 2 * g + b + 2) // 4) as a, floor((r - b) / 2)::bigint as co, floor((2 * g - r - b) / 4)::bigint as cg from s),
    t as (select *, case when max(greatest(abs(co), abs(cg))) over w <= 31 then 4 when max(greatest(abs(co), abs(cg))) over w <= 63 then 2 else 1 end as f from d window w as (partition by frame_no, y // 4, x // 4))
    select frame_no, y, x, greatest(0, least(255, co * f + 128)) as r, greatest(0, least(255, cg * f + 128)) as g, case f when 4 then 24 when 2 then 8 else 0 end as b, a from t)"""
case("hapy_blocks", _AT + ", block string", lambda t: b.hapy_blocks(t("px_hapy_small"), 7, 5),
     f"with hapy as {_HAPY}, {_encoded_colours('hapy', _ONE + ' and min(a) = max(a)')} select {_KEY}, {_ALPHA_BYTES} || {_COLOUR_BYTES} as block from done {_BC3 % _encoded('hapy', 'a')}")
case("bc1_bytes", _AT + ", block string", lambda t: b.colour_bytes(t("coded_blocks")),
     f"""with o as (select {_KEY}, greatest(c0, c1) as p, least(c0, c1) as q, if(c0 < c1, xor(mask, 1431655765::bigint), mask) as m from {{coded_blocks}})
         select {_KEY}, printf('%02x%02x%02x%02x%02x%02x%02x%02x', p % 256, p // 256, q % 256, q // 256, m & 255, (m >> 8) & 255, (m >> 16) & 255, (m >> 24) & 255) as block from o""")  # fmt: skip
case("bc3_bytes", _AT + ", block string", lambda t: b.colour_alpha_bytes(t("coded_blocks")),
     f"""with o as (select *, greatest(c0, c1) as p, least(c0, c1) as q, if(c0 < c1, xor(mask, 1431655765::bigint), mask) as m from {{coded_blocks}})
         select {_KEY}, printf('%02x%02x', a0, a1) || {" || ".join(f"printf('%02x', (indices >> {8 * k}) & 255)" for k in range(6))} || printf('%02x%02x%02x%02x%02x%02x%02x%02x', p % 256, p // 256, q % 256, q // 256, m & 255, (m >> 8) & 255, (m >> 16) & 255, (m >> 24) & 255) as block from o""")  # fmt: skip
case("bc4_palette", _AT + ", eight string, six string", lambda t: b.scalar_ends(_scalar(t)).select(*b.AT, _STRING(b.palette("hi", "lo", eight=F.lit(True))).alias("eight"), _STRING(b.palette("mid_lo", "mid_hi", eight=F.lit(False))).alias("six")),
     f"select {_KEY}, array_to_string(e8, ',') as eight, coalesce(array_to_string(e6, ','), '') as six from {_scalars('{px_luma}', 'luma')}")
case(
    "bc4_index",
    _AT + ", i long, entry long, error long",
    lambda t: b.scalar_ends(_scalar(t)).withColumn("e", b.palette("hi", "lo", eight=F.lit(True))).select(*b.AT, "v", "e", F.posexplode(F.transform("v", lambda x: b.nearest("e", x))).alias("i", "entry")).withColumn("error", F.abs(b.pick(F.col("v"), "i") - b.entry("e", "entry"))),
    f"""with k as (select *, {_list_codes("e8")} as codes, list_transform(px, lambda v: list_min({_gaps("e8")})) as errors from {_scalars("{px_luma}", "luma")}) select {_KEY}, i, codes[i + 1] as entry, errors[i + 1] as error from k cross join range(16) q(i)""",
)
case("bc4_encode", _ENC, lambda t: b.encode_scalars(_scalar(t)), _encoded("{px_luma}", "luma"))
view("px_alpha", "select frame_no, y, x, case when frame_no % 3 = 0 then 255 else a end as v from {px_rgba}")
case("hapa_blocks", _ENC, lambda t: b.encode_scalars(b.blocks(b.opaque_where(t("px_rgba"), F.col("frame_no") % 3 != 0).withColumnRenamed("a", "v"), ["v"])), _encoded("{px_alpha}", "v"))
case(
    "bc4_refined",
    _ENC,
    lambda t: b.refine_scalars(_scalar(t)),
    f"""with k as (select * exclude (e8, e6) from {_scalars("{px_luma}", "luma")}), t as (select *, least(255, greatest(0, hi + n % 7 - 3)) as h, least(255, greatest(0, lo + n // 7 % 7 - 3)) as w from k cross join range(98) q(n) where lo < hi),
        d as (select {_KEY}, px, n, if(n < 49, greatest(h, w), least(h, w)) as a0, if(n < 49, least(h, w), greatest(h, w)) as a1 from t where h <> w), e as (select *, if(n < 49, {_pal8("a0", "a1", 3)}, {_pal6("a0", "a1", 2)}) as pal from d),
        s as (select *, list_sum(list_transform(px, lambda v: list_min(list_transform(pal, lambda e: (e - v) * (e - v))))) as error from e), f as (select distinct on ({_KEY}) *, {_list_codes("pal")} as codes from s order by {_KEY}, error, n)
        select {_KEY}, a0, a1, {_bits("codes", 3)} as indices, error from f union all select {_KEY}, lo, lo, 0, 0 from k where lo = hi""",
)
case("bc4_pack", _AT + ", packed string", lambda t: t("coded_blocks").withColumn("packed", b.scalar_bytes("a0", "a1", "indices")),
     f"select {_KEY}, printf('%02x%02x%02x%02x%02x%02x%02x%02x', a0, a1, {', '.join(f'(indices >> {8 * k}) & 255' for k in range(6))}) as packed from {{coded_blocks}}")
case("bc4_unpack", _AT + ", a0 long, a1 long, indices long", lambda t: b.scalars_of_bytes(t("coded_blocks").select(*b.AT, F.unhex(b.scalar_bytes("a0", "a1", "indices")).alias("block"))), f"select {_KEY}, a0, a1, indices from {{coded_blocks}}")


def _decoded(a: str, c: str, codes: str) -> str:
    entry = f"if({a} > {c}, {_pal8(a, c, 0)}, {_pal6(a, c, 0)})"
    return f"{entry}[({codes} >> (3 * i)::int) % 8 + 1]"


_OVER = "from {coded_blocks} cross join range(16) q(i)"
case("bc4_decode", _AT + ", i long, v long", lambda t: t("coded_blocks").select(*b.AT, F.posexplode(b.decode_scalars("a0", "a1", "indices")).alias("i", "v")), f"select {_KEY}, i, {_decoded('a0', 'a1', 'indices')} as v {_OVER}")
_SECOND = "(mask + (c0 % 65536) * 4294967296)"
case("bc5_decode", _AT + ", i long, r long, g long",
     lambda t: t("coded_blocks").select(*b.AT, F.posexplode(F.arrays_zip(b.decode_scalars("a0", "a1", "indices").alias("r"), b.decode_scalars(F.col("c1") % 256, F.col("c0") % 256, F.col("mask") + (F.col("c0") % 65536) * 4294967296).alias("g"))).alias("i", "p")).select(*b.AT, "i", "p.r", "p.g"),
     f"select {_KEY}, i, {_decoded('a0', 'a1', 'indices')} as r, {_decoded('(c1 % 256)', '(c0 % 256)', _SECOND)} as g {_OVER}")


def _colours(four: str, alpha: str) -> str:
    """Pixels of colour blocks: each channel of both ends, mixed by the code."""
    ends = {"r": "({0} // 2048) * 8 + ({0} // 2048) // 4", "g": "({0} // 32 % 64) * 4 + ({0} // 32 % 64) // 16", "b": "({0} % 32) * 8 + ({0} % 32) // 4"}
    mixed = lambda c: f"case code when 0 then {c}0 when 1 then {c}1 when 2 then if(four, (2 * {c}0 + {c}1) // 3, ({c}0 + {c}1) // 2) else if(four, ({c}0 + 2 * {c}1) // 3, 0) end as {c}"
    return f"""(with k as (select *, (mask >> (2 * i)::int) & 3 as code, {four} as four, {", ".join(f"{e.format(f'c{n}')} as {c}{n}" for n in (0, 1) for c, e in ends.items())} {_OVER})
        select frame_no, block_y * 4 + i // 4 as y, block_x * 4 + i % 4 as x, {", ".join(mixed(c) for c in "rgb")}, {alpha} as a from k)"""


_RGBA = "frame_no long, y long, x long, r long, g long, b long, a long"
_ONE_BIT = _colours("c0 > c1", "if(c0 > c1 or code < 3, 255, 0)")
case("bc1_decode", _RGBA, lambda t: b.pixels(b.decode_colours(t("coded_blocks")), list("rgba")), f"select * from {_ONE_BIT}")
case("bc3_decode", _RGBA, lambda t: b.pixels(b.decode_colours_alpha(t("coded_blocks")), list("rgba")), f"select * from {_colours('true', _decoded('a0', 'a1', 'indices'))}")
case("dxt_unpack", _RGBA, lambda t: b.unpack_texture(t("coded_blocks"), 6, 7), f"select * from {_ONE_BIT} where x < 6 and y < 7")
case("edge_replicate", "frame_no long, y long, x long, luma long", lambda t: b.edge_replicate(t("px_luma"), ["luma"], 7, 6, 12, 8),
     "select p.frame_no, r.y, c.x, luma from range(8) r(y) cross join range(12) c(x) join {px_luma} p on p.y = least(r.y, 5) and p.x = least(c.x, 6)")
view("px_colour", "select frame_no, y, x, luma from {px_luma} where frame_no % 3 <> 0")
view("px_mask", "select frame_no, y, x, 255 - luma as a from {px_luma} where frame_no % 3 <> 1")
case("hapm_compose", "frame_no long, y long, x long, luma long, a long", lambda t: b.compose_planes(t("px_colour"), t("px_mask"), ["luma"]), "select frame_no, y, x, if(frame_no % 3 = 0, 255, luma) as luma, if(frame_no % 3 = 1, 255, 255 - luma) as a from {px_luma}")
