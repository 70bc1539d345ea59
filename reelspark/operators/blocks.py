"""4 x 4 block codecs (B rows of the blueprint) over rows of frame_no, block_y, block_x.

A block's sixteen values are one array, in rows, so each block is grouped once and
everything else is an expression over its row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import Value, clamp, col, idiv, le_bytes, le_int, let, pick, unused
from .colour import expand565, matched, pad, rgb565, scaled_ycocg

AT = ("frame_no", "block_y", "block_x")
#: Halves added before a palette's division: encoders round, decoders cut off.
ROUNDED, CUT = (3, 2), (0, 0)
#: Blocks searched at once: some 30 kB for each.
BLOCKS_AT_ONCE = 128


def blocks(pixels: DataFrame, channels: Sequence[str], w: int | None = None, h: int | None = None) -> DataFrame:
    """frame_no, block_y, block_x, and for each channel the array of a block's sixteen values in rows."""
    place = (F.col("y") % 4) * 4 + F.col("x") % 4
    grouped = pixels.groupBy("frame_no", idiv("y", 4).alias("block_y"), idiv("x", 4).alias("block_x"))
    found = grouped.agg(F.array_sort(F.collect_list(F.struct(place.cast("int").alias("i"), *channels))).alias("px"))
    return found.select(*AT, *[F.col(f"px.{c}").alias(c) for c in channels])


def pixels(rows: DataFrame, channels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The way back: a row for each place of each block."""
    zipped = rows.select(*AT, *keep, F.posexplode(F.arrays_zip(*channels)).alias("i", "p"))
    return zipped.select("frame_no", (F.col("block_y") * 4 + idiv("i", 4)).alias("y"), (F.col("block_x") * 4 + F.col("i") % 4).alias("x"), *keep, *[F.col(f"p.{c}").alias(c) for c in channels])


def palette(a: Value, b: Value, half: tuple[int, int] = ROUNDED, eight: Column | None = None) -> Column:
    """The eight values of a scalar block: six steps between a and b if a > b (or as eight says), else four, 0 and 255."""
    a, b = col(a), col(b)
    step = lambda k, n, more: idiv(a * (n - k) + b * k + more, n)
    long = F.array(a, b, *[step(k, 7, half[0]) for k in range(1, 7)])
    short = F.array(a, b, *[step(k, 5, half[1]) for k in range(1, 5)], F.lit(0), F.lit(255))
    return F.when(a > b if eight is None else eight, long.cast("array<bigint>")).otherwise(short.cast("array<bigint>"))


def nearest(entries: Value, v: Column) -> Column:
    """The place of the entry nearest to v, the first of equals."""
    gaps = F.transform(col(entries), lambda e: F.abs(e - v))
    return F.array_position(gaps, F.array_min(gaps)) - 1


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)


def packed(codes: Value, bits: int) -> Column:
    """Codes of some bits as one integer, the first in the lowest bits."""
    return total(F.transform(col(codes), lambda c, i: c.cast("long") * F.pow(F.lit(2), i * bits).cast("long")))


def unpacked(v: Value, bits: int, n: int = 16) -> Column:
    return let(col(v), lambda whole: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.floor(whole / F.pow(F.lit(2), i * bits)), F.lit(1 << bits))))


def constant_colours(rows: DataFrame) -> DataFrame:
    """Blocks of one colour (r, g, b, and a where there is one) with c0, c1 and mask, whose third colour is the nearest to it."""
    one = rows.where(F.expr(" and ".join(f"array_min({c}) = array_max({c})" for c in ("r", "g", "b", "a") if c in rows.columns)))
    level = lambda low: matched(F.get("r", F.lit(0)), 5, low) * 2048 + matched(F.get("g", F.lit(0)), 6, low) * 32 + matched(F.get("b", F.lit(0)), 5, low)
    return one.select(*AT, level(False).alias("c0"), level(True).alias("c1"), F.lit(0xAAAAAAAA).alias("mask"))


def colour_stats(rows: DataFrame) -> DataFrame:
    """Smallest, largest and rounded mean of each channel, and the six covariance sums about that mean."""
    rgb = ("r", "g", "b")
    out = rows.withColumns({f"mean_{c}": F.shiftright(total(F.col(c)) + 8, 4) for c in rgb} | {f"min_{c}": F.array_min(c) for c in rgb} | {f"max_{c}": F.array_max(c) for c in rgb})
    pairs = [(a, b) for i, a in enumerate(rgb) for b in rgb[i:]]

    def covariance(a: str, b: str) -> Column:
        return total(F.zip_with(a, b, lambda x, y: (x - F.col(f"mean_{a}")) * (y - F.col(f"mean_{b}"))))

    return out.withColumns({f"cov_{a}{b}": covariance(a, b) for a, b in pairs})


def colour_endpoints(rows: DataFrame, steps: int = 4) -> DataFrame:
    """c0 and c1: the pixels furthest along the main axis of a block's colours, found by power iteration in single precision, or along luma where that axis is short."""
    out = colour_stats(rows)
    pairs = ("rr", "rg", "rb", "gg", "gb", "bb")
    covariances = F.struct(*[(F.col(f"cov_{p}").cast("float") / F.lit(255.0).cast("float")).cast("float").alias(p) for p in pairs])
    start = F.struct(*[(F.col(f"max_{c}") - F.col(f"min_{c}")).cast("float").alias(c) for c in "rgb"])
    fused = lambda s, v, k: (s.cast("double") + v.cast("double") * k.cast("double")).cast("float")

    def turned(k: Column, v: Column) -> Column:
        axes = {"r": ("rr", "rg", "rb"), "g": ("rg", "gg", "gb"), "b": ("rb", "gb", "bb")}
        return F.struct(*[fused(fused((v.g * k[y]).cast("float"), v.r, k[x]), v.b, k[z]).alias(c) for c, (x, y, z) in axes.items()])

    def whole(v: Column) -> Column:
        size = F.greatest(*[F.abs(v[c]).cast("double") for c in "rgb"])
        return let(size, lambda n: F.struct(*[F.when(n < 4.0, luma).otherwise((v[c].cast("double") * (512.0 / n)).cast("long")).alias(c) for c, luma in (("r", 299), ("g", 587), ("b", 114))]))

    def ends(dots: Column) -> Column:
        at = F.struct((F.array_position(dots, F.array_max(dots)) - 1).cast("int").alias("c0"), (F.array_position(dots, F.array_min(dots)) - 1).cast("int").alias("c1"))
        return let(at, lambda i: F.struct(*[rgb565(*[F.get(F.col(c), i[k]) for c in "rgb"]).alias(k) for k in ("c0", "c1")]))

    axis = let(let(covariances, lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda v, _: turned(k, v))), whole)
    dots = let(axis, lambda a: F.transform(F.arrays_zip("r", "g", "b"), lambda p: p.r * a.r + p.g * a.g + p.b * a.b))
    return out.withColumn("__ends", let(dots, ends)).withColumns({"c0": F.col("__ends.c0"), "c1": F.col("__ends.c1")}).drop("__ends")


def colour_indices(rows: DataFrame) -> DataFrame:
    """mask of blocks with r, g, b and endpoints c0 and c1: each pixel's place on the line between them, told apart at the middles of the four colours."""
    ends = F.struct(*[v.alias(f"{c}{n}") for n, e in enumerate((expand565("c0"), expand565("c1"))) for c, v in zip("rgb", e)])

    def middles(e: Column) -> Column:
        gap = {c: e[f"{c}0"] - e[f"{c}1"] for c in "rgb"}
        dot = lambda colour: sum((colour(c) * gap[c] for c in "gb"), colour("r") * gap["r"])
        third = lambda a, b: dot(lambda c: idiv(2 * e[f"{c}{a}"] + e[f"{c}{b}"], 3))
        stops = F.struct(dot(lambda c: e[f"{c}0"]).alias("s0"), dot(lambda c: e[f"{c}1"]).alias("s1"), third(0, 1).alias("s2"), third(1, 0).alias("s3"))
        half = lambda s, a, b: F.shiftright(s[a] + s[b], 1)
        return let(stops, lambda s: F.struct(*[gap[c].alias(c) for c in "rgb"], half(s, "s1", "s3").alias("low"), half(s, "s3", "s2").alias("half"), half(s, "s2", "s0").alias("high")))

    def code(m: Column, p: Column) -> Column:
        return let(p.r * m.r + p.g * m.g + p.b * m.b, lambda d: F.when(d < m.half, F.when(d < m.low, 1).otherwise(3)).otherwise(F.when(d < m.high, 2).otherwise(0)))

    return rows.withColumn("mask", packed(let(let(ends, middles), lambda m: F.transform(F.arrays_zip("r", "g", "b"), lambda p: code(m, p))), 2))


def average_match(rows: DataFrame) -> DataFrame:
    """c0 and c1 whose third colour is the nearest to a block's rounded mean colour."""
    mean = {c: F.shiftright(total(F.col(c)) + 8, 4).cast("int") for c in "rgb"}
    level = lambda low: matched(mean["r"], 5, low) * 2048 + matched(mean["g"], 6, low) * 32 + matched(mean["b"], 5, low)
    return rows.withColumns({"c0": level(False), "c1": level(True)})


def refined_ends(rows: DataFrame) -> DataFrame:
    """c0 and c1 of blocks with r, g, b and mask, moved to where the squared error of these codes is least.

    A code's colour is (w * c0 + (3 - w) * c1) / 3, so the normal equations are sums
    over the block's sixteen places, solved in single precision with the sum and
    product of the last step rounded once, then cut to the levels of 5 and 6 bits.
    A block that has one code only leaves them singular, and takes the ends that
    match its mean colour.
    """
    single = lambda v: v.cast("float").cast("double")
    weights = F.transform(unpacked("mask", 2), lambda k: pick(F.array(*[F.lit(w) for w in (3, 0, 2, 1)]), k.cast("int")).cast("long"))

    def sums(w: Column) -> Column:
        of = {"xx": lambda x: x * x, "yy": lambda x: (3 - x) * (3 - x), "xy": lambda x: x * (3 - x)}
        own = [total(F.transform(w, f)).alias(name) for name, f in of.items()]
        firsts = [total(F.zip_with(w, c, lambda x, v: x * v)).alias(f"{c}0") for c in "rgb"]
        lasts = [total(F.zip_with(w, c, lambda x, v: (3 - x) * v)).alias(f"{c}1") for c in "rgb"]
        return F.struct(*own, *firsts, *lasts, (F.array_min(w) == F.array_max(w)).alias("one"))

    def solved(s: Column) -> Column:
        unit = single(single(F.lit(93.0) / 255.0) / (s.xx * s.yy - s.xy * s.xy))

        def ends(f: Column) -> Column:
            scale = {"r": f, "g": single(single(f * 63.0) / 31.0), "b": f}
            top = {"r": 31, "g": 63, "b": 31}
            level = lambda c, n: clamp(single(n.cast("double") * scale[c] + 0.5).cast("long"), 0, top[c])
            at = lambda own, a, b: [level(c, s[f"{c}{a}"] * s[own] - s[f"{c}{b}"] * s["xy"]) for c in "rgb"]
            packed_ = lambda r, g, b: r * 2048 + g * 32 + b
            return F.struct(packed_(*at("yy", 0, 1)).alias("c0"), packed_(*at("xx", 1, 0)).alias("c1"))

        return let(unit, ends)

    made = average_match(rows).withColumn("__sums", let(weights, sums))
    made = made.withColumn("__ends", F.when(~F.col("__sums.one"), let(F.col("__sums"), solved)))
    return made.withColumns({c: F.coalesce(F.col(f"__ends.{c}"), F.col(c)) for c in ("c0", "c1")}).drop("__sums", "__ends")


def encode_colours(rows: DataFrame) -> DataFrame:
    """c0, c1 and mask of blocks with arrays r, g and b: ends on the main axis, matched, refined by least squares and matched again.

    Blocks of one colour (and one alpha, where there is one) are exact to the tables'
    best, all codes 2. ordered_ends or colour_bytes put the larger end first. Other
    columns stay.
    """
    found = colour_indices(refined_ends(colour_indices(colour_endpoints(rows))))
    channels = [c for c in ("r", "g", "b", "a") if c in rows.columns]
    flat = F.expr(" and ".join(f"array_min({c}) = array_max({c})" for c in channels))
    kept = [c for c in rows.columns if c not in ("c0", "c1", "mask")]
    return average_match(found.withColumnsRenamed({"c0": "__c0", "c1": "__c1"})).select(*kept, *[F.when(flat, F.col(c)).otherwise(F.col(f"__{c}")).cast("long").alias(c) for c in ("c0", "c1")], F.when(flat, F.lit(0xAAAAAAAA)).otherwise(F.col("mask")).alias("mask"))


def encode_colours_alpha(rows: DataFrame) -> DataFrame:
    """encode_colours with a0, a1 and indices of the alpha array a beside it; block is the sixteen bytes of both."""
    return colour_alpha_bytes(encode_scalars(encode_colours(rows), "a").drop("error"))


def hapy_blocks(pixels_: DataFrame, w: int, h: int) -> DataFrame:
    """block: sixteen bytes for each 4 x 4 block of a frame of w x h: the scaled differences and their factor as colours, luma as alpha; places beyond the frame are black."""
    whole = pad(pixels_.select("frame_no", "y", "x", "r", "g", "b"), ["r", "g", "b"], w, h, (w + 3) // 4 * 4, (h + 3) // 4 * 4, 0)
    planes = scaled_ycocg(whole).select("frame_no", "y", "x", F.col("co8").alias("r"), F.col("cg8").alias("g"), F.col("scale_byte").alias("b"), F.col("luma").alias("a"))
    return encode_colours_alpha(blocks(planes, ("r", "g", "b", "a")))


def ordered_ends(rows: DataFrame) -> DataFrame:
    """c0, c1 and mask so that c0 isn't below c1, which means four colours: swapped ends swap the meaning of each code."""
    swap = F.col("c0") < F.col("c1")
    return rows.withColumns({"c0": F.greatest("c0", "c1"), "c1": F.least("c0", "c1"), "mask": F.when(swap, F.col("mask").cast("long").bitwiseXOR(F.lit(0x55555555))).otherwise(F.col("mask"))})


def colour_bytes(rows: DataFrame) -> DataFrame:
    """block: the eight bytes of c0, c1 and mask, in order of ordered_ends, as hexadecimal digits."""
    return ordered_ends(rows).withColumn("block", F.concat(le_bytes("c0", 2), le_bytes("c1", 2), le_bytes("mask", 4)))


def scalar_ends(rows: DataFrame, v: str = "v") -> DataFrame:
    """hi and lo of a block's values, and mid_hi and mid_lo of those other than 0 and 255, null where there are none."""
    inner = F.filter(v, lambda x: (x > 0) & (x < 255))
    return rows.withColumns({"hi": F.array_max(v), "lo": F.array_min(v), "mid_lo": F.array_min(inner), "mid_hi": F.array_max(inner)})


def _coded(rows: DataFrame, entries: str, v: str, power: int, into: str) -> DataFrame:
    """Columns into_codes and into_error of a block's values in a palette."""
    codes = F.transform(v, lambda x: nearest(entries, x))
    gap = lambda x, k: F.abs(x - F.get(F.col(entries), k.cast("int")))
    with_codes = rows.withColumn(f"{into}_codes", codes)
    return with_codes.withColumn(f"{into}_error", total(F.zip_with(v, f"{into}_codes", lambda x, k: F.pow(gap(x, k), power).cast("long"))))


def encode_scalars(rows: DataFrame, v: str = "v") -> DataFrame:
    """a0, a1, indices and error of scalar blocks: the better of eight steps from hi to lo and, where two values lie inside, six from mid_lo to mid_hi; eight on ties."""
    out = scalar_ends(rows, v)
    long = palette("hi", "lo", eight=F.lit(True))
    out = _coded(out.withColumns({"__e8": long, "__e6": palette("mid_lo", "mid_hi", eight=F.lit(False))}), "__e8", v, 1, "__8")
    out = _coded(out, "__e6", v, 1, "__6")
    six = F.coalesce((F.col("mid_lo") < F.col("mid_hi")) & (F.col("__6_error") < F.col("__8_error")), F.lit(False))
    pick_ = lambda a, b: F.when(six, F.col(a)).otherwise(F.col(b))
    out = out.withColumns({"a0": pick_("mid_lo", "hi"), "a1": pick_("mid_hi", "lo"), "indices": packed(pick_("__6_codes", "__8_codes"), 3), "error": pick_("__6_error", "__8_error")})
    return out.drop("hi", "lo", "mid_lo", "mid_hi", *[c for c in out.columns if c.startswith("__")])


def _searched(px: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a0, a1, error and indices of blocks (blocks, values) that refine_scalars looks through; a block of one value keeps it."""
    side = 2 * reach + 1
    n = side * side
    k, at = np.arange(2 * n), np.arange(len(px))
    hi, lo = px.max(1), px.min(1)
    h = np.clip(hi[:, None] + k % side - reach, 0, 255)
    low = np.clip(lo[:, None] + k // side % side - reach, 0, 255)
    a0, a1 = (np.where(k < n, f(h, low), g(h, low)) for f, g in ((np.maximum, np.minimum), (np.minimum, np.maximum)))
    eight = [a0, a1, *[(a0 * (7 - j) + a1 * j + ROUNDED[0]) // 7 for j in range(1, 7)]]
    six = [a0, a1, *[(a0 * (5 - j) + a1 * j + ROUNDED[1]) // 5 for j in range(1, 5)], np.zeros_like(a0), np.full_like(a0, 255)]
    entries = [np.where(k < n, e, s).astype(np.int32) for e, s in zip(eight, six)]
    values = px.astype(np.int32)[:, None]
    gap = np.abs(entries[0][:, :, None] - values)
    for e in entries[1:]:
        np.minimum(gap, np.abs(e[:, :, None] - values), out=gap)
    error = (gap.astype(np.int64) ** 2).sum(2)
    error[h == low] = np.iinfo(np.int64).max
    best = error.argmin(1)
    chosen = np.stack([e[at, best] for e in entries], 1)
    codes = np.abs(chosen[:, None] - values[:, 0, :, None]).argmin(2)
    indices = (codes.astype(np.int64) << (3 * np.arange(px.shape[1]))).sum(1)
    flat = hi == lo
    return np.where(flat, lo, a0[at, best]), np.where(flat, lo, a1[at, best]), np.where(flat, 0, error[at, best]), np.where(flat, 0, indices)


def refine_scalars(rows: DataFrame, v: str = "v", reach: int = 3) -> DataFrame:
    """As encode_scalars, by squared errors over both modes and all endpoints up to reach from hi and lo, the first of the smallest; a block of one value is exact.

    Array arithmetic over many blocks at once, in Arrow batches, as each block tries 98
    palettes. Blocks without values, or with a null among them, have no ends and no error.
    """
    made = ("a0", "a1", "error", "indices")
    name = unused(rows, "searched")
    asked = rows.drop(*made).withColumn(name, F.when(~F.exists(v, lambda x: x.isNull()), col(v).cast("array<bigint>")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                b = batch.slice(start, BLOCKS_AT_ONCE)
                lists = b.column(b.num_columns - 1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                out = np.zeros((4, len(sizes)), np.int64)
                # blocks on a frame's edge may be smaller
                for size in set(sizes.tolist()) - {0}:
                    those = np.flatnonzero(sizes == size)
                    out[:, those] = _searched(lists.take(pa.array(those)).flatten().to_numpy().reshape(-1, size), reach)
                none = sizes == 0
                columns = [pa.array(c, mask=none if m != "error" else None) for c, m in zip(out, made)]
                yield pa.record_batch([*b.columns[:-1], *columns], [*b.schema.names[:-1], *made])

    types = StructType([f for f in asked.schema if f.name != name])
    for m in made:
        types = types.add(m, "long")
    return asked.mapInArrow(search, types)


def scalar_bytes(a0: Value, a1: Value, indices: Value) -> Column:
    """The eight bytes of a scalar block as hexadecimal digits: endpoints, then sixteen codes of three bits, the first in the lowest bits."""
    return F.concat(le_bytes(a0, 1), le_bytes(a1, 1), le_bytes(indices, 6))


def colour_alpha_bytes(rows: DataFrame) -> DataFrame:
    """block: the sixteen bytes of an alpha block (a0, a1, indices) and the colour block beside it."""
    return colour_bytes(rows).withColumn("block", F.concat(scalar_bytes("a0", "a1", "indices"), "block"))


def scalars_of_bytes(rows: DataFrame, block: str = "block") -> DataFrame:
    """a0, a1 and indices of a binary of eight bytes."""
    data = F.col(block)
    return rows.withColumns({"a0": le_int(data, 0, 1), "a1": le_int(data, 1, 1), "indices": le_int(F.substring(data, 3, 6), 0, 6)})


def decode_scalars(a0: Value, a1: Value, indices: Value) -> Column:
    """The sixteen values of a scalar block, with a palette that cuts off, in eight steps if a0 > a1, else six."""
    return F.transform(unpacked(indices, 3), lambda k: F.get(palette(a0, a1, CUT), k.cast("int")))


def _colours(c0: Value, c1: Value, always_four: bool) -> Column:
    four = F.lit(True) if always_four else col(c0) > col(c1)
    a, b = expand565(c0), expand565(c1)
    colour = lambda rgb, alpha=255: F.struct(*[x.cast("long").alias(n) for x, n in zip(rgb, "rgb")], F.lit(alpha).cast("long").alias("a"))
    mix = lambda p, q, n: [idiv(x * p + y * q, n) for x, y in zip(a, b)]
    black = [F.lit(0)] * 3
    long = F.array(colour(a), colour(b), colour(mix(2, 1, 3)), colour(mix(1, 2, 3)))
    short = F.array(colour(a), colour(b), colour(mix(1, 1, 2)), colour(black, 0))
    return F.when(four, long).otherwise(short)


def decode_colours(rows: DataFrame, always_four: bool = False) -> DataFrame:
    """r, g, b and a arrays of colour blocks (c0, c1, mask): four colours if c0 > c1, else three and transparent black; always four in blocks that have an alpha block beside them."""
    out = rows.withColumn("__px", F.transform(unpacked("mask", 2), lambda k: F.get(_colours("c0", "c1", always_four), k.cast("int"))))
    return out.withColumns({c: F.col(f"__px.{c}") for c in "rgba"}).drop("__px")


def decode_colours_alpha(rows: DataFrame) -> DataFrame:
    """r, g, b and a arrays of blocks with a0, a1 and indices beside c0, c1 and mask."""
    return decode_colours(rows, always_four=True).withColumn("a", decode_scalars("a0", "a1", "indices"))


def unpack_texture(rows: DataFrame, w: int, h: int, always_four: bool = False) -> DataFrame:
    """Pixels of a texture of colour blocks, without its padding beyond w x h."""
    return pixels(decode_colours(rows, always_four), ("r", "g", "b", "a")).where(f"x < {w} and y < {h}")


def edge_replicate(plane: DataFrame, channels: Sequence[str], w: int, h: int, coded_w: int, coded_h: int) -> DataFrame:
    """A plane of w x h carried on to coded_w x coded_h with its last column and row; places of the edge are dealt to theirs, without a join."""
    spread = lambda c, side, coded: F.when(F.col(c) == side - 1, F.sequence(F.lit(side - 1), F.lit(coded - 1))).otherwise(F.array(F.col(c).cast("int")))
    held = plane.where(f"x < {w} and y < {h}").select("frame_no", F.explode(spread("y", h, coded_h)).alias("y"), "x", *channels)
    return held.select("frame_no", "y", F.explode(spread("x", w, coded_w)).alias("x"), *channels)


def opaque_where(pixels_: DataFrame, has_alpha: Column, alpha: str = "a") -> DataFrame:
    """Alpha of 255 for frames without any."""
    return pixels_.withColumn(alpha, F.when(has_alpha, F.col(alpha)).otherwise(255))


def compose_planes(colour: DataFrame, alpha: DataFrame, channels: Sequence[str], key: Sequence[str] = ("frame_no", "y", "x")) -> DataFrame:
    """Colours and alpha of pixels, from whichever there is: white without colour, 255 without alpha."""
    rows = colour.join(alpha, list(key), "full_outer")
    return rows.select(*key, *[F.coalesce(c, F.lit(255)).alias(c) for c in [*channels, "a"]])


def entry(entries: Value, code: Value) -> Column:
    return pick(col(entries), col(code).cast("int"))
