"""Colour and alpha operators (C1-C11 of the blueprint) over pixel rows: frame_no, y, x, and channels r, g, b, a of 0 to 255."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Value, byte, col, half_away, idiv, lookup, pick

R, G, B, A = "r", "g", "b", "a"
# What is done with colours of each kind of alpha.
ALPHA_MODES = {"premultiplied": "unpremultiply", "straight": "pass", "none": "opaque", "unknown": "pass"}


def ycocg(r: Value = R, g: Value = G, b: Value = B) -> tuple[Column, Column, Column]:
    """Luma and the two differences; right shifts round down, below zero too."""
    r, g, b = col(r), col(g), col(b)
    return F.shiftright(r + 2 * g + b + 2, 2), F.shiftright(r - b, 1), F.shiftright(2 * g - r - b, 2)


def ycocg_forward(pixels: DataFrame) -> DataFrame:
    luma, co, cg = ycocg()
    return pixels.select("frame_no", "y", "x", luma.alias("luma"), co.alias("co"), cg.alias("cg"))


def pad(plane: DataFrame, channels: list[str], w: int, h: int, coded_w: int, coded_h: int, value: int) -> DataFrame:
    """A plane of w x h filled up to coded_w x coded_h with a value, in every frame that has a place at all."""
    places = plane.select("frame_no").distinct().select("frame_no", F.explode(F.sequence(F.lit(0), F.lit(coded_w * coded_h - 1))).alias("i"))
    at = places.select("frame_no", idiv("i", coded_w).alias("y"), (F.col("i") % coded_w).cast("long").alias("x")).where(f"x >= {w} or y >= {h}")
    held = plane.select("frame_no", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.col(c).cast("long").alias(c) for c in channels])
    return held.unionByName(at.select("*", *[F.lit(value).cast("long").alias(c) for c in channels]))


def luma_plane(pixels: DataFrame, w: int, h: int, coded_w: int, coded_h: int) -> DataFrame:
    return pad(ycocg_forward(pixels).select("frame_no", "y", "x", "luma"), ["luma"], w, h, coded_w, coded_h, 0)


def chroma_planes(pixels: DataFrame, w: int, h: int, coded_w: int, coded_h: int) -> DataFrame:
    """co and cg of cells of 2 x 2: sums over the corners that exist, divided with halves away from zero, plus 128; cells of the padding are 128."""
    cells = ycocg_forward(pixels).groupBy("frame_no", idiv("y", 2).alias("y"), idiv("x", 2).alias("x")).agg(F.sum("co").alias("co"), F.sum("cg").alias("cg"), F.count("*").alias("n"))
    stored = cells.select("frame_no", "y", "x", *[byte(half_away(c, "n") + 128).alias(c) for c in ("co", "cg")])
    return pad(stored, ["co", "cg"], (w + 1) // 2, (h + 1) // 2, coded_w // 2, coded_h // 2, 128)


def ycocg_inverse(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """r, g, b of a luma plane and stored chroma planes of half its sides, each chroma value for its four places."""
    rows = luma.withColumns({"cy": idiv("y", 2), "cx": idiv("x", 2)}).join(chroma.withColumnsRenamed({"y": "cy", "x": "cx"}), ["frame_no", "cy", "cx"])
    y, co, cg = F.col("luma"), F.col("co") - 128, F.col("cg") - 128
    return rows.select("frame_no", "y", "x", byte(y + co - cg).alias("r"), byte(y + cg).alias("g"), byte(y - co - cg).alias("b"))


def alpha_modes(frames: DataFrame) -> DataFrame:
    """mode of alpha_info, or error for alpha without colour; what isn't known passes."""
    known = F.coalesce("alpha_info", F.lit("unknown"))
    return frames.withColumns({"mode": F.when(known != "alpha_only", lookup(ALPHA_MODES, known, F.lit("pass"))), "error": F.when(known == "alpha_only", "unsupported alpha")})


def unpremultiply(pixels: DataFrame, mode: Value = "mode") -> DataFrame:
    """Colours divided by their alpha, to the nearest, zero without any; as they are for pass, and with an alpha of 255 for opaque."""
    mode, a = col(mode), F.col(A)
    out = lambda c: F.when(mode != "unpremultiply", F.col(c)).when(a == 0, 0).otherwise(F.least(F.lit(255), idiv(F.col(c) * 255 + idiv(a, 2), a)))
    return pixels.withColumns({c: out(c) for c in (R, G, B)} | {A: F.when(mode == "opaque", 255).otherwise(a)})


def premultiply(pixels: DataFrame, alpha_info: Value = "alpha_info") -> DataFrame:
    """Colours times their alpha, to the nearest; those already premultiplied stay, and those without alpha count as opaque."""
    kind, a = F.coalesce(col(alpha_info), F.lit("unknown")), F.col(A)
    scaled = lambda c: F.when(a == 0, 0).when(a == 255, F.col(c)).otherwise(idiv(F.col(c) * a + 127, 255))
    return pixels.withColumns({c: F.when(kind.isin("premultiplied", "none"), F.col(c)).otherwise(scaled(c)) for c in (R, G, B)} | {A: F.when(kind == "none", 255).otherwise(a)})


def swizzle(pixels: DataFrame) -> DataFrame:
    """Channels in the other order, b, g, r, a, as c0 to c3."""
    return pixels.select("frame_no", "y", "x", *[F.col(c).alias(f"c{i}") for i, c in enumerate((B, G, R, A))])


def scaled_ycocg(pixels: DataFrame) -> DataFrame:
    """Differences of each 4 x 4 block times 4, 2 or 1, as far as its largest allows, plus 128, with the byte that tells the factor."""
    rows = ycocg_forward(pixels)
    top = F.max(F.greatest(F.abs("co"), F.abs("cg"))).over(Window.partitionBy("frame_no", idiv("y", 4), idiv("x", 4)))
    rows = rows.withColumn("scale", F.when(top <= 31, 4).when(top <= 63, 2).otherwise(1))
    code = lookup({4: 24, 2: 8, 1: 0}, "scale")
    return rows.select("frame_no", "y", "x", byte(F.col("co") * F.col("scale") + 128).alias("co8"), byte(F.col("cg") * F.col("scale") + 128).alias("cg8"), code.alias("scale_byte"), byte("luma").alias("luma"))


def scaled_ycocg_inverse(pixels: DataFrame) -> DataFrame:
    """red, green and blue of textures that hold co, cg and the scale byte in r, g and b, and luma in a."""
    share = lambda c: F.col(c).cast("double") / 255.0
    scale = 1.0 / ((255.0 / 8.0) * share(B) + 1.0)
    co, cg, y = (share(R) - 0.5) * scale, (share(G) - 0.5) * scale, share(A)
    whole = lambda v: byte(F.floor(v * 255.0 + 0.5))
    return pixels.select("frame_no", "y", "x", whole(y + co - cg).alias("red"), whole(y + cg).alias("green"), whole(y - co - cg).alias("blue"))


def luma_bt709(r: Value = R, g: Value = G, b: Value = B) -> Column:
    return F.shiftright(13933 * col(r) + 46871 * col(g) + 4732 * col(b) + 32768, 16)


def quantize(v: Value, top: int) -> Column:
    """An 8-bit value as one of top + 1 levels, to the nearest."""
    m = col(v) * top + 128
    return F.shiftright(m + F.shiftright(m, 8), 8)


def rgb565(r: Value = R, g: Value = G, b: Value = B) -> Column:
    return quantize(r, 31) * 2048 + quantize(g, 63) * 32 + quantize(b, 31)


def expand565(v: Value) -> tuple[Column, Column, Column]:
    """Channels of 8 bits, the high bits repeated below."""
    v = col(v)
    r, g, b = F.shiftright(v, 11).bitwiseAND(31), F.shiftright(v, 5).bitwiseAND(63), v.bitwiseAND(31)
    five = lambda c: c * 8 + F.shiftright(c, 2)
    return five(r), g * 4 + F.shiftright(g, 4), five(b)


def lerp13(a: Value, b: Value) -> Column:
    return idiv(2 * col(a) + col(b), 3)


@functools.cache
def match_table(bits: int) -> list[tuple[int, int]]:
    """For each 8-bit value the pair (high, low) of levels whose colour at a third comes nearest, the first in order of low, then high."""
    grown = [(v << (8 - bits)) | (v >> (2 * bits - 8)) for v in range(1 << bits)]
    at_third = [((2 * grown[high] + grown[low]) // 3, high, low) for low in range(1 << bits) for high in range(1 << bits)]
    return [min(at_third, key=lambda t: abs(t[0] - v))[1:] for v in range(256)]


def matched(v: Value, bits: int, low: bool) -> Column:
    """The high or low level of match_table for an 8-bit value."""
    return pick(F.lit(np.array([pair[low] for pair in match_table(bits)], np.int32)), v)
