"""Frame filters and geometry (P1-P16 of the blueprint): functions from DataFrames to DataFrames.

Geometry rows hold src_w and src_h; rectangles are x, y, w, h in source pixels, from
the top left. Results are added as columns, and other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Value, clamp, col, idiv, round_to_multiple, up_to_multiple

CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")

#: Name, width and height of the standard sizes.
PRESETS = (
    ("hd_1280_720", 1280, 720), ("fhd_1920_1080", 1920, 1080), ("qhd_2560_1440", 2560, 1440), ("uhd_3840_2160", 3840, 2160),
    ("dci_2048_1080", 2048, 1080), ("dci_4096_2160", 4096, 2160), ("sq_1024", 1024, 1024), ("sq_1080", 1080, 1080), ("sq_2048", 2048, 2048),
    ("v_720_1280", 720, 1280), ("v_1080_1920", 1080, 1920), ("v_1440_2560", 1440, 2560),
)


def trim_frames(frames: DataFrame, lo: Value = None, hi: Value = None, total: Value = None) -> DataFrame:
    """Frames lo <= frame_no < hi, lo not below zero, hi not above total; a total of zero or null is unknown."""
    total = F.nullif(F.greatest(col(total), F.lit(0)), F.lit(0)) if total is not None else F.lit(None)
    end = F.least(col(hi), total) if hi is not None else total
    return frames.where((F.col("frame_no") >= F.greatest(F.lit(0), F.coalesce(col(lo), F.lit(0)))) & F.coalesce(F.col("frame_no") < end, F.lit(True)))


def resolve_trim(jobs: DataFrame) -> DataFrame:
    """first_frame and last_frame, both kept, of in_frame and out_frame (null: open) within total; 0 and 0 without frames."""
    last = F.col("total") - 1
    a, b = clamp(F.coalesce("in_frame", F.lit(0)), 0, last), clamp(F.coalesce("out_frame", last), 0, last)
    known = F.col("total") > 0
    return jobs.withColumns({"first_frame": F.when(known, F.least(a, b)).otherwise(0), "last_frame": F.when(known, F.greatest(a, b)).otherwise(0)})


def crop_error(align: Value = "align") -> Column:
    """misaligned: not in whole pixels, no pixels, or a side that isn't a multiple of align (offsets may be any); outside: not within the source."""
    x, y, w, h = (F.col(c) for c in "xywh")
    whole = (F.floor(x) == x) & (F.floor(y) == y) & (F.floor(w) == w) & (F.floor(h) == h)
    fits = (w > 0) & (h > 0) & (w % col(align) == 0) & (h % col(align) == 0)
    inside = (x >= 0) & (y >= 0) & (x + w <= F.col("src_w")) & (y + h <= F.col("src_h"))
    return F.when(~whole | ~fits, "misaligned").when(~inside, "outside")


def validate_crop(crops: DataFrame, align: Value = "align") -> DataFrame:
    return crops.withColumn("error", crop_error(align))


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The pixels of a rectangle, counted from its top left."""
    held = pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return held.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def resolve_output_dims(requests: DataFrame, align: Value = "align") -> DataFrame:
    """out_w, out_h and error of requests: a crop's size (crop_w, crop_h) or else the source's where dst_w and dst_h are null, and only sizes asked for must be multiples of align."""
    w, h = F.coalesce("dst_w", "crop_w", "src_w"), F.coalesce("dst_h", "crop_h", "src_h")
    bad = F.col("dst_w").isNotNull() & ((w % col(align) != 0) | (h % col(align) != 0))
    return requests.withColumns({"out_w": w, "out_h": h, "error": F.when(bad, "misaligned")})


def _targets(s: str, src: int, dst: int) -> Column:
    """The places t with t * src div dst = s."""
    first, stop = idiv(F.col(s) * dst + src - 1, src), idiv((F.col(s) + 1) * dst + src - 1, src)
    return F.when(first < stop, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<bigint>"))


def resize_nearest(pixels: DataFrame, src_w: int, src_h: int, dst_w: int, dst_h: int) -> DataFrame:
    """Each target pixel takes the source pixel at x * source / target; a source pixel is dealt to its targets, without a join."""
    rows = pixels.withColumn("y", F.explode(_targets("y", src_h, dst_h)))
    return rows.withColumn("x", F.explode(_targets("x", src_w, dst_w)))


def _linear_taps(src: int, dst: int) -> list[tuple[int, int, int]]:
    """(target, source, weight in 1 / (2 * dst)): centres mapped onto the source, edges repeated."""
    out = []
    for t in range(dst):
        at = max(0, (2 * t + 1) * src - dst)
        low, part = min(src - 1, at // (2 * dst)), at % (2 * dst)
        out += [(t, low, 2 * dst - part), (t, min(src - 1, low + 1), part)]
    return out


def _lanczos_taps(src: int, dst: int) -> list[tuple[int, int, int]]:
    """(target, source, weight in 1 / 4096, about): three lobes, stretched where the picture shrinks, edges repeated."""
    from math import floor, pi, sin

    wide = max(1.0, src / dst)
    out = []
    for t in range(dst):
        centre = (t + 0.5) * src / dst - 0.5
        for s in range(floor(centre - 3 * wide), floor(centre + 3 * wide) + 2):
            d = (s - centre) / wide
            if abs(d) < 3:
                weight = 4096.0 if d == 0 else 4096 * 3 * sin(pi * d) * sin(pi * d / 3) / (pi * pi * d * d)
                out.append((t, min(src - 1, max(0, s)), floor(weight + 0.5) if weight >= 0 else -floor(0.5 - weight)))
    return out


def _resize(pixels: DataFrame, channels: list[str], rows: list, columns: list) -> DataFrame:
    spark = pixels.sparkSession
    # two taps or six for each row and column of the target, not for each pixel
    down = spark.createDataFrame(rows, "ty long, y long, wy long").groupBy("ty", "y").agg(F.sum("wy").alias("wy"))
    across = spark.createDataFrame(columns, "tx long, x long, wx long").groupBy("tx", "x").agg(F.sum("wx").alias("wx"))
    taps = pixels.join(F.broadcast(down), "y").join(F.broadcast(across), "x").withColumn("weight", F.col("wy") * F.col("wx"))
    sums = taps.groupBy("frame_no", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum("weight").alias("whole"), *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in channels])
    return sums.select("frame_no", "y", "x", *[F.least(F.lit(255), idiv(F.greatest(F.lit(0), F.col(c)) * 2 + F.col("whole"), F.col("whole") * 2)).alias(c) for c in channels])


def resize_bilinear(pixels: DataFrame, channels: list[str], src_w: int, src_h: int, dst_w: int, dst_h: int) -> DataFrame:
    """Weights exact in integers, so a solid colour stays; results rounded to the nearest."""
    return _resize(pixels, channels, _linear_taps(src_h, dst_h), _linear_taps(src_w, dst_w))


def resize_lanczos(pixels: DataFrame, channels: list[str], src_w: int, src_h: int, dst_w: int, dst_h: int) -> DataFrame:
    """Sums are divided by the sum of their weights, so a solid colour stays. Not the bytes of an operating system's resizer."""
    return _resize(pixels, channels, _lanczos_taps(src_h, dst_h), _lanczos_taps(src_w, dst_w))


def resize_filter(requests: DataFrame, quality: Value = None) -> DataFrame:
    """filter: what was asked for, and for auto bilinear at equal size, lanczos where neither side grows, else bilinear."""
    same = (F.col("src_w") == F.col("dst_w")) & (F.col("src_h") == F.col("dst_h"))
    smaller = (F.col("dst_w") <= F.col("src_w")) & (F.col("dst_h") <= F.col("src_h"))
    auto = F.when(same, "bilinear").when(smaller, "lanczos").otherwise("bilinear")
    asked = F.lit("auto") if quality is None else col(quality)
    return requests.withColumn("filter", F.when(asked == "auto", auto).otherwise(asked))


def letterbox_rect(geometry: DataFrame) -> DataFrame:
    """x, y, w, h of the source within dst_w x dst_h: the whole target at equal aspect, else the inner side rounded to a multiple of four and centred."""
    wide, high = F.col("src_w") * F.col("dst_h"), F.col("src_h") * F.col("dst_w")
    w = F.when(wide >= high, F.col("dst_w")).otherwise(F.least("dst_w", round_to_multiple(idiv(wide, "src_h"), 4)))
    h = F.when(wide <= high, F.col("dst_h")).otherwise(F.least("dst_h", round_to_multiple(idiv(high, "src_w"), 4)))
    return geometry.withColumns({"w": w, "h": h}).withColumns({"x": idiv(F.col("dst_w") - F.col("w"), 2), "y": idiv(F.col("dst_h") - F.col("h"), 2)})


def letterbox(pixels: DataFrame, channels: list[str], w: int, h: int, canvas_w: int, canvas_h: int) -> DataFrame:
    """w x h pixels centred on an opaque black canvas, for every frame that has a pixel at all."""
    x0, y0 = (canvas_w - w) // 2, (canvas_h - h) // 2
    inner = pixels.select("frame_no", (F.col("y") + y0).cast("long").alias("y"), (F.col("x") + x0).cast("long").alias("x"), *channels, F.lit(255).alias("a"))
    canvas = pixels.select("frame_no").distinct().select("frame_no", F.explode(F.sequence(F.lit(0), F.lit(canvas_w * canvas_h - 1))).alias("i"))
    at = canvas.select("frame_no", idiv("i", canvas_w).alias("y"), (F.col("i") % canvas_w).cast("long").alias("x"))
    black = at.where(~(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)))
    return inner.unionByName(black.select("*", *[F.lit(0).alias(c) for c in channels], F.lit(255).alias("a")))


def aspect_fit(geometry: DataFrame) -> DataFrame:
    """fit_x, fit_y, fit_w, fit_h and scale of the source within the view view_x, view_y, view_w, view_h; all zero where one has no area."""
    src, view = F.col("src_w") / F.col("src_h"), F.col("view_w") / F.col("view_h")
    some = (F.col("src_w") > 0) & (F.col("src_h") > 0) & (F.col("view_w") > 0) & (F.col("view_h") > 0)
    high = some & (view > src)
    w = F.when(~some, 0.0).when(high, F.col("view_h") * src).otherwise(F.col("view_w").cast("double"))
    h = F.when(~some, 0.0).when(high, F.col("view_h").cast("double")).otherwise(F.col("view_w") / src)
    fitted = geometry.withColumns({"fit_w": w, "fit_h": h})
    at = {f"fit_{a}": F.when(some, F.col(f"view_{a}") + (F.col(f"view_{s}") - F.col(f"fit_{s}")) / 2).otherwise(0.0) for a, s in (("x", "w"), ("y", "h"))}
    return fitted.withColumns(at | {"scale": F.when(some, F.col("fit_w") / F.col("src_w")).otherwise(0.0)})


def to_source(fitted: DataFrame, x: str, y: str, w: str | None = None, h: str | None = None, into: str = "source") -> DataFrame:
    """A point of the view, or a rectangle, in source pixels, as into_x, into_y and into_w, into_h; zero where nothing is shown."""
    out = {f"{into}_x": (F.col(x) - F.col("fit_x")) / F.col("scale"), f"{into}_y": (F.col(y) - F.col("fit_y")) / F.col("scale")}
    if w:
        out |= {f"{into}_w": F.col(w) / F.col("scale"), f"{into}_h": F.col(h) / F.col("scale")}
    return fitted.withColumns({k: F.when(F.col("scale") > 0, v).otherwise(0.0) for k, v in out.items()})


def to_view(fitted: DataFrame, x: str, y: str, w: str | None = None, h: str | None = None, into: str = "view_at") -> DataFrame:
    """A point or a rectangle of the source in the view; zero where nothing is shown."""
    out = {f"{into}_x": F.col("fit_x") + F.col(x) * F.col("scale"), f"{into}_y": F.col("fit_y") + F.col(y) * F.col("scale")}
    if w:
        out |= {f"{into}_w": F.col(w) * F.col("scale"), f"{into}_h": F.col(h) * F.col("scale")}
    return fitted.withColumns({k: F.when(F.col("scale") > 0, v).otherwise(0.0) for k, v in out.items()})


def snap(c: Value, align: Value) -> Column:
    """A coordinate on the grid: the nearest multiple, halves up, one and less at zero; pixel by pixel for an align of one."""
    n = F.round(col(c)).cast("long")
    return F.when(col(align) <= 1, F.greatest(F.lit(0), n)).when(n <= 1, 0).otherwise(round_to_multiple(n, align))


def aligned_edge(side: Value, align: Value) -> Column:
    return F.greatest(F.lit(0), idiv(side, align) * col(align))


def _drag(start: Column, size: Column, low: Column, to: Column, edge: Column, align: Column) -> tuple[Column, Column]:
    """Start and size of a side whose low or high end goes to a place: on the grid, at least one step long, within the aligned edge."""
    at = F.least(edge, F.greatest(F.lit(0), snap(to, align)))
    first = F.greatest(F.lit(0), F.least(at, start + size - align))
    last = F.least(edge, F.greatest(at, start + align))
    return F.when(low, first).otherwise(start), F.when(low, start + size - first).otherwise(last - start)


def _dragged(to_x: Column, to_y: Column, corner: Column, a: Column) -> dict[str, Column]:
    x, w = _drag(F.col("x"), F.col("w"), corner.endswith("left"), to_x, aligned_edge("src_w", a), a)
    y, h = _drag(F.col("y"), F.col("h"), corner.startswith("top"), to_y, aligned_edge("src_h", a), a)
    return {"x": x, "y": y, "w": w, "h": h}


def _resized(dx: Column, dy: Column, corner: Column, a: Column) -> dict[str, Column]:
    at_x = F.when(corner.endswith("left"), F.col("x")).otherwise(F.col("x") + F.col("w"))
    at_y = F.when(corner.startswith("top"), F.col("y")).otherwise(F.col("y") + F.col("h"))
    return _dragged(at_x + dx, at_y + dy, corner, a)


def _moved(dx: Column, dy: Column, a: Column) -> dict[str, Column]:
    x = F.greatest(F.lit(0), F.least(snap(F.col("x") + dx, a), aligned_edge("src_w", a) - F.col("w")))
    y = F.greatest(F.lit(0), F.least(snap(F.col("y") + dy, a), aligned_edge("src_h", a) - F.col("h")))
    return {"x": x, "y": y, "w": F.col("w"), "h": F.col("h")}


def _step(align: Value) -> Column:
    return F.greatest(F.lit(1), col(align))


def crop_drag(crops: DataFrame, to_x: Value = "to_x", to_y: Value = "to_y", corner: Value = "corner", align: Value = 4) -> DataFrame:
    """x, y, w, h after a corner (see CORNERS) was dragged to a place; the opposite corner stays."""
    return crops.withColumns(_dragged(col(to_x), col(to_y), col(corner), _step(align)))


def crop_resize(crops: DataFrame, dx: Value = "dx", dy: Value = "dy", corner: Value = "corner", align: Value = 4) -> DataFrame:
    """As crop_drag, by a distance from where the corner is."""
    return crops.withColumns(_resized(col(dx), col(dy), col(corner), _step(align)))


def crop_translate(crops: DataFrame, dx: Value = "dx", dy: Value = "dy", align: Value = 4) -> DataFrame:
    """x and y moved by a distance, on the grid, within the aligned edge; the size stays."""
    return crops.withColumns(_moved(col(dx), col(dy), _step(align)))


def crop_seed(geometry: DataFrame, align: Value = 4) -> DataFrame:
    """The largest aligned rectangle from the top left."""
    a = _step(align)
    return geometry.withColumns({"x": F.lit(0), "y": F.lit(0), "w": aligned_edge("src_w", a), "h": aligned_edge("src_h", a)})


def crop_nudge(crops: DataFrame, align: Value = "align") -> DataFrame:
    """The rectangle after an arrow key (key: up, down, left, right), by 4 pixels or 16 with shift: a focused corner moves, else the whole. No rectangle (null x) is first the full frame; other keys change nothing."""
    a, none = _step(align), F.col("x").isNull()
    full = {"x": F.lit(0), "y": F.lit(0), "w": aligned_edge("src_w", a), "h": aligned_edge("src_h", a)}
    base = crops.withColumns({"__was": F.struct("x", "y", "w", "h")} | {k: F.when(none, v).otherwise(F.col(k)) for k, v in full.items()})
    step = F.when(F.col("shift"), 16).otherwise(4)
    dx = F.when(F.col("key") == "left", -step).when(F.col("key") == "right", step).otherwise(0)
    dy = F.when(F.col("key") == "up", -step).when(F.col("key") == "down", step).otherwise(0)
    corner, whole = _resized(dx, dy, F.col("corner"), a), _moved(dx, dy, a)
    after = {k: F.when(~F.col("key").isin("up", "down", "left", "right"), F.col(f"__was.{k}")).when(F.col("corner").isNotNull(), corner[k]).otherwise(whole[k]) for k in "xywh"}
    return base.withColumns(after).drop("__was")


def crop_field_commit(crops: DataFrame, field: Value = "field", typed: Value = "typed", align: Value = 4) -> DataFrame:
    """The rectangle after a number was typed into one of its fields (x, y, w, h), as value: to the nearest multiple, what is left of the source at most; corrected where that isn't what was typed."""
    a, field, typed = _step(align), col(field), col(typed)
    room = {"x": aligned_edge(F.col("src_w") - F.col("w"), a), "y": aligned_edge(F.col("src_h") - F.col("h"), a)}
    room |= {"w": F.greatest(a, aligned_edge(F.col("src_w") - F.col("x"), a)), "h": F.greatest(a, aligned_edge(F.col("src_h") - F.col("y"), a))}
    value = F.lit(None).cast("long")
    for k, most in room.items():
        value = F.when(field == k, F.least(most, round_to_multiple(typed, a, 0 if k in "xy" else None))).otherwise(value)
    done = crops.withColumn("value", value).withColumn("corrected", F.col("value") != typed)
    return done.withColumns({k: F.when(field == k, F.col("value")).otherwise(F.col(k)) for k in "xywh"})


def coded_dims(geometry: DataFrame, align: int) -> DataFrame:
    """coded_w and coded_h: sides padded to multiples of align (16 and 4 are the codecs')."""
    return geometry.withColumns({"coded_w": up_to_multiple("src_w", align), "coded_h": up_to_multiple("src_h", align)})


def validate_geometry(sources: DataFrame) -> DataFrame:
    """error: the first rule that w, h, fps or duration break."""
    w, h = F.col("w").cast("long"), F.col("h").cast("long")
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    error = F.when((w < 1) | (h < 1), "empty").when((w > 65535) | (h > 65535), "side").when(w * h > 16384 * 16384, "area")
    return sources.withColumn("error", error.when(~(finite("fps") & (F.col("fps") > 0)), "rate").when(~(finite("duration") & (F.col("duration") >= 0)), "duration"))


def jobs_pending(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'")


def jobs_cleared(jobs: DataFrame) -> DataFrame:
    """Jobs without those that are done or failed."""
    return jobs.where("status not in ('done', 'failed')")


def jobs_without(jobs: DataFrame, removed: DataFrame) -> DataFrame:
    """Jobs without those whose job_id is in removed; one that is encoding stays."""
    return jobs.where("status = 'encoding'").unionByName(jobs.where("status <> 'encoding'").join(removed.select("job_id"), "job_id", "left_anti").select(jobs.columns))
