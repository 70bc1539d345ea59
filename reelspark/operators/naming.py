"""Output names, timecodes and request parsers (N1-N7 of the blueprint), as columns added to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Value, col, idiv, lookup, unused

# What a codec is called in names, the containers it may go into, and the multiple that its sides must be.
CODEC_TOKENS = {
    "dxt1": "DXV Normal Quality", "dxt5": "DXV Normal Quality With Alpha", "ycg6": "DXV High Quality", "yg10": "DXV High Quality With Alpha",
    "hap1": "Hap1", "hap5": "Hap5", "hapy": "HapY", "hapa": "HapA", "hapm": "HapM",
    "prores422": "ProRes 422", "prores422hq": "ProRes 422 HQ", "prores422lt": "ProRes 422 LT", "prores422proxy": "ProRes 422 Proxy", "prores4444": "ProRes 4444",
    "h264": "H.264", "hevc": "HEVC", "mjpeg": "MotionJPEG",
}
MP4_CODECS = ("h264", "hevc")
CONTAINERS = ("mov", "mp4")
EDGES = r"^\s+|\s+$"


def trimmed(text: Value) -> Column:
    return F.regexp_replace(col(text), EDGES, "")


def path_parts(rows: DataFrame, path: str = "path") -> DataFrame:
    """dir (without its last slash), stem and ext; a leading or a last dot begins no extension."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ext = F.regexp_extract(name, "[^/][.]([^./]+)$", 1)
    parts = {"dir": F.regexp_extract(path, "^(.*)/[^/]*$", 1), "ext": ext}
    return rows.withColumns(parts | {"stem": F.when(ext == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1))})


def _time(frame: Value, fps: Value, pattern: str, unknown: str) -> Column:
    """Minutes, seconds and hundredths of a frame at the exact rate, each cut off after the larger parts are taken away."""
    fps = col(fps).cast("double")
    total = F.greatest(F.lit(0.0), col(frame) / fps)
    minutes = idiv(total.cast("long"), 60)
    part = total - (minutes * 60).cast("double")
    return F.when(fps > 0, F.format_string(pattern, minutes, part.cast("long"), ((part - part.cast("long").cast("double")) * 100).cast("long"))).otherwise(unknown)


def mmsscc(frame: Value, fps: Value) -> Column:
    """MM.SS.CC; zeros where the rate isn't positive."""
    return _time(frame, fps, "%02d.%02d.%02d", "00.00.00")


def auto_name(jobs: DataFrame) -> DataFrame:
    """name of each job's output: stem of its path, codec, [WxH] of its crop (crop_w, crop_h), [in-out] of its trim, and container.

    An open in is frame 0, an open out the last of total frames, or the in where
    total isn't known; ends in the wrong order change places. trim_format is time
    or frames. Codecs without a name give null.
    """
    parts = path_parts(jobs)
    lo = F.coalesce("in_frame", F.lit(0))
    hi = F.coalesce("out_frame", F.when(F.col("total") > 0, F.col("total") - 1), lo)
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    by_time = F.concat(mmsscc(a, "fps"), F.lit("-"), mmsscc(b, "fps"))
    bracket = F.when(F.col("trim_format") == "frames", F.concat_ws("-", a, b)).otherwise(by_time)
    crop = F.when(F.col("crop_w").isNotNull(), F.format_string(" [%dx%d]", F.round("crop_w").cast("long"), F.round("crop_h").cast("long"))).otherwise("")
    trim = F.when(F.coalesce("in_frame", "out_frame").isNotNull(), F.concat(F.lit(" ["), bracket, F.lit("]"))).otherwise("")
    name = F.concat("stem", F.lit("_"), lookup(CODEC_TOKENS, "codec"), crop, trim, F.lit("."), "container")
    return parts.withColumn("name", name).drop("dir", "ext", "stem")


def collision_free(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (dir, stem, ext; others stay) with name: stem.ext where files (dir, name) have none, else stem_N.ext with N one above the largest number taken, 2 at least; gaps stay. Numbers beyond 64 bits don't count."""
    base = F.concat("stem", F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise(""))
    pattern = "^(.*)_([0-9]+)(?:[.]([^.]+))?$"
    plain, taken, most = (unused(wanted, c) for c in ("base_name", "is_taken", "top_number"))
    numbered = files.select("dir", *[F.regexp_extract("name", pattern, k).alias(n) for k, n in ((1, "stem"), (2, "n"), (3, "ext"))])
    top = numbered.where("n <> ''").groupBy("dir", "stem", "ext").agg(F.max(F.expr("try_cast(n as bigint)")).alias(most))
    held = files.select("dir", F.col("name").alias(plain), F.lit(True).alias(taken)).distinct()
    rows = wanted.withColumn(plain, base).join(held, ["dir", plain], "left").join(top, ["dir", "stem", "ext"], "left")
    free = F.concat("stem", F.lit("_"), (F.greatest(F.lit(1), F.coalesce(most, F.lit(1))) + 1).cast("string"), F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise(""))
    return rows.withColumn("name", F.when(F.col(taken), free).otherwise(F.col(plain))).drop(plain, taken, most)


def rounded_rate(fps: Value) -> Column:
    return F.greatest(F.lit(1), F.round(col(fps)).cast("long"))


def timecode(frame: Value, fps: Value) -> Column:
    """HH:MM:SS:FF at the rounded rate; dashes where it isn't positive."""
    f, rate = F.greatest(F.lit(0), col(frame)), rounded_rate(fps)
    seconds = idiv(f, rate)
    text = F.format_string("%02d:%02d:%02d:%02d", idiv(seconds, 3600), idiv(seconds % 3600, 60), seconds % 60, (f % rate).cast("long"))
    return F.when(col(fps) > 0, text).otherwise("—:—:—:—")


def frame_of_timecode(text: Value, fps: Value) -> Column:
    """The frame of a timecode; null where it hasn't four fields of digits (a plus or a minus zero may stand), or the rate isn't positive. Fields may be over 59."""
    field = "([+]?[0-9]+|-0+)"
    parts = [F.regexp_extract(trimmed(text), f"^{field}:{field}:{field}:{field}$", k) for k in (1, 2, 3, 4)]
    h, m, s, f = (F.when(p != "", p).try_cast("long") for p in parts)
    return F.when(col(fps) > 0, ((h * 3600 + m * 60 + s) * rounded_rate(fps) + f))


def crop_badge(jobs: DataFrame) -> DataFrame:
    """badge: while editing (editing) the size and place of pending (struct x, y, w, h), else the size of committed."""
    n = lambda c, k: F.round(F.col(f"{c}.{k}")).cast("long")
    pending = F.when(F.col("pending").isNull(), "—  (no crop yet)").otherwise(F.format_string("%dx%d @ (%d, %d)", n("pending", "w"), n("pending", "h"), n("pending", "x"), n("pending", "y")))
    committed = F.when(F.col("committed").isNull(), "—  (no crop)").otherwise(F.format_string("%dx%d", n("committed", "w"), n("committed", "h")))
    return jobs.withColumn("badge", F.when(F.col("editing"), pending).otherwise(committed))


def card_time(jobs: DataFrame) -> DataFrame:
    """card: what is kept of a clip, by times or frames (trim_format)."""
    time = lambda c: _time(c, F.coalesce("fps", F.lit(0.0)), "%02d:%02d.%02d", "?")
    shown = lambda c, text, open_: F.when(F.col(c).isNull(), open_).otherwise(text)
    by_time = F.concat(shown("in_frame", time("in_frame"), "start"), F.lit(" → "), shown("out_frame", time("out_frame"), "end"))
    by_frame = F.concat(F.lit("frame "), shown("in_frame", F.col("in_frame").cast("string"), "0"), F.lit(" → "), shown("out_frame", F.col("out_frame").cast("string"), "end"))
    some = F.coalesce("in_frame", "out_frame").isNotNull()
    return jobs.withColumn("card", F.when(~some, "—  (full clip)").when(F.col("trim_format") == "frames", by_frame).otherwise(by_time))


def _integers(text: str, n: int) -> Column:
    """The n integers between colons, empty ones left out; null where there are more or fewer, or one isn't an integer."""
    parts = F.filter(F.split(text, ":"), lambda p: p != "")
    fine = (F.size(parts) == n) & F.forall(parts, lambda p: p.rlike("^[+-]?[0-9]+$"))
    return F.when(fine, F.transform(parts, lambda p: p.try_cast("long")))


def parse_requests(requests: DataFrame) -> DataFrame:
    """Typed values of codec, container, chunks, width, height, crop (x:y:w:h) and trim (start:end), and error: the first of them, in this order, that can't be read."""
    codec, container = F.lower("codec"), F.lower("container")
    crop, trim = _integers("crop", 4), _integers("trim", 2)
    size = F.col("width").isNotNull() | F.col("height").isNotNull()
    error = F.when(~codec.isin(*CODEC_TOKENS), "codec").when(~container.isin(*CONTAINERS) | ((container == "mp4") & ~codec.isin(*MP4_CODECS)), "container")
    error = error.when(~F.col("chunks").between(1, 64), "chunks").when(size & ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "size")
    bad_trim = ~F.coalesce((trim[0] >= 0) & (trim[1] > trim[0]), F.lit(False))
    error = error.when(F.col("crop").isNotNull() & crop.isNull(), "crop").when(F.col("trim").isNotNull() & bad_trim, "trim")
    typed = {"codec": codec, "container": container, "error": error} | {f"crop_{k}": crop[i] for i, k in enumerate("xywh")}
    return requests.withColumns(typed | {"lo": F.when(~bad_trim, trim[0]), "hi": F.when(~bad_trim, trim[1])})
