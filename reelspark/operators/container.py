"""Container metadata as relations: routing, sample tables, packets and muxing rules (D and K rows of the blueprint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Value, ascii_at, col, idiv, le_int, lookup
from .naming import path_parts

# Codes of the streams that each reader takes; the platform's takes the rest.
DXV_CODES = ("DXT1", "DXT5", "YCG6", "YG10", "DXDI", "DXD3")
HAP_CODES = ("Hap1", "Hap5", "HapY", "HapM", "HapA")
ALPHA_CODES = {"ap4h": True, "ap4x": True, "Hap5": True, "HapM": True, "HapA": True, "apcn": False, "apch": False, "apcs": False, "apco": False, "HapY": False, "Hap1": False}
#: Extensions of files that count as movies; a parameter where a system knows more.
MOVIE_EXTENSIONS = ("mov", "qt", "mp4", "m4v", "mpg", "mpeg", "avi", "3gp", "3g2", "m2v", "mkv", "webm")
VARIANTS = {"DXT1": "dxt1", "DXT5": "dxt5", "YCG6": "ycg6", "YG10": "yg10"}


def hap_streams(streams: DataFrame) -> DataFrame:
    return streams.where(F.col("fourcc").isin(*HAP_CODES))


def route_readers(streams: DataFrame) -> DataFrame:
    """reader: dxv, hap, or platform for every other code, HapA among them, and for none."""
    readers = {c: "dxv" for c in DXV_CODES} | {c: "hap" for c in HAP_CODES if c != "HapA"}
    return streams.withColumn("reader", lookup(readers, "fourcc", F.lit("platform")))


def _before(order: list[str], *keys: str):
    return Window.partitionBy("source_id", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def frame_index(samples: DataFrame, chunks: DataFrame, runs: DataFrame, deltas: DataFrame, timescale: Value) -> DataFrame:
    """(source_id, frame_no, size, file_offset, pts, delta) of a movie's sample tables.

    samples: source_id, frame_no from 0, size. chunks: source_id, chunk from 1,
    chunk_offset. runs: source_id, first_chunk, per_chunk, each for the chunks up to
    the next run. deltas: source_id, nth, n, delta, runs of durations, the last of
    which goes on (1 where there are none). Samples beyond the last chunk are left
    out. Chunks find their run, and samples their chunk and duration, as the last
    one that begins at or before them, so nothing is joined by range.
    """
    order = Window.partitionBy("source_id").orderBy("at", "kind")
    sized = chunks.select("source_id", F.col("chunk").alias("at"), F.lit(1).alias("kind"), "chunk_offset", F.lit(None).cast("long").alias("per_chunk"))
    sized = sized.unionByName(runs.select("source_id", F.col("first_chunk").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk_offset"), F.col("per_chunk").cast("long").alias("per_chunk")))
    sized = sized.withColumn("per_chunk", F.last("per_chunk", ignorenulls=True).over(order)).where("kind = 1 and per_chunk > 0")
    starts = sized.withColumn("first", F.coalesce(F.sum("per_chunk").over(_before(["at"])), F.lit(0)))
    timed = deltas.where("n > 0").withColumns({"first": F.coalesce(F.sum("n").over(_before(["nth"])), F.lit(0)), "ticks": F.coalesce(F.sum(F.col("n") * F.col("delta")).over(_before(["nth"])), F.lit(0))})
    chunk, run, size = (F.lit(None).cast(t) for t in ("struct<chunk:bigint,first:bigint,stop:bigint,chunk_offset:bigint>", "struct<first:bigint,ticks:bigint,delta:bigint>", "long"))
    at = lambda df, c, kind, ch=chunk, rn=run, sz=size: df.select("source_id", F.col(c).cast("long").alias("at"), F.lit(kind).alias("kind"), ch.alias("chunk"), rn.alias("run"), sz.alias("size"))
    long = lambda c, n: F.col(c).cast("long").alias(n)
    rows = at(starts, "first", 0, ch=F.struct(long("at", "chunk"), long("first", "first"), (F.col("first") + F.col("per_chunk")).cast("long").alias("stop"), long("chunk_offset", "chunk_offset")))
    rows = rows.unionByName(at(timed, "first", 0, rn=F.struct(long("first", "first"), long("ticks", "ticks"), long("delta", "delta")))).unionByName(at(samples, "frame_no", 1, sz=F.col("size").cast("long")))
    known = rows.withColumns({"chunk": F.last("chunk", ignorenulls=True).over(order), "run": F.last("run", ignorenulls=True).over(order)}).where("kind = 1 and at < chunk.stop")
    ticks = F.coalesce(F.expr("run.ticks + (at - run.first) * run.delta"), F.col("at"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source_id", "chunk.chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return known.select("source_id", F.col("at").alias("frame_no"), "size", (F.col("chunk.chunk_offset") + inside).alias("file_offset"), (ticks / col(timescale).cast("double")).alias("pts"), F.coalesce("run.delta", F.lit(1)).alias("delta"))


def expand_deltas(deltas: DataFrame) -> DataFrame:
    """A row for each sample of the runs of durations: frame_no and delta."""
    rows = deltas.where("n > 0").withColumn("first", F.coalesce(F.sum("n").over(_before(["nth"])), F.lit(0)))
    return rows.select("source_id", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("frame_no"), "delta")


def sample_sizes(headers: DataFrame, table: DataFrame) -> DataFrame:
    """(source_id, frame_no, size) of headers (source_id, constant, n) and table: the constant for n samples where it isn't zero, else what the table says."""
    same = headers.where("constant > 0 and n > 0").select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("frame_no"), F.col("constant").cast("long").alias("size"))
    other = table.join(headers.where("constant = 0").select("source_id"), "source_id", "left_semi")
    return same.unionByName(other.select("source_id", F.col("frame_no").cast("long").alias("frame_no"), F.col("size").cast("long").alias("size")))


def movie_rate(index: DataFrame, timescale: Value) -> DataFrame:
    """frames, duration (last time and last duration) and fps, 30 where nothing lasts."""
    last = F.max_by(F.struct("pts", "delta"), "frame_no")
    found = index.groupBy("source_id").agg(F.count("*").alias("frames"), last.alias("last")).withColumn("duration", F.col("last.pts") + F.col("last.delta") / col(timescale).cast("double"))
    return found.select("source_id", "frames", "duration", F.when(F.col("duration") > 0, F.col("frames") / F.col("duration")).otherwise(30.0).alias("fps"))


def legacy_format(kind: Column) -> Column:
    """Texture format that the type byte of an older packet tells."""
    version = F.pmod(kind.bitwiseAND(15) - 1, F.lit(256))
    return F.when(kind.bitwiseAND(64) != 0, "dxt5").when((kind.bitwiseAND(32) != 0) | (version == 1), "dxt1")


def peek_variants(packets: DataFrame) -> DataFrame:
    """variant: what the head of the first packet says (generation dxv3: a tag back to front in 12 bytes; dxv1: a type byte), else what the sample description said (described)."""
    tagged = F.when(F.octet_length("head") >= 12, lookup(VARIANTS, ascii_at("head", 0, 4, backwards=True)))
    peeked = F.when(F.col("generation") == "dxv3", tagged).otherwise(legacy_format(le_int("head", 3, 1)))
    return packets.withColumns({"variant": F.coalesce(peeked, "described"), "peeked": peeked.isNotNull()})


def resolve_dims(headers: DataFrame) -> DataFrame:
    """w and h: the sample description's, or where zero the track header's, which are in 1/65536."""
    return headers.withColumns({s: F.when(F.col(f"stsd_{s}") > 0, F.col(f"stsd_{s}")).otherwise(F.shiftright(f"tkhd_{s}", 16)) for s in "wh"})


def read_packets(index: DataFrame, contents: DataFrame) -> DataFrame:
    """index (source_id, idx, file_offset, size) with packet, actual and short_read: size bytes of each source's content from the offset on, fewer where it ends before.

    A source's entries come to its content as one list, so the content is carried once and not for each entry. Entries of a source without content read nothing.
    """
    entries = index.groupBy("source_id").agg(F.collect_list(F.struct("idx", "file_offset", "size")).alias("entries"))
    data = F.coalesce("content", F.lit(b""))
    read = F.transform("entries", lambda e: F.struct(e.idx.alias("idx"), e.file_offset.alias("file_offset"), e["size"].alias("expected"), F.substring(data, (e.file_offset + 1).cast("int"), e["size"].cast("int")).alias("packet")))
    rows = entries.join(contents, "source_id", "left").select("source_id", F.inline(read))
    return rows.withColumn("actual", F.octet_length("packet").cast("long")).withColumn("short_read", F.col("actual") < F.col("expected"))


def entries_covering(contents: DataFrame, size: Value) -> DataFrame:
    """An index of entries of size bytes that covers each source's content; the last one's may end early, and an empty content has one that reads none."""
    n = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    rows = contents.select("source_id", col(size).cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), idiv(F.greatest(F.lit(0), n - 1), size))).alias("idx"))
    return rows.withColumn("file_offset", F.col("idx") * F.col("size"))


def estimate_frames(duration: Value, fps: Value) -> Column:
    return F.round(col(duration) * col(fps)).cast("long")


def rational_fps(tracks: DataFrame) -> DataFrame:
    """fps: timescale / value of the shortest frame's duration, else nominal."""
    fine = (F.col("value") > 0) & (F.col("timescale") > 0)
    return tracks.withColumn("fps", F.when(fine, F.col("timescale") / F.col("value")).otherwise(F.col("nominal").cast("double")))


def probe_alpha(streams: DataFrame) -> DataFrame:
    """has_alpha: what the stream says itself (contains_alpha), else its code, else null."""
    return streams.withColumn("has_alpha", F.coalesce("contains_alpha", lookup(ALPHA_CODES, "fourcc")))


def resolve_audio_rates(tracks: DataFrame) -> DataFrame:
    """rate: the reader's (primary), else the track's (nominal), else an error where there is sound, and 48,000 without; channels_ok: 1 to 64."""
    rate = F.when(F.col("primary") > 0, F.col("primary")).when(F.col("nominal") > 0, F.col("nominal")).when(~F.col("has_pcm"), 48_000)
    return tracks.withColumns({"channels_ok": F.col("channels").between(1, 64), "rate": rate, "error": F.when(rate.isNull(), "unknown rate")})


def first_frames(frames: DataFrame) -> DataFrame:
    """The frame of smallest number of each source."""
    return frames.groupBy("source_id").agg(F.min_by(F.struct(*[c for c in frames.columns if c != "source_id"]), "frame_no").alias("first")).select("source_id", "first.*")


def movies(urls: DataFrame, path: str = "path", extensions: tuple[str, ...] = MOVIE_EXTENSIONS) -> DataFrame:
    """Rows whose path ends in a movie's extension, in any case."""
    return path_parts(urls, path).where(F.lower("ext").isin(*extensions)).select(urls.columns)


def skipped_movies(urls: DataFrame, path: str = "path", extensions: tuple[str, ...] = MOVIE_EXTENSIONS) -> DataFrame:
    """dropped and skipped: how many rows there are, and how many movies leaves out."""
    return path_parts(urls, path).agg(F.count("*").alias("dropped"), F.count_if(~F.lower("ext").isin(*extensions)).alias("skipped"))


def stco_offsets(packets: DataFrame, first: int = 36) -> DataFrame:
    """file_offset of packets that follow each other from first on."""
    return packets.withColumn("file_offset", F.coalesce(F.sum("size").over(_before(["frame_no"])), F.lit(0)) + first)


def derive_timescale(rows: DataFrame) -> DataFrame:
    """timescale and delta of fps: whole rates in 1/512, 29.97 and 23.976 in 1/1001, all within 1e-6; others have none."""
    near = lambda x: F.abs(F.col("fps") - x) < 1e-6
    whole = near(F.round("fps")) & (F.round("fps") > 0)
    scale = F.when(whole, (F.round("fps") * 512).cast("long")).when(near(29.97), 30_000).when(near(23.976), 24_000)
    return rows.withColumns({"timescale": scale, "delta": F.when(whole, 512).when(scale.isNotNull(), 1001), "error": F.when(scale.isNull(), "unsupported rate")})


def movie_durations(movies: DataFrame) -> DataFrame:
    """video_ms and ms: frames * delta / timescale in whole milliseconds, and the longer of it and audio_ms."""
    video = idiv(F.col("frames") * 1000 * F.col("delta"), "timescale")
    return movies.withColumns({"video_ms": video, "ms": F.greatest(video, F.coalesce("audio_ms", F.lit(0)))})


def audio_entries(tracks: DataFrame) -> DataFrame:
    """entry: in32 for rates of up to 65,535, which 16 bits hold, lpcm beyond; layout of the channels."""
    return tracks.withColumns({"entry": F.when(F.col("rate") <= 65_535, "in32").otherwise("lpcm"), "layout": lookup({1: "mono", 2: "stereo"}, "channels", F.lit("discrete"))})


def guard_muxes(movies: DataFrame) -> DataFrame:
    """error of movies whose media (video_bytes and audio_bytes, behind 8 bytes of head) exceed 32 bits, or whose sound would begin beyond them."""
    size = F.col("video_bytes") + F.coalesce("audio_bytes", F.lit(0)) + 8
    late = F.coalesce("audio_bytes", F.lit(0)) > 0
    return movies.withColumn("error", F.when(size > 0xFFFFFFFF, "mdat over 4 GB").when(late & (F.col("first") + F.col("video_bytes") > 0xFFFFFFFF), "audio offset over 4 GB"))


def valid_fourcc(code: Value) -> Column:
    """Four ASCII characters, of any kind."""
    return F.coalesce(col(code).rlike(r"^[\x00-\x7f]{4}\z"), F.lit(False))


def compression_properties(settings: DataFrame) -> DataFrame:
    """What an encoder is told: quality or bit_rate (megabits * 1e6), key_frame if above zero, and profile for h264 only."""
    by_rate = F.col("mode") == "bitrate"
    return settings.select(
        *[c for c in settings.columns if c not in ("quality", "megabits", "interval", "profile", "mode")],
        F.when(~by_rate, F.col("quality")).alias("quality"),
        F.when(by_rate, (F.col("megabits") * 1_000_000).cast("long")).alias("bit_rate"),
        F.when(F.col("interval") > 0, F.col("interval")).alias("key_frame"),
        F.when(F.col("codec") == "h264", F.col("profile")).alias("profile"),
    )


def densest_window(packets: DataFrame, frames: int = 30) -> DataFrame:
    """last_frame and bytes of the window of that many frames with the most bytes, the first of equals; shorter sources have none."""
    w = Window.partitionBy("source_id").orderBy("frame_no").rowsBetween(1 - frames, 0)
    rows = packets.select("source_id", "frame_no", F.sum("size").over(w).alias("bytes"), F.count("*").over(w).alias("n")).where(F.col("n") == frames)
    return rows.groupBy("source_id").agg(F.max_by(F.struct("frame_no", "bytes"), F.struct("bytes", -F.col("frame_no"))).alias("best")).select("source_id", F.col("best.frame_no").alias("last_frame"), "best.bytes")
