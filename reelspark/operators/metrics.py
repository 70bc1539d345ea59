"""Fidelity metrics over pixel pairs, and playback statistics (M rows of the blueprint)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Value, col, idiv

WINDOW = 8
K1, K2, TOP = 0.01, 0.03, 255


def ssim(pairs: DataFrame) -> DataFrame:
    """Mean structural similarity of each frame's lumas a and b, over disjoint 8 x 8 windows with population variances; windows cut by the edge are left out."""
    s = lambda x: F.sum(x).cast("double") / WINDOW**2
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    cells = pairs.groupBy("frame_no", idiv("y", WINDOW).alias("wy"), idiv("x", WINDOW).alias("wx"))
    m = cells.agg(F.count("*").alias("n"), s(a).alias("ma"), s(b).alias("mb"), s(a * a).alias("aa"), s(b * b).alias("bb"), s(a * b).alias("ab")).where(F.col("n") == WINDOW**2)
    c1, c2 = (K1 * TOP) ** 2, (K2 * TOP) ** 2
    score = F.expr(f"((2 * ma * mb + {c1!r}D) * (2 * (ab - ma * mb) + {c2!r}D)) / ((ma * ma + mb * mb + {c1!r}D) * ((aa - ma * ma) + (bb - mb * mb) + {c2!r}D))")
    return m.groupBy("frame_no").agg(F.avg(score).alias("ssim"))


def channel_deltas(pairs: DataFrame, channels: list[str]) -> DataFrame:
    """mean_c and max_c of |a_c - b_c| for each channel c and frame."""
    gap = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    return pairs.groupBy("frame_no").agg(*[F.avg(gap(c)).alias(f"mean_{c}") for c in channels], *[F.max(gap(c)).alias(f"max_{c}") for c in channels])


def psnr(pairs: DataFrame, channels: list[str]) -> DataFrame:
    """db of each frame over the channels given: colours, or alpha alone; null for equal frames."""
    squares = sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in channels), F.lit(0.0))
    mse = F.avg(squares) / len(channels)
    return pairs.groupBy("frame_no").agg(mse.alias("mse")).select("frame_no", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(255.0 * 255.0) / F.col("mse"))).alias("db"))


def mean_psnr(frames: DataFrame) -> DataFrame:
    return frames.agg(F.avg("db").alias("db"))


def worst_frames(scores: DataFrame, score: str, *keys: str) -> DataFrame:
    """The smallest score of each group, or of all, and its frame, the first of equals."""
    found = F.min(F.struct(F.col(score).alias("score"), "frame_no")).alias("worst")
    return scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(found).select(*keys, "worst.*")


def size_ratios(sizes: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """ratio of each key's bytes to its baseline's; null where that is missing or zero."""
    rows = sizes.groupBy(key).agg(F.sum("bytes").alias("bytes")).join(baselines.groupBy(key).agg(F.sum("bytes").alias("baseline")), key, "left")
    return rows.withColumn("ratio", F.when(F.col("baseline") > 0, F.col("bytes") / F.col("baseline")))


def decode_stats(decodes: DataFrame, interval: float = 1.0) -> DataFrame:
    """A report (player_id, seconds, frames, mean_ms, max_ms, dropped) with the first decode that comes interval seconds or more after a player's last report, of all since; the first decode of a player is one itself.

    decodes: player_id, seconds, ms, dropped (requests dropped since the
    decode before). Each player's decodes pass in order through one task, which
    holds only the sums since the last report. A report depends on when the last one
    was, and so on all before it: no window tells that, and a loop over a player's
    decodes is its price.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, last, n, total, top, lost = None, None, 0, 0.0, 0.0, 0
        for batch in batches:
            out = []
            for p, at, ms, drop in zip(batch.player_id.tolist(), batch["seconds"].tolist(), batch.ms.tolist(), batch.dropped.tolist()):
                if p != player:
                    player, last, n, total, top, lost = p, float("-inf"), 0, 0.0, 0.0, 0
                n, total, top, lost = n + 1, total + ms, max(top, ms), lost + drop
                if at - last >= interval:
                    out.append((p, at, n, total / n, top, lost))
                    last, n, total, top, lost = at, 0, 0.0, 0.0, 0
            yield pd.DataFrame(out, columns=["player_id", "seconds", "frames", "mean_ms", "max_ms", "dropped"])

    rows = decodes.select(F.col("player_id").cast("long").alias("player_id"), F.col("seconds").cast("double").alias("seconds"), F.col("ms").cast("double").alias("ms"), F.col("dropped").cast("long").alias("dropped"))
    return rows.repartition("player_id").sortWithinPartitions("player_id", "seconds").mapInPandas(run, "player_id long, seconds double, frames long, mean_ms double, max_ms double, dropped long")


def drop_intermediate(requests: DataFrame, services: DataFrame) -> DataFrame:
    """What each service (player_id, seconds) does with the requests (player_id, seconds, frame) that came since the one before: the last is served, the others are dropped. Requests after the last service aren't in it."""
    rows = requests.select("player_id", "seconds", "frame", F.lit(None).cast("double").alias("service")).unionByName(services.select("player_id", "seconds", F.lit(None).cast("long").alias("frame"), F.col("seconds").cast("double").alias("service")))
    # from the end, so that the frame only grows
    w = Window.partitionBy("player_id").orderBy(F.desc("seconds"), F.col("service").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.withColumn("service", F.last("service", ignorenulls=True).over(w)).where("frame is not null and service is not null")
    return dealt.groupBy("player_id", "service").agg(F.max_by("frame", "seconds").alias("served"), (F.count("*") - 1).alias("dropped"))


def skipped_frames(shown: DataFrame) -> DataFrame:
    """skipped: frames that a player left out between those it showed, in order of seq; steps back count none."""
    step = F.col("frame") - F.lag("frame").over(Window.partitionBy("player_id").orderBy("seq"))
    return shown.withColumn("__step", step).groupBy("player_id").agg(F.coalesce(F.sum(F.greatest(F.col("__step") - 1, F.lit(0))), F.lit(0)).alias("skipped"))


def frames_at(clocks: DataFrame) -> DataFrame:
    """frame and paused of clocks: start plus whole frames of elapsed seconds; looping goes round total, else the last frame stays and pauses. Without frames or rate the start stays."""
    runs = (F.col("total") > 0) & (F.col("fps") > 0)
    target = F.col("start") + F.floor(F.col("elapsed") * F.col("fps"))
    last = F.col("total") - 1
    frame = F.when(~runs, F.col("start")).when(F.col("looping"), F.pmod(target, F.greatest(F.lit(1), "total"))).otherwise(F.greatest(F.lit(0), F.least(target, last)))
    return clocks.withColumns({"frame": frame, "paused": runs & ~F.col("looping") & (target >= last)})


def job_progress(jobs: DataFrame, lo: Value = 0) -> DataFrame:
    """progress: 1 for done; while encoding the share written of the frames from lo up to total, of one frame where that range is empty or total isn't known; 0 else."""
    frames = F.greatest(F.lit(1), F.coalesce("total", F.lit(0)) - F.greatest(F.lit(0), col(lo)))
    share = F.least(F.lit(1.0), F.coalesce("written", F.lit(0)) / frames)
    return jobs.withColumn("progress", F.when(F.col("status") == "done", 1.0).when(F.col("status") == "encoding", share).otherwise(0.0))


def overall_progress(jobs: DataFrame, *keys: str) -> DataFrame:
    """Mean progress of all jobs; null without jobs."""
    return job_progress(jobs).groupBy(*keys).agg(F.avg("progress").alias("progress"))


def with_pair(frames: DataFrame, shift: Value = 1) -> DataFrame:
    """Each frame (frame_no, and arrays) beside that shift later, as columns a_ and b_: one join of frames, not of pixels."""
    names = [c for c in frames.columns if c != "frame_no"]
    left = frames.select("frame_no", *[F.col(c).alias(f"a_{c}") for c in names])
    return left.join(frames.select((F.col("frame_no") - col(shift)).alias("frame_no"), *[F.col(c).alias(f"b_{c}") for c in names]), "frame_no")
