"""Jobs, collisions, presets, markers and opened files (Q1-Q17 of the blueprint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Value, clamp, col, idiv, lookup, unused
from .naming import frame_of_timecode, trimmed

# Formats by quality tier and alpha, and the tier of each.
FORMATS = {("normal", False): "dxt1", ("normal", True): "dxt5", ("hq", False): "ycg6", ("hq", True): "yg10", ("hap", False): "hap1", ("hap", True): "hap5", ("hap_q", False): "hapy", ("hap_q", True): "hapm"}
TIERS = {f: t for (t, _), f in FORMATS.items()} | {"hapa": "hap"}
ALPHA = {f: a for (_, a), f in FORMATS.items()} | {"hapa": True}
#: Highest sample rate of a container's sound; others have none.
AUDIO_CAPS = {"mp4": 48_000}


def enqueue(urls: DataFrame, held: int = 0, queue: str = "queue_id", order: str = "seq", **defaults) -> DataFrame:
    """Jobs for urls in their order within each queue, behind held ones, with the defaults of now."""
    position = F.row_number().over(Window.partitionBy(queue).orderBy(order)) - 1 + held
    return urls.withColumns({"position": position, "status": F.lit("queued")} | {k: F.lit(v) for k, v in defaults.items()})


def job_states(events: DataFrame) -> DataFrame:
    """job_id, status and error from job events (seq, kind: queue, start, finish, fail, cancel): the first end of a job stays, whatever comes behind it."""
    ends = F.col("kind").isin("finish", "fail", "cancel")
    by_job = events.groupBy("job_id").agg(F.min_by(F.when(ends, F.col("kind")), F.when(ends, F.col("seq"))).alias("end"), F.bool_or(F.col("kind") == "start").alias("started"))
    status = F.when(F.col("end") == "finish", "done").when(F.col("end").isNotNull(), "failed").when(F.col("started"), "encoding").otherwise("queued")
    return by_job.select("job_id", status.alias("status"), F.when(F.col("end") == "cancel", "Cancelled").alias("error"))


def serial_runs(jobs: DataFrame, queue: str = "queue_id", order: str = "position") -> DataFrame:
    """start_ms, end_ms, status and error of jobs that each queue runs one after another, in order.

    arrival_ms: when a job is there; cost_ms: how long it takes. cancelled: while it
    waited, so it never starts and takes no time. stopped_ms: cancelled so long after
    its start, if that is before its end. fails: ends with an error. stop_all_ms: when
    its whole queue is cancelled, which ends the job that runs and keeps later ones
    from starting. Nulls of these mean never, and 0 for times. status is done or failed,
    error what went wrong; jobs that never start have no times.

    A job starts at its arrival or at the end before it, whichever is later. Unrolled,
    that is the time spent before it and the largest of (arrival - time spent before)
    up to it: two running windows of a queue, no job-by-job loop.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    runs, stopped = ~F.coalesce("cancelled", F.lit(False)), F.col("stopped_ms").cast("long")
    halted = F.coalesce(stopped < number("cost_ms"), F.lit(False))
    spent, before, slack = (unused(jobs, c) for c in ("spent", "before", "slack"))
    w = Window.partitionBy(queue).orderBy(order)
    rows = jobs.withColumn(spent, F.when(runs, F.when(halted, F.greatest(stopped, F.lit(0))).otherwise(number("cost_ms"))).otherwise(0))
    rows = rows.withColumn(before, F.coalesce(F.sum(spent).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn(slack, F.max(F.when(runs, number("arrival_ms") - F.col(before))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start, stop = F.col(before) + F.col(slack), F.col("stop_all_ms").cast("long")
    end = start + F.col(spent)
    started = runs & F.coalesce(start < stop, F.lit(True))
    cut = F.coalesce(stop < end, F.lit(False))
    error = F.when(~started | cut | halted, "Cancelled").when(F.coalesce("fails", F.lit(False)), "Failed")
    made = {"start_ms": F.when(started, start), "end_ms": F.when(started, F.when(cut, stop).otherwise(end)), "status": F.when(error.isNull(), "done").otherwise("failed"), "error": error}
    return rows.withColumns(made).drop(spent, before, slack)


def collision_actions(jobs: DataFrame) -> DataFrame:
    """action of each job of a session, in order of position: proceed, rename, skip, cancel or not_run.

    taken: the output exists; policy: ask, overwrite or rename; decision: the answer
    where it is asked (overwrite, rename, skip, cancel); for_all: that answer holds
    for the rest of the session, whatever their policy. A cancel ends the session.
    """
    w = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    asks = F.col("taken") & (F.col("policy") == "ask")
    # nothing is asked once an answer holds for all, so the first such answer is the one
    answer = F.when(asks & F.col("for_all") & (F.col("decision") != "cancel"), F.col("decision"))
    held, over = unused(jobs, "held_answer"), unused(jobs, "is_over")
    rows = jobs.withColumn(held, F.first(answer, ignorenulls=True).over(w))
    asked = asks & F.col(held).isNull()
    rows = rows.withColumn(over, F.coalesce(F.bool_or(asked & (F.col("decision") == "cancel")).over(w), F.lit(False)))
    chosen = F.coalesce(held, F.when(asks, F.col("decision")).otherwise(F.col("policy")))
    action = F.when(F.col(over), "not_run").when(~F.col("taken") | (chosen == "overwrite"), "proceed").otherwise(chosen)
    return rows.withColumn("action", action).drop(held, over)


def format_of(tier: Value, alpha: Value) -> Column:
    return lookup({f"{t} {str(a).lower()}": f for (t, a), f in FORMATS.items()}, F.concat_ws(" ", col(tier), col(alpha).cast("string")))


def steer_prores(jobs: DataFrame) -> DataFrame:
    """steered: the variant for the source's alpha (has_alpha, or what the format says), and flattens: whether the chosen variant loses it."""
    alpha = F.coalesce("has_alpha", lookup(ALPHA, "format"))
    return jobs.withColumns({"steered": F.when(alpha, "ap4h").otherwise("apcn"), "flattens": F.coalesce(F.col("variant").isNotNull() & (F.col("variant") != "ap4h") & alpha, F.lit(False))})


def clamp_audio(jobs: DataFrame) -> DataFrame:
    """rate: the requested or the source's rate, within the container's; warned where that is less than it."""
    wanted, cap = F.coalesce("requested", "source_rate"), lookup(AUDIO_CAPS, "container")
    return jobs.withColumns({"rate": F.least(wanted, cap), "warned": F.coalesce(wanted > cap, F.lit(False))})


def upsert_presets(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Presets (id, name, width, height) after fresh ones (seq too) were added in order: same name but for case and outer space gives new size and name under the old id; blank names are left out."""
    key = F.lower(trimmed("name"))
    rows = held.select("id", "name", "width", "height", F.lit(None).cast("long").alias("seq")).unionByName(fresh.select("id", trimmed("name").alias("name"), "width", "height", F.col("seq").cast("long").alias("seq")).where("name <> ''"))
    at = F.coalesce("seq", F.lit(-(2**62)))
    out = rows.withColumn("key", key).groupBy("key").agg(F.min_by("id", at).alias("id"), F.max_by(F.struct("name", "width", "height"), at).alias("last"))
    return out.select("id", "last.name", "last.width", "last.height")


def remove_presets(held: DataFrame, removed: DataFrame) -> DataFrame:
    return held.join(removed.select("id"), "id", "left_anti")


def selected_after_removal(jobs: DataFrame, queue: str = "queue_id", order: str = "position") -> DataFrame:
    """selected: what is selected once this row, selected before, was removed: the next of its queue, else the last, else none."""
    w = Window.partitionBy(queue).orderBy(order)
    return jobs.withColumn("selected", F.coalesce(F.lead("job_id").over(w), F.lag("job_id").over(w)))


def merge_probes(jobs: DataFrame, probes: DataFrame) -> DataFrame:
    """Jobs with width, height, fps and frame_count filled in from probes (job_id, the same, error and typed); what is known stays. A typed error fails the job, another leaves it as it is."""
    fields = ["width", "height", "fps", "frame_count"]
    probe = unused(jobs, "probe")
    found = probes.select("job_id", F.struct(*fields, "error", "typed").alias(probe))
    rows, of = jobs.join(found, "job_id", "left"), lambda c: F.col(f"{probe}.{c}")
    failed = F.coalesce(of("error").isNotNull() & of("typed"), F.lit(False))
    filled = {c: F.when(of("error").isNull(), F.coalesce(F.col(c), of(c))).otherwise(F.col(c)) for c in fields}
    out = {"status": F.when(failed, "failed").otherwise(F.col("status")), "message": F.when(failed, F.concat(F.lit("Unusable source: "), of("error")))}
    return rows.withColumns(filled | out).select(*[c for c in jobs.columns if c != "message"], "message")


def edit_trim(edits: DataFrame) -> DataFrame:
    """in_frame and out_frame after an edit at current (action: set_in, set_out, clear): a marker pushes the other along."""
    now, a, b = F.col("current"), F.col("in_frame"), F.col("out_frame")
    first = F.when(F.col("action") == "set_in", now).when((F.col("action") == "set_out") & (a > now), now).when(F.col("action") == "clear", None).otherwise(a)
    last = F.when(F.col("action") == "set_out", now).when((F.col("action") == "set_in") & (b < now), now).when(F.col("action") == "clear", None).otherwise(b)
    return edits.withColumns({"in_frame": first, "out_frame": last})


def snap_playhead(players: DataFrame) -> DataFrame:
    """seek: where a playhead outside the trim goes, null for inside; paused: whether it stops there. While playing, one beyond the end goes to the start if looping, else to the end, and stops; when still, it goes to the start."""
    some = F.coalesce("in_frame", "out_frame").isNotNull()
    lo, hi = F.coalesce("in_frame", F.lit(0)), F.coalesce("out_frame", F.col("total") - 1)
    beyond, before = some & (F.col("current") > hi), some & (F.col("current") < lo)
    stops = beyond & F.col("playing") & ~F.col("looping")
    seek = F.when(stops, hi).when(beyond | before, lo)
    return players.withColumns({"seek": clamp(seek, 0, F.col("total") - 1), "paused": stops}).withColumn("seek", F.when(beyond | before, F.col("seek")))


def frame_at_x(x: Value, width: Value, total: Value) -> Column:
    x, width, total = col(x), col(width), col(total)
    share = clamp(x, F.lit(0.0), width) / width
    return F.when((total > 1) & (width > 0), F.round(share * (total - 1)).cast("long")).otherwise(0)


def x_of_frame(frame: Value, width: Value, total: Value) -> Column:
    return F.when(col(total) > 1, clamp(col(frame) / (col(total) - 1), F.lit(0.0), F.lit(1.0)) * col(width)).otherwise(0.0)


def checker_dark(x: Value, y: Value, tile: Value) -> Column:
    """Whether a place counted from the board's corner is in a dark tile; the first is dark."""
    return (idiv(x, tile) + idiv(y, tile)) % 2 == 0


def audio_master_frames(ticks: DataFrame, player: str = "player_id", order: str = "seq") -> DataFrame:
    """Ticks that move the picture, with frame: the sound's time in frames, within the clip; the last frame within half a frame of the end unless looping. Repeats are left out, per player."""
    last = F.greatest(F.lit(0), F.col("total") - 1)
    ended = ~F.col("looping") & (F.col("time") >= F.col("duration") - 0.5 / F.col("fps"))
    frame = F.when(ended, last).otherwise(clamp(F.round(F.col("time") * F.col("fps")).cast("long"), 0, F.col("total") - 1))
    w = Window.partitionBy(player).orderBy(order)
    before = unused(ticks, "frame_before")
    rows = ticks.where("fps > 0").withColumn("frame", frame).withColumn(before, F.lag("frame").over(w))
    return rows.where(F.col(before).isNull() | (F.col(before) != F.col("frame"))).drop(before)


def deliver_opened(opened: DataFrame, receivers: DataFrame, session: str = "session_id") -> DataFrame:
    """opened (session, seq) with delivered_at and nth: what came before the session's receiver (installed_at) waits for it and is handed over once, in order; null without one."""
    at = unused(opened, "first_receiver")
    rows = opened.join(receivers.groupBy(session).agg(F.min("installed_at").alias(at)), session, "left")
    rows = rows.withColumn("delivered_at", F.when(F.col(at).isNotNull(), F.greatest("seq", at))).drop(at)
    nth = F.row_number().over(Window.partitionBy(session).orderBy("delivered_at", "seq"))
    return rows.withColumn("nth", F.when(F.col("delivered_at").isNotNull(), nth))


def commit_names(edits: DataFrame) -> DataFrame:
    """value and changed of a typed name: without outer space; blank or the same gives back the current one."""
    text = trimmed("text")
    changed = (text != "") & (text != F.col("current"))
    return edits.withColumns({"value": F.when(changed, text).otherwise(F.col("current")), "changed": changed})


def commit_timecodes(edits: DataFrame) -> DataFrame:
    """frame or error (rate, format, range) of a typed timecode within total frames."""
    frame, last = frame_of_timecode("text", "fps"), F.greatest(F.lit(0), F.col("total") - 1)
    error = F.when(~(F.col("fps") > 0), "rate").when(frame.isNull(), "format").when(frame > last, "range")
    return edits.withColumns({"frame": F.when(error.isNull(), frame), "error": error})


def previewable(jobs: DataFrame, version: Value = "version", writer: str = "reelspark") -> DataFrame:
    """loadable: whether a job can be shown, and writer: who is named as writer, with the version where there is one."""
    return jobs.withColumns({"loadable": F.col("status") != "failed", "writer": F.concat_ws(" ", F.lit(writer), col(version))})
