"""Every media query against DuckDB SQL of its own, and golden rows of operators on tables made here."""

import math
import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelspark import plans
from reelspark.operators import blocks, colour, container, geometry, metrics, naming, queue, streams
from reelspark.plans.fixtures import TABLES, Inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("key", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, key):
    got = plans.QUERIES[key](spark, SF)
    want = duck.execute(plans.ORACLE_SQL[key])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_every_sql_ends_under_an_outer_limit(duck):
    stalled = []
    for key, sql in sorted(plans.ORACLE_SQL.items()):
        timer = threading.Timer(10, duck.interrupt)
        timer.start()
        try:
            duck.execute(f"select * from ({sql}) q limit 2000000").fetchall()
        except duckdb.InterruptException:
            stalled.append(key)
        finally:
            timer.cancel()
    assert not stalled


def test_queries_leave_the_sessions_views_alone(spark):
    spark.range(3).createOrReplaceTempView("events")
    plans.QUERIES["first_frame"](spark, SF).collect()
    assert spark.table("events").count() == 3
    spark.catalog.dropTempView("events")


@pytest.mark.parametrize("key, scans", [("ycocg_forward", 1), ("scaled_ycocg", 1), ("crop_pixels", 1), ("bc1_endpoints", 1), ("bc1_match", 1), ("bc4_encode", 1), ("bc4_refined", 1), ("ssim_8x8", 2), ("channel_delta", 2), ("psnr", 2)])
def test_planes_are_read_once_for_each_side(spark, key, scans):
    plan = plans.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == scans
    assert plan.count("Join") == scans - 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def px(spark, values, w, channels="rgb"):
    return spark.createDataFrame([(0, i // w, i % w, *v) for i, v in enumerate(values)], ["frame_no", "y", "x", *channels])


def rect(df):
    r = df.first()
    return r.x, r.y, r.w, r.h


@pytest.mark.parametrize("rgb, want", [((255, 0, 0), (64, 127, -64)), ((0, 0, 255), (64, -128, -64)), ((0, 255, 0), (128, 0, 127))])
def test_ycocg_golden(spark, rgb, want):
    assert tuple(colour.ycocg_forward(px(spark, [rgb], 1)).select("luma", "co", "cg").first()) == want


def test_chroma_golden_and_padding(spark):
    assert [(r.co, r.cg) for r in colour.chroma_planes(px(spark, [(200, 100, 50)] * 4, 2), 2, 2, 2, 2).collect()] == [(203, 115)]
    single = px(spark, [(200, 100, 50)], 1)
    assert [(r.co, r.cg) for r in colour.chroma_planes(single, 1, 1, 2, 2).collect()] == [(203, 115)]
    assert [r.luma for r in colour.luma_plane(single, 1, 1, 2, 2).orderBy("y", "x").collect()] == [113, 0, 0, 0]


def test_alpha_both_ways(spark):
    p = px(spark, [(100, 50, 0, 128)], 1, "rgba")
    out = lambda df: tuple(df.select("r", "g", "b", "a").first())
    assert out(colour.unpremultiply(p, F.lit("unpremultiply"))) == (199, 100, 0, 128)
    assert out(colour.unpremultiply(p, F.lit("opaque"))) == (100, 50, 0, 255)
    assert out(colour.premultiply(p, F.lit("straight"))) == (50, 25, 0, 128)
    assert out(colour.premultiply(p, F.lit("premultiplied"))) == (100, 50, 0, 128)


def test_match_table_golden():
    five, six = colour.match_table(5), colour.match_table(6)
    assert five[:6] == [(0, 0), (0, 0), (0, 1), (0, 1), (1, 0), (1, 0)] and five[11] == (0, 4) and five[255] == (31, 31)
    assert six[:6] == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (2, 0)] and six[255] == (63, 63)


def scalar(spark, values):
    return blocks.blocks(px(spark, [(v,) for v in values], 4, "v"), ["v"])


def decoded(df):
    return df.select(blocks.decode_scalars("a0", "a1", "indices").alias("v")).first().v


def test_scalar_blocks_golden(spark):
    two = [0] * 8 + [255] * 8
    assert decoded(blocks.encode_scalars(scalar(spark, two))) == two
    ramp = list(range(0, 256, 16))
    gaps = [abs(a - b) for a, b in zip(ramp, decoded(blocks.encode_scalars(scalar(spark, ramp))))]
    assert max(gaps) <= 18 and sum(gaps) / 16 <= 9
    # encoders round where decoders cut off
    made = lambda half: spark.range(1).select(blocks.palette(F.lit(200), F.lit(10), half)).first()[0]
    assert made(blocks.ROUNDED) != made(blocks.CUT)


def test_refined_blocks_by_brute_force(spark):
    def palette(a, b, eight):
        n = 7 if eight else 5
        return [a, b] + [((n - k) * a + k * b + n // 2) // n for k in range(1, n)] + ([] if eight else [0, 255])

    rows_ = blocks.refine_scalars(blocks.blocks(Inputs(spark, SF)("px_luma").where("frame_no < 12"), ["luma"]).withColumnRenamed("luma", "v")).collect()
    assert len(rows_) == 48
    for r in rows_:
        v, best = r.v, None
        for mode, low, high in [(mode, low, high) for mode in (0, 1) for low in range(-3, 4) for high in range(-3, 4)]:
            a, b = min(255, max(0, max(v) + high)), min(255, max(0, min(v) + low))
            if a == b:
                continue
            a, b = (max(a, b), min(a, b)) if mode == 0 else (min(a, b), max(a, b))
            entries = palette(a, b, mode == 0)
            codes = [min(range(8), key=lambda k: ((x - entries[k]) ** 2, k)) for x in v]
            error = sum((x - entries[c]) ** 2 for x, c in zip(v, codes))
            if best is None or error < best[0]:
                best = (error, a, b, sum(c << 3 * i for i, c in enumerate(codes)))
        assert (r.error, r.a0, r.a1, r.indices) == (best if min(v) < max(v) else (0, v[0], v[0], 0))


def test_constant_colour_blocks_decode_to_their_colour(spark):
    for rgb in ((0, 0, 0), (200, 17, 99), (255, 255, 255)):
        made = blocks.constant_colours(blocks.blocks(px(spark, [rgb] * 16, 4), list("rgb")))
        r = blocks.decode_colours(blocks.ordered_ends(made)).first()
        assert all(abs(r[c][i] - v) <= 2 for c, v in zip("rgb", rgb) for i in range(16)) and set(r.a) == {255}
    assert blocks.constant_colours(blocks.blocks(px(spark, [(1, 2, 3)] * 15 + [(1, 2, 4)], 4), list("rgb"))).isEmpty()


def test_colour_blocks_keep_a_picture(spark):
    """Endpoints, places and bytes of real blocks decode to colours near the source's."""
    px_rgb = Inputs(spark, SF)("px_rgb").where("frame_no < 50")
    coded = blocks.ordered_ends(blocks.colour_indices(blocks.colour_endpoints(blocks.blocks(px_rgb, list("rgb")))))
    back = blocks.pixels(blocks.decode_colours(coded), list("rgb"))
    gap = back.select("frame_no", "y", "x", *[F.col(c).alias(f"b_{c}") for c in "rgb"]).join(px_rgb, ["frame_no", "y", "x"]).agg(*[F.avg(F.abs(F.col(c) - F.col(f"b_{c}"))) for c in "rgb"]).first()
    assert coded.count() == 200 and coded.where("c0 < c1").isEmpty() and max(gap) < 45


def test_swapped_ends_keep_the_picture(spark):
    row = lambda c0, c1, mask: one(spark, frame_no=0, block_y=0, block_x=0, c0=c0, c1=c1, mask=mask)
    swapped = blocks.decode_colours(blocks.ordered_ends(row(100, 50_000, 0b11100100)), True).first()
    assert swapped.r == blocks.decode_colours(row(100, 50_000, 0b11100100), True).first().r


def test_ssim_of_equal_frames_is_one(spark):
    pairs = spark.range(64).selectExpr("0 as frame_no", "id div 8 as y", "id % 8 as x", "id * 3 as a", "id * 3 as b")
    assert metrics.ssim(pairs).first().ssim == 1.0
    # a window cut by the edge is left out
    assert metrics.ssim(pairs.where("x < 7")).collect() == []


def test_decode_reports(spark):
    seen = [(1, 0.0, 5.0, 0), (1, 0.4, 7.0, 1), (1, 0.9, 3.0, 0), (1, 1.1, 1.0, 2), (2, 5.0, 2.0, 0), (1, 2.2, 4.0, 0)]
    got = metrics.decode_stats(spark.createDataFrame(seen, "player_id long, seconds double, ms double, dropped long"))
    assert sorted((r.player_id, r.seconds, r.frames, round(r.mean_ms, 4), r.max_ms, r.dropped) for r in got.collect()) == [(1, 0.0, 1, 5.0, 5.0, 0), (1, 1.1, 3, 3.6667, 7.0, 3), (1, 2.2, 1, 4.0, 4.0, 0), (2, 5.0, 1, 2.0, 2.0, 0)]


CROP = {"src_w": 1920, "src_h": 1080, "x": 100, "y": 100, "w": 200, "h": 200}


def test_crop_drags_golden(spark):
    crop = one(spark, **CROP)
    drag = lambda corner, x, y, a=4: rect(geometry.crop_drag(crop, F.lit(x), F.lit(y), F.lit(corner), F.lit(a)))
    assert drag("bottom_right", 401.0, 399.0) == (100, 100, 300, 300)
    assert drag("bottom_right", 5000.0, 5000.0) == (100, 100, 1820, 980)
    assert drag("bottom_right", 0.0, 0.0) == (100, 100, 4, 4)
    assert drag("top_left", 1.0, 1.0) == (0, 0, 300, 300)
    assert drag("top_left", 299.0, 299.0) == (296, 296, 4, 4)
    assert drag("top_right", 251.0, 51.0, 1) == (100, 51, 151, 249)
    assert rect(geometry.crop_drag(one(spark, **(CROP | {"x": 0, "y": 0, "w": 1920, "h": 1080})), F.lit(101.7), F.lit(50.3), F.lit("top_left"))) == (104, 52, 1816, 1028)
    assert rect(geometry.crop_translate(crop, F.lit(7), F.lit(3))) == (108, 104, 200, 200)
    assert rect(geometry.crop_translate(crop, F.lit(3), F.lit(-500))) == (104, 0, 200, 200)
    assert rect(geometry.crop_translate(crop, F.lit(5000), F.lit(0))) == (1720, 100, 200, 200)
    assert rect(geometry.crop_seed(one(spark, src_w=1923, src_h=1081))) == (0, 0, 1920, 1080)


def test_typed_crop_fields_stay_above_the_alignment(spark):
    far = one(spark, **(CROP | {"x": 1919}))
    r = geometry.crop_field_commit(far, F.lit("w"), F.lit(50)).first()
    assert (r.value, r.corrected, r.w) == (4, True, 4)
    r = geometry.crop_field_commit(one(spark, **CROP), F.lit("y"), F.lit(-7)).first()
    assert (r.value, r.corrected, r.y) == (0, True, 0)


def test_letterbox_golden(spark):
    box = lambda sw, sh, dw, dh: rect(geometry.letterbox_rect(one(spark, src_w=sw, src_h=sh, dst_w=dw, dst_h=dh)))
    assert box(1920, 1080, 1280, 720) == (0, 0, 1280, 720)
    assert box(854, 853, 427 * 2, 853) == (0, 0, 854, 853)
    assert box(1920, 1080, 1080, 1080) == (0, 236, 1080, 608)
    assert box(1080, 1920, 1920, 1080) == (656, 0, 608, 1080)


def test_resizers_keep_a_solid_colour(spark):
    plane = px(spark, [(201,)] * 64, 8, ["luma"])
    for resize in (geometry.resize_bilinear, geometry.resize_lanczos):
        for w, h in ((4, 4), (11, 3)):
            got = resize(plane, ["luma"], 8, 8, w, h).collect()
            assert [r.luma for r in got] == [201] * (w * h)


def test_trims(spark):
    frames = spark.range(10).withColumnRenamed("id", "frame_no")
    kept = lambda *a: [r.frame_no for r in geometry.trim_frames(frames, *a).orderBy("frame_no").collect()]
    assert kept(-2, 3) == [0, 1, 2] and kept(8, 30, 9) == [8] and kept(8, None, 0) == [8, 9] and kept() == list(range(10))


def named(spark, **values):
    base = {"path": "/in/Clip.mov", "codec": "dxt1", "container": "mov", "in_frame": None, "out_frame": None, "fps": 24.0, "total": None, "crop_w": None, "crop_h": None, "trim_format": "time"} | values
    schema = "path string, codec string, container string, in_frame long, out_frame long, fps double, total long, crop_w double, crop_h double, trim_format string"
    return naming.auto_name(spark.createDataFrame([tuple(base.values())], schema)).first().name


def test_names_golden(spark):
    assert named(spark, in_frame=24, out_frame=180) == "Clip_DXV Normal Quality [00.01.00-00.07.50].mov"
    assert named(spark, codec="yg10", in_frame=47, out_frame=86, fps=30.0) == "Clip_DXV High Quality With Alpha [00.01.56-00.02.86].mov"
    assert named(spark, in_frame=67, total=240) == "Clip_DXV Normal Quality [00.02.79-00.09.95].mov"
    assert named(spark, in_frame=36, out_frame=36, fps=30.0) == "Clip_DXV Normal Quality [00.01.19-00.01.19].mov"
    assert named(spark, in_frame=180, out_frame=24, trim_format="frames") == "Clip_DXV Normal Quality [24-180].mov"
    assert named(spark, in_frame=24, out_frame=180, fps=0.0) == "Clip_DXV Normal Quality [00.00.00-00.00.00].mov"
    assert named(spark, codec="h264", container="mp4", crop_w=639.5, crop_h=360.0) == "Clip_H.264 [640x360].mp4"
    for codec, token in naming.CODEC_TOKENS.items():
        assert named(spark, codec=codec) == f"Clip_{token}.mov"


def test_free_names_golden(spark):
    wanted = one(spark, dir="/o", stem="clip", ext="mov")
    free = lambda *names: naming.collision_free(wanted, spark.createDataFrame([("/o", n) for n in names] + [("/p", "clip.mov")], "dir string, name string")).first().name
    assert free() == "clip.mov"
    assert free("clip_2.mov", "clip_7.mov") == "clip.mov"
    assert free("clip.mov") == "clip_2.mov"
    assert free("clip.mov", "clip_2.mov", "clip_4.mov") == "clip_5.mov"
    assert free("clip.mov", "clip_02.mov", "clip_-9.mov", "clip_x9.mov", "clip_9.mp4", "clip_99999999999999999999.mov") == "clip_3.mov"


def test_timecodes_golden(spark):
    frame = lambda text, fps=25.0: spark.range(1).select(naming.frame_of_timecode(F.lit(text), F.lit(fps))).first()[0]
    assert frame("01:02:03:04") == 3723 * 25 + 4 and frame(" 00:00:00:99\n") == 99 and frame("+1:0:0:0", 29.97) == 108_000
    assert frame("1:2:3") is None and frame("1:2:3: 4") is None and frame("-1:0:0:0") is None and frame("1:0:0:0", 0.0) is None
    text = lambda n, fps: spark.range(1).select(naming.timecode(F.lit(n), F.lit(fps))).first()[0]
    assert text(3723 * 25 + 4, 25.0) == "01:02:03:04" and text(30, 29.97) == "00:00:01:00" and text(1, 0.0) == "—:—:—:—"


def test_timescales_golden(spark):
    got = container.derive_timescale(spark.createDataFrame([(f,) for f in (30.0, 29.97, 23.976, 29.5, 59.94)], "fps double")).collect()
    assert [(r.timescale, r.delta) for r in got] == [(15_360, 512), (30_000, 1001), (24_000, 1001), (None, None), (None, None)]
    assert [r.error is None for r in got] == [True, True, True, False, False]


def test_packets_cover_every_byte(spark):
    docs = [(1, b""), (2, b"x" * 1000), (3, None), (4, "straße".encode() * 300)]
    contents = spark.createDataFrame(docs, "source_id long, content binary")
    found = {}
    for r in container.read_packets(container.entries_covering(contents, F.lit(257)), contents).collect():
        found.setdefault(r.source_id, []).append(r)
    for key, data in docs:
        mine = sorted(found[key], key=lambda r: r.idx)
        assert b"".join(bytes(r.packet) for r in mine) == (data or b"")
        assert [r.short_read for r in mine] == [False] * (len(mine) - 1) + [len(mine[-1].packet) < 257]
    beyond = spark.createDataFrame([(2, 0, 995, 10), (2, 1, 2000, 10)], "source_id long, idx long, file_offset long, size long")
    assert [r.actual for r in container.read_packets(beyond, contents).orderBy("idx").collect()] == [5, 0]


def test_streams_golden(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert [value(streams.run_bytes(F.lit(n))) for n in (0, 254, 255, 255 + 65_535, 300_000)] == ["00", "fe", "ff0000", "ffffff0000", "ff" + "ffff" * 4 + "e592"]
    assert [value(streams.copy_cost(F.lit(n), F.lit(100))) for n in (3, 4, 11, 12, 64, 65, 67, 68, 132)] == [None, 2, 2, 3, 3, 5, 5, 5, 8]
    assert value(streams.section_header(F.lit(5), F.lit(0xBB))) == "050000bb" and value(streams.section_header(F.lit(1 << 24), F.lit(0xCE))) == "000000ce00000001"
    head = value(streams.packet_header(F.lit("DXT1"), F.lit(3)))
    got = streams.packet_headers(one(spark, data=bytes.fromhex(head) + b"abc")).first()
    assert (got.tag, got.major, got.raw_flag, got.payload_size, bytes(got.payload), got.error) == ("DXT1", 4, 0, 3, b"abc", None)


@pytest.mark.parametrize("length, want", [(1, []), (2, [(1, 1, 1)]), (4, [(1, 1, 1), (2, 1, 1), (3, 1, 1)]), (5, [(1, 0, 4)]), (259, [(1, 0, 258)]), (262, [(1, 0, 258), (259, 1, 1), (260, 1, 1), (261, 1, 1)]), (263, [(1, 0, 258), (259, 0, 4)])])
def test_long_runs_are_split(spark, length, want):
    got = streams.block_ops(spark.range(length).selectExpr("0 as source_id", "id as n", "7 as v"), "v", "source_id")
    assert sorted((r.block, r.op, r.covers) for r in got.collect()) == want


def test_job_ends_stay(spark):
    events = [(1, 1, "queue"), (1, 2, "start"), (1, 3, "finish"), (1, 4, "start"), (2, 1, "cancel"), (2, 2, "finish"), (3, 1, "start"), (4, 1, "queue")]
    got = queue.job_states(spark.createDataFrame(events, "job_id long, seq long, kind string")).orderBy("job_id").collect()
    assert [(r.status, r.error) for r in got] == [("done", None), ("failed", "Cancelled"), ("encoding", None), ("queued", None)]


def test_presets_keep_ids_and_untouched_sizes(spark):
    held = spark.createDataFrame([(1, "Wide", 10, 20), (2, "tall", 30, 40)], "id long, name string, width long, height long")
    fresh = spark.createDataFrame([(7, " WIDE ", 11, 21, 1), (8, "new", 1, 2, 2), (9, "New", 3, 4, 3), (10, "  ", 5, 6, 4)], "id long, name string, width long, height long, seq long")
    assert sorted(tuple(r) for r in queue.upsert_presets(held, fresh).collect()) == [(1, "WIDE", 11, 21), (2, "tall", 30, 40), (8, "New", 3, 4)]


def test_a_cancelled_session_runs_no_more(spark):
    jobs = [(0, True, "ask", "overwrite", False), (1, True, "ask", "skip", True), (2, True, "overwrite", None, False), (3, False, "ask", None, False), (4, True, "ask", "cancel", False)]
    df = spark.createDataFrame([(1, *j) for j in jobs] + [(2, 0, True, "ask", "cancel", True), (2, 1, False, "ask", None, False)], "session_id long, position long, taken boolean, policy string, decision string, for_all boolean")
    assert [r.action for r in queue.collision_actions(df).orderBy("session_id", "position").collect()] == ["proceed", "skip", "skip", "proceed", "skip", "cancel", "not_run"]


def test_progress_of_trims_and_unknown_totals(spark):
    jobs = spark.createDataFrame([(1, "encoding", 5, 10), (2, "encoding", 1, None), (3, "encoding", 0, 0), (4, "done", 0, 9), (5, "queued", 3, 9), (6, "encoding", 30, 10)], "job_id long, status string, written long, total long")
    assert [r.progress for r in metrics.job_progress(jobs, lo=4).orderBy("job_id").collect()] == [5 / 6, 1.0, 0.0, 1.0, 0.0, 1.0]


def test_frames_without_their_first_pixel_are_framed_and_padded(spark):
    px = spark.createDataFrame([(1, 1, 1, 9)], "frame_no long, y int, x int, luma int")
    got = {(r.y, r.x): (r.luma, r.a) for r in geometry.letterbox(px, ["luma"], 2, 2, 4, 4).collect()}
    assert got[2, 2] == (9, 255) and len(got) == 13 and all(got[0, x] == (0, 255) for x in range(4))


def test_entries_without_content_read_nothing(spark):
    index = spark.createDataFrame([(1, 0, 0, 4), (2, 0, 0, 4)], "source_id long, idx long, file_offset long, size long")
    contents = spark.createDataFrame([(1, b"abcdef"), (3, b"x")], "source_id long, content binary")
    got = container.read_packets(index, contents).orderBy("source_id").collect()
    assert [(r.source_id, bytes(r.packet), r.actual, r.short_read) for r in got] == [(1, b"abcd", 4, False), (2, b"", 0, True)]


def test_serial_runs_against_a_simulation(spark):
    rnd = random.Random(4)
    maybe = lambda p, v: v if rnd.random() < p else None
    jobs, want = [], {}
    for queue_ in range(60):
        stop_all, free = maybe(0.4, rnd.randrange(400)), 0
        for place in range(rnd.randrange(12)):
            arrival, cost = rnd.choice((None, rnd.randrange(300))), rnd.choice((None, 0, rnd.randrange(80)))
            cancelled, stopped, fails = maybe(0.5, rnd.random() < 0.3), maybe(0.3, rnd.randrange(90)), maybe(0.5, rnd.random() < 0.3)
            jobs.append((queue_, place, arrival, cost, cancelled, stopped, fails, stop_all))
            start, end, error = max(free, arrival or 0), None, "Cancelled"
            if not cancelled:
                takes = min(cost or 0, stopped) if stopped is not None else cost or 0
                free = end = start + takes
                error = "Cancelled" if takes < (cost or 0) else "Failed" if fails else None
            if cancelled or (stop_all is not None and start >= stop_all):
                start, end, error = None, None, "Cancelled"
            elif stop_all is not None and end > stop_all:
                end, error = stop_all, "Cancelled"
            want[queue_, place] = (start, end, "failed" if error else "done", error)
    df = spark.createDataFrame(jobs, "queue_id int, position int, arrival_ms int, cost_ms long, cancelled boolean, stopped_ms int, fails boolean, stop_all_ms int")
    got = {(r.queue_id, r.position): (r.start_ms, r.end_ms, r.status, r.error) for r in queue.serial_runs(df.withColumn("before", F.lit(1))).collect()}
    assert got == want


def test_columns_of_any_name_stay(spark):
    wanted = spark.createDataFrame([("d", "a", "mov", "mine", "yours")], "dir string, stem string, ext string, __base string, is_taken string")
    files = spark.createDataFrame([("d", "a.mov"), ("d", "a_7.mov")], "dir string, name string")
    got = naming.collision_free(wanted, files).first()
    assert (got.name, got["__base"], got.is_taken) == ("a_8.mov", "mine", "yours")
    jobs = spark.createDataFrame([(1, 0, True, "ask", "skip", True, "x"), (1, 1, True, "ask", None, False, "y")], "session_id long, position long, taken boolean, policy string, decision string, for_all boolean, __held string")
    assert [(r.action, r["__held"]) for r in queue.collision_actions(jobs).orderBy("position").collect()] == [("skip", "x"), ("skip", "y")]
