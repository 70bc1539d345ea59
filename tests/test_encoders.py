"""Block encoders against blocks worked by hand, sequential arithmetic and all ways to cut a block."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import blocks, clusterfit, colour

SIDE = "r array<int>, g array<int>, b array<int>"


def block_rows(spark, px, alpha=None):
    """Rows of blocks from an array (blocks, 16, 3)."""
    rows = [(0, 0, n, *[p[:, c].tolist() for c in range(3)]) + ((alpha[n],) if alpha else ()) for n, p in enumerate(np.asarray(px))]
    return spark.createDataFrame(rows, "frame_no long, block_y long, block_x long, " + SIDE + (", a array<int>" if alpha else ""))


def encoded(spark, encode, px, alpha=None):
    return [r.block for r in blocks.colour_bytes(encode(block_rows(spark, px, alpha))).orderBy("block_x").collect()]


BLACK, WHITE, RED = (0, 0, 0), (255, 255, 255), (255, 0, 0)
HALVES = [BLACK, BLACK, WHITE, WHITE] * 4


def test_blocks_worked_by_hand(spark):
    # halves: ends white and black, codes 1 1 0 0 in each row; red: 31 at a third of levels 31 and 31, code 2 throughout
    flat = encoded(spark, blocks.encode_colours, [HALVES, [RED] * 16])
    assert flat[0] == "ffff0000" + "05" * 4
    assert flat[1] == "00f800f8" + "aa" * 4
    # one colour whose alpha varies isn't of one colour: its codes come from matching
    varied = encoded(spark, blocks.encode_colours, [[(100, 100, 100)] * 16], [list(range(16))])
    assert varied[0][8:] != "aa" * 4 or varied[0][:8] == encoded(spark, blocks.encode_colours, [[(100, 100, 100)] * 16])[0][:8]
    assert encoded(spark, clusterfit.encode_colours_by_clusters, [HALVES, [RED] * 16]) == flat


def test_least_squares_by_hand(spark):
    """Codes 0 2 3 1 on greys 255 170 85 0, four of each: the fit is exact, whatever ends came before."""
    greys = [(v, v, v) for v in (255, 170, 85, 0)] * 4
    mask = sum(k << 2 * n for n, k in enumerate([0, 2, 3, 1] * 4))
    got = blocks.refined_ends(block_rows(spark, [greys]).selectExpr("*", "1L as c0", "2L as c1", f"{mask}L as mask")).first()
    assert (got.c0, got.c1) == (65535, 0)
    one = blocks.refined_ends(block_rows(spark, [[(100, 50, 7)] * 16]).selectExpr("*", "1L as c0", "2L as c1", "0L as mask")).first()
    high, low = (
        [t[v][n] for t, v in ((colour.match_table(5), 100), (colour.match_table(6), 50), (colour.match_table(5), 7))] for n in (0, 1)
    )
    assert (one.c0, one.c1) == tuple(r * 2048 + g * 32 + b for r, g, b in (high, low))


def expand(c):
    r, g, b = c >> 11, c >> 5 & 63, c & 31
    return np.array([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2])


def decoded(block):
    """The sixteen colours of a block whose first end is the larger."""
    data = bytes.fromhex(block)
    a, b = (expand(int.from_bytes(data[k : k + 2], "little")) for k in (0, 2))
    line = [a, b, (2 * a + b) // 3, (a + 2 * b) // 3]
    return np.array([line[int.from_bytes(data[4:], "little") >> 2 * n & 3] for n in range(16)])


def refined(px, mask):
    """One step of least squares, pixel by pixel in single precision."""
    f = np.float32
    codes = [mask >> 2 * n & 3 for n in range(16)]
    if len(set(codes)) == 1:
        mean = [(int(sum(p[c] for p in px)) + 8) >> 4 for c in range(3)]
        return tuple(sum(colour.match_table(n)[v][k] << s for n, v, s in ((5, mean[0], 11), (6, mean[1], 5), (5, mean[2], 0))) for k in (0, 1))
    w = [(3, 0, 2, 1)[k] for k in codes]
    xx, yy, xy = sum(x * x for x in w), sum((3 - x) ** 2 for x in w), sum(x * (3 - x) for x in w)
    unit = f(f(f(93) / f(255)) / f(xx * yy - xy * xy))
    out = []
    for own, back in ((yy, False), (xx, True)):
        packed = 0
        for c, top, shift in ((0, 31, 11), (1, 63, 5), (2, 31, 0)):
            p, q = sum(x * int(v[c]) for x, v in zip(w, px)), sum((3 - x) * int(v[c]) for x, v in zip(w, px))
            scale = f(f(unit * f(63)) / f(31)) if c == 1 else unit
            level = f(float(f((q if back else p) * own - (p if back else q) * xy)) * float(scale) + 0.5)
            packed |= min(top, max(0, int(level))) << shift
        out.append(packed)
    return tuple(out)


@pytest.fixture(scope="module")
def random_blocks():
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, (40, 16, 3))
    near = 100 + rng.integers(0, 9, (40, 16, 3))
    ramps = np.clip(np.linspace(0, 1, 16)[None, :, None] * rng.integers(-200, 200, (40, 1, 3)) + rng.integers(0, 256, (40, 1, 3)), 0, 255).astype(int)
    return np.concatenate([noise, near, ramps])


def test_refinement_against_single_pixels(spark, random_blocks):
    first = blocks.colour_indices(blocks.colour_endpoints(block_rows(spark, random_blocks)))
    rows = blocks.refined_ends(first.withColumn("codes", F.col("mask"))).orderBy("block_x").collect()
    assert [(r.c0, r.c1) for r in rows] == [refined(px, r.codes) for px, r in zip(random_blocks, rows)]


def test_refinement_and_clusters_lessen_the_error(spark, random_blocks):
    def errors(encode):
        return np.array([((decoded(b) - px) ** 2 @ clusterfit.LUMA).sum() for b, px in zip(encoded(spark, encode, random_blocks), random_blocks)])

    plain = errors(lambda rows: blocks.colour_indices(blocks.colour_endpoints(rows)))
    better, best = errors(blocks.encode_colours), errors(clusterfit.encode_colours_by_clusters)
    assert better.sum() < plain.sum() and best.sum() < better.sum()
    assert (best <= plain + 40).all()


def test_clusters_against_all_ways_in_turn(random_blocks):
    """The smallest error over all ways in double precision, one after another; equal up to single precision's own."""
    px = random_blocks[::20]
    _, _, _, error = clusterfit.fit(px)
    levels = np.array([31, 63, 31])
    for block, found in zip(px, error):
        x = block / 255
        axis = clusterfit._axis(x[None].astype(np.float32))[0]
        x = x[np.argsort(x.astype(np.float32) @ axis, kind="stable")]
        least = np.inf
        for cuts in clusterfit.ways():
            share = np.repeat([1, 2 / 3, 1 / 3, 0], np.diff([0, *cuts, 16]))
            a = np.stack([share, 1 - share], 1)
            if np.linalg.matrix_rank(a, tol=1e-4) < 2:
                continue
            ends = np.clip(np.linalg.lstsq(a, x, rcond=None)[0], 0, 1)
            ends = np.array([expand(int(np.dot(np.floor(e * levels + 0.5), [2048, 32, 1]))) for e in ends]) / 255
            least = min(least, (((a @ ends - x) ** 2).sum(0) @ clusterfit.LUMA))
        assert abs(float(found) + (x**2).sum(0) @ clusterfit.LUMA - least) < 1e-4


def test_alpha_and_padding(spark):
    px = spark.createDataFrame([(3, y, x, 255 - 40 * y, 30 * x, 7) for y in range(2) for x in range(5)], "frame_no long, y int, x int, r int, g int, b int")
    got = blocks.hapy_blocks(px, 5, 2).orderBy("block_x").collect()
    assert [(r.frame_no, r.block_y, r.block_x, len(r.block)) for r in got] == [(3, 0, 0, 32), (3, 0, 1, 32)]
    luma = blocks.decode_scalars("a0", "a1", "indices")
    seen = blocks.scalars_of_bytes(spark.createDataFrame([(bytes.fromhex(got[1].block)[:8],)], "block binary")).select(luma.alias("v")).first().v
    assert seen[1:4] == [0, 0, 0] and seen[8:] == [0] * 8 and seen[0] > 0


def test_planes_are_padded_without_their_first_place(spark):
    px = spark.createDataFrame([(1, 0, 1, 9)], "frame_no long, y int, x int, luma int")
    got = colour.pad(px, ["luma"], 2, 1, 4, 2, 5).orderBy("y", "x").collect()
    assert [(r.y, r.x, r.luma) for r in got] == [(0, 1, 9), (0, 2, 5), (0, 3, 5), (1, 0, 5), (1, 1, 5), (1, 2, 5), (1, 3, 5)]


def test_refined_scalars_against_brute_force(spark):
    rnd = random.Random(5)
    data = [[rnd.randrange(*rnd.choice([(0, 256), (100, 110), (0, 4), (250, 256)])) for _ in range(rnd.choice((16, 16, 8, 4)))] for _ in range(300)] + [[7] * 16, [0, 255] * 8]

    def best(px):
        found = []
        for k in range(98):
            h, low = (min(255, max(0, e + d - 3)) for e, d in ((max(px), k % 7), (min(px), k // 7 % 7)))
            a, b = (max(h, low), min(h, low)) if k < 49 else (min(h, low), max(h, low))
            entries = [a, b] + ([(a * (7 - j) + b * j + 3) // 7 for j in range(1, 7)] if k < 49 else [(a * (5 - j) + b * j + 2) // 5 for j in range(1, 5)] + [0, 255])
            codes = [min(range(8), key=lambda j, p=p: (abs(entries[j] - p), j)) for p in px]
            if a != b:
                found.append((sum((entries[c] - p) ** 2 for c, p in zip(codes, px)), k, a, b, sum(c << 3 * i for i, c in enumerate(codes))))
        error, _, a, b, indices = min(found)
        return (px[0], px[0], 0, 0) if min(px) == max(px) else (a, b, indices, error)

    df = spark.createDataFrame([(k, px, "kept") for k, px in enumerate([*data, None, [], [1, None]])], "searched int, v array<int>, error string")
    made = blocks.refine_scalars(df)
    # 98 palettes for each block are array arithmetic, not expressions that are interpreted one by one
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    got = [(r.a0, r.a1, r.indices, r.error) for r in made.orderBy("searched").collect()]
    assert got == [best(px) for px in data] + [(None, None, None, 0)] * 3
