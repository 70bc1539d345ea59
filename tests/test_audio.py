"""Rate conversion against direct sums, for blocks of several sizes."""

import struct

import numpy as np
import pytest

from reelspark.operators import audio


def samples(spark, tracks):
    rows = [(s, c, n, v) for (s, c), values in tracks.items() for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "source_id int, channel int, n long, v long")


def direct(values, rate, target):
    """Every output by itself, over all samples."""
    step = np.gcd(rate, target)
    p, q, side = int(rate // step), int(target // step), audio.reach(rate, target)
    table, out = audio.weights(rate, target), []
    for m in range(-(-len(values) * q // p)):
        at, phase = divmod(m * p, q)
        total = sum(values[at + 1 - side + k] * int(w) for k, w in enumerate(table[phase]) if 0 <= at + 1 - side + k < len(values))
        out.append((total + audio.UNIT // 2) >> 16)
    return out


@pytest.mark.parametrize("rate, target", [(44_100, 48_000), (48_000, 44_100), (8_000, 48_000), (48_000, 8_000), (3, 2), (5, 5)])
def test_any_size_of_blocks_gives_the_direct_sum(spark, rate, target):
    rng = np.random.default_rng(1)
    tracks = {(s, c): rng.integers(-(2**31), 2**31, n).tolist() for s, c, n in ((1, 0, 400), (1, 1, 400), (2, 0, 1), (3, 0, 97))}
    want = {k: v if rate == target else direct(v, rate, target) for k, v in tracks.items()}
    for size in (50, 97, 1000):
        got = {}
        for r in audio.resample(audio.blocks(samples(spark, tracks), size), rate, target, size).orderBy("block").collect():
            assert len(got.setdefault((r.source_id, r.channel), [])) == r["first"]
            got[r.source_id, r.channel] += r.v
        assert got == want


def test_weights_keep_a_constant_and_a_slow_wave():
    assert (audio.weights(44_100, 48_000).sum(1) == audio.UNIT).all() and (audio.weights(48_000, 8_000).sum(1) == audio.UNIT).all()
    wave = lambda rate, n: np.round(1e9 * np.sin(2 * np.pi * 440 * np.arange(n) / rate)).astype(np.int64)
    got = np.array(direct(wave(44_100, 3000).tolist(), 44_100, 48_000))
    assert np.abs(got - wave(48_000, len(got)))[50:-50].max() < 2e6


def test_short_blocks_are_refused(spark):
    with pytest.raises(ValueError):
        audio.resample(audio.blocks(samples(spark, {(1, 0): [1]}), 4), 44_100, 48_000, 4)


def test_packing_cuts_and_interleaves(spark):
    rows = audio.blocks(samples(spark, {(1, 0): [1, -1, 2**40], (1, 1): [-(2**40), 5]}), 2)
    got = audio.interleave(rows.selectExpr("*", "block * 2 as first")).orderBy("block").collect()
    assert [bytes(r.pcm) for r in got] == [struct.pack("<4i", 1, -(2**31), -1, 5), struct.pack("<i", 2**31 - 1)]
