"""Sound as blocks of samples (D16 of the blueprint): rate conversion by a windowed sine and packing to 32 bits.

Samples stay in arrays, a row for each block of a channel. A block carries the few
samples of its neighbours that its own outputs reach, so that every output is a sum
within one row, whatever the size of blocks.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Value, col, idiv, le_bytes, let

#: Zero crossings of the sine on either side of an output, and what weights are counted in.
LOBES, UNIT = 8, 1 << 16
HIGHEST, LOWEST = (1 << 31) - 1, -(1 << 31)


def reach(rate: int, target: int) -> int:
    """Samples on either side of an output's place that count for it: more where the rate falls, as the sine is then stretched."""
    return math.ceil(LOBES * max(1.0, rate / target))


@functools.cache
def weights(rate: int, target: int) -> np.ndarray:
    """Integer weights (phase, tap) of outputs whose place is phase / q behind a sample, q = target without common divisors; taps lie from 1 - reach to reach samples from it, and each phase adds up to UNIT."""
    step = math.gcd(rate, target)
    q, wide, side = target // step, max(1.0, rate / target), reach(rate, target)
    d = (np.arange(1 - side, side + 1)[None, :] - np.arange(q)[:, None] / q) / wide
    window = np.where(np.abs(d) < LOBES, np.cos(np.pi * d / (2 * LOBES)) ** 2, 0.0)
    raw = np.sinc(d) * window
    out = np.floor(UNIT * raw / raw.sum(1, keepdims=True) + 0.5).astype(np.int64)
    # what rounding leaves over goes to the tap nearest to the output, so that silence and a constant stay
    out[np.arange(q), side - 1 + (2 * np.arange(q) > q)] += UNIT - out.sum(1)
    return out


def blocks(samples: DataFrame, size: int = 4096) -> DataFrame:
    """(source_id, channel, block, v) of samples (source_id, channel, n from 0 without gaps, v): arrays of size samples, the last shorter."""
    rows = samples.groupBy("source_id", "channel", idiv("n", size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("v").cast("long").alias("v")))).alias("s"))
    return rows.select("source_id", "channel", "block", F.col("s.v").alias("v"))


def resample(rows: DataFrame, rate: int, target: int, size: int = 4096) -> DataFrame:
    """(source_id, channel, block, first, v): each block's outputs at the target rate, from the output number first on.

    rows: blocks of `size` samples. Output m lies at sample m * rate / target; a block
    has the outputs that lie within it, so that their number is that of the samples
    times target / rate, rounded up. Beyond the ends there is silence. Sums are of
    integers and rounded to the nearest, so results don't depend on size, of which
    blocks must have as many samples as an output reaches. At equal rates nothing changes.
    """
    step = math.gcd(rate, target)
    p, q, side = rate // step, target // step, reach(rate, target)
    if size < side:
        raise ValueError(f"blocks of {size} samples are shorter than the {side} that an output reaches")
    w = Window.partitionBy("source_id", "channel").orderBy("block")
    start = F.col("block") * size
    first, stop = idiv(start * q + p - 1, p), idiv((start + F.size("v")) * q + p - 1, p)
    if rate == target:
        return rows.select("source_id", "channel", "block", start.alias("first"), "v")
    silence = F.array_repeat(F.lit(0).cast("long"), side)
    before, after = F.lag(F.expr(f"slice(v, -least({side}, size(v)), least({side}, size(v)))")).over(w), F.lead(F.expr(f"slice(v, 1, {side})")).over(w)
    wide = rows.withColumn("reached", F.concat(F.coalesce(before, silence), "v", F.coalesce(after, F.array().cast("array<bigint>")), silence))
    table = F.lit(weights(rate, target).ravel())

    def output(m: Column, v: Column) -> Column:
        at, phase = idiv(m * p, q), (m * p) % q
        # tap 0 is side - 1 samples before the output's place, which is side samples behind the array's start
        taps = F.slice(v, (at - start + 2).cast("int"), F.lit(2 * side))
        total = F.aggregate(F.zip_with(taps, F.slice(table, (phase * 2 * side + 1).cast("int"), F.lit(2 * side)), lambda x, k: x * k), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.shiftright(total + UNIT // 2, UNIT.bit_length() - 1)

    outputs = F.when(first < stop, let(F.col("reached"), lambda v: F.transform(F.sequence(first, stop - 1), lambda m: output(m, v)))).otherwise(F.array().cast("array<bigint>"))
    return wide.select("source_id", "channel", "block", first.alias("first"), outputs.alias("v"))


def pcm32(v: Value) -> Column:
    """A sample in four bytes, the lowest first, as hexadecimal digits; cut to what 32 bits hold."""
    cut = F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), col(v).cast("long")))
    return le_bytes(cut.bitwiseAND(0xFFFFFFFF), 4)


def interleave(rows: DataFrame) -> DataFrame:
    """(source_id, block, first, pcm): the channels of each block (arrays v that begin at first) one beside another, in order of channel, as signed 32-bit samples. A channel that ends early is silent there."""
    held = rows.groupBy("source_id", "block", "first").agg(F.array_sort(F.collect_list(F.struct("channel", "v"))).alias("c"))
    n = F.array_max(F.transform("c", lambda c: F.size(c.v)))
    frames = let(F.col("c.v"), lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.transform(v, lambda x: pcm32(F.coalesce(F.get(x, i), F.lit(0)))), "")))
    return held.select("source_id", "block", "first", F.unhex(F.when(n > 0, F.array_join(frames, "")).otherwise("")).alias("pcm"))
