"""Colour blocks by search over ordered clusters (B6 of the blueprint).

A block's pixels are put in order along the main axis of their colours. Every way to
cut that order into four runs, one for each colour of the block's line, fixes a least
squares fit of the line's ends; the way whose ends, once cut to 5, 6 and 5 bits, leave
the smallest error wins, channels weighted as luma weighs them. Sums of all runs come
from one table of 17 x 17 for each block, so that a way costs three look-ups. All
numbers are of single precision, in one fixed order of operations.

The search is array arithmetic over many blocks at once, in Arrow batches; built-in
higher-order functions would interpret some hundred operations for each of 969 ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import AT, average_match

#: Blocks searched at once: some 300 bytes for each of their ways.
BLOCKS_AT_ONCE = 256
#: Shares of luma in red, green and blue, and the first axis where colours don't differ.
LUMA = np.array([0.2126, 0.7152, 0.0722], np.float32)
TURNS = 8
_ONE = np.float32(1)


def ways() -> np.ndarray:
    """All (i, j, k) with 0 <= i <= j <= k <= 16, where places below i have the first end's colour, below j the colour at a third, below k that at two thirds."""
    return np.array([(i, j, k) for i in range(17) for j in range(i, 17) for k in range(j, 17)], np.int64)


def _axis(px: np.ndarray) -> np.ndarray:
    """Main axis of each block's colours (blocks, 16, 3), by power iteration."""
    mean = np.add.accumulate(px, 1)[:, -1] / np.float32(16)
    gap = px - mean[:, None]
    cov = np.add.accumulate(gap[:, :, :, None] * gap[:, :, None, :], 1)[:, -1]
    axis, still = np.ones((len(px), 3), np.float32), np.zeros(len(px), bool)
    for _ in range(TURNS):
        turned = cov[:, :, 0] * axis[:, :1] + cov[:, :, 1] * axis[:, 1:2] + cov[:, :, 2] * axis[:, 2:]
        size = np.sqrt(turned[:, 0] * turned[:, 0] + turned[:, 1] * turned[:, 1] + turned[:, 2] * turned[:, 2])
        still |= size <= np.float32(1e-10)
        with np.errstate(divide="ignore", invalid="ignore"):
            axis = np.where(still[:, None], LUMA, turned / size[:, None])
    return axis


def _half_up(v: np.ndarray) -> np.ndarray:
    low = np.trunc(v)
    return (low + (v - low >= np.float32(0.5))).astype(np.int64)


def fit(colours: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """c0, c1, mask and error, less a block's own constant, of blocks (blocks, 16, 3) of 0 to 255; c0 and c1 come in no order."""
    px = colours.astype(np.float32) / np.float32(255)
    axis = _axis(px)
    dots = px[:, :, 0] * axis[:, :1] + px[:, :, 1] * axis[:, 1:2] + px[:, :, 2] * axis[:, 2:]
    order = np.argsort(dots, 1, kind="stable")
    ordered = np.take_along_axis(px, order[:, :, None], 1)
    # runs[:, i, j]: the colours from place i up to j, added one after another
    runs = np.zeros((len(px), 17, 17, 3), np.float32)
    for i in range(16):
        runs[:, i, i + 1 :] = np.add.accumulate(ordered[:, i:], 1)
    i, j, k = ways().T
    w = np.float32
    first, third, later = runs[:, 0, i], runs[:, i, j], runs[:, j, k]
    last = runs[:, 0, 16][:, None] - first - third - later
    n0, n1, n2 = i.astype(w), (j - i).astype(w), (k - j).astype(w)
    n3 = w(16) - n0 - n1 - n2
    aa = n0 + w(4 / 9) * n1 + w(1 / 9) * n2
    bb = n3 + w(1 / 9) * n1 + w(4 / 9) * n2
    ab = w(2 / 9) * (n1 + n2)
    det = aa * bb - ab * ab
    fine = (n0 < 16) & (n3 < 16) & (det > w(1e-9))
    with np.errstate(divide="ignore"):
        inverse = _ONE / det
    ax = first + w(2 / 3) * third + w(1 / 3) * later
    bx = last + w(1 / 3) * third + w(2 / 3) * later
    top = np.array([31, 63, 31], w)

    def cut(v: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return _half_up(np.clip(np.nan_to_num(v), 0, 1).astype(w) * top)

    with np.errstate(invalid="ignore", over="ignore"):
        start = cut((ax * bb[:, None] - bx * ab[:, None]) * inverse[:, None])
        end = cut((bx * aa[:, None] - ax * ab[:, None]) * inverse[:, None])
    grown = [np.array([v << 3 | v >> 2 for v in range(32)], w) / w(255), np.array([v << 2 | v >> 4 for v in range(64)], w) / w(255)]
    level = lambda q: np.stack([grown[c == 1][q[:, :, c]] for c in range(3)], 2)
    s, e = level(start), level(end)
    square = s * s * aa[:, None] + e * e * bb[:, None]
    cross = s * e * ab[:, None] - s * ax - e * bx
    each = w(2) * cross + square
    error = LUMA[0] * each[:, :, 0] + LUMA[1] * each[:, :, 1] + LUMA[2] * each[:, :, 2]
    error[:, ~fine] = np.inf
    best, at = error.argmin(1), np.arange(len(px))
    packed = lambda q: q[:, 0] << 11 | q[:, 1] << 5 | q[:, 2]
    place = np.arange(16)
    code = np.where(place < i[best][:, None], 0, np.where(place < j[best][:, None], 2, np.where(place < k[best][:, None], 3, 1)))
    mask = (code.astype(np.int64) << (2 * order)).sum(1)
    return packed(start[at, best]), packed(end[at, best]), mask, error[at, best]


def encode_colours_by_clusters(rows: DataFrame) -> DataFrame:
    """frame_no, block_y, block_x, c0, c1 and mask of blocks with arrays r, g and b of sixteen values.

    Blocks of one colour (and one alpha, where there is one) take the ends that match
    it and code 2 throughout. Equal places along the axis keep their order, and of
    equal errors the first way counts. ordered_ends or colour_bytes put the larger end first.
    """
    channels = [c for c in ("r", "g", "b", "a") if c in rows.columns]
    flat = F.expr(" and ".join(f"array_min({c}) = array_max({c})" for c in channels))
    asked = average_match(rows).select(*[F.col(c).cast("long").alias(c) for c in AT], *[F.col(c).cast("array<int>").alias(c) for c in "rgb"], flat.alias("flat"), *[F.col(c).cast("long").alias(c) for c in ("c0", "c1")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                b = batch.slice(start, BLOCKS_AT_ONCE)
                colours = np.stack([b.column(c).flatten().to_numpy().reshape(-1, 16) for c in "rgb"], 2)
                flat_, mask = b.column("flat").to_numpy(zero_copy_only=False), np.full(b.num_rows, 0xAAAAAAAA, np.int64)
                c0, c1 = b.column("c0").to_numpy().copy(), b.column("c1").to_numpy().copy()
                if not flat_.all():
                    c0[~flat_], c1[~flat_], mask[~flat_], _ = fit(colours[~flat_])
                yield pa.record_batch([*[b.column(c) for c in AT], pa.array(c0), pa.array(c1), pa.array(mask)], [*AT, "c0", "c1", "mask"])

    return asked.mapInArrow(search, "frame_no long, block_y long, block_x long, c0 long, c1 long, mask long")
