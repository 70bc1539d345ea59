"""Streams of compressed blocks against a sequential reader, and against operations worked out one block at a time."""

import random

import pytest

from reelspark.operators import lzblocks
from reelspark.operators.streams import runs


def read(data, n_blocks, alpha):
    """The blocks that a stream stands for, read from left to right."""
    size, at, word, left = (16 if alpha else 8), 0, 0, 0

    def take(n):
        nonlocal at
        at += n
        return data[at - n : at]

    def op():
        nonlocal word, left
        if not left:
            word, left = int.from_bytes(take(4), "little"), 16
        word, left, out = word >> 2, left - 1, word & 3
        return out

    def back():
        """How many blocks back, 0 for none."""
        code = op()
        return (0, 1, 0, 0)[code] if code < 2 else take(1)[0] + 2 if code == 2 else int.from_bytes(take(2), "little") + 0x102

    out, run = [take(size)], 0
    while len(out) < n_blocks:
        n = len(out)
        half = b""
        if alpha:
            if run:
                run, half = run - 1, out[n - 1][:8]
            else:
                code = op()
                if code == 1:
                    run = take(1)[0]
                    if run == 255:
                        while (more := int.from_bytes(take(2), "little")) == 0xFFFF:
                            run += more
                        run += more
                    half = out[n - 1][:8]
                elif code == 2:
                    half = out[n - 2 - int.from_bytes(take(2), "little")][:8]
                else:
                    assert code == 3
                    half = take(8)
        d = back()
        if d:
            colour = out[n - d][-8:]
        else:
            d = back()
            ends = out[n - d][-8:-4] if d else take(4)
            d = back()
            colour = ends + (out[n - d][-4:] if d else take(4))
        out.append(half + colour)
    assert at == len(data)
    return out


def encoded(spark, streams, **options):
    rows = [(s, n, b.hex()) for s, blocks in streams.items() for n, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "stream string, n long, block string").repartition(5)
    return {r.stream: bytes.fromhex(r.data) for r in lzblocks.encode_stream(df, "stream", **options).collect()}


def random_blocks(n, alpha, seed):
    rnd = random.Random(seed)
    part = lambda k, size: bytes([rnd.randrange(k)]) * size
    out = []
    while len(out) < n:
        a = part(rnd.choice((2, 200)), 8) if alpha else b""
        for _ in range(rnd.choice((1, 1, 2, 9))):
            out.append(a + part(9, 4) + part(rnd.choice((2, 90)), 4))
    return out[:n]


@pytest.mark.parametrize("alpha", [False, True])
def test_streams_are_read_back(spark, alpha):
    streams = {f"random {n}": random_blocks(n, alpha, n) for n in (1, 2, 3, 17, 1500)}
    streams["one value"] = [bytes(16 if alpha else 8)] * 700
    streams["all new"] = [(k.to_bytes(8, "big") if alpha else b"") + k.to_bytes(4, "little") + (2**31 + k).to_bytes(4, "little") for k in range(1, 600)]
    got = encoded(spark, streams, alpha=alpha)
    assert got.keys() == streams.keys()
    for name, blocks in streams.items():
        assert read(got[name], len(blocks), alpha) == blocks
    if alpha:
        # the first block, one word of operations, a run of 699 with the count of 698 beyond it, and a distance of one block each
        assert len(got["one value"]) == 16 + -(-700 // 16) * 4 + 3


def test_values_beyond_the_lookback_are_new(spark):
    blocks = random_blocks(400, True, 3)
    near, far = (encoded(spark, {"s": blocks}, alpha=True, lookback=n)["s"] for n in (4, 400))
    assert read(near, 400, True) == read(far, 400, True) == blocks and len(near) > len(far)


def test_clashing_names_and_two_keys(spark):
    rows = [(k % 2, "x", k // 2, bytes([k // 4] * 8).hex().upper(), k) for k in range(40)]
    df = spark.createDataFrame(rows, "seq int, item string, n int, words string, op int")
    got = lzblocks.encode_stream(df, "seq", "item", value="words")
    assert got.columns == ["seq", "item", "data"] and got.count() == 2
    for r in got.collect():
        assert read(bytes.fromhex(r.data), 20, False) == [bytes([k // 4] * 8) for k in range(r.seq, 40, 2)]


@pytest.mark.parametrize("alpha", [False, True])
def test_parts_of_a_stream_give_the_same_bytes(spark, alpha):
    streams = {"random": random_blocks(400, alpha, 8), "one value": [bytes(16 if alpha else 8)] * 300}
    whole = encoded(spark, streams, alpha=alpha, lookback=30)
    assert read(whole["random"], 400, alpha) == streams["random"]
    for size in (7, 64):
        assert encoded(spark, streams, alpha=alpha, lookback=30, size=size) == whole


def test_no_window_holds_a_whole_stream(spark):
    rows = spark.createDataFrame([("s", 0, "00" * 16)], "stream string, n long, block string")
    plan = lzblocks.encode_stream(rows, "stream", alpha=True)._jdf.queryExecution().optimizedPlan().toString()
    # windows over all of a stream take its parts, or the first and last runs of each
    windows = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(s0" in line]
    assert windows and all("part#" in line or "sum(before" in line or "goes_on" in line or "start_at" in line for line in windows)


def test_runs_across_parts(spark):
    rnd = random.Random(2)
    values = {s: [v for _ in range(40) for v in [rnd.choice(["a", "b", None])] * rnd.choice((1, 2, 30))] for s in (1, 2, None)}
    df = spark.createDataFrame([(s, n * 3, v) for s, vs in values.items() for n, v in enumerate(vs)], "s int, n long, v string").repartition(5)
    want = []
    for s, vs in values.items():
        starts = [n for n in range(len(vs)) if not n or vs[n] != vs[n - 1]]
        want += [(s, k + 1, n * 3, m - n, vs[n]) for k, (n, m) in enumerate(zip(starts, [*starts[1:], len(vs)]))]
    for size in (5, 50, 1 << 18):
        assert set(map(tuple, runs(df, "v", "s", size=size).collect())) == set(want)
