"""Operator 3: repeated passages of WORDS words and more, by content-defined chunks.

A text's words are joined by single spaces. A gear hash rolls over the bytes:
h = 2 * h + G[byte] in 16 bits, so h depends on the last GRAM bytes. A chunk ends
where h is the smallest of some WINDOW consecutive ones: so chunks are at most
WINDOW bytes long, and those after an insertion are the same again within
GRAM + WINDOW bytes. Whatever its surroundings, a stretch of 50 words (99 bytes at
least) that occurs twice has the same chunks both times, one at least, from at most
WINDOW + 15 bytes behind its start to WINDOW - 1 before its end.

Chunks are deduplicated by digest (64 bits). Runs of chunks that occur more than
once, with these margins, hold every repeated stretch. Within runs that can have 50
words, each stretch of 50 words is hashed exactly (96 bits) and compared: those that
occurred before, joined where they overlap, are the passages, from their first word
to their last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, materialize, mix, table, unused

WORDS, GRAM, WINDOW = 50, 16, 42
#: Bytes by which a repeated stretch can go on before and behind its common chunks.
BEFORE, BEHIND = WINDOW + GRAM - 1, WINDOW - 1
#: Fewer bytes can't hold WORDS words.
LEAST_BYTES = 2 * WORDS - 1
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype(np.uint16)
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Digests that are frequent in one of SAMPLE ids, at most HOT of them, don't travel to one task each. Bounds a broadcast, never results.
SAMPLE, HOT, HOT_LEAST = 64, 10_000, 16
NONE = np.zeros(0, np.int64)


def _slid(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """of (minimum or maximum) over each size consecutive values, by doubling."""
    if len(x) < size:
        return x[:0]
    out, n = x, 1
    while 2 * n <= size:
        out, n = of(out[:-n], out[n:]), 2 * n
    return of(out[: len(x) - size + 1], out[size - n :]) if size > n else out


def chunk_ends(data: bytes) -> np.ndarray:
    """The byte after each end of a chunk. The rolling sum is built by doubling: GRAM bytes in four steps."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += shifted
    h = h[GRAM - 1 :]
    least = _slid(h, WINDOW, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    # smallest of some window: the largest of the minima of the windows around it
    around = np.zeros(len(least) + 2 * (WINDOW - 1), np.uint16)
    around[WINDOW - 1 : WINDOW - 1 + len(least)] = least
    return np.flatnonzero(_slid(around, WINDOW, np.maximum) == h) + GRAM


#: Bytes of text whose sums are held at once, longer spans apart.
SEGMENT = 1 << 18


@cache
def powers(factor: int, n: int) -> np.ndarray:
    """factor ** 0, 1, 2, ... n - 1 in 64 bits; n a power of two."""
    out, size = np.ones(n, np.uint64), 1
    while size < n:
        out[size : 2 * size] = out[:size] * np.uint64(pow(factor, size, 1 << 64))
        size *= 2
    return out


def spans_hash(data: bytes, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """64-bit polynomial hash of each span of bytes, from sums up to each byte of a segment. Spans are ordered by start."""
    out, all_bytes = np.zeros(len(starts), np.uint64), np.frombuffer(data, np.uint8)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, at + SEGMENT)))
        values = BYTE_HASH[all_bytes[at : int(ends[i:j].max())]]
        n = 1 << max(18, len(values).bit_length())
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(factor, n)[: len(values)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * powers(pow(factor, -1, 1 << 64), n)[starts[i:j] - at]
        i = j
    return mix(out)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it. Words are parted by space; in scripts without spaces each character is one."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    after = np.append(data[1:], 0)
    alone = ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)) | ((data == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F)))
    before = np.append(True, space[:-1])
    before[3:] |= alone[:-3]
    starts = ~space & (before | alone)
    ends = np.append(starts[1:] | space[1:], True) & ~space
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def joined_words(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space where any was, the place of each in that, and its bytes in the text."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data)
    gap = np.append(starts[1:] > ends[:-1], False) if len(starts) else np.zeros(0, bool)
    at = np.cumsum(ends - starts + gap) - (ends - starts + gap)
    if gap[:-1].all():
        joined = b" ".join(raw.split())
    else:
        joined = b"".join(raw[a:b] + b" " * g for a, b, g in zip(starts.tolist(), ends.tolist(), gap.tolist()))
    return joined, at, starts, ends


def _batch(columns: list[list[np.ndarray]], schema: list[tuple[str, type]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t)) for x, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _repeats(*keys: np.ndarray) -> np.ndarray:
    """Whether each row's keys came in an earlier row."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    again = np.zeros(len(order), bool)
    again[order[1:]] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    return again


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each key is one of the known ones, which are in order."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


_CHUNK = [("digest", np.int64), ("doc_id", np.int64), ("part", np.int32), ("seq", np.int32), ("first", np.int32), ("words", np.int32), ("again", np.bool_), ("hot", np.bool_)]
_STRETCH = [("a", np.int64), ("b", np.int32), ("doc_id", np.int64), ("part", np.int32), ("place", np.int64), ("again", np.bool_), ("hot", np.bool_)]


def _chunk_rows(hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 128):
        out: list[list] = [[] for _ in _CHUNK]
        for doc_id, part, text in zip(*(block.column(x).to_pylist() for x in ("doc_id", "part", "text"))):
            joined, at, *_ = joined_words(text)
            ends = chunk_ends(joined)
            if len(at) < WORDS or len(ends) < 2:
                continue
            a, b = ends[:-1], ends[1:]
            digest = spans_hash(joined, a, b, FACTORS[0]).view(np.int64)
            first = np.searchsorted(at, a - BEFORE)
            for column, values in zip(out, (digest, np.full(len(a), doc_id), np.full(len(a), part), np.arange(len(a)), first, np.searchsorted(at, b + BEHIND) - first, _repeats(digest), _among(digest, hot))):
                column.append(values)
        yield _batch(out, _CHUNK)


def chunks(rows: DataFrame, hot: np.ndarray = NONE) -> DataFrame:
    """A row for each chunk between two ends: digest, document, place, the words that a repeated stretch with it can reach (the first of them and how many), whether its text had it before, and whether the digest is among hot."""
    return rows.mapInArrow(partial(_chunk_rows, hot), "digest long, doc_id long, part int, seq int, first int, words int, again boolean, hot boolean")


#: Of the rows of one key: first and last document, and whether one has it twice.
_OCCURRENCES = {"least": "min(doc_id)", "last": "max(doc_id)", "any_again": "max(again)"}
_REPEATED = "(last > least or any_again)"


def _occurrences() -> list:
    return [F.expr(x).alias(n) for n, x in _OCCURRENCES.items()]


def frequent(rows: DataFrame, key: str) -> np.ndarray:
    """Keys that are frequent among these rows and occur in two documents, or twice in one: at most HOT, in order."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), *_occurrences()).where(f"n >= {HOT_LEAST} and {_REPEATED}")
    return np.sort(np.array([r[0] for r in found.orderBy(F.desc("n"), key).limit(HOT).select(key).collect()], np.int64))


def in_sample(rows: DataFrame) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)


def _with_occurrences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the first and last document of their keys, each sent once to its key's task; hot rows are dealt by document, and know only of those dealt along."""
    dealt = rows.withColumn("deal", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))))
    w = Window.partitionBy(*keys, "deal")
    return dealt.select("*", *(F.expr(x).over(w).alias(n) for n, x in _OCCURRENCES.items()))


def common_chunks(rows: DataFrame) -> DataFrame:
    """The chunks whose digest occurs more than once, in one document or several.

    Every chunk travels once, to its digest; those of frequent digests, found in
    a sample of the ids, are dealt out.
    """
    found = _with_occurrences(chunks(rows, frequent(chunks(in_sample(rows)), "digest")), ["digest"])
    return found.where(f"hot or {_REPEATED}").select("doc_id", "part", "seq", "first", "words")


def candidates(common: DataFrame) -> DataFrame:
    """(doc_id, part, regions): the ranges of words of each text that a run of common chunks can reach, of WORDS words at least."""
    run = F.col("seq") - F.dense_rank().over(Window.partitionBy("doc_id", "part").orderBy("seq"))
    runs = common.withColumn("run", run).groupBy("doc_id", "part", "run").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("words")).alias("stop"))
    return runs.where(F.col("stop") - F.col("first") >= WORDS).groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "stop")).alias("regions"))


def _stretch_rows(hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 128):
        out: list[list] = [[] for _ in _STRETCH]
        for doc_id, part, text, regions in zip(*(block.column(x).to_pylist() for x in ("doc_id", "part", "text", "regions"))):
            joined, at, starts, ends = joined_words(text)
            first = np.unique(np.concatenate([np.arange(r["first"], r["stop"] - WORDS + 1) for r in regions]))
            a, b = at[first], (at + ends - starts)[first + WORDS - 1]
            one, two = spans_hash(joined, a, b, FACTORS[0]).view(np.int64), (spans_hash(joined, a, b, FACTORS[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for column, values in zip(out, (one, two, np.full(len(a), doc_id), np.full(len(a), part), starts[first] << 32 | ends[first + WORDS - 1], _repeats(one, two), _among(one, hot))):
                column.append(values)
        yield _batch(out, _STRETCH)


def hashed_stretches(rows: DataFrame, regions: DataFrame, hot: np.ndarray = NONE) -> DataFrame:
    """A row for each stretch of WORDS words in the regions of the texts: hash, document, place (first byte in the high half, the byte behind in the low one), whether its text had it before, and whether the hash's first part is among hot."""
    return rows.join(regions, ["doc_id", "part"]).mapInArrow(partial(_stretch_rows, hot), "a long, b int, doc_id long, part int, place long, again boolean, hot boolean")


def whole_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_bytes, n_stretches, first_doc_id) of each passage of at least WORDS words that occurred before, in a document of smaller id or earlier in its own.

    start and end are byte offsets of the UTF-8 text, from the passage's first
    word to its last; n_stretches counts the stretches of WORDS words in it;
    first_doc_id is the smallest document with one of them. Case counts, the
    space between words doesn't; a run without space is one word. Null ids and
    null or empty texts take no part. Rows that share an id are one document's
    parts: a passage that only such rows share isn't reported, a row given twice
    counts once, and texts of one id are told apart by 32 bits of hash. An empty
    table gives an empty result; other columns play no part.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("part"), text.alias("text")).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LEAST_BYTES))
    regions = materialize(docs.sparkSession, candidates(common_chunks(rows)), "regions")
    tried = hashed_stretches(rows, regions, frequent(hashed_stretches(in_sample(rows), in_sample(regions)), "a"))
    # first documents of the hot hashes, at most HOT of them but for those that share their first part
    hot = tried.where("hot").groupBy("a", "b").agg(*_occurrences()).where(_REPEATED).select("a", "b", F.col("least").alias("hot_least"))
    hot = materialize(docs.sparkSession, hot, "hot-stretches")
    owner = F.when(F.col("hot"), F.col("hot_least")).when(F.expr(_REPEATED), F.col("least"))
    again = _with_occurrences(tried, ["a", "b"]).join(F.broadcast(hot), ["a", "b"], "left").where(owner.isNotNull() & ((F.col("doc_id") != owner) | F.col("again")))
    # dealt by text first, so that the run below needs no other shuffle
    again = again.select("doc_id", "part", "place", owner.alias("owner")).repartition("doc_id", "part").groupBy("doc_id", "part", "place").agg(F.min("owner").alias("owner"))
    again = again.select("*", F.shiftright("place", 32).alias("start"), F.col("place").bitwiseAND((1 << 32) - 1).alias("end"))
    before = Window.partitionBy("doc_id", "part").orderBy("place")
    new = F.coalesce(F.col("start") >= F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    runs = again.withColumn("new", new).withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "part", "run")
    out = runs.agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.count("*").alias("n_stretches"), F.min("owner").alias("first_doc_id"))
    return out.select("doc_id", "start", "end", (F.col("end") - F.col("start")).cast("long").alias("n_bytes"), "n_stretches", "first_doc_id")


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the reported passages cut out of the texts; every row and other column stays, whatever its name."""
    key, held = unused(docs, "passage_id"), unused(docs, "passage_spans")
    spans = passages.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(held))
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            texts = []
            for text, cut in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                if text and cut:
                    data, parts, pos = text.encode("utf-8", "surrogatepass"), [], 0
                    for s in cut:
                        parts.append(data[pos : s["start"]])
                        pos = max(pos, s["end"])
                    text = (b"".join(parts) + data[pos:]).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.record_batch([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names)

    joined = docs.join(spans, F.col(id_col).cast("long") == F.col(key), "left").select(*[F.col(f"`{c}`") for c in names], held)
    return joined.mapInArrow(run, docs.schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_passages(table(spark, sf_dir, "documents"))
