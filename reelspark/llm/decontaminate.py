"""Operator 2: benchmark decontamination by rare seeds and Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. Three words in a row of a test
item are a seed; an item of nine words and more that a passage repeats with up to
a quarter of its words replaced still shares one with it. Seeds that chance alone would bring about
often are left out: those whose words' frequencies in the whole corpus multiply
to more than COMMON. (What counts is what the words' frequencies predict, not how
often the seed occurs, so a passage copied into a third of all documents stays
findable.) An item keeps all its seeds if none is rare. Each place where seeds
meet is aligned with the whole item by Smith-Waterman over words; the best
alignment's score, as a share of the item's own, decides.

Test items are the stated query set: they go to the tasks in blocks of at most
ITEM_BLOCK_WORDS words, each block a pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table

SEED_WORDS = 3
COMMON = 1e-7
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score from which a passage counts as its copy.
THRESHOLD = 0.6
#: Words of test items that one pass holds in each task.
ITEM_BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_NONE = -1


def item_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: (best score, first and end word of the passage's part).

    One row of the matrix at a time; gaps along the row by a running maximum,
    where each cell carries the start of its path. Ties go to the earliest end.
    """
    n = len(passage)
    if not n or not len(item):
        return 0, 0, 0
    steps = np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        cell = np.concatenate([[0], np.maximum(diagonal, up)])
        begin = np.concatenate([[0], np.where(diagonal >= up, start[:-1], start[1:])])
        begin = np.where(cell > 0, begin, steps)
        cell = np.maximum(cell, 0)
        # along the row: cell[j] = max over i <= j of cell[i] + GAP * (j - i)
        level = cell - GAP * steps
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, steps, 0))
        along = top + GAP * steps
        start = np.where(along > cell, begin[source], begin)
        score = np.maximum(cell, along)
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j]), j)
    return best


class ItemBlock:
    """Test items with their words as numbers, and the seeds in order."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [(i, w) for i, w in items if w]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        self.frequency: np.ndarray | None = None

    def numbers(self, text: str | None) -> np.ndarray:
        found = item_words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, _NONE) for w in found), np.int64, len(found))

    def grams(self, words: np.ndarray, size: int) -> np.ndarray:
        """Each run of `size` words as one number, -1 where a word isn't an item's."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        parts = [words[i : i + n] for i in range(size)]
        known = np.logical_and.reduce([p >= 0 for p in parts])
        out = np.zeros(n, np.uint64)
        for p in parts:
            out = out * np.uint64(0x9E3779B97F4A7C15) + (p + 1).astype(np.uint64)
        return np.where(known, (out >> np.uint64(1)).astype(np.int64), _NONE)

    def seed(self) -> None:
        """Choose the seeds: (number, item, place), sorted by number. Items under SEED_WORDS words seed with their whole length."""
        self.short = sorted({len(x) for x in self.ids if len(x) < SEED_WORDS})
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for item, ids in enumerate(self.ids):
            size = min(SEED_WORDS, len(ids))
            grams = self.grams(ids, size)
            expected = np.array([self.frequency[ids[i : i + size]].prod() for i in range(len(grams))])
            rare = expected <= COMMON
            for place in np.flatnonzero(rare if rare.any() else np.ones(len(grams), bool)):
                rows.setdefault(size, []).append((int(grams[place]), item, int(place)))
        self.seeds = {size: tuple(np.array(x, np.int64) for x in zip(*sorted(found))) for size, found in rows.items()}

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in the text where the item would begin) of each place where a seed meets the text."""
        items, begins = [], []
        for size, (numbers, item, place) in self.seeds.items():
            grams = self.grams(words, size)
            at = np.flatnonzero(grams >= 0)
            low, high = np.searchsorted(numbers, grams[at], "left"), np.searchsorted(numbers, grams[at], "right")
            count = high - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            pick = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(at) else np.zeros(0, np.int64)
            items.append(item[pick])
            begins.append(np.repeat(at, count) - place[pick])
        return (np.concatenate(items), np.concatenate(begins)) if items else (np.zeros(0, np.int64),) * 2

    def found(self, text: str | None) -> list[tuple[int, int, float, int, int]]:
        """(item_id, score, share, first word, end word) of the best alignment of every item that the text copies."""
        words = self.numbers(text)
        item, begin = self.hits(words)
        out = []
        for i in np.unique(item):
            ids, best = self.ids[i], (0, 0, 0)
            size = len(ids)
            slack = size // 2 + 2
            begins = np.unique(begin[item == i])
            group = np.concatenate([[0], np.cumsum(np.diff(begins) > size + slack)])
            for g in range(group[-1] + 1):
                own = begins[group == g]
                low, high = max(0, int(own[0]) - slack), min(len(words), int(own[-1]) + size + slack)
                window = words[low:high]
                # no alignment can match more words than the window has of the item's
                if MATCH * min(size, int(np.isin(window, ids).sum())) < THRESHOLD * MATCH * size:
                    continue
                score, first, end = align(ids, window)
                if score > best[0]:
                    best = (score, low + first, low + end)
            if best[0] >= THRESHOLD * MATCH * size:
                out.append((int(self.items[i][0]), best[0], best[0] / (MATCH * size), best[1], best[2]))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, words: int = ITEM_BLOCK_WORDS) -> Iterator[ItemBlock]:
    """The test items, streamed to the driver in blocks of bounded size. Null ids and texts without words take no part."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull()).distinct().orderBy(*range(1, 3)).toLocalIterator():
        found = item_words(row[1])
        if size and size + len(found) > words:
            yield ItemBlock(block)
            block, size = [], 0
        block.append((row[0], found))
        size += len(found)
    if block:
        yield ItemBlock(block)


def _count_words(texts: DataFrame, block: ItemBlock) -> np.ndarray:
    """Frequency of each of the block's words in all texts: summed in each task, then by word."""
    size = len(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size + 1, np.int64)
        for b in blocks(batches):
            for text in b.column(0).to_pylist():
                out += np.bincount(block.numbers(text) + 1, minlength=size + 1)
        at = np.flatnonzero(out)
        yield pa.record_batch([pa.array(at), pa.array(out[at])], ["word", "n"])

    got = texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1)
    out[got["word"].to_numpy()] = got["n"].to_numpy()
    return out[1:] / max(1.0, out.sum())


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame | None:
    """(doc_id, item_id, score, share, first_word, end_word) for each document and test item that it copies.

    A row of docs gives a row for each such item, repeated rows too; null ids of
    docs are carried, null and wordless texts copy nothing. None without items.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text):
        block.frequency = _count_words(texts, block)
        block.seed()

        def run(batches: Iterator[pa.RecordBatch], block: ItemBlock = block) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                rows = [(d, *x) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in block.found(text)]
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "share", "first_word", "end_word"])

        part = texts.mapInArrow(run, "doc_id long, item_id long, score long, share double, first_word long, end_word long")
        out = part if out is None else out.unionAll(part)
    return out


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """contaminated(), with an empty table where there are no items."""
    found = contaminated(docs, items, **columns)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, score long, share double, first_word long, end_word long")


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that copy a test item, decided where they stand; every column as it was."""
    at, out = docs.columns.index(text_col), docs
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for block in item_blocks(items, item_id, item_text):
        block.frequency = _count_words(texts, block)
        block.seed()

        def run(batches: Iterator[pa.RecordBatch], block: ItemBlock = block) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                yield b.filter(pa.array([not block.found(text) for text in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
