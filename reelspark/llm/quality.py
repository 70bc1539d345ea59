"""Operator 10: a quality classifier, as a factorisation machine.

Inputs of a score come from the text alone: hashed words (log counts, unit
length), structure statistics, and the length that the table states as
metadata. The score is w0 + w.x + 1/2 * sum over factors of
((V.x) ** 2 - (V ** 2).(x ** 2)): the sum-of-squares identity gives all pairwise
interactions in time linear in the inputs (Rendle, Factorization Machines, ICDM
2010). Rows to be fitted are held without their zeros; batches of some hundred
rows are dense.

It is fitted on the driver from at most `sample` labelled rows (SAMPLE unless
given) outside the held-out fold, those of smallest hash; everything else runs
over all rows in tasks that hold only the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import WordHashes, blocks, table

BUCKETS = 1 << 12
FACTORS = 8
#: Rows of one id that are fitted at most.
ID_ROWS = 2
SAMPLE = 12_000
THRESHOLD = 0.3
FOLDS = 5
STRUCTURE = 14

_UPPER, _LOWER, _DIGIT, _SPACE = (np.array([chr(i) in s for i in range(128)] + [False] * 128) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c"))
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])


def structure(text: str, n_chars: float | None) -> list[float]:
    """Length, case, mark, line and repetition statistics of a text; all zero but the bias of an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    found, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    size, n = max(1, len(raw)), max(1, len(found))
    upper, lower = count[_UPPER].sum(), count[_LOWER].sum()
    ends = sum(w[-1:] in b"!#$%&*|;" for w in found) if found else 0
    return [
        math.log1p(len(raw)) / 10,
        math.log1p(max(0.0, n_chars if n_chars is not None and math.isfinite(n_chars) else len(text))) / 10,
        math.log1p(len(found)) / 10,
        sum(map(len, found)) / n / 10,
        upper / max(1, upper + lower),
        count[_DIGIT].sum() / size * 4,
        count[_MARK].sum() / size * 4,
        count[_SPACE].sum() / size * 4,
        len(lines) / n * 4,
        1 - len(set(lines)) / max(1, len(lines)),
        len(set(found)) / n,
        ends / n,
        sum(len(w) == 1 for w in found) / n * 2,
        count[128:].sum() / size,
    ]


def inputs(texts: list[str | None], n_chars: list[float | None], hashes: WordHashes, buckets: int = BUCKETS) -> np.ndarray:
    """Dense inputs of a block of texts, a row each: buckets of words, then structure."""
    out = np.zeros((len(texts), buckets + STRUCTURE), np.float32)
    for i, (text, n) in enumerate(zip(texts, n_chars)):
        text = text or ""
        h = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
        if len(h):
            row = np.log1p(np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets))
            out[i, :buckets] = row / np.sqrt((row * row).sum())
        out[i, buckets:] = structure(text, n)
    return out


class Rows:
    """Inputs of many rows, of which only those that aren't zero are held; x[rows] has all of some rows."""

    def __init__(self, places: list[bytes], values: list[bytes], width: int):
        self.places, self.values, self.shape = places, values, (len(places), width)

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.shape[1]), np.float32)
        for i, row in enumerate(rows.tolist()):
            out[i, np.frombuffer(self.places[row], "<u2")] = np.frombuffer(self.values[row], np.float32)
        return out


@dataclass
class Machine:
    """A fitted factorisation machine: scores are probabilities of label 1."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.weights + 0.5 * ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray | Rows, y: np.ndarray, epochs: int = 30, rate: float = 0.5, decay: float = 1e-5, seed: int = 7, batch: int = 128) -> Machine:
        """AdaGrad on log loss; the rows of x in their order decide the result. Without rows every score is 0.5."""
        random = np.random.default_rng(seed)
        if isinstance(x, np.ndarray):
            x = x.astype(np.float32, copy=False)
        m = cls(0.0, np.zeros(x.shape[1], np.float32), random.normal(0, 0.02, (x.shape[1], FACTORS)).astype(np.float32))
        if not len(x):
            m.factors[:] = 0
            return m
        m.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        gb, gw, gv = 1.0, np.full_like(m.weights, 0.1), np.full_like(m.factors, 0.1)
        for _ in range(epochs):
            order = random.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                b, t = x[rows], y[rows]
                sums = b @ m.factors
                error = ((m.score(b) - t) / len(rows)).astype(np.float32)
                db, dw = float(error.sum()), b.T @ error + decay * m.weights
                dv = b.T @ (error[:, None] * sums) - ((b * b).T @ error)[:, None] * m.factors + decay * m.factors
                gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
                m.bias -= rate * db / gb**0.5
                m.weights -= rate * dw / np.sqrt(gw)
                m.factors -= rate * 0.5 * dv / np.sqrt(gv)
        return m


def held_out(doc_id) -> F.Column:
    """Rows kept out of fitting: crc32 of the id as text leaves no rest modulo FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _has_length(docs: DataFrame) -> bool:
    """Whether docs has numbers in n_chars; a column of that name and another type is some other thing, and plays no part."""
    return any(f.name == "n_chars" and isinstance(f.dataType, NumericType) for f in docs.schema.fields)


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    length = F.col("n_chars").cast("double") if _has_length(docs) else F.lit(None).cast("double")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), length.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on the rows of at most `sample` labelled ids outside the held-out fold.

    Labels other than 0 and 1, and ids with both, are not used; a repeated
    label counts once. Of the rows of a repeated id, ID_ROWS count, the first by a
    hash of what is fitted; so at most ID_ROWS * sample rows come to the driver.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows: a proven bound for the broadcast
    rows = _text_rows(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in blocks(batches):
            x = inputs(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), hashes)
            at = [np.flatnonzero(row) for row in x]
            yield pa.record_batch([b.column("doc_id").cast(pa.string()), b.column("y"), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([row[a].tobytes() for a, row in zip(at, x)], pa.binary())], ["doc_id", "y", "at", "x"])

    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("at", "x"), "at", "x"))
    some = rows.mapInArrow(prepare, "doc_id string, y int, at binary, x binary").withColumn("nth", nth).where(F.col("nth") <= ID_ROWS).drop("nth")
    got = some.toArrow().sort_by([("doc_id", "ascending"), ("at", "ascending"), ("x", "ascending")])
    return Machine.fit(Rows(got["at"].to_pylist(), got["x"].to_pylist(), BUCKETS + STRUCTURE), np.array(got["y"].to_pylist(), np.float32))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts have the score of a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in blocks(batches, 128):
            s = model.score(inputs(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), hashes))
            yield pa.record_batch([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    rows = _text_rows(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the model rejects, scored where they stand; every column as it was."""
    at = [docs.columns.index(text_col), docs.columns.index("n_chars") if _has_length(docs) else None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in blocks(batches, 128):
            n = [None if x is None else float(x) for x in b.column(at[1]).to_pylist()] if at[1] is not None else [None] * b.num_rows
            yield b.filter(pa.array(model.score(inputs(b.column(at[0]).to_pylist(), n, hashes)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
