"""Helpers that the training-data operators share: the shared folder, cutting
lineage, files in that folder, and hashing of words."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Entries a worker's word cache may hold before it starts afresh; bounds memory, never results.
CACHE_ENTRIES = 200_000

#: Documents that a task works on at once.
BLOCK_ROWS = 256

_own: dict[str, str] = {}
_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in
    local mode, where that is unset, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="reelspark-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_scratch() -> None:
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # the context has gone; the cluster's own clean-up remains
            return


#: Spark then deletes an execution's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, and needs its shuffle files no more."""
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, for tasks that write or read files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def blocks(batches: Iterable[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller pieces, so that a task's memory doesn't follow Arrow's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches: Iterable[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of up to so many bytes of a text column, or of one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        cuts = np.flatnonzero(np.diff(sizes.cumsum() // most)) + 1
        for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text in UTF-8, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """Word to its 64-bit xxh3 hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Fewer words than size: the whole sequence is one shingle. No words, or no text: empty.
    """
    h = hashes.of(words(text))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(mix(out))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
