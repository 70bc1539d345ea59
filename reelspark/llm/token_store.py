"""Operator 8: token ids in binary shards with a minimal perfect hash index.

A store is a folder of shards. Shard file: 16 bytes of header (magic, version,
bytes per id, zero), then the raw little-endian ids of its documents, each with
the end id, one document after the other. Sidecar file of the same name with
`.mph`: an .npz of the shard's document keys in order with their lengths, and
the index: bit levels of a minimal perfect hash (each level sets the bits that
exactly one remaining key hashes to; rank of a key's bit is its slot), and for
each slot a 32-bit fingerprint of the key, first id and number of ids. A lookup
costs one hash per level, a rank and a fingerprint comparison. Shards hold
ascending ranges of keys and end at SHARD_BYTES. manifest/ (Parquet, committed by Spark) names the
files that count: what a failed or repeated task attempt left is never read.
"""

from __future__ import annotations

import array
import bisect
import functools
import io
import itertools
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import filesystem, mix, scratch_path, table

MAGIC, VERSION = b"RSTK", 1
END_ID = 0
#: Bits of a level for each remaining key.
GAMMA = 2.0
#: Bytes of text that are encoded at once, whole texts at least, and runs that go through the library in one text.
TEXT_BYTES, RUNS_AT_ONCE = 40 << 20, 1000
#: Bytes of ids from which a shard ends and the task begins the next.
SHARD_BYTES = 1 << 30

# Within these characters the pre-tokenizer's pieces can be told by plain rules; other texts are encoded whole.
_LETTERS, _SPACE = "A-Za-zÀ-ÖØ-öø-ɏ", " \t\n\r\x0b\x0c"
_OTHER = r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]"
#: A space that no mark follows.
_WIDE_SPACE = rf" (?:[{_SPACE}]|$)"
#: Stands before a text's first run, as no space does; one of the characters that _OTHER keeps out.
_FIRST = "\x1f"
#: Ends each of the runs that go through the library in one text.
_END = "\x0b"
#: Runs that would grow together with _END, or hold it.
_ALONE = rf"^{_FIRST}?(?:$|[{_SPACE}])|[{_SPACE}]$|{_END}"


class Encoder:
    """ids of texts, from a tokenizers file in JSON.

    Byte-level pieces are encoded independently of each other, and none goes on
    over a space that a mark follows. So a block's distinct runs between spaces go
    through the library once, many in one text, and each text takes its runs' ids.
    Texts with characters outside Latin letters, ASCII digits, marks and spaces,
    with a space that no mark follows, or with an added token such as
    <|endoftext|>, go through the library whole.
    """

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        end = self._ids([_END])[0]
        how = json.loads(tokenizer_json)
        split = how.get("pre_tokenizer") or {}
        self.by_run = len(end) == 1 and not how.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.end = end[0] if self.by_run else None
        # a normalized token may match other spellings; only where there is no normalizer, which by_run asks for, is its content all that it matches
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join([_OTHER, _WIDE_SPACE, *(rf"\Q{x}\E" for x in added)])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_runs(self, runs: list[str], before: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of (ids, number of ids of each run), in order; before stands before each run."""
        for at in range(0, len(runs), RUNS_AT_ONCE):
            (ids,) = self._ids([before + (_END + before).join(runs[at : at + RUNS_AT_ONCE]) + _END])
            ends = np.flatnonzero(ids == self.end)
            yield np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def encode(self, texts: pa.Array) -> list[bytes]:
        """ids of each text as little-endian bytes; null: none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, self.whole) if self.by_run else pa.array([True] * len(texts), pa.bool_())
        out: list[bytes | None] = [None] * len(texts)
        at = np.flatnonzero(whole)
        for i, ids in zip(at.tolist(), self._ids(texts.filter(whole).to_pylist())):
            out[i] = ids.tobytes()
        at = np.flatnonzero(pc.invert(whole))
        if not len(at):
            return out
        split = pc.split_pattern(pc.binary_join_element_wise(_FIRST, texts.take(pa.array(at)), ""), " ")
        runs = split.flatten().dictionary_encode()
        ends_of, names, codes = split.offsets.to_numpy(), runs.dictionary, runs.indices.to_numpy()
        del split, runs
        alone, first = (np.asarray(x) for x in (pc.match_substring_regex(names, _ALONE), pc.starts_with(names, _FIRST)))
        parts, order = [], []
        for which, before in ((~alone & ~first, " "), (~alone & first, "")):
            order.append(np.flatnonzero(which))
            said = names.filter(pa.array(which)).to_pylist()
            parts += self._of_runs(said if before else [r[1:] for r in said], before)
        order.append(np.flatnonzero(alone))
        parts += [(x, np.array([len(x)])) for x in self._ids([r[1:] if r[:1] == _FIRST else " " + r for r in names.filter(pa.array(alone)).to_pylist()])]
        place = np.empty(len(names), np.int32)
        place[np.concatenate(order)] = np.arange(len(names), dtype=np.int32)
        ends = np.concatenate([[0], *(n for _, n in parts)]).cumsum() * self.dtype.itemsize
        ids = pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([x for x, _ in parts]))])
        ids = ids.take(pa.array(place[codes]))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ends_of].tolist()
        raw = memoryview(ids.buffers()[2])
        for i, a, b in zip(at.tolist(), ends, ends[1:]):
            out[i] = bytes(raw[a:b])
        return out


@functools.cache
def encoder(tokenizer_json: str) -> Encoder:
    """One for each process, so that a worker's later tasks find the pieces of its earlier ones."""
    return Encoder(tokenizer_json)


def key_hash(keys: np.ndarray) -> np.ndarray:
    """Two keys per document, its id and which of the rows with that id it is, as one 64-bit hash."""
    k = keys.astype(np.int64).view(np.uint64).reshape(-1, 2)
    return mix(mix(k[:, 0] + np.uint64(0x9E3779B97F4A7C15)) ^ (k[:, 1] * np.uint64(0xD1B54A32D192ED03)))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes, with a fingerprint for each slot."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints
        #: Set bits before each level, and within a level before each of its 64-bit words.
        ones = [np.bitwise_count(x).astype(np.int64) for x in levels]
        self.before = np.concatenate([[0], np.cumsum([x.sum() for x in ones])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(x)]) for x in ones]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, levels = hashes, []
        while len(left):
            size = max(64, int(-(-GAMMA * len(left) // 64)) * 64)
            at = cls._at(left, len(levels), size)
            count = np.bincount(at, minlength=size)
            words = np.zeros(size // 64, np.uint64)
            alone = np.flatnonzero(count == 1)
            np.bitwise_or.at(words, alone >> 6, np.uint64(1) << (alone & 63).astype(np.uint64))
            levels.append(words)
            left = left[count[at] != 1]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        out = cls(levels, np.zeros(len(hashes), np.uint32))
        slots = out._slots(hashes)
        out.fingerprints[slots] = cls.fingerprint(hashes)
        return out

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64((level + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def fingerprint(hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, words in enumerate(self.levels):
            at = self._at(hashes[open_], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[level] + self.ranks[level][at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1 where the fingerprint says that the key isn't there (a stranger passes once in 2 ** 32)."""
        out = self._slots(hashes)
        if len(self.fingerprints):
            out[(out >= 0) & (self.fingerprints[np.maximum(out, 0)] != self.fingerprint(hashes))] = -1
        return out


#: What the manifest says of a shard: name, first and last key with their numbers among the rows of one id, documents and ids.
MANIFEST = pa.schema([("shard", pa.string()), ("first_key", pa.int64()), ("first_nth", pa.int64()), ("last_key", pa.int64()), ("last_nth", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])


class _ShardWriter:
    """Streams one shard: ids go to the file as they come, only keys and lengths stay in memory."""

    def __init__(self, folder: str, dtype: np.dtype):
        fs, path = filesystem(folder)
        fs.create_dir(f"{path}/shards", recursive=True)
        task = TaskContext.get()
        self.name = f"shards/{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}"
        self.fs, self.path, self.dtype, self.bytes = fs, f"{path}/{self.name}", dtype, 0
        self.keys, self.sizes = array.array("q"), array.array("q")
        self.file = fs.open_output_stream(self.path)
        self.file.write(MAGIC + bytes([VERSION, dtype.itemsize]) + bytes(10))

    def add(self, key: tuple[int, int], ids: bytes) -> None:
        self.file.write(ids)
        self.bytes += len(ids)
        self.keys.extend(key)
        self.sizes.append(len(ids) // self.dtype.itemsize)

    def close(self) -> dict:
        self.file.close()
        keys, sizes = np.array(self.keys, np.int64).reshape(-1, 2), np.array(self.sizes, np.int64)
        hashes = key_hash(keys)
        index = PerfectHash.build(hashes)
        slots = index.slots(hashes)
        starts, lengths = np.zeros((2, len(keys)), np.int64)
        starts[slots], lengths[slots] = np.cumsum(sizes) - sizes, sizes
        data = io.BytesIO()
        np.savez(data, keys=keys, sizes=sizes, fingerprints=index.fingerprints, starts=starts, lengths=lengths, level_words=np.array([len(x) for x in index.levels]), words=np.concatenate([np.zeros(0, np.uint64), *index.levels]))
        with self.fs.open_output_stream(f"{self.path}.mph") as f:
            f.write(data.getvalue())
        return dict(zip(MANIFEST.names, (self.name, *keys[0].tolist(), *keys[-1].tolist(), len(keys), int(sizes.sum()))))


class Shard:
    """One shard opened for reading."""

    def __init__(self, folder: str, name: str):
        self.fs, path = filesystem(folder)
        self.path = f"{path}/{name}"
        with self.fs.open_input_file(self.path) as f:
            head = f.read(16)
        if head[:4] != MAGIC or head[4] != VERSION:
            raise ValueError(f"{name} is no shard of version {VERSION}")
        self.dtype = np.dtype(f"<u{head[5]}")
        with self.fs.open_input_file(f"{self.path}.mph") as f:
            z = np.load(io.BytesIO(f.read()))
        self.keys, self.sizes, self.starts, self.lengths = z["keys"], z["sizes"], z["starts"], z["lengths"]
        self.index = PerfectHash(np.split(z["words"], np.cumsum(z["level_words"])[:-1]) if len(z["level_words"]) else [], z["fingerprints"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of each key (id, nth row of that id); -1 where it isn't here."""
        slots = self.index.slots(key_hash(keys))
        return np.where(slots >= 0, self.starts[slots], -1), np.where(slots >= 0, self.lengths[slots], -1)

    def get(self, key: int, nth: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        start, size = (int(x[0]) for x in self.find(np.array([[key, nth]])))
        if start < 0:
            return None
        with self.fs.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at(size * self.dtype.itemsize, 16 + start * self.dtype.itemsize), self.dtype)

    def scan(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(key, nth, first id, ids) of all documents in file order."""
        starts, sizes = self.find(self.keys)
        with self.fs.open_input_stream(self.path, buffer_size=1 << 20) as f:
            f.read(16)
            for (key, nth), start, size in zip(self.keys.tolist(), starts.tolist(), sizes.tolist()):
                yield key, nth, start, np.frombuffer(f.read(size * self.dtype.itemsize), self.dtype)


def _sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of up to TEXT_BYTES of text, or of one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
        cuts = np.flatnonzero(np.diff(sizes.cumsum() // TEXT_BYTES)) + 1
        for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text of docs and write a store in ascending order of id_col.

    Null text: empty, so only the end id. Rows that share an id keep one entry
    each, told apart by their number among these rows, ordered by text. A null
    id isn't addressable and sorts first, under the smallest integer. An empty
    table writes an empty manifest. Other columns play no part. All rows of one
    id pass through one task, as a stream; only their keys and sizes are held.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, writer, before = encoder(tokenizer_json), None, (None, 0)
        end = np.array([end_id], ids_of.dtype).tobytes()
        for b in _sized(batches):
            writer = writer or _ShardWriter(folder, ids_of.dtype)
            for key, ids in zip(b.column(0).to_pylist(), ids_of.encode(b.column(1))):
                if writer.bytes > shard_bytes:
                    yield pa.RecordBatch.from_pylist([writer.close()], MANIFEST)
                    writer = _ShardWriter(folder, ids_of.dtype)
                before = (key, before[1] + 1 if key == before[0] else 0)
                writer.add(before, ids + end)
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()], MANIFEST)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.col(text_col).cast("string").alias("text"))
    shards = rows.repartitionByRange(*_partitions(spark), "key").sortWithinPartitions("key", "text")
    shards.mapInArrow(encode, "shard string, first_key long, first_nth long, last_key long, last_nth long, docs long, ids long").write.parquet(f"{folder}/manifest")


def _partitions(spark: SparkSession) -> list[int]:
    return [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def shard_list(spark: SparkSession, folder: str) -> list[dict]:
    """The manifest in key order, a row for each shard, with the ids before it; a row for each write task, or for each SHARD_BYTES if these are more."""
    rows, total = [], 0
    for r in sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: (r.first_key, r.first_nth)):
        rows.append(r.asDict() | {"before": total})
        total += r.ids
    return rows


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, nth, start, n_tokens, ids_crc32, shard, index_start), read from the files, a task for each shard.

    start counts the ids of all documents before; index_start is where the perfect hash index finds the document within its shard.
    """
    listed = shard_list(spark, folder)
    schema = "doc_id long, nth int, start long, n_tokens long, ids_crc32 long, shard string, index_start long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "nth", "start", "n_tokens", "ids_crc32", "shard", "index_start"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for name, at in zip(b.column("shard").to_pylist(), b.column("before").to_pylist()):
                out = []
                for key, nth, found, ids in Shard(folder, name).scan():
                    out.append((None if key == -(2**63) else key, nth, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name, found))
                    at += len(ids)
                    if len(out) == 5000:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                        out = []
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    if not listed:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame([(r["shard"], r["before"]) for r in listed], "shard string, before long")
    return todo.repartition(len(listed)).mapInArrow(scan, schema)


class Store:
    """A store opened for keyed access: the manifest is read once, and a shard's index when a key first falls into it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.shards = folder, shard_list(spark, folder)
        self.first = [(r["first_key"], r["first_nth"]) for r in self.shards]
        self.opened = functools.lru_cache(maxsize=64)(lambda name: Shard(folder, name))

    def get(self, key: int, nth: int = 0) -> np.ndarray | None:
        """One document's ids, or None: its shard by the manifest's key ranges, its place by the shard's index."""
        at = bisect.bisect_right(self.first, (key, nth)) - 1
        return None if at < 0 else self.opened(self.shards[at]["shard"]).get(key, nth)


def lookup(spark: SparkSession, folder: str, key: int, nth: int = 0) -> np.ndarray | None:
    """One document's ids by key; for many keys, keep a Store."""
    return Store(spark, folder).get(key, nth)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokens_of(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write docs to a new store in the shared folder and read it back."""
    folder = scratch_path(spark, "tokens")
    write_tokens(spark, docs, folder, tokenizer_path or tokenizer_file())
    return read_tokens(spark, folder)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(spark, table(spark, sf_dir, "documents"))
