"""Operator 6: cross-entropy difference of two matched n-gram models.

Both models are bigram models over the words of all documents. The target model
counts the documents labelled good, the background model all documents;
background counts are scaled to the target's size, so both smooth alike.
p(w) = (c(w) + 0.1) / (n + 0.1 * V), where V is the number of distinct words, but at
least VOCABULARY, and after a word h p(w | h) = (c(h, w) + BETA * p(w)) / (c(h) + BETA).
A document's score is the mean over its tokens of -ln p_target + ln p_background
(Moore and Lewis, 2010): below zero is closer to the target than to the rest.

Counts cover every word of every document and are kept by full keys: a word's
64-bit hash, and for a bigram those of both words. Nothing is folded, so counts
grow with the corpus. Words are counted first, in a Spark table. Then occurrences
go to the shard of their word w, summed for each document before, as packed
columns. There c(w) and c(h, w) are sums over the shard, and ln(c(w) + BETA) is due
once for each time that a word follows w in the same document, so a shard gives its
share of every document's losses; shares are summed by block of documents. Words with a large
part of all occurrences (a bounded number) are dealt by (h, w), with c(w) sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, blocks, materialize, mix, table, words

#: Least size of the vocabulary for smoothing; words aren't folded to it.
VOCABULARY = 1 << 17
#: Added mass: a tenth of a word for each word of the least vocabulary; BETA words' worth of the word model after each word.
ALPHA, BETA = 0.1 * VOCABULARY, 4.0
#: Up to so many ids of target documents are broadcast, some 70 MB; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Occurrences that a task packs at once, and that a shard has on average at most.
PACK_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 21
#: Documents whose shares of losses travel and are summed together.
BLOCK_DOCS = 4096
#: At most so many words are dealt by (h, w), some 6 MB that go with the tasks' code. A word that isn't has at most this part of all occurrences, and they are in one shard.
HOT_WORDS = 1 << 18
#: In place of a word before a text's first.
START = np.zeros(1, np.uint64)
PACKED = [("w", "<u8"), ("h", "<u8"), ("doc", "<u4"), ("n", "<u4"), ("followed", "<u4"), ("good", "u1")]


def token_ids(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of(words(text))


@dataclass
class Models:
    """What was counted: the texts with their mark, sizes of both models, and counts of the commonest words."""

    docs: DataFrame
    columns: tuple[str, str]
    rows: DataFrame
    total: tuple[int, int]
    vocabulary: int
    shards: int
    hot: np.ndarray
    hot_counts: np.ndarray


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, held, size = WordHashes(), [], 0

    def summed() -> pa.RecordBatch:
        w, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        good = np.concatenate([np.full(len(x), g) for x, g in held])
        return pa.record_batch([pa.array(w.view(np.int64)), pa.array(np.bincount(at[good], minlength=len(w)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(w)).astype(np.int64))], ["w", "target", "n"])

    for b in blocks(batches):
        for text, good in zip(b.column("text").to_pylist(), b.column("good").to_pylist()):
            ids = token_ids(text, hashes)
            if len(ids):
                held.append((ids, good))
                size += len(ids)
            if size >= PACK_TOKENS:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()


def train(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """Count docs; target_ids has the ids (column id_col) of the target's documents, repeated ids counting once.

    The ids are counted first: up to BROADCAST_IDS go to the texts, beyond that
    both are shuffled by id, with the same result. Words are counted here;
    bigrams where score looks them up.
    """
    good = target_ids.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().withColumn("__good", F.lit(True))
    if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(good, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", F.coalesce("__good", F.lit(False)).alias("good"))
    spark = docs.sparkSession
    counted = rows.select("text", "good").mapInArrow(_count_words, "w long, target long, n long").groupBy("w").agg(F.sum("target").alias("target"), F.sum("n").alias("n"))
    counted = materialize(spark, counted, "words")
    target, n, vocabulary = counted.agg(F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_TOKENS))
    hot = counted.where(F.col("n") > n // min(4 * shards, HOT_WORDS)).toArrow().sort_by("w")  # fewer than HOT_WORDS
    w = hot["w"].to_numpy().view(np.uint64)
    order = np.argsort(w)
    return Models(docs, (id_col, text_col), rows, (target, n), vocabulary, shards, w[order], np.array([hot["target"].to_numpy(), hot["n"].to_numpy()])[:, order])


def _known(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ones, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _pairs(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(w ^ mix(h + np.uint64(0x9E3779B97F4A7C15)))


def _occurrences(rows: DataFrame, kind: str, m: Models, counts: bool, scored: bool) -> DataFrame:
    """Occurrences packed by shard (data, base, counts, scored), and a row for each document to be scored (row, doc_id, n_tokens)."""
    shards, hot = m.shards, m.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0
        base = TaskContext.get().partitionId() << 36
        doc_type: pa.DataType | None = None

        def packed() -> Iterator[pa.RecordBatch]:
            ids = [x for x, *_ in held]
            lengths = np.array([len(x) for x in ids])
            if scored:
                row = base + np.arange(len(held))
                empty = [pa.nulls(len(held), t) for t in (pa.binary(), pa.int64(), pa.bool_(), pa.bool_())]
                yield pa.record_batch([pa.array((row % shards).astype(np.int32)), *empty, pa.array(row), pa.array([d for _, d, _ in held], doc_type), pa.array(lengths)], names)
            w, n = np.concatenate(ids), int(lengths.sum())
            if not n:
                return
            ends = np.cumsum(lengths)
            h = np.concatenate([START, w[:-1]])
            h[(ends - lengths)[lengths > 0]] = 0
            followed = np.ones(n, np.uint32)
            followed[ends[lengths > 0] - 1] = 0
            doc, good = np.repeat(np.arange(len(held), dtype=np.uint32), lengths), np.repeat(np.array([g for *_, g in held], np.uint8), lengths)
            pair = _pairs(w, h)
            shard = np.where(_known(hot, w)[0], pair, mix(w)) % np.uint64(shards)
            order = np.argsort(shard << np.uint64(40) | pair >> np.uint64(24), kind="stable")
            w, h, doc, good, followed, shard = (x[order] for x in (w, h, doc, good, followed, shard))
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
            columns = dict(zip((k for k, _ in PACKED), (w[first], h[first], doc[first], np.diff(first, append=n), np.add.reduceat(followed, first), good[first])))
            shard = shard[first]
            cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            data = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                raw = b"".join(columns[k][a:b].astype(t).tobytes() for k, t in PACKED)
                data.append((b - a).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
            k = len(data)
            for a in range(0, k, 64):
                at = cuts[:-1][a : a + 64]
                j = len(at)
                yield pa.record_batch([pa.array(shard[at].astype(np.int32)), pa.array(data[a : a + 64], pa.binary()), pa.array(np.full(j, base)), pa.array([counts] * j), pa.array([scored] * j), pa.nulls(j, pa.int64()), pa.nulls(j, doc_type), pa.nulls(j, pa.int64())], names)

        for b in blocks(batches):
            doc_type = b.column("doc_id").type
            for doc_id, text, good in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("good").to_pylist()):
                held.append((token_ids(text, hashes), doc_id, good))
                size += len(held[-1][0])
                if size >= PACK_TOKENS or len(held) >= PACK_TOKENS // 8:
                    yield from packed()
                    base, held, size = base + len(held), [], 0
        if held:
            yield from packed()

    names = ["shard", "data", "base", "counts", "scored", "row", "doc_id", "n_tokens"]
    return rows.mapInArrow(run, f"shard int, data binary, base long, counts boolean, scored boolean, row long, doc_id {kind}, n_tokens long")


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row; losses and score are means over tokens.

    Null and empty texts have no tokens, and zeros. Rows that share an id, or have
    none, are scored each. Other columns play no part; an empty table gives an
    empty result.
    """
    m, kind = models, dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    if docs is m.docs and m.columns == (id_col, text_col):
        found = _occurrences(m.rows, kind, m, True, True)
    else:
        asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("good"))
        found = _occurrences(asked, kind, m, False, True).unionByName(_occurrences(m.rows.withColumn("doc_id", F.lit(None).cast(kind)), kind, m, True, False))
    size = max(float(m.total[0]), 1.0)
    scale = np.array([[1.0], [size / m.total[1] if m.total[1] else 1.0]])
    total = np.array([[float(m.total[0])], [m.total[1] * scale[1, 0]]])
    each = ALPHA / VOCABULARY
    mass, hot, hot_counts = each * max(VOCABULARY, m.vocabulary), m.hot, m.hot_counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = ["block", "data", "row", "doc_id", "n_tokens"], []
        doc_type: pa.DataType | None = None
        for b in batches:
            doc_type = b.column("doc_id").type
            heads = b.filter(b.column("row").is_valid())
            block = pa.array(heads.column("row").to_numpy() // BLOCK_DOCS)
            yield pa.record_batch([block, pa.nulls(heads.num_rows, pa.binary()), heads.column("row"), heads.column("doc_id"), heads.column("n_tokens")], names)
            for data, base, counts, scored in zip(*(b.filter(b.column("data").is_valid()).column(k).to_pylist() for k in ("data", "base", "counts", "scored"))):
                n = int.from_bytes(data[:8], "little")
                raw = pa.decompress(data[8:], n * sum(np.dtype(t).itemsize for _, t in PACKED), codec="zstd", asbytes=True)
                got, at = {}, 0
                for k, t in PACKED:
                    got[k] = np.frombuffer(raw, t, n, at)
                    at += n * np.dtype(t).itemsize
                weight = got["n"].astype(np.int64)
                parts.append((got["w"], got["h"], base + got["doc"].astype(np.int64) if scored else np.full(n, -1), got["n"], got["followed"], weight * got["good"] if counts else 0 * weight, weight if counts else 0 * weight))
        if not parts:
            return
        w, h, row, n, followed, good, all_ = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((h, w))
        w, h, row, n, followed, good, all_ = (x[order] for x in (w, h, row, n, followed, good, all_))
        new_word = np.concatenate([[True], w[1:] != w[:-1]])
        new_pair = new_word | np.concatenate([[True], h[1:] != h[:-1]])
        word_at, pair_at = np.flatnonzero(new_word), np.flatnonzero(new_pair)
        of_word = np.array([np.add.reduceat(x, word_at) for x in (good, all_)])
        is_hot, at = _known(hot, w[word_at])
        of_word[:, is_hot] = hot_counts[:, at[is_hot]]
        of_pair = np.array([np.add.reduceat(x, pair_at) for x in (good, all_)])
        one = of_word * scale
        # from words to pairs to rows
        p_word, as_context = (one + each) / (total + mass), np.log(one + BETA)
        at_word = np.cumsum(new_word)[pair_at] - 1
        loss = -np.log(np.where(h[pair_at] == 0, p_word[:, at_word], of_pair * scale + BETA * p_word[:, at_word]))
        at_pair = np.cumsum(new_pair) - 1
        ask = row >= 0
        rows_, at_row = np.unique(row[ask], return_inverse=True)
        share = [np.bincount(at_row, (loss[i][at_pair] * n + as_context[i][at_word][at_pair] * followed)[ask], minlength=len(rows_)) for i in (0, 1)]
        # rows are ordered, so a block's shares lie together
        block, first = np.unique(rows_ // BLOCK_DOCS, return_index=True)
        for a in range(0, len(block), 64):
            cuts = zip(first[a : a + 64].tolist(), np.append(first, len(rows_))[a + 1 : a + 65].tolist())
            data = [b"".join([(rows_[i:j] % BLOCK_DOCS).astype("<u2").tobytes(), share[0][i:j].tobytes(), share[1][i:j].tobytes()]) for i, j in cuts]
            k = len(data)
            yield pa.record_batch([pa.array(block[a : a + 64]), pa.array(data, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, doc_type), pa.nulls(k, pa.int64())], names)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum up the shares of each block of documents; blocks come one after the other."""
        held, heads, sums = None, [], np.zeros((2, BLOCK_DOCS))

        def summed() -> Iterator[pa.RecordBatch]:
            for h in heads:
                at = h.column("row").to_numpy() % BLOCK_DOCS
                yield pa.record_batch([h.column("doc_id"), h.column("n_tokens"), pa.array(sums[0][at]), pa.array(sums[1][at])], ["doc_id", "n_tokens", "a", "b"])

        for b in batches:
            blocks_ = b.column("block").to_numpy()
            for at in np.split(np.arange(len(blocks_)), np.flatnonzero(np.diff(blocks_)) + 1):
                if not len(at):
                    continue
                if held is not None and held != blocks_[at[0]]:
                    yield from summed()
                    heads, sums = [], np.zeros((2, BLOCK_DOCS))
                held, part = blocks_[at[0]], b.slice(int(at[0]), len(at))
                heads.append(part.filter(part.column("row").is_valid()))
                for data in part.column("data").drop_null().to_pylist():
                    n = len(data) // 18
                    row = np.frombuffer(data, "<u2", n)
                    sums[0][row] += np.frombuffer(data, np.float64, n, 2 * n)
                    sums[1][row] += np.frombuffer(data, np.float64, n, 10 * n)
        if held is not None:
            yield from summed()

    shares = found.repartitionById(m.shards, F.col("shard")).mapInArrow(run, f"block long, data binary, row long, doc_id {kind}, n_tokens long")
    of_doc = shares.repartition("block").sortWithinPartitions("block").mapInArrow(combine, f"doc_id {kind}, n_tokens long, a double, b double")
    mean = lambda x: F.when(F.col("n_tokens") > 0, F.col(x) / F.col("n_tokens")).otherwise(0.0)
    return of_doc.select("doc_id", "n_tokens", mean("a").alias("target_loss"), mean("b").alias("background_loss")).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels").where("quality = 1")))
