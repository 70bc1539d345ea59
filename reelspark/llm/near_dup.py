"""Operator 4: near-duplicate groups by fast similarity sketches.

Every distinct shingle set gets a sketch of SKETCH coordinates: in round i each
shingle is hashed into one of the SKETCH bins (from round SKETCH on, all go into
bin i - SKETCH), and a bin keeps its smallest (round, hash). Rounds end when all
bins are full, at the latest after 2 * SKETCH, so every coordinate fills, at
about |set| + SKETCH * ln(SKETCH) hashes (Dahlgaard, Knudsen and Thorup, Fast
Similarity Sketching, FOCS 2017). Sets that agree on all ROWS coordinates of one
of BANDS bands are candidates: a pair at similarity 0.75 is missed with
probability (1 - 0.75 ** 4) ** 32, below 6e-6. Links are confirmed on full sets.

Only one document of those with the same set takes part in the search. Within a
bucket, members are compared with one hub, not with each other. Members of
buckets that then hold several components are compared in full, but only across
components (these pairs alone can add a link), in blocks, by an exact prefix filter
on their rarest shingles: nothing is lost, no table holds all pairs of a group, and
texts that merely share a frequent passage never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, blocks, cut, materialize, mix, shingles, table, unused
from .components import components

SKETCH, BANDS, ROWS = 128, 32, 4
SHINGLE_WORDS = 5
#: Similarity as percentages: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Buckets of several components meet a second hub first if they hold more pairs across components for each member.
PAIRS_EACH = 16
#: About as many documents and characters are in one block of the full comparison.
BLOCK_DOCS, BLOCK_CHARS = 256, 4_000_000
_ROUND_SEEDS = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketch(shingle_set: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes; size coordinates, a power of two.

    Rounds are done several at a time for small sets; a bin's smallest value has
    the smallest round in its high bits, so rounds past the last needed one change nothing.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(size, full, np.uint64)
    done, n = 0, len(shingle_set)
    while n and done < 2 * size:
        rounds = np.arange(done, min(2 * size, done + max(1, -(-6 * size // n))), dtype=np.uint64)
        h = mix(shingle_set[None, :] ^ _ROUND_SEEDS[rounds.astype(np.int64), None])
        bins = np.where(rounds[:, None] < size, h & np.uint64(size - 1), rounds[:, None] - np.uint64(size))
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(56)) | (h >> np.uint64(8))).ravel())
        done += len(rounds)
        if not (out == full).any():
            break
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, with the band's number mixed in."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in coordinates.reshape(bands, rows).T:
        out = mix(out ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in blocks(batches):
        n, keys, bands = [], [], []
        for text in b.column(1).to_pylist():
            s = shingles(text, hashes, SHINGLE_WORDS)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(band_keys(sketch(s)) if len(s) else None)
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])


def _linked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, hub, hub_set = WordHashes(), object(), None
    for b in blocks(batches):
        keep = []
        for u, text_u, text_v in zip(b.column("u").to_pylist(), b.column("text_u").to_pylist(), b.column("text_v").to_pylist()):
            if (u, text_u) != hub:
                hub, hub_set = (u, text_u), shingles(text_u, hashes, SHINGLE_WORDS)
            other = shingles(text_v, hashes, SHINGLE_WORDS)
            both = len(np.intersect1d(hub_set, other, assume_unique=True)) if 100 * min(len(hub_set), len(other)) >= PERCENT * max(len(hub_set), len(other)) else 0
            keep.append(both > 0 and 100 * both >= PERCENT * (len(hub_set) + len(other) - both))
        yield pa.record_batch([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; pairs arrive at a task sorted by hub u."""
    both = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v").join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(_linked_rows, "u long, v long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Null or wordless texts: n_shingles 0, linked with nothing. Rows that share an
    id are one node with all their texts, and each gives a row. A null id is
    linked with nothing; its component_id is null and kept is true. An empty
    table gives an empty result; other columns of docs play no part.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(spark, docs.mapInArrow(_sketch_rows, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    able = rows.where("doc_id is not null and set_key is not null")
    classes = cut(able.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    # one row of each class carries its bands on
    own = able.select(F.col("doc_id").alias("rep"), "set_key", "bands").join(classes, ["set_key", "rep"], "left_semi").dropDuplicates(["set_key", "rep"])
    members = own.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("bucket", "hub")
    members = materialize(spark, members.join(hubs, "bucket"), "buckets")
    texts = materialize(spark, docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "candidates")
    # ids that occur with several sets tie these classes together
    named = able.select("doc_id", "set_key").join(classes, "set_key").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"))
    several = named.where("u < v").select("doc_id", "u")
    ties = able.join(several, "doc_id").join(classes, "set_key").select("u", F.col("rep").alias("v"))
    tried = cut(members.where("hub < id").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct())
    links = cut(_confirmed(tried, texts).unionAll(ties))
    labels = components(links)
    failed = cut(tried.join(links, ["u", "v"], "left_anti"))
    if not failed.isEmpty():
        labels = _settle(members, texts, labels, failed)
    reps = labels.select(F.col("node").alias("rep"), "component")
    found = classes.join(reps, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    return rows.drop("bands").join(found, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in blocks(batches, 64):
        sets = [shingles(text, hashes, SHINGLE_WORDS) for text in b.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        ids = b.column("doc_id").to_numpy()
        yield pa.record_batch([pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(keys, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "set", "n", "shingle"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across labels between two blocks of documents, whose rows come one after the other."""
    hashes = WordHashes()

    def links(rows: list[tuple]) -> pa.RecordBatch:
        sets = [shingles(r[4], hashes, SHINGLE_WORDS) for r in rows]
        size = np.array([len(x) for x in sets], np.int64)
        label, second = np.array([r[3] for r in rows]), np.array([r[1] for r in rows], bool)
        left, right = np.flatnonzero(~second), np.flatnonzero(second) if second.any() else np.arange(len(rows))
        doc, value = np.repeat(np.arange(len(rows)), size), np.concatenate(sets)
        kinds, code = np.unique(value, return_inverse=True)
        both = np.zeros((len(left), len(right)), np.float32)
        place = np.full((2, len(rows)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        for at in range(0, len(kinds), 4096):
            here = (code >= at) & (code < at + 4096)
            held = np.zeros((2, max(len(left), len(right)), 4096), np.float32)
            for side in (0, 1):
                some = here & (place[side][doc] >= 0)
                held[side, place[side][doc[some]], code[some] - at] = 1
            both += held[0, : len(left)] @ held[1, : len(right)].T
        union = size[left][:, None] + size[right][None, :] - both
        found = (100 * both >= PERCENT * union) & (both > 0) & (label[left][:, None] != label[right][None, :])
        i, j = np.nonzero(found)
        ids = np.array([r[2] for r in rows], np.int64)
        return pa.record_batch([pa.array(np.minimum(ids[left[i]], ids[right[j]])), pa.array(np.maximum(ids[left[i]], ids[right[j]]))], ["u", "v"])

    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("pair", "second", "id", "label", "text"))):
            if rows and rows[0][0] != r[0]:
                yield links(rows)
                rows = []
            rows.append(r)
    if rows:
        yield links(rows)


def _prefix_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """All links (u, v) across labels between members (id, label, leader).

    Shingles are ranked by how many members have them, rarest first. Sets x and y
    of the similarity sought share one of the first |x| - ceil(0.75 |x|) + 1 of x and the
    like of y, or else their common part would be too small. So texts that only
    share a frequent passage never meet, and shingles of a single component add nothing.
    Members are put into blocks of BLOCK_DOCS by their leader; blocks that share
    such a shingle are compared, each pair of blocks in one go.
    """
    docs = cut(members.join(texts.select(F.col("doc_id").alias("id"), "text"), "id"))
    parts = docs.groupBy("leader").agg(F.greatest(F.count("*") / BLOCK_DOCS, F.sum(F.length("text")) / BLOCK_CHARS).alias("parts"))
    docs = cut(docs.join(parts, "leader").select("id", "label", "text", F.xxhash64("leader", F.pmod(F.xxhash64("id"), F.ceil("parts"))).alias("block")))
    rows = docs.select(F.col("id").alias("doc_id"), "text").mapInArrow(_shingle_rows, "id long, set long, n long, shingle long")
    held = rows.groupBy("shingle").agg(F.count("*").alias("held"))
    rank = F.row_number().over(Window.partitionBy("id", "set").orderBy("held", "shingle"))
    prefix = rows.join(held, "shingle").withColumn("rank", rank).where(f"rank <= n - ({PERCENT} * n + 99) div 100 + 1 and held > 1").select("shingle", "id")
    held_in = prefix.join(docs.select("id", "label", "block").distinct(), "id").groupBy("shingle", "block").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    held_in = cut(held_in)
    open_ = held_in.groupBy("shingle").agg(F.min("a").alias("low"), F.max("b").alias("high")).where("low < high").select("shingle")
    held_in = held_in.join(open_, "shingle", "left_semi").select("shingle", "block", "a", "b")
    other = held_in.select("shingle", F.col("block").alias("block_v"), F.col("a").alias("a_v"), F.col("b").alias("b_v"))
    pairs = held_in.join(other, "shingle").where("block <= block_v and least(a, a_v) < greatest(b, b_v)").select("block", "block_v").distinct()
    sides = pairs.select(F.struct("block", "block_v").alias("pair"), F.explode(F.when(F.col("block") == F.col("block_v"), F.array(F.struct(F.lit(False).alias("second"), "block"))).otherwise(F.array(F.struct(F.lit(False).alias("second"), F.col("block").alias("block")), F.struct(F.lit(True).alias("second"), F.col("block_v").alias("block"))))).alias("side"))
    sides = sides.select(F.concat_ws(":", "pair.block", "pair.block_v").alias("pair"), "side.second", "side.block")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.join(docs, "block").select("pair", "second", "id", "label", "text").repartition(n, "pair").sortWithinPartitions("pair", "second", "id")
    return dealt.mapInArrow(_block_links, "u long, v long").distinct()


def _settle(members: DataFrame, texts: DataFrame, labels: DataFrame, failed: DataFrame) -> DataFrame:
    """Compare what is left across components of one bucket: with another hub where much is left, then in full.

    New links join components, so only components' ids go into the next contraction.
    """
    mixed = members.join(failed.select(F.col("u").alias("hub"), F.col("v").alias("id")), ["hub", "id"], "left_semi").select("bucket").distinct()
    members = members.select("bucket", "id", F.col("hub").alias("leader")).join(mixed, "bucket", "left_semi")
    for turn in range(2):
        now = cut(members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "leader", F.coalesce("component", "id").alias("label")))
        open_ = now.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min_by("id", F.xxhash64("id")).alias("hub")).where("a < b").select("bucket", "hub")
        members = cut(now.join(open_, "bucket"))
        by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        rows, left = by_label.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") - F.col("own")) / 2).first()
        if not left:
            return labels
        last = turn == 1 or left <= PAIRS_EACH * rows
        if last:
            links = _prefix_links(members.groupBy("id", "label").agg(F.min("leader").alias("leader")), texts)
        else:
            hubs = members.where("id = hub").select("bucket", F.col("label").alias("hub_label"))
            pairs = members.join(hubs, "bucket").where("label <> hub_label").select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()
            links = _confirmed(pairs, texts)
        of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        joins = components(links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v")))
        both = labels.unionAll(joins.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("at"))
        labels = cut(both.join(joins.select(F.col("node").alias("at"), "component"), "at", "left").select("node", F.coalesce("component", "at").alias("component")))
        if last:
            return labels
        members = members.select("bucket", "id", "leader")
    return labels


def keep_one_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the smallest id of each near-duplicate group, in one row; every column as it was.

    Of rows that share an id, which are one node, that with the smallest text
    stays, a null text before all; of equal ones any. Rows without an id stay, as
    do rows with texts of their own. Columns with clashing names don't matter.
    """
    gone = near_duplicates(spark, docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    rest = docs.join(gone, id_col, "left_anti").select(docs.columns)
    nth = unused(docs, "nth")
    # rows without an id are dealt by their texts, not to one task
    w = Window.partitionBy(id_col, F.when(F.col(id_col).isNull(), F.xxhash64(text_col))).orderBy(text_col)
    return rest.withColumn(nth, F.row_number().over(w)).where((F.col(nth) == 1) | F.col(id_col).isNull()).select(docs.columns)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
