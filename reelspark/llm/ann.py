"""Operator 9: nearest neighbours by inner product with vantage-point trees.

Vectors are dealt to shards by a hash of their id. A vector x gets one more
coordinate, sqrt(M ** 2 - |x| ** 2) with M the largest norm, and a query gets 0
there: Euclidean order is then inner-product order, and distances obey the
triangle inequality that the trees need. Each shard is a file in the shared
folder: vectors, and a tree of vantage points, each with the distance that halves
the rest and the range of distances on both sides. A search goes down the nearer
side first; a side is left out where the query's distance is more than
factor * (distance of the k-th best so far) outside its range. Factor one skips
nothing that could be nearer, so it is exact; smaller factors skip more.
Scores are inner products of the original vectors in double precision, summed up
in order of the components, so that equal vectors have equal scores wherever they
lie; products of blocks only choose what is scored.

Each query meets every shard, a keyed deal of the stated query set, and a shard
returns its k best, so what travels on is k rows for each query and shard.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, scratch_path, table

K = 20
#: Default relaxation; measured recall and shares of pairs looked at are in the README.
FACTOR = 0.25
#: Vectors in a shard, about; bounds what a task holds.
SHARD_VECTORS = 25_000
#: Shards that smaller tables are dealt to all the same, so that several tasks work, while a shard has at least LEAST_VECTORS.
SHARDS, LEAST_VECTORS = 16, 512
LEAF = 128
QUERY_BLOCK = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) without null ids and vectors that are null, empty, zero or hold null or non-finite components, nor those of another length than most (of equally many, the shortest)."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (most["size"] if most else 0))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed up in order of the components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Tree:
    """A vantage-point tree over the rows of x; ids break ties. scored counts the pairs of queries and rows that a search looked at."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.scored = ids[order], x[order], 0
        self.norm = norm
        self.y = np.column_stack([self.x, np.sqrt(np.maximum(0, norm * norm - (self.x * self.x).sum(1)))])
        self.random = np.random.default_rng(seed)
        #: Rows of (vantage row, inside node, outside node, and the least and most distance inside and outside); leaves hold row numbers.
        self.nodes: list = []
        self.root = self._build(np.arange(len(ids)))

    def _distances(self, rows: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt(((self.y[rows] - self.y[at]) ** 2).sum(1))

    def _build(self, rows: np.ndarray) -> int:
        if len(rows) > LEAF:
            # far from a row by chance: such points spread distances
            some = self.random.choice(rows, min(len(rows), 256), replace=False)
            vantage = int(some[np.argmax(self._distances(some, int(some[0])))])
            d = self._distances(rows, vantage)
            inside = d <= np.median(d)
            if not inside.all():
                at = len(self.nodes)
                self.nodes.append(None)
                a, b = self._build(rows[inside]), self._build(rows[~inside])
                self.nodes[at] = (vantage, a, b, d[inside].min(), d[inside].max(), d[~inside].min(), d[~inside].max())
                return at
        self.nodes.append(rows)
        return len(self.nodes) - 1

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows for each query, other than its own id; -1 and -inf where there are fewer."""
        best_id, best = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
        if not len(self.ids):
            return best_id, best
        q2, norm2 = (q * q).sum(1), self.norm * self.norm
        # rounding of products and distances must not cut off ties
        margin, slack = 1e-12 * (1 + np.sqrt(q2) * self.norm), 1e-9 * (1 + self.norm)

        def reach(who: np.ndarray) -> np.ndarray:
            """Distance to the k-th best; endless while there are fewer."""
            return np.sqrt(np.maximum(0, q2[who] + norm2 - 2 * best[who, -1]))

        def look(here: np.ndarray, part: np.ndarray) -> None:
            s = q[part] @ self.x[here].T
            s[self.ids[here][None, :] == ids[part][:, None]] = -np.inf
            self.scored += s.size
            least = best[part, -1]
            if len(here) > k:
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            row, column = np.nonzero((s >= (least - margin[part])[:, None]) & (s > -np.inf))
            if not len(row):
                return
            exact = np.full(s.shape, -np.inf)
            exact[row, column] = inner(q[part[row]], self.x[here[column]])
            hit = np.unique(row)
            part, exact = part[hit], exact[hit]
            all_s = np.concatenate([best[part], exact], 1)
            all_i = np.concatenate([best_id[part], np.broadcast_to(self.ids[here], exact.shape)], 1)
            order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best[part], best_id[part] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            here = self.nodes[node]
            if isinstance(here, np.ndarray):
                for part in np.array_split(who, -(-len(who) * len(here) // 500_000)):
                    look(here, part)
                return
            vantage, inside, outside, *ranges = here
            y = self.y[vantage]
            d = np.sqrt(np.maximum(0, q2[who] + (y * y).sum() - 2 * (q[who] @ y[:-1])))
            # how far each query is from the distances on either side
            off = [np.maximum(0, np.maximum(low - d, d - high)) for low, high in (ranges[:2], ranges[2:])]
            near = off[0] <= off[1]
            for first in (True, False):
                for side, node_, gap in ((near == first, inside, off[0]), (near != first, outside, off[1])):
                    chosen = who[side]
                    visit(node_, chosen[gap[side] <= factor * reach(chosen) + slack])

        visit(self.root, np.arange(len(q)))
        best_id[~np.isfinite(best)] = -1
        return best_id, best

    def save(self) -> bytes:
        out, leaves = io.BytesIO(), [n for n in self.nodes if isinstance(n, np.ndarray)]
        kind = [(-1, i, 0, 0, 0, 0, 0) if isinstance(n, np.ndarray) else n for n, i in zip(self.nodes, np.cumsum([isinstance(n, np.ndarray) for n in self.nodes]) - 1)]
        np.savez(out, ids=self.ids, x=self.x, norm=self.norm, nodes=np.array(kind, np.float64).reshape(-1, 7), sizes=np.array([len(x) for x in leaves]), rows=np.concatenate(leaves) if leaves else np.zeros(0, np.int64), root=self.root)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        t = cls.__new__(cls)
        t.ids, t.x, t.norm, t.root, t.scored = z["ids"], z["x"], float(z["norm"]), int(z["root"]), 0
        t.y = np.column_stack([t.x, np.sqrt(np.maximum(0, t.norm**2 - (t.x * t.x).sum(1)))])
        leaves = np.split(z["rows"], np.cumsum(z["sizes"])[:-1])
        t.nodes = [leaves[int(a)] if v < 0 else (int(v), int(a), int(b), *ranges) for v, a, b, *ranges in z["nodes"].tolist()]
        return t


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build_index(spark: SparkSession, vectors: DataFrame, folder: str, shard_vectors: int = SHARD_VECTORS) -> list[str]:
    """Write one tree for each shard under folder; returns the shards' names: about rows / shard_vectors of them, or up to SHARDS where that is more.

    All vectors must have one length, as usable leaves them.
    """
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2")).first()
    shards, norm = max(1, -(-stats.n // shard_vectors), min(SHARDS, stats.n // LEAST_VECTORS)), float(stats.norm2 or 0) ** 0.5

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task may be dealt several shards, one after the other
        held: tuple[int | None, list, list] = (None, [], [])
        for b in batches:
            shard = b.column("shard").to_numpy()
            for at in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(shard)) + 1):
                if len(at):
                    if held[0] is not None and held[0] != shard[at[0]]:
                        yield write(*held)
                        held = (None, [], [])
                    part = b.slice(int(at[0]), len(at))
                    held = (int(shard[at[0]]), [*held[1], part.column("vec_id").to_numpy()], [*held[2], _matrix(part.column("v"))])
        if held[0] is not None:
            yield write(*held)

    def write(shard: int, ids: list, xs: list) -> pa.RecordBatch:
        import uuid

        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"tree-{shard:06d}-{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(Tree(np.concatenate(ids), np.concatenate(xs), norm).save())
        return pa.record_batch([pa.array([name])], ["shard"])

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard")
    dealt.mapInArrow(build, "shard string").write.parquet(f"{folder}/manifest")
    return sorted(r.shard for r in spark.read.parquet(f"{folder}/manifest").collect())


def search(spark: SparkSession, queries: DataFrame, folder: str, names: list[str], k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest, nearest first, ties to the smaller id, never the query's own id."""
    if not names:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        tree, shard = None, None
        for b in batches:
            names_here = b.column("shard").to_pylist()
            at = 0
            while at < b.num_rows:
                end = at
                while end < b.num_rows and end - at < QUERY_BLOCK and names_here[end] == names_here[at]:
                    end += 1
                if shard != names_here[at]:
                    shard = names_here[at]
                    with fs.open_input_file(f"{path}/{shard}") as f:
                        tree = Tree.load(f.read())
                part = b.slice(at, end - at)
                ids = part.column("query_id").to_numpy()
                found, score = tree.search(ids, _matrix(part.column("q")), k, factor)
                some = found >= 0
                yield pa.record_batch([pa.array(np.repeat(ids, some.sum(1))), pa.array(found[some]), pa.array(score[some])], ["query_id", "vec_id", "score"])
                at = end

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode(F.array(*[F.lit(x) for x in names])).alias("shard"))
    dealt = asked.repartition(len(names), "shard").sortWithinPartitions("shard", "query_id")
    near = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """The k nearest of every vector whose id is divisible by `every`, among all others.

    Null, empty or zero vectors, those with null or non-finite components and
    those of another length than most take no part. Of rows that share an id, that with the smallest vector counts.
    An empty table gives an empty result; other columns play no part.
    """
    rows = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    folder = scratch_path(spark, "trees")
    names = build_index(spark, rows, folder, shard_vectors)
    return search(spark, rows.where(F.col("vec_id") % every == 0), folder, names, k, factor)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"))
