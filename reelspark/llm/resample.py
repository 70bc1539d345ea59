"""Operator 13: importance resampling towards a target's distribution, native.

A document's features are its runs of one to ORDER consecutive words; each falls
into one of BUCKETS buckets by the CRC of its bytes. How much commoner a bucket is
in the target than in the documents is its gain, an integer of thousandths of a
natural logarithm. A document's weight is the mean of its features' gains, and its
score the weight and a Gumbel number that its id draws, so that the highest scores
are a sample without replacement whose odds follow the weights.

Scoring explodes nothing: higher-order functions make a document's array of buckets,
and its weight is an aggregate over element_at of the gains, a literal array of
BUCKETS entries. What is shuffled are a row for each bucket and task, a row for each
score, and of the documents those near or above the last score drawn, as ids.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import let
from .common import materialize, table, unused

BUCKETS = 10_000
ORDER = 2
#: Percent of the documents with at least LEAST_WORDS words that are drawn.
SHARE, LEAST_WORDS = 25, 20
SEED = 7
#: Neighbouring scores whose counts are summed together, to find how many documents stand above a score.
SCORE_STEP = 256
#: What stands between words: ASCII but for letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MADE = ("n_words", "n_features", "weight", "score")


def words(text: Column | str) -> Column:
    """Array of a text's words, with A-Z alone in lower case; empty for a null text."""
    text = F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(lowered, BREAKS), lambda w: w != "")


def bucket_array(words_: Column, order: int = ORDER, buckets: int = BUCKETS) -> Column:
    """Array of the buckets, from 0, of all runs of 1 to order of the words, repeats included."""
    bucket = lambda run: (F.crc32(run) % buckets).cast("int")

    def runs(w: Column) -> Column:
        parts, longer = [F.transform(w, bucket)], w
        for k in range(2, order + 1):
            n = F.greatest(F.lit(0), F.size(w) - (k - 1))
            longer = F.zip_with(F.slice(longer, F.lit(1), n), F.slice(w, F.lit(k), n), lambda a, b: F.concat(a, F.lit(" "), b))
            parts.append(F.transform(longer, bucket))
        return F.concat(*parts)

    return let(words_, runs)


def bucket_counts(rows: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: tasks count first, so that a row for each bucket and task is shuffled."""
    found = rows.select(F.explode(bucket_array(words(text_col), order, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much commoner each bucket is in the target), each count with one more."""
    n = len(source)
    s_all, t_all = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel number) that seed and id fix, from 32 bits of SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def with_scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, seed: int = SEED) -> DataFrame:
    """docs with n_words, n_features, weight (floored mean of the features' gains, 0 without any) and score, all long.

    Columns of these names are replaced; others stay. Null and empty texts have no
    features. A null id draws as the text 'null'; rows of one id draw alike.
    """
    table_ = F.lit(gain)

    def scored(w: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, k: s + F.element_at(table_, k + 1))
        return let(bucket_array(w, order, len(gain)), lambda b: F.struct(F.size(w).cast("long").alias("n_words"), F.size(b).cast("long").alias("n_features"), total(b).alias("total")))

    kept = docs.drop(*_MADE)
    made = unused(kept, "scored")
    n, total = F.col(f"{made}.n_features"), F.col(f"{made}.total")
    # exact: what is left after a multiple of n, which isn't negative
    weight = F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(0).cast("long")
    rows = kept.withColumn(made, let(words(text_col), scored))
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    out = rows.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"{made}.n_words"), n.alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + gumbel(id_, seed))


def with_ranks(scored: DataFrame, id_col: str = "doc_id", share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank, from 1, of the floor(share * n / 100) highest scores among the n rows with least_words words; null for the others.

    Ties go to the smaller id, null ones first; rows alike in score and id take
    successive ranks. scored is read several times: give it written. A column rank is replaced.

    Scores are integers within some 10^5 of each other, so that their counts, which
    say how many rows stand above each score, are a small table whatever the rows;
    rows are then numbered within their score.
    """
    scored = scored.drop("rank")
    fits = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    drawn = share * scored.where(fits).count() // 100
    above, step, below = (unused(scored, x) for x in ("above", "step", "below"))
    counts = scored.where(fits).groupBy("score").agg(F.count("*").alias("n")).withColumn(step, F.floor(F.col("score") / SCORE_STEP))
    before = lambda w: F.coalesce(F.sum("n").over(w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.groupBy(step).agg(F.sum("n").alias("n")).withColumn("score", F.col(step))
    steps = steps.select(step, before(Window.partitionBy(F.lit(0))).alias(below))  # a row for each SCORE_STEP scores: some hundreds at most
    counts = counts.join(F.broadcast(steps), step).select("score", (F.col(below) + before(Window.partitionBy(step))).alias(above))
    counts = materialize(scored.sparkSession, counts.where(F.col(above) < drawn), "scores")
    near = scored.where(fits).join(F.broadcast(counts), "score").select(*scored.columns, above)  # a row for each score: bounded, see above
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_first()))
    ranked = near.withColumn("rank", F.col(above) + place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop(above)
    far = scored.join(F.broadcast(counts.select("score", F.lit(True).alias(above))), "score", "left").where(~fits | F.col(above).isNull())
    return ranked.unionByName(far.select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs; rank as with_ranks gives it.

    The id keeps its column's name and type. With an empty target, or without
    documents, counts of 0 stand for it; an empty table gives an empty result.
    Repeated rows count each. Texts may be of any length.
    """
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_col, order, buckets))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    scored = with_scores(own, gain, "_id", "_text", order, seed).drop("_text")
    ranked = with_ranks(materialize(spark, scored, "resample"), "_id", share, least_words)
    return ranked.withColumnRenamed("_id", id_col)


def draw(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that resample draws, with all their columns; options are resample's. Ids must be unique, and rows without one aren't drawn."""
    drawn = resample(spark, docs, target, id_col, **options).where(F.col("rank").isNotNull()).select(id_col)
    return docs.join(drawn, id_col, "left_semi")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "n_features", "weight", "score", "rank")])


OP13_SQL = f"""
with texts as (select 0 as side, doc_id as id, coalesce(text, '') as text from documents union all select 1, item_id, coalesce(text, '') from benchmark),
words as (select side, id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
runs as (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as run from words),
crc_table as (select list(c order by n) as t from (select n, list_reduce(list_concat([n], range(8)), lambda c, k: if(c % 2 = 1, xor(c // 2, 3988292384), c // 2)) as c from range(256) r(n))),
distinct_runs as (select run, hex(encode(run)) as h from (select distinct run from runs)),
buckets as (
  select run, xor(list_reduce(list_concat([4294967295], range(len(h) // 2)), lambda c, i: xor(c // 256, t[xor(c % 256, ('0x' || substr(h, 2 * i + 1, 2))::bigint) + 1])), 4294967295) % {BUCKETS} as bucket
  from distinct_runs, crc_table
),
counts as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from runs join buckets using (run) group by bucket),
totals as (select coalesce(sum(s), 0)::bigint as s_all, coalesce(sum(t), 0)::bigint as t_all from counts),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + {BUCKETS}) / ((s + 1)::double * (t_all + {BUCKETS}))))::bigint as gain from counts, totals),
weights as (select id, count(*) as n, sum(gain)::bigint as total from runs join buckets using (run) join gains using (bucket) where side = 0 group by id),
scored as (
  select w.id as doc_id, len(w.w) as n_words, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0) as weight,
         coalesce((total - ((total % n) + n) % n) // n, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || w.id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from words w left join weights on weights.id = w.id where w.side = 0
),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as fitting from scored where n_words >= {LEAST_WORDS})
select doc_id::bigint as doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, if(place <= {SHARE} * fitting // 100, place, null)::bigint as rank
from scored left join ranked using (doc_id)
"""
