"""Operator 7: mixing sources to target weights by Poisson replication, native.

A source's rate is (target share) * (all rows) / (its rows). A document of it is
repeated by a Poisson count of that mean, from inverting the distribution at a
uniform number that the seed and the document's id give, so each run and each
partitioning gives the same copies. Rates over RATE_STEP are drawn as a sum of
several smaller counts, which has the same distribution and can't underflow.
Copies are then dealt out by a hash of (seed, id, copy) and sorted by it: a
global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, unused

SEED = 20240229
RATE_STEP = 32.0
#: Terms of the distribution; beyond them less than 1e-40 is left at RATE_STEP.
TERMS = 160
#: Rates of up to so many sources, about 14 MB, are broadcast.
BROADCAST_SOURCES = 10_000
#: Target weights of the registered query: a source's rows to this power.
POWER = 0.5


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the parts' text: 52 bits of md5."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", power: float = POWER) -> DataFrame:
    """(source, rows, draws, rate, distribution) of each source, one row each.

    weights has source and weight; without it a source's weight is its rows to
    `power`. Sources without a weight, or with a null, negative or non-finite
    one, get none and are left out of the mix; a null source is a source. A
    source that weights repeats has the sum. With no weight at all, all rates are 0.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(power)))
    else:
        w = F.col("weight").cast("double")
        given = weights.where(w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf"))).groupBy("source").agg(F.sum(w).alias("weight"))
        counts = counts.alias("c").join(given.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")), "left").select("c.source", "rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    totals = counts.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_rows") / F.col("rows")).otherwise(0.0)
    out = counts.join(F.broadcast(totals), F.lit(True)).select("source", "rows", rate.alias("rate"))  # totals: one row
    out = out.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_STEP)).cast("int")).withColumn("step", F.col("rate") / F.col("draws"))
    start = F.struct(F.exp(-F.col("step")).alias("p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    add = lambda s, k: F.struct((s.p * F.col("step") / (k + 1)).alias("p"), (s["sum"] + s.p).alias("sum"), F.concat(s["all"], F.array(s["sum"] + s.p)).alias("all"))
    return out.withColumn("distribution", F.aggregate(F.sequence(F.lit(0), F.lit(TERMS)), start, add)["all"]).drop("step")


def replicate(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, power: float = POWER) -> DataFrame:
    """All columns of docs, and copy (from 0) and shuffle_key, a row for each copy, globally shuffled.

    Rows with the same id get the same count. A null id is drawn as the text
    'null'. An empty table gives an empty result. Columns named copy or
    shuffle_key are replaced; other names don't clash, whatever they are. Texts
    may be null or of any length.

    Sources are counted first: rates of up to BROADCAST_SOURCES go to the
    documents, which then aren't shuffled by source; beyond that both are, with
    the same result.
    """
    plain = docs.drop("copy", "shuffle_key")
    source, draws, dist = (unused(plain, x) for x in ("mix_source", "mix_draws", "mix_distribution"))
    r = materialize(docs.sparkSession, rates(docs, weights, source_col, power).select(F.col("source").alias(source), F.col("draws").alias(draws), F.col("distribution").alias(dist)), "rates")
    if r.count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # each uniform number is bound to a lambda's variable, so that it is computed once and not for each term
    uniforms = F.transform(F.sequence(F.lit(0), F.col(draws) - 1), lambda j: uniform(seed, key, j.cast("string")))
    n = F.aggregate(uniforms, F.lit(0), lambda s, u: s + F.size(F.filter(dist, lambda c: c <= u)))
    out = plain.join(r, plain[source_col].eqNullSafe(F.col(source)))
    out = out.withColumn("copy", F.explode(F.slice(F.sequence(F.lit(0), n), F.lit(1), n)))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:shuffle"), key, F.col("copy").cast("string"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.select(*plain.columns, "copy", "shuffle_key").repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key", id_col)


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key", "text")


OP7_SQL = f"""
with recursive counts as (select source, count(*) as n, pow(count(*)::double, {POWER}) as weight from documents group by source),
rates as (select source, weight / (select sum(weight) from counts) * (select sum(n) from counts)::double / n as rate from counts),
steps as (select source, greatest(1, ceil(rate / {RATE_STEP}))::int as draws, rate / greatest(1, ceil(rate / {RATE_STEP})) as step from rates),
terms as (
  select source, draws, step, 0 as k, exp(-step) as p, exp(-step) as c from steps
  union all
  select source, draws, step, k + 1, p * step / (k + 1), c + p * step / (k + 1) from terms where k < {TERMS}
),
dist as (select source, draws, list(c order by k) as cs from terms group by source, draws),
draws as (select doc_id, documents.source, text, cs, unnest(range(draws)) as j from documents join dist on documents.source is not distinct from dist.source),
counted as (
  select doc_id, source, text, sum(len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{SEED}:' || doc_id || ':' || j), 1, 13))::bigint / 4503599627370496.0)))::bigint as n
  from draws group by doc_id, source, text
)
select doc_id, source, copy::int as copy, md5('{SEED}:shuffle:' || doc_id || ':' || copy) as shuffle_key, text
from (select *, unnest(range(n)) as copy from counted where n > 0)
"""
