"""A corpus pipeline of five stages, each an operator of reelspark.llm over all that its predecessor kept.

All stages but the last return the columns of docs. An empty table passes through
every stage, and texts may be of any length. The columns doc_id, text and source
are read, and n_chars where it is there; others, whatever their names and nulls,
are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import decontaminate, mixing, near_dup, quality, token_store
from reelspark.llm.common import materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of the input, doesn't reject.

    Each row is scored by itself, so repeated rows stay or go together; null and
    empty texts have the score of a text without words, and a null id, which no
    label can name, is scored like any other. A score at the threshold stays.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, in one row.

    Of rows that share an id, that with the smallest text stays, a null one
    first. Texts without words are linked with nothing and stay, as do rows
    without an id.
    """
    return near_dup.keep_one_each(spark, docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no test item.

    Each row is compared by itself: repeated rows stay or go together, null and
    empty texts stay, and so do rows without an id. Test items without words
    match nothing, and a repeated item counts once.
    """
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by source to the target weights, shuffled.

    A row's count follows from its id, so rows of one id get the same; a null id
    is drawn as the text 'null', and a null source is a source of its own. Copies
    of one row are alike in every column.
    """
    return mixing.replicate(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards, read back: a row for each document and repetition, numbered from 0 within its id (nth), in order of the texts.

    Null and empty texts have the end id alone. Rows without an id come first.
    """
    return token_store.tokens_of(spark, docs).drop("shard")


STAGES = [("quality_classifier", good_quality), ("near_dedup", one_of_each), ("decontaminate", uncontaminated), ("mix_sources", mixed), ("token_store", tokens)]

#: Fitting, sketches, alignment and encoding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
