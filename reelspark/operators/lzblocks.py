"""Compressed textures as operations (Z1, Z2 of the blueprint): blocks that came before are told by distance.

What an encoder keeps in hash tables while it goes along is the last block with the
same value: a lag within the value. Runs are islands, and sixteen operations of two
bits share a word that stands before the first one's operand, so that a stream is its
operations in order, numbered once, and nothing goes block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Value, col, idiv, le_bytes, let
from .streams import PART, islands, numbered, run_bytes

# How far back, in blocks, a value is known, and what the operands' bytes can say beyond two and 0x102.
LOOKBACK = 0x10101
NEAR, FAR, FARTHEST_ALPHA = 2, 0x102, 2 + 0xFFFF
OPS_IN_WORD = 16


#: Words that are joined before all of a stream's are.
WORDS_IN_PAGE = 4096


def _dealt(rows: DataFrame, last: str, lookback: int, size: int) -> DataFrame:
    """rows in the part they lie in (own), and in those where their last place is still known."""
    on = F.sequence(idiv(last, size), idiv(F.col(last) + lookback, size))
    return rows.withColumn("own", idiv("n", size)).withColumn("part", F.explode(F.array_union(F.array("own"), on)))


def _distance(key: str | Column, keys: Sequence[str], last: str, lookback: int) -> Column:
    """How far back the key came last, of rows as _dealt leaves them; null beyond lookback."""
    d = F.col("n") - F.lag(last).over(Window.partitionBy(*keys, "part", key).orderBy("n"))
    return F.when(d <= lookback, d)


def _item(k: int, op: Value, operand: Value, when: Column | bool = True) -> Column:
    """An operation as a struct, or null where it isn't written."""
    made = F.struct(F.lit(k).alias("k"), col(op).cast("int").alias("op"), operand if isinstance(operand, Column) else F.lit(operand))
    return made if when is True else F.when(when, made)


def _back(k: int, distance: str, literal: Column | None, when: Column | bool = True) -> Column:
    """The operation of a distance in blocks: 1 for the block before, 2 with a byte, 3 with two, 0 for none, followed by the value itself where one is given."""
    d = F.col(distance)
    op = F.when(d.isNull(), 0).when(d >= FAR, 3).when(d >= NEAR, 2).otherwise(1)
    operand = F.when(d >= FAR, le_bytes(d - FAR, 2)).when(d >= NEAR, le_bytes(d - NEAR, 1)).when(d.isNull() & F.lit(literal is not None), literal if literal is not None else F.lit("")).otherwise("")
    return _item(k, op, operand.alias("operand"), when)


def encode_stream(rows: DataFrame, *streams: str, value: str = "block", order: str = "n", alpha: bool = False, lookback: int = LOOKBACK, size: int = PART) -> DataFrame:
    """streams and data (hexadecimal digits) of streams of colour blocks: rows with order from 0 and value, a block's sixteen digits, or thirty-two with an alpha block before it.

    The first block is written as it is. Then, for each block, with alpha: 1 and a
    run's count for the blocks of a run of one alpha, at its second; else 2 and the
    distance, two bytes, to the last block of that alpha; else 3 and the alpha. Then
    the distance to the last block of that colour half; where there is none, those to
    the last of its two ends and of its codes, each with the value where it is new.
    Distances beyond lookback aren't known, so a part of a stream, size places long,
    needs no more than lookback places before it, and no task holds a stream but for
    the one that joins its bytes: data is one value, of up to two gigabytes of digits.
    """
    keys, at = [f"s{i}" for i in range(len(streams))], 16 if alpha else 0
    named = [F.col(s).alias(k) for s, k in zip(streams, keys)]
    given = rows.select(*named, F.col(order).cast("long").alias("n"), F.lower(col(value)).alias("block"))
    colours = _dealt(given.select(*keys, "n", F.substring("block", at + 1, 16).alias("colour")), "n", lookback, size)
    parts = {"colour": F.col("colour"), "ends": F.substring("colour", 1, 8), "codes": F.substring("colour", 9, 8)}
    for k, v in parts.items():
        colours = colours.withColumn(f"d_{k}", _distance(v, keys, "n", lookback))
    colours = colours.where("part = own and n > 0")
    fresh = F.col("d_colour").isNull()
    counts = colours.groupBy(*keys, "part").agg(F.sum(F.when(fresh, 3).otherwise(1)).alias("n"))
    some = lambda *items: F.inline(F.filter(F.array(*items), lambda x: x.isNotNull()))
    written = colours.select(*keys, "n", "part", some(_back(1, "d_colour", None), _back(2, "d_ends", parts["ends"], fresh), _back(3, "d_codes", parts["codes"], fresh)))
    if alpha:
        found = islands(given.withColumn("alpha", F.substring("block", 1, 16)), "alpha", *keys, size=size).withColumnRenamed("start_at", "n")
        d, first, again = F.col("d"), F.col("n") > 0, F.col("length") > 1
        counts = counts.unionByName(found.groupBy(*keys, idiv("n", size).alias("part")).agg(F.sum(first.cast("int") + again.cast("int")).alias("n")))
        found = _dealt(found, "end_at", lookback, size).withColumn("d", _distance("value", keys, "end_at", lookback)).where("part = own")
        known = F.when(d <= FARTHEST_ALPHA, _item(0, 2, le_bytes(d - NEAR, 2).alias("operand"))).otherwise(_item(0, 3, F.col("value").alias("operand")))
        # a run's count belongs to its second block, before its colours: right after those of the first
        written = written.unionByName(found.select(*keys, "n", "part", some(F.when(first, known), _item(4, 1, run_bytes(F.col("length") - 2).alias("operand"), again))))
    seq = F.col("seq")
    ops = numbered(written, counts, keys, "part", ["n", "k"], "seq")
    grouped = ops.groupBy(*keys, idiv(seq, OPS_IN_WORD).alias("word")).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "operand"))).alias("items"))
    bits = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + F.call_function("shiftleft", x.op.cast("long"), (2 * (x.seq % OPS_IN_WORD)).cast("int")))
    said = F.concat(let(bits, lambda b: le_bytes(b, 4)), F.array_join(F.transform("items", lambda x: x.operand), ""))
    joined = lambda df, *by: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("list"))
    text = F.array_join(F.transform("list", lambda x: x.said), "")
    pages = joined(grouped.select(*keys, F.col("word").alias("at"), idiv("word", WORDS_IN_PAGE).alias("page"), said.alias("said")), *keys, "page").select(*keys, F.col("page").alias("at"), text.alias("said"))
    heads = given.where("n = 0").select(*keys, F.lit(-1).cast("long").alias("at"), F.col("block").alias("said"))
    whole = joined(heads.unionByName(pages), *keys).where(F.get("list", F.lit(0)).at == -1)
    return whole.select(*[F.col(k).alias(s) for s, k in zip(streams, keys)], F.when(F.get("list", F.lit(0)).said.isNotNull(), text).alias("data"))
