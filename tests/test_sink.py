"""The packet sink with tasks that fail."""

import os

import pytest
from pyspark.sql import functions as F

from reelspark.operators import sink


def packets(spark, n=100):
    return spark.range(n).select((F.col("id") % 7).alias("source_id"), F.col("id").alias("frame_no"), F.col("id").cast("string").cast("binary").alias("packet"))


def failing(spark, flag=None):
    """Rows whose last partition fails, each time or, with a flag file, the first time."""

    def run(batches):
        from pyspark import TaskContext

        last = TaskContext.get().partitionId() == 3
        for b in batches:
            yield b
        if last and (flag is None or not os.path.exists(flag)):
            if flag:
                open(flag, "w").close()
            raise ValueError("on purpose")

    df = packets(spark).repartition(4, "frame_no")
    return df.mapInArrow(run, df.schema)


def seen(spark, path):
    return sorted((r.source_id, r.frame_no, bytes(r.packet)) for r in sink.read_packets_of(spark, path).collect())


def test_writes_appear_whole(spark, tmp_path):
    sink.register(spark)
    path = f"file://{tmp_path}/out"
    assert seen(spark, path) == []
    packets(spark).write.format("packets").mode("append").save(path)
    want = [(k % 7, k, str(k).encode()) for k in range(100)]
    assert seen(spark, path) == sorted(want)
    packets(spark, 3).write.format("packets").mode("append").save(path)
    assert seen(spark, path) == sorted(want + want[:3])
    packets(spark, 5).write.format("packets").mode("overwrite").save(path)
    assert seen(spark, path) == sorted(want[:5])
    packets(spark, 0).write.format("packets").mode("append").save(path)
    assert seen(spark, path) == sorted(want[:5])
    assert not os.listdir(f"{tmp_path}/out/{sink.HIDDEN}")


def test_a_failed_write_leaves_nothing_visible(spark, tmp_path):
    sink.register(spark)
    path = f"file://{tmp_path}/out"
    packets(spark, 2).write.format("packets").mode("append").save(path)
    before = seen(spark, path)
    with pytest.raises(Exception, match="on purpose"):
        failing(spark).write.format("packets").mode("append").save(path)
    assert seen(spark, path) == before and len(before) == 2
    assert len([f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet")]) <= 2


def test_files_of_repeated_attempts_are_never_listed(spark, tmp_path):
    """What a first attempt wrote before it failed, beside what the second did."""
    writer = sink.PacketWriter(f"file://{tmp_path}/out", False)
    batches = packets(spark, 10).toArrow().to_batches()

    def broken():
        yield from batches
        raise ValueError("on purpose")

    with pytest.raises(ValueError):
        writer.write(broken())
    done = [writer.write(iter(batches)), writer.write(iter([]))]
    assert len(os.listdir(f"{tmp_path}/out/{sink.HIDDEN}/{writer.run}")) == 2
    assert seen(spark, f"file://{tmp_path}/out") == []
    writer.commit([*done, None])
    assert len(seen(spark, f"file://{tmp_path}/out")) == 10
    assert not os.path.exists(f"{tmp_path}/out/{sink.HIDDEN}/{writer.run}")
