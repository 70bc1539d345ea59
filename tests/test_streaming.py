"""Streams of files in several cuts against the batch operators, with a restart from the checkpoint."""

import random

from pyspark.sql import functions as F

from reelspark.operators import metrics
from reelspark.streaming import players


def cuts(spark, df, folder, n, order="seconds"):
    """The rows in n files, in order of time."""
    edges = [r[0] for r in df.select(order).orderBy(order).collect()]
    bounds = [edges[len(edges) * k // n] for k in range(n)] + [float("inf")]
    for k in range(n):
        df.where((F.col(order) >= bounds[k]) & (F.col(order) < bounds[k + 1])).coalesce(1).write.mode("append").parquet(f"{folder}/cut{k}")
    return [f"{folder}/cut{k}" for k in range(n)]


def streamed(spark, schema, parts, make, work):
    """Rows of a stream that is stopped and started again after each two parts, file by file."""
    import shutil

    source, out, check = (f"{work}/{x}" for x in ("in", "out", "check"))
    for at in range(0, len(parts), 2):
        for k, p in enumerate(parts[at : at + 2]):
            shutil.copytree(p, f"{source}/{at + k:02d}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start()
        assert query.awaitTermination(200)
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def test_decode_reports(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(p, round(t * 0.37 + p * 0.01, 6), rnd.random() * 20, rnd.randrange(3)) for p in range(4) for t in range(60)]
    df = spark.createDataFrame(rows, "player_id long, seconds double, ms double, dropped long")
    parts = cuts(spark, df, tmp_path / "cuts", 4)
    got = streamed(spark, df.schema, parts, players.decode_stats, tmp_path)
    assert got == sorted(map(tuple, metrics.decode_stats(df).collect())) and len(got) > 50


def test_intermediate_requests_are_dropped(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(p, float(t), None if rnd.random() < 0.3 else rnd.randrange(500)) for p in range(4) for t in range(80)]
    df = spark.createDataFrame(rows, "player_id long, seconds double, frame long")
    parts = cuts(spark, df, tmp_path / "cuts", 4)
    got = streamed(spark, df.schema, parts, players.drop_intermediate, tmp_path)
    want = metrics.drop_intermediate(df.where("frame is not null"), df.where("frame is null").drop("frame"))
    assert got == sorted(tuple(r) for r in want.select("player_id", "service", "served", "dropped").collect()) and got
