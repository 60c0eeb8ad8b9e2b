"""Streaming windows give what the same batch query gives, and appended edges can be read as a relationship table."""

import shutil

from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.streaming import events as e


def drained(df, name, spark):
    query = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_windows_and_sessions(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events.parquet")
    batch = spark.read.parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, make in (("windows", lambda d: e.windowed_counts(d, "ts", ["event_type"], "1 hour", "30 minutes")), ("sessions", lambda d: e.sessions(d, "ts", "user_id", "10 minutes"))):
        assert sorted(map(tuple, drained(make(stream), name, spark).collect())) == sorted(map(tuple, make(batch).collect()))


def test_append_edges(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "_id long, _src long, _dst long").write.parquet(source)
    stream = spark.readStream.schema("_id long, _src long, _dst long").parquet(source)
    e.append_edges(stream, out, str(tmp_path / "ck")).awaitTermination(120)
    g = PropertyGraph({}, {"E": spark.read.parquet(out)})
    assert g.out_degree("E").count() == 2
