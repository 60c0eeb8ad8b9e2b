"""Scratch tables that cut lineage: Parquet in the folder that spark.checkpoint.dir names, so they outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():  # unset, as in tests
        context.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4()}")
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
