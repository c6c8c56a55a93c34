"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores where its files make fewer splits than there are cores; a larger table is not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df
