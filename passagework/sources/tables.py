"""Loading of columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of fewer splits than cores over all of them.

    Large inputs have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)
