"""Joins, tables and top-k shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 << 20
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A temporary folder serves only where the setting is missing and driver and executors
    are one process (``local[n]``); on a cluster the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="passagework-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/passagework-{spark.sparkContext.applicationId}"


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A setting of the session for what is run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str, *partition_by: str, compact: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and
    gives later joins real sizes. ``release`` deletes what a session has written.
    A ``compact`` table is packed closer, for more time, and the shuffle files of its
    write go when it ends; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compact:
        with setting(spark, SHUFFLES_GO, "true"):
            writer.option("compression", "zstd").parquet(path)
    else:
        writer.parquet(path)
    # partition columns come last; the given schema also serves a table without rows
    names = [c for c in df.columns if c not in partition_by] + list(partition_by)
    return spark.read.schema(StructType([df.schema[c] for c in names])).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def release(spark: SparkSession, *labels: str) -> None:
    """Delete the intermediate tables of this session; their DataFrames end with them.

    ``labels`` restricts it to tables whose label starts with one of them.
    """
    files, path = hadoop_path(spark, _session_dir(spark))
    if not files.exists(path):
        return
    for status in files.listStatus(path):
        if not labels or status.getPath().getName().startswith(labels):
            files.delete(status.getPath(), True)


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a side before it is broadcast: its rows and their total size, summed in all tasks."""
    width = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    seen = df.agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return seen["n"] <= max_rows and (seen["bytes"] or 0) <= max_bytes


def join_sized(
    big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Join with ``side`` broadcast when it measures small; otherwise a shuffled join.

    In the shuffled join AQE splits the skewed partitions of ``big``; ``side`` should be
    a written table or cheap to compute, since it is measured first.
    """
    if small_enough(side, max_rows, max_bytes):
        return big.join(F.broadcast(side), on, how)
    return big.join(side.hint("shuffle_merge"), on, how)


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows per key, numbered from 1.

    Spark keeps only ``limit`` rows per key in every input partition before it shuffles,
    so a key that holds most rows does not fill one task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one greatest in ``order``. Partial aggregation, no window.

    Rows equal in ``order`` are decided by their other columns, so the result does not
    depend on the order of arrival; maps and variants have no order and count as JSON.
    """
    rest = [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)

    def ordered(name: str) -> Column:
        plain = "map<" not in types[name] and "variant" not in types[name]
        return F.col(name) if plain else F.to_json(F.struct(F.col(name))).alias(name)

    ordering = F.struct(*[ordered(c) for c in order], *[ordered(c) for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_row")).select(
        *keys, *[F.col("_row")[c].alias(c) for c in rest]
    ).select(*df.columns)
