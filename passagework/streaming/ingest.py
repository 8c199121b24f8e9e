"""Incremental ingest: capped micro-batches merged into a bucketed passage table.

The table is a folder of ``batch=<n>/bucket=<b>`` parts, a bucket being a hash of the
asset; the number of buckets is stored with it. A micro-batch reads and rewrites only the
buckets its assets fall into; the newest batch of a bucket is its content, and what it
replaced is deleted with the next batch. A batch that is replayed writes the same part
again, so losing executors or restarting the query changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256


def _parts(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """Newest complete batch (older than ``before``) of every bucket, from folder names only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    if not fs.exists(path):
        return newest
    for batch in fs.listStatus(path):
        name = batch.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(batch.getPath(), "_SUCCESS")
        if not name.startswith("batch=") or not fs.exists(done):
            continue
        number = int(name.split("=")[1])
        if before is not None and number >= before:
            continue
        for bucket in fs.listStatus(batch.getPath()):
            folder = bucket.getPath().getName()
            if folder.startswith("bucket="):
                key = int(folder.split("=")[1])
                newest[key] = max(number, newest.get(key, -1))
    return newest


def read_table(
    spark: SparkSession, root: str, schema: T.StructType, buckets: set[int] | None = None, before: int | None = None
) -> DataFrame:
    """Current rows of the table, or of some buckets; ``before`` ignores later batches."""
    parts = _parts(spark, root, before)
    paths = [
        f"{root}/batch={batch}/bucket={bucket}"
        for bucket, batch in sorted(parts.items())
        if buckets is None or bucket in buckets
    ]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def table_buckets(spark: SparkSession, root: str, buckets: int) -> int:
    """Number of buckets of the table; a new table is given ``buckets``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("_buckets="):
                return int(name.split("=")[1])
    fs.mkdirs(hadoop.Path(path, f"_buckets={buckets}"))
    return buckets


def drop_replaced(spark: SparkSession, root: str, before: int) -> None:
    """Delete bucket parts that a batch before ``before`` has replaced by a newer one.

    Batch ``before`` may be replayed and needs only the newest parts older than itself.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    newest: dict[str, int] = {}
    parts = []
    for batch in fs.listStatus(path):
        name = batch.getPath().getName()
        if name.startswith("batch=") and int(name.split("=")[1]) < before and fs.exists(hadoop.Path(batch.getPath(), "_SUCCESS")):
            number = int(name.split("=")[1])
            for bucket in fs.listStatus(batch.getPath()):
                folder = bucket.getPath().getName()
                if folder.startswith("bucket="):
                    parts.append((folder, number, bucket.getPath()))
                    newest[folder] = max(number, newest.get(folder, -1))
    for folder, number, part in parts:
        if number < newest[folder]:
            fs.delete(part, True)


def merged_rows(
    stored: DataFrame, incoming: DataFrame, asset_key: list[str], chunk: str, order: list[str] | None, replace: tuple[str, ...], ends: str | None
) -> DataFrame:
    """Stored and incoming rows as one row per (asset, chunk), in one aggregation.

    Every column has its newest value that is not null, those in ``replace`` that of the
    newest row. Newest is by ``order`` over stored and incoming rows alike, so a late row
    never overwrites a newer one; rows equal in it, the incoming one wins. With ``ends``,
    a column that carries the asset's number of chunks, chunks from that number on go,
    as the asset's newest row has it; without it nothing is trimmed, since an asset may
    come in several batches.
    """
    key = [*asset_key, chunk]
    rest = [c for c in stored.columns if c not in key]
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("_new", F.lit(1)))
    plain = [c for c in rest if "map<" not in dict(stored.dtypes)[c] and "variant" not in dict(stored.dtypes)[c]]
    newest = F.struct(*[F.col(c) for c in order or []], F.col("_new"), *[F.col(c) for c in plain])
    rows = both.groupBy(*key).agg(
        *[F.max_by(c, newest if c in replace else F.when(F.col(c).isNotNull(), newest)).alias(c) for c in rest]
    ).select(*stored.columns)
    if ends is None:
        return rows
    last = F.struct(*[F.col(c) for c in order or []], F.col(ends))
    limits = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in asset_key]).agg(F.max_by(ends, F.when(F.col(ends).isNotNull(), last)).alias("_end"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asset_key]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return rows.join(limits, condition).filter(F.col("_end").isNull() | (F.col(chunk) < F.col("_end"))).select(*stored.columns)


def merge_batch(
    incoming: DataFrame,
    batch: int,
    root: str,
    asset_key: list[str],
    chunk: str = "chunk_index",
    order: list[str] | None = None,
    buckets: int = BUCKETS,
    replace: tuple[str, ...] = ("attrs",),
    ends: str | None = None,
) -> None:
    """Merge one micro-batch (``merged_rows``). Only bucket numbers come to the driver.

    ``buckets`` counts for a new table; an old one keeps its own number.
    """
    spark = incoming.sparkSession
    bucket = F.pmod(F.xxhash64(*asset_key), F.lit(table_buckets(spark, root, buckets))).cast("int")
    touched = {row["b"] for row in incoming.select(bucket.alias("b")).distinct().collect()}
    if not touched:
        return
    drop_replaced(spark, root, before=batch)
    stored = read_table(spark, root, incoming.schema, touched, before=batch)
    merged = merged_rows(stored, incoming, asset_key, chunk, order, replace, ends).withColumn("bucket", bucket)
    (
        merged.repartitionByRange("bucket", *asset_key, chunk)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{root}/batch={batch}")
    )


def ingest_stream(
    source: DataFrame,
    root: str,
    checkpoint: str,
    asset_key: list[str],
    chunk: str = "chunk_index",
    order: list[str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    buckets: int = BUCKETS,
    replace: tuple[str, ...] = ("attrs",),
    ends: str | None = None,
):
    """Start the query: every available batch is merged, then it stops.

    ``source`` is a streaming read whose ``maxFilesPerTrigger`` is the cap per batch.
    """

    def merge(batch_df: DataFrame, batch: int) -> None:
        merge_batch(prepare(batch_df), batch, root, asset_key, chunk, order, buckets, replace, ends)

    return (
        source.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
