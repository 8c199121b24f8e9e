"""Keyed maintenance of the passage table.

Every function returns the whole new table; ``write_snapshot`` stores it beside the old
one, so a job that fails half-way leaves the current snapshot untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import latest_per
from .schema import drop_legacy

ASSET_KEY = ["asset_type", "asset_id"]


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    asset_key: list[str],
    chunk: str = "chunk_index",
    order: list[str] | None = None,
    replace: tuple[str, ...] = ("attrs",),
    trim: bool = True,
) -> DataFrame:
    """Write ``incoming`` over ``stored`` by (asset, chunk) and cut rewritten assets.

    A column the incoming row leaves null keeps its stored value, except those named in
    ``replace``. Duplicate incoming keys count once, the last one in ``order``. Stored
    chunks past the last incoming chunk of their asset are removed; assets that are not
    rewritten stay. The full join is on the unique chunk key, so a large asset spreads
    over many tasks; the trim joins one row per asset, and AQE splits a large one.
    """
    key = [*asset_key, chunk]
    rest = [c for c in stored.columns if c not in key]
    fresh = latest_per(incoming, key, order or [])
    if trim:
        ends = fresh.groupBy(*asset_key).agg(F.max(chunk).alias("_end"))
        stored = stored.join(ends, asset_key, "left").filter(
            F.col("_end").isNull() | (F.col(chunk) <= F.col("_end"))
        ).drop("_end")
    old = stored.select(*key, F.struct(*rest).alias("_old"), F.lit(True).alias("_had"))
    new = fresh.select(
        *key, F.struct(*[c for c in rest if c in fresh.columns]).alias("_new"), F.lit(True).alias("_has")
    )
    new_columns = set(fresh.columns)

    def merged(name: str) -> Column:
        if name not in new_columns:
            return F.col("_old")[name]
        if name in replace:
            return F.when(F.col("_has"), F.col("_new")[name]).otherwise(F.col("_old")[name])
        return F.coalesce(F.col("_new")[name], F.col("_old")[name])

    return old.join(new, key, "full").select(*key, *[merged(c).alias(c) for c in rest]).select(*stored.columns)


def upsert_passages(
    stored: DataFrame, incoming: DataFrame, merge_attrs: bool = False, order: list[str] | None = None
) -> DataFrame:
    """:func:`upsert` for passage rows; ``merge_attrs`` keeps stored members the new row lacks."""

    def keyed(df: DataFrame) -> DataFrame:
        return drop_legacy(df).withColumns({"asset_type": F.col("asset.type"), "asset_id": F.col("asset.id")})

    old, new = keyed(stored), keyed(incoming)
    if not merge_attrs:
        return upsert(old, new, ASSET_KEY, order=order).drop(*ASSET_KEY)
    members = stored.schema["attrs"].dataType.names
    flat = {f"_attr_{m}": F.col(f"attrs.{m}") for m in members}
    out = upsert(old.withColumns(flat), new.withColumns(flat), ASSET_KEY, order=order)
    merged = F.struct(*[F.col(f"_attr_{m}").alias(m) for m in members])
    return out.withColumn("attrs", merged).select(*stored.columns)


def replace_rows(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Whole-row replacement by key; the other rows stay."""
    kept = stored.join(incoming.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(incoming)


def update_attrs(
    passages: DataFrame, changes: DataFrame, members: tuple[str, ...], kind: str | None = None, order: list[str] | None = None
) -> DataFrame:
    """Set attribute members on every passage of the assets in ``changes``.

    ``changes`` has ``asset_id``, one column per member, and ``asset_type`` unless all are of
    one ``kind``: ids are only unique within a type. Of several changes of one asset the
    last in ``order`` counts. A null leaves the stored member alone; other members and
    assets, and passages whose asset has no change, are not touched. Passages without
    attributes get them.
    """
    typed = changes if kind is None else changes.withColumn("asset_type", F.lit(kind))
    last = latest_per(typed, ASSET_KEY, order or [])
    renamed = last.select(*[F.col(c).alias(f"_{c}") for c in (*ASSET_KEY, *members)])
    joined = passages.join(
        renamed, (F.col("asset.type") == F.col("_asset_type")) & (F.col("asset.id") == F.col("_asset_id")), "left"
    )
    stored = passages.schema["attrs"].dataType.names
    merged = F.struct(*[(F.coalesce(F.col(f"_{m}"), F.col("attrs")[m]) if m in members else F.col("attrs")[m]).alias(m) for m in stored])
    touched = F.coalesce(*[F.col(f"_{m}").cast("string") for m in members]).isNotNull()
    return joined.withColumn("attrs", F.when(touched, merged).otherwise(F.col("attrs"))).select(*passages.columns)


def missing_assets(known: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Known assets the table does not have."""
    return known.join(stored.select(*key).distinct(), key, "left_anti")


# --- snapshots ------------------------------------------------------------------------


def snapshot_numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete snapshots below ``root``, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("snapshot=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete snapshot, or None."""
    numbers = snapshot_numbers(spark, root)
    return spark.read.parquet(f"{root}/snapshot={numbers[-1]}") if numbers else None


def write_snapshot(passages: DataFrame, root: str) -> int:
    """Store the table as the next snapshot; readers see it once it is complete.

    Rows are range-partitioned by the full key, so a file covers a narrow key range and an
    asset with many chunks spreads over several tasks.
    """
    numbers = snapshot_numbers(passages.sparkSession, root)
    number = numbers[-1] + 1 if numbers else 1
    (
        passages.withColumn("asset_type", F.col("asset.type"))
        .repartitionByRange("asset_type", F.col("asset.id"), "chunk_index")
        .sortWithinPartitions("asset_type", F.col("asset.id"), "chunk_index")
        .write.partitionBy("asset_type")
        .parquet(f"{root}/snapshot={number}")
    )
    return number
