"""Migration of a table in an older layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import present
from ..operators.common import hadoop_path
from ..operators.schema import LEGACY_COLUMNS, SCHEMA_VERSION, from_legacy, split_valid, validation_errors


def migrate(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid passages, rejected rows with reasons) of a table in any layout."""
    return split_valid(from_legacy(table), validation_errors())


def needs_rewrite(table: DataFrame) -> DataFrame:
    """Rows that are not passages of the current version yet; the others stay untouched."""
    legacy = [c for c in LEGACY_COLUMNS if c in table.columns]
    stale = F.lit(False)
    for name in legacy:
        stale = stale | present(F.col(name).cast("string")).isNotNull()
    if "schema_version" not in table.columns:
        return table
    return table.filter(stale | ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)))


def migration_report(table: DataFrame) -> DataFrame:
    """``asset_type, scanned, replaced, rejected``: rows that break a table rule are rejected."""
    moved = from_legacy(needs_rewrite(table))
    usable = F.size(validation_errors()) == 0
    return moved.groupBy(F.col("asset.type").alias("asset_type")).agg(
        F.count("*").alias("scanned"), F.count_if(usable).alias("replaced"), F.count_if(~usable).alias("rejected")
    )


def migrate_in_steps(
    spark: SparkSession, source: str, target: str, files_per_step: int = 1000, at_most: int | None = None
) -> tuple[DataFrame, DataFrame, int]:
    """Migrate a Parquet table group of files by group of files; a stopped run goes on where it was.

    ``target/plan`` lists the source files with their step; files that appear later get
    further steps. A step reads its files once and writes valid and rejected rows in one
    pass to ``target/rows/step=N``; the writer's ``_SUCCESS`` is its commit. A step without one is written
    anew, a step with one is never read again. ``at_most`` bounds the steps of this call.

    Returns valid passages, rejected rows with their reasons, both of the finished steps
    only, and the number of steps that are left.
    """
    old = spark.read.option("mergeSchema", "true").parquet(source)
    steps = _planned(spark, sorted(old.inputFiles()), target, files_per_step)
    paths = {step: f"{target}/rows/step={step}" for step in sorted(steps)}
    left = [step for step, path in paths.items() if not _exists(spark, f"{path}/_SUCCESS")]
    for step in left[:at_most]:
        part = spark.read.schema(old.schema).option("basePath", source).parquet(*steps[step])
        moved = from_legacy(part).withColumn("reject_reasons", validation_errors())
        moved.write.mode("overwrite").parquet(paths[step])
    left = left[len(left[:at_most]):]
    done = [path for step, path in paths.items() if step not in left]
    schema = from_legacy(old.limit(0)).withColumn("reject_reasons", validation_errors()).schema
    rows = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    sound = F.size("reject_reasons") == 0
    return rows.filter(sound).drop("reject_reasons"), rows.filter(~sound), len(left)


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = hadoop_path(spark, path)
    return files.exists(at)


def _planned(spark: SparkSession, files: list[str], target: str, per_step: int) -> dict[int, list[str]]:
    """Files by step: those of earlier runs as planned then, new ones in steps of their own."""
    steps: dict[int, list[str]] = {}
    n = 0
    while _exists(spark, f"{target}/plan/{n}/_SUCCESS"):
        for row in spark.read.schema("file string, step int").parquet(f"{target}/plan/{n}").toLocalIterator():
            steps.setdefault(row["step"], []).append(row["file"])
        n += 1
    known = {f for listed in steps.values() for f in listed}
    new = [f for f in files if f not in known]
    if new:
        start = max(steps, default=-1) + 1
        rows = [(f, start + i // per_step) for i, f in enumerate(new)]
        spark.createDataFrame(rows, "file string, step int").coalesce(1).write.mode("overwrite").parquet(f"{target}/plan/{n}")
        for f, step in rows:
            steps.setdefault(step, []).append(f)
    return steps
