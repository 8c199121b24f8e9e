"""What is stored already: roll-ups, ingest states, plans and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present


def stored_state(chunks: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: chunk numbers, dates and flags in constant space.

    ``chunks`` has ``key, chunk_index, lastmod, complete, start_ms``. Contiguous means the
    chunk numbers are exactly 0..n-1; duplicates break it. Distinct numbers are counted by
    (key, number) first, so a key with very many rows is pre-aggregated in every task.
    """
    numbers = chunks.groupBy(*key, "chunk_index").agg(
        F.count("*").alias("n"),
        F.min(F.coalesce("lastmod", F.lit(""))).alias("oldest"),
        F.bool_and(F.coalesce("complete", F.lit(False))).alias("all_complete"),
        F.bool_or(F.coalesce("complete", F.lit(False))).alias("any_complete"),
        F.bool_or(F.coalesce(F.col("start_ms") >= 0, F.lit(False))).alias("timed"),
    )
    n = F.sum("n")
    return numbers.groupBy(*key).agg(
        n.alias("n_chunks"),
        ((F.min("chunk_index") == 0) & (F.max("chunk_index") == n - 1) & (F.count("*") == n)).alias("contiguous"),
        F.min("oldest").alias("oldest_lastmod"),
        F.bool_and("all_complete").alias("all_complete"),
        F.bool_or("any_complete").alias("any_complete"),
        F.bool_or("timed").alias("timed"),
    )


def post_state(lastmod: Column, force: bool = False) -> Column:
    """complete, stale, partial or missing for a post: all rows complete and new enough."""
    missing = F.col("n_chunks").isNull() | F.lit(force)
    fresh = present(lastmod).isNotNull() & (F.col("oldest_lastmod") != "") & (F.col("oldest_lastmod") >= lastmod)
    return (
        F.when(missing, "missing")
        .when(F.col("contiguous") & F.coalesce(fresh, F.lit(False)) & F.col("all_complete"), "complete")
        .when(~F.col("contiguous"), "partial")
        .otherwise("stale")
    )


def video_state(force: bool = False) -> Column:
    """complete, partial or missing for a video: any complete row, or no gap, is enough."""
    return (
        F.when(F.col("n_chunks").isNull() | F.lit(force), "missing")
        .when(F.col("any_complete") | F.col("contiguous"), "complete")
        .otherwise("partial")
    )


def doc_state(stored_lastmod: Column, lastmod: Column, force: bool = False) -> Column:
    """A documentation page is complete when the stored date is at least the listed one."""
    fresh = present(stored_lastmod).isNotNull() & present(lastmod).isNotNull() & (stored_lastmod >= lastmod)
    return F.when(F.coalesce(fresh, F.lit(False)) & ~F.lit(force), "complete").otherwise("missing")


def file_state(stored_ref: Column, ref: Column, force: bool = False) -> Column:
    """A source file is complete when its content hash is the stored one."""
    return F.when(stored_ref.eqNullSafe(ref) & ref.isNotNull() & ~F.lit(force), "complete").otherwise("missing")


def episode_state(force: bool = False) -> Column:
    """An episode is complete as soon as one chunk has a time."""
    return F.when(F.coalesce(F.col("timed"), F.lit(False)) & ~F.lit(force), "complete").otherwise("missing")


def ingest_plan(
    catalog: DataFrame, state: DataFrame, key: list[str], verdict: Column, consider: int = 0, most_new: int = 0,
    newest: list[Column] | None = None,
) -> DataFrame:
    """Catalog rows with a ``state``; caps as in a batch run.

    ``consider`` keeps that many catalog rows in ``newest`` order before the states are
    looked at; ``most_new`` keeps that many rows that need writing, after it. Zero is no cap.
    """
    if consider:
        catalog = catalog.orderBy(*(newest or [])).limit(consider)
    plan = catalog.join(state, key, "left").withColumn("state", verdict)
    if most_new:
        plan = plan.filter("state <> 'complete'").orderBy(*(newest or [])).limit(most_new)
    return plan


def run_summary(plan: DataFrame, outcome: DataFrame, key: list[str]) -> DataFrame:
    """One row: ingested, skipped, failed, rewritten assets and chunks written.

    ``outcome`` has the chunks written per attempted asset; none or zero is a failure.
    """
    joined = plan.join(outcome.select(*key, "chunks_written"), key, "left")
    todo = F.col("state") != "complete"
    wrote = F.coalesce("chunks_written", F.lit(0)) > 0
    return joined.agg(
        F.count_if(todo & wrote).alias("ingested"),
        F.count_if(~todo).alias("skipped"),
        F.count_if(todo & ~wrote).alias("failed"),
        F.count_if(F.col("state").isin("partial", "stale") & wrote).alias("rewritten"),
        F.coalesce(F.sum(F.when(todo, F.col("chunks_written"))), F.lit(0)).alias("chunks"),
    )


def count_by_type(passages: DataFrame) -> DataFrame:
    """Passages per asset type, largest first."""
    return (
        passages.groupBy(F.col("asset.type").alias("asset_type"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "asset_type")
    )


def count_by_container(passages: DataFrame, attribute: str | None = None) -> DataFrame:
    """Chunks and distinct assets per container, and how many assets have an attribute.

    Assets are reduced to one row each first, so a container with very many chunks is
    counted from pre-aggregated rows.
    """
    has = present(F.col("attrs")[attribute].cast("string")).isNotNull() if attribute else F.lit(False)
    per_asset = passages.groupBy(
        F.col("parent.type").alias("parent_type"), F.col("parent.id").alias("parent_id"),
        F.col("asset.type").alias("_t"), F.col("asset.id").alias("_i"),
    ).agg(F.count("*").alias("n"), F.bool_or(has).alias("has"))
    return per_asset.groupBy("parent_type", "parent_id").agg(
        F.sum("n").alias("n_chunks"), F.count("*").alias("n_assets"), F.count_if("has").alias("n_with_attr")
    )


SKETCH_BITS = 14  # 2^14 registers: about 0.7 % of relative standard error, 16 KB at most


def container_sketches(passages: DataFrame, attribute: str | None = None) -> DataFrame:
    """Mergeable counts per container: sketches of its passages, its assets and its assets with an attribute.

    A passage that is written again changes nothing, so the sketches of an upsert's rows
    can be merged into those of the stored table without reading it.
    """
    asset = F.concat_ws("\u001f", "asset.type", "asset.id")
    has = present(F.col("attrs")[attribute].cast("string")).isNotNull() if attribute else F.lit(False)

    def sketch(of: Column) -> Column:
        return F.hll_sketch_agg(of, SKETCH_BITS)

    return passages.groupBy(F.col("parent.type").alias("parent_type"), F.col("parent.id").alias("parent_id")).agg(
        sketch(F.col("passage_id")).alias("chunks"), sketch(asset).alias("assets"), sketch(F.when(has, asset)).alias("with_attr")
    )


def merge_sketches(stored: DataFrame, *changes: DataFrame) -> DataFrame:
    """Sketches of several tables as one; rows in more than one of them count once."""
    for change in changes:
        stored = stored.unionByName(change)
    return stored.groupBy("parent_type", "parent_id").agg(*[F.hll_union_agg(c).alias(c) for c in ("chunks", "assets", "with_attr")])


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """The columns of ``count_by_container``, estimated from sketches."""
    shown = {"chunks": "n_chunks", "assets": "n_assets", "with_attr": "n_with_attr"}
    return sketches.select("parent_type", "parent_id", *[F.hll_sketch_estimate(c).alias(name) for c, name in shown.items()])


def newest_first(df: DataFrame, date: str, tie: str, limit: int = 0) -> DataFrame:
    """Newest first, undated last; with ``limit`` a top-k that never sorts everything."""
    ordered = df.orderBy(F.col(date).desc_nulls_last(), F.col(tie))
    return ordered.limit(limit) if limit else ordered
