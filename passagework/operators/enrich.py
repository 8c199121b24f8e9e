"""Match stored assets with an external catalog by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_title, present
from ..functions.urls import anchor_episode_id, transcript_episode_id
from .common import latest_per

GRAM_SIZES = (1, 2, 4, 8, 16)


def with_title_key(df: DataFrame, title: str) -> DataFrame:
    return df.withColumn("title_key", normal_title(F.col(title)))


def match_exact(assets: DataFrame, catalog: DataFrame, title: str, catalog_title: str, order: str) -> DataFrame:
    """Left join on the normal title; of catalog rows with one title the last counts.

    The catalog is reduced to one row per title before the join, so a title that very many
    assets share meets a single row.
    """
    rows = with_title_key(catalog, catalog_title)
    last = latest_per(rows, ["title_key"], [order])
    return with_title_key(assets, title).join(last, "title_key", "left")


def _of_size(key: Column, n: int) -> Column:
    """Every substring of ``n`` letters."""
    made = F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda at: F.substr(key, at, F.lit(n)))
    return F.when(F.length(key) >= n, made).otherwise(F.array().cast("array<string>"))


def _grams(key: Column) -> Column:
    """Every substring of one of the gram sizes."""
    return F.array_distinct(F.concat(*[_of_size(key, n) for n in GRAM_SIZES]))


def _longest_grams(key: Column) -> Column:
    """Every substring of the largest gram size that the title has."""
    grams = _of_size(key, GRAM_SIZES[0])
    for n in GRAM_SIZES[1:]:
        grams = F.when(F.length(key) >= n, _of_size(key, n)).otherwise(grams)
    return F.array_distinct(grams)


def _inside(small: DataFrame, small_key: str, large: DataFrame, large_key: str) -> DataFrame:
    """``small_key, large_key`` where the large title contains the small one.

    A contained title has all its grams in the containing one, so it is enough to meet by
    its rarest: what very many titles share, such as a common start, brings none together.
    A title with a gram that no large title has is in none.
    """
    held = large.select(large_key, F.explode(_grams(F.col(large_key))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    asked = small.select(small_key, F.explode(_longest_grams(F.col(small_key))).alias("gram")).join(counts, "gram", "left")
    rarest = asked.groupBy(small_key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("g")).filter("g.n > 0")
    return rarest.select(small_key, "g.gram").join(held, "gram").filter(F.contains(large_key, small_key)).select(small_key, large_key)


def contained_titles(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """``wanted_key, catalog_key`` where one title contains the other: equi-joins on rare grams."""
    left = wanted.select(F.col("title_key").alias("wanted_key")).filter("wanted_key <> ''").distinct()
    right = catalog.select(F.col("title_key").alias("catalog_key")).filter("catalog_key <> ''").distinct()
    inside = _inside(left, "wanted_key", right, "catalog_key").select("wanted_key", "catalog_key")
    around = _inside(right, "catalog_key", left, "wanted_key").select("wanted_key", "catalog_key")
    return inside.unionByName(around).distinct()


def feed_ids(stored: DataFrame, feed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Stored episodes left-joined with the feed by guid: what to write to their attributes.

    ``stored`` has ``asset_id, title, url`` per episode; ``feed`` has ``guid, title, link,
    transcript_url`` per item, of which the last in ``order`` counts. The result,
    ``asset_id, title, spotify_episode_id, anchor_id``, is a change table for
    ``update_attrs(..., kind="episode")``: the feed's title and link win where it has them.
    """
    items = latest_per(feed.select("guid", "title", "link", "transcript_url", *(order or [])), ["guid"], order or [])
    known = items.select(F.col("guid").alias("asset_id"), F.col("title").alias("_title"), F.col("link").alias("_link"), "transcript_url")
    return stored.select("asset_id", "title", "url").join(known, "asset_id", "left").select(
        "asset_id",
        F.coalesce(present(F.col("_title")), F.col("title")).alias("title"),
        transcript_episode_id(F.col("transcript_url")).alias("spotify_episode_id"),
        anchor_episode_id(F.coalesce(present(F.col("_link")), F.col("url"))).alias("anchor_id"),
    )


def match_contained(assets: DataFrame, catalog: DataFrame, title: str, catalog_title: str, order: str) -> DataFrame:
    """For every asset the first catalog row whose title equals, contains or is in its own.

    An equal title wins over containment; otherwise the first row in ``order`` counts.
    """
    rows = with_title_key(catalog, catalog_title)
    first = latest_per(rows.withColumn("_first", -F.col(order)), ["title_key"], ["_first"]).drop("_first")
    keyed = with_title_key(assets, title)
    pairs = contained_titles(keyed, first)
    best = (
        pairs.join(first, pairs["catalog_key"] == first["title_key"])
        .drop("title_key")
        .groupBy("wanted_key")
        .agg(
            F.min_by(
                F.struct(*[c for c in first.columns if c != "title_key"]),
                F.struct(F.col("wanted_key") != F.col("catalog_key"), F.col(order)),
            ).alias("_row")
        )
        .select(F.col("wanted_key").alias("title_key"), "_row.*")
    )
    return keyed.join(best, "title_key", "left")


def attribute_coverage(passages: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Distinct assets, and distinct assets having each attribute."""
    per_asset = passages.groupBy("asset.type", "asset.id").agg(
        *[F.bool_or(present(F.col("attrs")[a].cast("string")).isNotNull()).alias(a) for a in attributes]
    )
    return per_asset.agg(
        F.count("*").alias("n_assets"), *[F.count_if(a).alias(f"n_{a}") for a in attributes]
    )
