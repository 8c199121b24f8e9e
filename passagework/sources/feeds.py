"""Episode feeds and video catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mail_timestamp, present, strip, unescape_html
from ..functions.urls import anchor_episode_id, transcript_episode_id

# Explicit schemas: inference would read a duration such as 00:10 as a time stamp.
ITEM = (
    "guid struct<_VALUE:string,_isPermaLink:string>, title string, link string, pubDate string, description string, "
    "enclosure struct<_url:string,_type:string>, `podcast:transcript` struct<_url:string>, `itunes:duration` string"
)
CHANNEL = "title string, `itunes:author` string"
VIDEO = (
    "id string, title string, url string, duration double, upload_date string, release_date string"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Raw ``item`` elements of feed files, split over many tasks, with their file."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    return items.withColumn("feed", F.col("_metadata.file_path"))


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """``feed, show_title, author``: the channel header of every feed file."""
    raw = spark.read.format("xml").option("rowTag", "channel").schema(CHANNEL).load(path)
    return raw.select(
        F.col("_metadata.file_path").alias("feed"),
        strip(F.coalesce("title", F.lit(""))).alias("show_title"),
        strip(F.coalesce("itunes:author", F.lit(""))).alias("author"),
    )


def item_column(xml: Column) -> Column:
    """One ``<item>`` element held in a string column as a struct for :func:`episodes`."""
    return F.from_xml(xml, f"struct<{_as_ddl(ITEM)}>")


def _as_ddl(columns: str) -> str:
    return ", ".join(_name_type(part) for part in _split_columns(columns))


def _split_columns(columns: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in columns:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += char
    return [*parts, current.strip()]


def _name_type(part: str) -> str:
    name, _, kind = part.partition(" ")
    return f"{name}: {kind}"


def episodes(items: DataFrame, *keep: str) -> DataFrame:
    """Typed episodes; items without guid or title are dropped."""
    guid = strip(F.coalesce(F.col("guid._VALUE"), F.lit("")))
    title = unescape_html(strip(F.coalesce("title", F.lit(""))))
    link = strip(F.coalesce("link", F.lit("")))
    transcript = F.col("`podcast:transcript`._url")
    return items.select(
        *keep,
        guid.alias("guid"),
        title.alias("title"),
        link.alias("link"),
        mail_timestamp(F.col("pubDate")).alias("published_at"),
        F.coalesce("itunes:duration", F.lit("")).alias("duration"),
        F.coalesce(F.col("enclosure._url"), F.lit("")).alias("audio_url"),
        transcript.alias("transcript_url"),
        F.coalesce("description", F.lit("")).alias("description"),
        transcript_episode_id(transcript).alias("spotify_episode_id"),
        anchor_episode_id(link).alias("anchor_id"),
    ).filter((F.col("guid") != "") & (F.col("title") != ""))


def first_audio_link(enclosure_url: Column, links: Column) -> Column:
    """The enclosure, else the first link whose type is audio (``links``: href, type)."""
    audio = F.filter(links, lambda link: F.coalesce(link["type"], F.lit("")).startswith("audio/"))
    return F.coalesce(present(enclosure_url), F.try_element_at(F.transform(audio, lambda link: link["href"]), F.lit(1)))


def videos(catalog: DataFrame) -> DataFrame:
    """``video_id, title, url, duration, published_at`` of catalog entries that have an id."""
    day = F.left(F.coalesce(present(F.col("upload_date")), F.col("release_date")), F.lit(8))
    entry = catalog.filter(present(F.col("id")).isNotNull())
    return entry.select(
        F.col("id").alias("video_id"),
        strip(F.coalesce(present(F.col("title")), F.col("id"))).alias("title"),
        F.coalesce(present(F.col("url")), F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id"))).alias("url"),
        "duration",
        F.when(F.length(day) == 8, F.try_to_timestamp(day, F.lit("yyyyMMdd"))).alias("published_at"),
    )
