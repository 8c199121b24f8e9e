"""Sitemaps of articles and of documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import present, strip
from ..functions.urls import is_current_docs_url, is_post_url, product, slug, url_path, url_query

ENTRY = "loc string, lastmod string"


def read_entries(spark: SparkSession, path: str, tag: str = "url") -> DataFrame:
    """``loc, lastmod, file`` of ``url`` (or ``sitemap``) elements, split over many tasks."""
    raw = spark.read.format("xml").option("rowTag", tag).schema(ENTRY).load(path)
    return raw.withColumn("file", F.col("_metadata.file_path"))


def entry_column(xml: Column) -> Column:
    """One ``<url>`` or ``<sitemap>`` element held in a string column."""
    return F.from_xml(xml, "struct<loc: string, lastmod: string>")


def _loc() -> Column:
    return strip(F.coalesce("loc", F.lit("")))


def _day() -> Column:
    return present(F.left(strip(F.coalesce("lastmod", F.lit(""))), F.lit(10)))


def post_entries(entries: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """``url, lastmod, slug`` of article URLs below ``prefix``."""
    return entries.select(*keep, _loc().alias("url"), _day().alias("lastmod")).filter(
        (F.col("url") != "") & is_post_url(F.col("url"), prefix)
    ).withColumn("slug", slug(F.col("url")))


def current_sitemaps(entries: DataFrame, book: str | None = None) -> DataFrame:
    """``loc, product`` of the sitemaps of current books, or of one book."""
    rows = entries.select(_loc().alias("loc")).filter((F.col("loc") != "") & is_current_docs_url(F.col("loc")))
    rows = rows.withColumn("product", product(F.col("loc")))
    return rows.filter(F.col("product") == book) if book else rows


def page_entries(entries: DataFrame, book: Column | None = None, *keep: str) -> DataFrame:
    """``url, lastmod, product, slug`` of current pages, one per page without query string.

    ``book`` is the product the sitemap belongs to; pages outside it are dropped.
    """
    book = F.lit("") if book is None else F.coalesce(book, F.lit(""))
    rows = entries.select(*keep, _loc().alias("url"), _day().alias("lastmod"), book.alias("_book"))
    path = url_path(F.col("url"))
    root = F.concat(F.lit("/docs/"), F.col("_book"))
    inside = (F.col("_book") == "") | (F.regexp_replace(path, "/+$", "") == root) | F.startswith(path, F.concat(root, F.lit("/")))
    return (
        rows.filter((F.col("url") != "") & (url_query(F.col("url")) == "") & is_current_docs_url(F.col("url")) & inside)
        .withColumn("product", F.coalesce(present(F.col("_book")), product(F.col("url"))))
        .withColumn("slug", slug(F.col("url")))
        .drop("_book")
    )
