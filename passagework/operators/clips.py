"""Saved passages and transcripts as plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, present, slugify_title

PAGE_ENTRIES = 500


def clip_text(clip_no: Column) -> Column:
    """One numbered entry: link, titles, start time and text, each on its line."""
    group, asset = present(F.col("group_title")), present(F.col("asset_title"))
    start = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit("At "), clock(F.col("start_ms"))))
    body = F.concat_ws(
        "\n", present(F.col("href")), F.when(group.eqNullSafe(asset), None).otherwise(group), asset, start, present(F.col("text"))
    )
    return F.concat(clip_no.cast("string"), F.lit(".\n"), body)


def clip_pages(clips: DataFrame, entries: int = PAGE_ENTRIES) -> DataFrame:
    """``pack_id, page, text``: the pack as text, ``entries`` clips to a page.

    ``ord`` numbers the clips of a pack from 0. A pack of any size is spread over pages of
    bounded length; pages joined by a blank line are the whole text.
    """
    numbered = clips.select(
        "pack_id", F.floor(F.col("ord") / entries).cast("int").alias("page"), "ord", clip_text(F.col("ord") + 1).alias("entry")
    )
    return numbered.groupBy("pack_id", "page").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda e: e["entry"]), "\n\n"
        ).alias("text")
    )


def transcript_lines(assets: DataFrame, passages: DataFrame) -> DataFrame:
    """``safe_title, line_no, line`` of one text file per asset: header, then its passages.

    ``assets`` has ``asset_id, title, published, url``; ``passages`` has ``asset_id,
    chunk_index, text``.
    """
    head = assets.select(
        "asset_id", slugify_title(F.col("title")).alias("safe_title"),
        F.posexplode(
            F.array(
                F.concat(F.lit("Episode: "), F.col("title")),
                F.concat(F.lit("Date: "), F.coalesce("published", F.lit("Unknown"))),
                F.concat(F.lit("URL: "), F.coalesce("url", F.lit("Unknown"))),
                F.lit("-" * 50),
                F.lit(""),
            )
        ).alias("line_no", "line"),
    )
    names = head.filter("line_no = 0").select("asset_id", "safe_title")
    body = passages.join(names, "asset_id").select(
        "asset_id", "safe_title", (F.col("chunk_index") + 5).alias("line_no"), F.col("text").alias("line")
    )
    return head.unionByName(body)


def write_transcripts(lines: DataFrame, path: str, buckets: int = 256) -> None:
    """Text files under ``bucket=<n>/file=<safe title>-<asset id>``, lines in their order.

    The asset id keeps equal titles apart and the buckets keep folders short. An asset of
    very many lines is several files, in order by name.
    """
    name = F.concat_ws("-", "safe_title", slugify_title(F.col("asset_id")))
    (
        lines.withColumns({"file": name, "bucket": F.pmod(F.xxhash64("asset_id"), F.lit(buckets))})
        .repartitionByRange("bucket", "file", "asset_id", "line_no")
        .sortWithinPartitions("bucket", "file", "asset_id", "line_no")
        .select("bucket", "file", F.col("line").alias("value"))
        .write.partitionBy("bucket", "file")
        .text(path)
    )
