"""Subtitles, captions and speech segments as timed cues.

Each function turns one file per row into an array of ``struct<start_ms, end_ms, text>``;
``explode_cues`` numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, bind, squeeze, strip, strip_tags

CUE = "struct<start_ms:bigint,end_ms:bigint,text:string>"
CAPTION_JSON = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"
SEGMENTS_JSON = "struct<text:string,segments:array<struct<start:double,end:double,text:string>>>"
SNIPPETS_JSON = "array<struct<start:double,duration:double,text:string>>"

# A time stamp line; hours may be missing.
_TIME = r"(?:(\d{2,}):)?(\d{2}):(\d{2})[,.](\d{3})"
STAMP = rf"^{_TIME}\s*-->\s*{_TIME}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: one row per text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _stamp_ms(line: Column, first: int) -> Column:
    part = [F.regexp_extract(line, STAMP, first + i).try_cast("long") for i in range(4)]
    hours = F.coalesce(part[0], F.lit(0))
    return ((hours * 60 + part[1]) * 60 + part[2]) * 1000 + part[3]


def subtitle_cues(body: Column) -> Column:
    """Cues of an SRT or WebVTT file.

    Blocks are separated by blank lines. The line above the time stamp is the cue number
    or name and is dropped, as are tags; blocks without a stamp (headers, notes) and
    without text give no cue. Text lines keep their digits and dots.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "^﻿+", ""), "\r\n?", "\n")
    blocks = F.split(strip(text), rf"\n{WS}*\n")

    def cue(block: Column) -> Column:
        rows = F.filter(F.transform(F.split(block, "\n"), strip), lambda line: line != "")

        def from_stamp(rows: Column) -> Column:
            def timed(stamp: Column) -> Column:
                at = F.array_position(rows, stamp).cast("int")
                words = F.filter(F.slice(rows, at + 1, F.size(rows)), lambda line: ~line.rlike(STAMP))
                return F.when(
                    stamp.isNotNull(),
                    F.struct(
                        _stamp_ms(stamp, 1).alias("start_ms"),
                        _stamp_ms(stamp, 5).alias("end_ms"),
                        squeeze(strip_tags(F.array_join(words, " "))).alias("text"),
                    ),
                )

            # the lines are searched for the stamp once
            return bind(F.try_element_at(F.filter(rows, lambda line: line.rlike(STAMP)), F.lit(1)), timed)

        return bind(rows, from_stamp)

    return F.filter(F.transform(blocks, cue), lambda c: c.isNotNull() & (c["text"] != ""))


def subtitle_text(body: Column) -> Column:
    """Plain text of a subtitle file."""
    return F.array_join(F.transform(subtitle_cues(body), lambda c: c["text"]), " ")


def caption_json_cues(body: Column) -> Column:
    """Cues of caption JSON: the segments of an event joined, start and duration."""
    events = F.from_json(body, CAPTION_JSON)["events"]

    def cue(event: Column) -> Column:
        joined = F.array_join(F.transform(event["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
        start = F.coalesce(event["tStartMs"], F.lit(0))
        return F.struct(
            start.alias("start_ms"),
            (start + F.coalesce(event["dDurationMs"], F.lit(0))).alias("end_ms"),
            squeeze(F.coalesce(joined, F.lit(""))).alias("text"),
        )

    cues = F.transform(F.coalesce(events, F.array().cast("array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>")), cue)
    return F.filter(cues, lambda c: c["text"] != "")


def _ms(seconds: Column) -> Column:
    return F.greatest(F.lit(0), (seconds * 1000).cast("long"))


def segment_cues(segments: Column) -> Column:
    """Cues of speech segments with ``start``, ``end`` in seconds and ``text``."""

    def cue(s: Column) -> Column:
        start = F.coalesce(s["start"], F.lit(0.0))
        end = F.when(F.coalesce(s["end"], F.lit(0.0)) == 0, start).otherwise(s["end"])
        return F.struct(
            _ms(start).alias("start_ms"), _ms(end).alias("end_ms"), squeeze(F.coalesce(s["text"], F.lit(""))).alias("text")
        )

    return F.filter(F.transform(segments, cue), lambda c: c["text"] != "")


def snippet_cues(snippets: Column) -> Column:
    """Cues of snippets with ``start``, ``duration`` in seconds and ``text``."""

    def cue(s: Column) -> Column:
        start = F.coalesce(s["start"], F.lit(0.0))
        return F.struct(
            _ms(start).alias("start_ms"),
            _ms(start + F.coalesce(s["duration"], F.lit(0.0))).alias("end_ms"),
            squeeze(F.coalesce(s["text"], F.lit(""))).alias("text"),
        )

    return F.filter(F.transform(snippets, cue), lambda c: c["text"] != "")


def explode_cues(df: DataFrame, cues: Column, *keys: str) -> DataFrame:
    """``keys, ord, start_ms, end_ms, text``, numbered from 0 in file order."""
    return df.select(*keys, F.posexplode(cues).alias("ord", "cue")).select(*keys, "ord", "cue.*")
