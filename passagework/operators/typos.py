"""Word parts for typo candidates: how terms are cut, and the stored table of a vocabulary's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, materialize

# Fixed value: the typo limit.
MAX_EDITS = 2
BUCKETS = 64
WRITERS = 64  # tasks at most that write parts, each a file for a bucket


def segments_of(term: Column) -> Column:
    """Cut a term of ``n`` letters into parts, one more than the edits it may differ by."""
    n = F.length(term)
    parts = _parts(n)
    base = (n / parts).cast("int")
    longer = n % parts  # the last `longer` parts have one letter more

    def part(i: Column) -> Column:
        start = i * base + F.greatest(F.lit(0), i - (parts - longer))
        size = base + F.when(i >= parts - longer, 1).otherwise(0)
        return F.struct(n.alias("len"), i.alias("part"), F.substr(term, start + 1, size).alias("segment"))

    return F.transform(F.sequence(F.lit(0), parts - 1), part)


def _parts(n: Column) -> Column:
    return F.least(F.lit(MAX_EDITS), n - 1) + 1


def probes_of(token: Column) -> Column:
    """Substrings of a token that some part of a term within reach must equal.

    The positions follow the multi-match-aware selection of Pass-Join (Li, Deng, Wang,
    Feng; VLDB 2012).
    """
    size_q = F.length(token)

    def for_length(n: Column) -> Column:
        parts = _parts(n)
        edits = parts - 1
        base = (n / parts).cast("int")
        longer = n % parts
        delta = size_q - n

        def for_part(i: Column) -> Column:
            start = i * base + F.greatest(F.lit(0), i - (parts - longer))
            size = base + F.when(i >= parts - longer, 1).otherwise(0)
            low = F.greatest(F.lit(0), start - i, start + delta - (edits - i))
            high = F.least(size_q - size, start + i, start + delta + (edits - i))
            return F.when(
                low <= high,
                F.transform(
                    F.sequence(low, high),
                    lambda at: F.struct(
                        n.alias("len"), i.alias("part"), F.substr(token, at + 1, size).alias("segment")
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<len:int,part:int,segment:string>>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), for_part))

    lengths = F.sequence(F.greatest(F.lit(1), size_q - MAX_EDITS), size_q + MAX_EDITS)
    return F.array_distinct(F.flatten(F.transform(lengths, for_length)))


def part_bucket() -> Column:
    return F.pmod(F.xxhash64("field", "len", "part", "segment"), F.lit(BUCKETS)).cast("int")


def write_parts(vocab: DataFrame) -> DataFrame:
    """``field, term, df, len, part, segment`` of a vocabulary, partitioned by bucket and sorted by part.

    Every task writes the parts of its own terms and nothing is shuffled, so a part that
    many terms share is not one task's.
    """
    parts = vocab.select("field", "term", "df", F.inline(segments_of(F.col("term")))).withColumn("bucket", part_bucket())
    ordered = parts.coalesce(WRITERS).sortWithinPartitions("bucket", "field", "len", "part", "segment")
    return materialize(ordered, "word-parts", "bucket", compact=True)


def asked_parts(parts: DataFrame, probes: DataFrame) -> DataFrame:
    """Stored parts that equal a probe (``field, token, len, part, segment``); only asked buckets (64 at most) are read.

    The probes of a search are broadcast where they measure small, so the table isn't shuffled.
    """
    buckets = [r["bucket"] for r in probes.select(part_bucket().alias("bucket")).distinct().collect()]
    return join_sized(parts.filter(F.col("bucket").isin(buckets)).drop("bucket"), probes, ["field", "len", "part", "segment"])
