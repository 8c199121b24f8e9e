"""Keyword index over passages: term rows, vocabulary and field statistics.

A passage is one row of bounded length, so term counts, field lengths and vector norms
are computed inside the row and building the index needs no shuffle. The vocabulary is
its only aggregation: it adds up the lengths of packed lists, one for a term and some
thousand passages, so a term that occurs in every passage costs one partial row per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import english_term, english_terms, standard_terms
from .common import BATCH_ROWS, materialize, setting
from .grams import GramIndex, build_gram_index
from .posting_lists import SCHEMA, block_lists
from .typos import write_parts


@dataclass(frozen=True)
class Field:
    name: str
    source: str
    analyzer: str
    boost: float
    fuzzy: bool = False


# Searched fields with their analyzer and boost.
FIELDS = (
    Field("text", "text", "english", 1.0),
    Field("asset.title", "asset.title", "english", 2.0),
    Field("asset.title.fuzzy", "asset.title", "standard", 2.2, fuzzy=True),
    Field("parent.title", "parent.title", "english", 1.3),
    Field("parent.title.fuzzy", "parent.title", "standard", 1.1, fuzzy=True),
    Field("text.fuzzy", "text", "standard", 0.8, fuzzy=True),
    Field("code", "code", "standard", 1.0),
    Field("attrs.path", "attrs.path", "standard", 1.3),
)


#: What a search may be filtered by, with the passage member behind it.
FILTERS = {"asset_type": "asset.type", "asset_id": "asset.id", "parent_id": "parent.id"}
BUCKETS = 64
WRITERS = 256  # tasks at most that write postings, each a file for a bucket
PASSAGES_PER_STEP = 1000  # passages that a task counts at once
ENTRIES = T.ArrayType(
    T.StructType()
    .add("field", T.StringType()).add("term", T.StringType()).add("tf", T.IntegerType()).add("len", T.IntegerType()).add("norm", T.DoubleType())
)


def analyze(text: Column, analyzer: str | Column) -> Column:
    """Terms of a text; the analyzer may differ from row to row."""
    if isinstance(analyzer, str):
        return english_terms(text) if analyzer == "english" else standard_terms(text)
    return F.when(analyzer == "english", english_terms(text)).otherwise(standard_terms(text))


def _has(df: DataFrame, path: str) -> bool:
    schema = df.schema
    for part in path.split("."):
        if part not in getattr(schema, "names", []):
            return False
        schema = schema[part].dataType
    return True


def index_rows(passages: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """``passage_id``, the filter columns and ``entries``: all terms of a passage in one row.

    An entry has ``field, term, tf, len, norm``: ``len`` is the number of terms in the field
    and ``norm`` the length of its vector of ``1 + ln(tf)`` weights. A text is cut into words
    once for all its fields, and a task stems and counts the words of many passages at a time.
    """
    held = [f for f in fields if _has(passages, f.source)]
    sources = list(dict.fromkeys(f.source for f in held))
    keys = [F.col(path).alias(name) if _has(passages, path) else F.lit(None).cast("string").alias(name) for name, path in FILTERS.items()]
    words = [standard_terms(F.col(s)).alias(f"words{i}") for i, s in enumerate(sources)]
    table = passages.select("passage_id", *keys, *words)
    first = 1 + len(keys)  # the words come after the keys
    schema = T.StructType(table.schema.fields[:first]).add("entries", ENTRIES)
    names = schema.names
    plan = [(f.name, f.analyzer, sources.index(f.source)) for f in held]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PASSAGES_PER_STEP):
                rows = batch.slice(begin, PASSAGES_PER_STEP)
                entries = _entries(rows.columns[first:], plan, rows.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns[:first], entries], names=names)

    return table.mapInArrow(count, schema)


def _entries(texts: list[pa.ListArray], plan: list[tuple[str, str, int]], n: int) -> pa.ListArray:
    """Entries of ``n`` passages, by field and then by term, from the words of their texts."""
    coded = []
    for words in texts:
        distinct = words.flatten().dictionary_encode()
        owner = np.repeat(np.arange(n), words.value_lengths().to_numpy(zero_copy_only=False))
        coded.append((owner, distinct.indices.to_numpy(zero_copy_only=False), distinct.dictionary.to_pylist()))
    names, parts = [], []
    for number, (_, analyzer, source) in enumerate(plan):
        owner, at, words = coded[source]
        terms = list(map(english_term, words)) if analyzer == "english" else words
        ordered = sorted({t for t in terms if t is not None})
        place = {t: i for i, t in enumerate(ordered)}
        code = np.array([place.get(t, -1) for t in terms], np.int64)[at]
        found = code >= 0
        both, tf = np.unique(owner[found] * max(1, len(ordered)) + code[found], return_counts=True)
        row, term = np.divmod(both, max(1, len(ordered)))
        size = np.bincount(row, tf, minlength=n)[row]
        squares = np.array([0.0] + [(1 + math.log(k)) ** 2 for k in range(1, tf.max(initial=0) + 1)])
        norm = np.sqrt(np.bincount(row, squares[tf], minlength=n))[row]
        parts.append((row, np.full(len(row), number), term + len(names), tf, size, norm))
        names += ordered
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 6
    order = np.argsort(columns[0], kind="stable")  # fields keep their order in a passage
    row, field, term, tf, size, norm = (c[order] for c in columns)
    members = [
        pa.array([f[0] for f in plan], pa.string()).take(pa.array(field)), pa.array(names, pa.string()).take(pa.array(term)),
        pa.array(tf.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(norm.astype(np.float64)),
    ]
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(members, ["field", "term", "tf", "len", "norm"]))


def postings(rows: DataFrame) -> DataFrame:
    """``field, term, passage_id, tf, len, norm`` of index rows: one row per entry."""
    # the outer form keeps Spark from testing the size of `entries` by computing it twice
    return (
        rows.select("passage_id", F.inline_outer("entries"))
        .filter(F.col("term").isNotNull())
        .select("field", "term", "passage_id", "tf", "len", "norm")
    )


def vocabulary(lists: DataFrame) -> DataFrame:
    """``field, term, df`` of written posting lists."""
    return lists.filter("term is not null").groupBy("field", "term").agg(F.sum("n").alias("df"))


def field_stats(rows: DataFrame) -> DataFrame:
    """``field, n_passages, avg_len`` over the index rows whose passage has the field.

    Every entry of a field tells its length; the first is asked.
    """
    names, sizes = F.col("entries.field"), F.col("entries.len")  # only these members are read
    each = rows.select(names.alias("names"), sizes.alias("sizes")).select(
        F.explode(
            F.transform(
                F.array_distinct("names"),
                lambda f: F.struct(f.alias("field"), F.get("sizes", (F.array_position("names", f) - 1).cast("int")).alias("len")),
            )
        ).alias("e")
    )
    sums = each.groupBy("e.field").agg(F.count("*").alias("n_passages"), F.sum(F.col("e.len").cast("long")).alias("total"))
    return sums.select("field", "n_passages", (F.col("total") / F.col("n_passages")).alias("avg_len"))


def term_bucket(field: Column, term: Column) -> Column:
    return F.pmod(F.xxhash64(field, term), F.lit(BUCKETS)).cast("int")


def write_postings(rows: DataFrame) -> DataFrame:
    """Postings as packed lists, in a table partitioned by term bucket and sorted by term.

    ``field, term, block, n, packed``: the ``n`` passages of a block that have the term, and
    how often. A block is some thousand passages of one task; rows without a term, in buckets
    below 0, have its ``ids`` (where the field is null), and ``lens`` and ``norms`` by field.

    A search for a few terms reads their buckets only, and in these the row groups whose
    range holds them. Every task writes the postings of its own passages, nothing is
    shuffled, and a term that nearly every passage has is never one task's.
    """
    members = [f"entries.{name}" for name in ("field", "term", "tf", "len", "norm")]
    lists = rows.select("passage_id", *members).coalesce(WRITERS).mapInArrow(block_lists, SCHEMA)
    of_block = -1 - F.pmod(F.xxhash64("block"), F.lit(BUCKETS)).cast("int")
    bucket = F.when(F.col("term").isNull(), of_block).otherwise(term_bucket(F.col("field"), F.col("term")))
    ordered = lists.withColumn("bucket", bucket).sortWithinPartitions("bucket", "field", "term")
    with setting(rows.sparkSession, BATCH_ROWS, PASSAGES_PER_STEP):
        return materialize(ordered, "postings", "bucket", compact=True)


@dataclass(frozen=True)
class Index:
    """Written tables a search reads."""

    rows: DataFrame
    postings: DataFrame  # packed lists
    vocabulary: DataFrame
    stats: DataFrame
    keys: DataFrame  # ``passage_id`` and the filter columns, sorted by these
    parts: DataFrame | None = None  # word parts of the fields with typo matches
    grams: GramIndex | None = None  # letter triples for literal matches
    repeated: DataFrame | None = None  # ids that several passages have


def build_index(passages: DataFrame, fields: tuple[Field, ...] = FIELDS, literals: bool = False) -> Index:
    """Analyse ``passages`` once, write the index rows, and count terms from them.

    With ``literals`` the letter triples are written too: the literal step of a search then
    looks passages up where it would read all texts. They take several times the texts' space.
    """
    with setting(passages.sparkSession, BATCH_ROWS, PASSAGES_PER_STEP):
        rows = materialize(index_rows(passages, fields), "index-rows", compact=True)
    terms = write_postings(rows)
    words = materialize(vocabulary(terms), "vocabulary", compact=True)
    keys = materialize(rows.select("passage_id", *FILTERS).sortWithinPartitions(*FILTERS), "index-keys", compact=True)
    fuzzy = [f.name for f in fields if f.fuzzy]
    parts = write_parts(words.filter(F.col("field").isin(fuzzy))) if fuzzy else None
    grams = build_gram_index(passages) if literals else None
    again = keys.groupBy("passage_id").agg(F.count("*").alias("n")).filter("n > 1").select("passage_id")
    repeated = materialize(again, "repeated-ids", compact=True)
    return Index(rows, terms, words, materialize(field_stats(rows), "field-stats", compact=True), keys, parts, grams, repeated)
