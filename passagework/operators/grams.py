"""Stored letter triples of passages: which of them contain a literal, without reading every text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import join_sized, materialize, top_per

SIZE = 3
BUCKETS = 64
SLICES = 8  # files that the lists of a bucket are spread over
STEP = 2_000_000  # letters whose triples a task lists at once; one passage may have more
MEET = 3  # rarest triples of a literal that a passage must have before its text is read
COMMON = 16  # a literal is common if its rarest triple stands in more than this part of the passages


@dataclass(frozen=True)
class GramIndex:
    """``postings`` (gram, n, keys, bucket), ``counts`` (gram, n, bucket), the columns read and their passages.

    A triple has several rows of postings, each with the keys of some of its passages. The
    rows of the empty triple count passages and name none.
    """

    postings: DataFrame
    counts: DataFrame
    columns: tuple[str, ...]
    n_passages: int


def folded(columns: tuple[str, ...]) -> Column:
    """The lower-cased columns as one text. NUL keeps them apart; it cannot occur in a trimmed query."""
    return F.lower(F.concat_ws("\0", *[F.col(c) for c in columns]))


def triples(text: Column) -> Column:
    """Distinct runs of three letters; none for a shorter text. Linear in its length."""

    def runs(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(letters) - SIZE)
        each = F.transform(starts, lambda i: F.concat(*[F.get(letters, i + k) for k in range(SIZE)]))
        return F.when(F.size(letters) >= SIZE, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return bind(F.split(text, ""), runs)


def passage_key() -> Column:
    """Four bytes of a passage id. Two ids may share a key, so what a key finds is compared by its text."""
    return F.hash("passage_id")


def gram_bucket() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")


def _listed(keys: np.ndarray, bodies: list[str]) -> Iterator[pa.RecordBatch]:
    """``gram, n, keys``: triples of some texts, and for each the keys of the texts that have it."""
    units = np.frombuffer("".join(bodies).encode("utf-32-le"), np.uint32)
    if len(units) < SIZE:
        return
    row = np.repeat(np.arange(len(bodies), dtype=np.uint64), [len(b) for b in bodies])
    seen = np.zeros(int(units.max()) + 1, bool)
    seen[units] = True
    letters = np.flatnonzero(seen).astype(np.uint32)
    wide, deep = int(len(letters) - 1).bit_length(), int(len(bodies) - 1).bit_length()
    if SIZE * wide + deep > 64:  # triple and text must fit one number; one text always does
        half = len(bodies) // 2
        yield from _listed(keys[:half], bodies[:half])
        yield from _listed(keys[half:], bodies[half:])
        return
    rank = (np.cumsum(seen) - 1).astype(np.uint64)[units]
    last = len(units) - SIZE + 1
    whole, held = row[:last] == row[SIZE - 1 :], np.zeros(last, np.uint64)
    for k in range(SIZE):
        whole &= units[k : last + k] != 0
        held = held << np.uint64(wide) | rank[k : last + k]
    held = np.sort((held << np.uint64(deep) | row[:last])[whole])
    held = held[np.append(True, held[1:] != held[:-1])[: len(held)]]
    gram, row = held >> np.uint64(deep), held & np.uint64((1 << deep) - 1)
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    places = [gram[first] >> np.uint64(wide * (SIZE - 1 - k)) & np.uint64((1 << wide) - 1) for k in range(SIZE)]
    text = letters[np.stack(places, axis=1).astype(np.int64)].tobytes().decode("utf-32-le")
    ends = np.append(first, len(row))
    yield _rows([text[i : i + SIZE] for i in range(0, len(text), SIZE)], np.diff(ends), ends, keys[row.astype(np.int64)])


def _rows(grams: list[str], n: list[int] | np.ndarray, ends: list[int] | np.ndarray, keys: list[int] | np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64()), lists], ["gram", "n", "keys"])


def _posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples of the texts of a task, step by step, and the number of texts under the empty triple.

    A step goes on from one batch to the next, however few rows a batch may have.
    """
    keys, held, letters = [], [], 0

    def listed() -> Iterator[pa.RecordBatch]:
        yield _rows([""], [len(held)], [0, 0], [])
        yield from _listed(np.concatenate(keys), held)

    for batch in batches:
        of, bodies = np.asarray(batch.column("key")), batch.column("body")
        size = letters + np.cumsum(np.asarray(pc.utf8_length(bodies), dtype=np.int64))
        step = size // STEP
        starts = np.flatnonzero(np.append(True, np.diff(step) != 0)[: len(of)])
        for start, end in zip(starts, np.append(starts[1:], len(of))):
            if step[start] and held:
                yield from listed()
                keys, held = [], []
            keys.append(of[start:end])
            held += bodies[start:end].to_pylist()
        letters = size[-1] % STEP if len(of) else letters
    if held:
        yield from listed()


def build_gram_index(passages: DataFrame, columns: tuple[str, ...] = ("asset.title", "parent.title", "text")) -> GramIndex:
    """Write the triples of all passages, by bucket and sorted, and count them.

    A task lists the passages of each triple for some thousand passages at a time, so what
    is shuffled and sorted is a row per triple and list, not one per triple and passage.
    The lists of a bucket are dealt over ``SLICES`` files, so a triple that every passage
    has is not one task's. Triples across the end of a column are left out, as no literal
    has one. ``passage_id`` must be unique.
    """
    texts = passages.select(passage_key().alias("key"), folded(columns).alias("body"))
    lists = texts.mapInArrow(_posting_lists, "gram string, n bigint, keys array<int>")
    dealt = lists.withColumn("bucket", gram_bucket()).repartition(F.col("bucket"), F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(SLICES)))
    postings = materialize(dealt.sortWithinPartitions("bucket", "gram"), "gram-postings", "bucket")
    counts = postings.filter("gram <> ''").groupBy("gram", "bucket").agg(F.sum("n").alias("n")).select("gram", "n", "bucket")
    n_passages = postings.filter("gram = ''").agg(F.sum("n")).first()[0] or 0
    return GramIndex(postings, materialize(counts.sortWithinPartitions("bucket", "gram"), "gram-counts", "bucket"), columns, n_passages)


def _asked(stored: DataFrame, side: DataFrame) -> DataFrame:
    """Rows of a bucketed table with a gram of ``side``; other buckets (64 at most are named) are not read."""
    buckets = [r["bucket"] for r in side.select(gram_bucket().alias("bucket")).distinct().collect()]
    return join_sized(stored.filter(F.col("bucket").isin(buckets)).drop("bucket"), side, ["gram"])


def split_literals(literals: DataFrame, index: GramIndex) -> tuple[DataFrame, DataFrame]:
    """Triples to meet (``literal, gram, needed``), and the literals that a scan of all texts answers better.

    These are the literals of one or two letters and the common ones, of which the index
    would only say that they may stand in much of the table. A literal with a triple that
    no passage has stands nowhere and is in neither.
    """
    short = F.length("literal") < SIZE
    cut = literals.filter(~short).withColumn("grams", triples(F.col("literal")))
    asked = cut.select("literal", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    found = materialize(_asked(index.counts, asked), "literal-grams")
    whole = found.groupBy("literal", "size").agg(F.count("*").alias("known"), F.min("n").alias("least")).filter("known = size")
    common = F.col("least") * COMMON > index.n_passages
    rarest = top_per(found.join(whole.filter(~common).select("literal"), "literal", "left_semi"), ["literal"], [F.col("n"), F.col("gram")], MEET)
    meet = rarest.select("literal", "gram", F.least("size", F.lit(MEET)).alias("needed"))
    scanned = literals.filter(short & (F.col("literal") != "")).select("literal").unionByName(whole.filter(common).select("literal"))
    return materialize(meet, "literal-meet"), materialize(scanned, "literal-scan")


def containing(meet: DataFrame, passages: DataFrame, index: GramIndex) -> DataFrame:
    """``literal, passage_id`` of the passages given that contain a literal of ``meet``.

    Passages that have all the triples asked for are looked up by key, and their texts
    compared; passages written after the index are not found.
    """
    listed = _asked(index.postings.drop("n"), meet).select("literal", "needed", F.explode("keys").alias("key"))
    held = listed.groupBy("literal", "key", "needed").agg(F.count("*").alias("n"))
    likely = materialize(held.filter("n >= needed").select("literal", "key"), "literal-likely")
    texts = passages.filter("passage_id is not null").select("passage_id", passage_key().alias("key"), folded(index.columns).alias("body"))
    hits = join_sized(texts, likely, ["key"]).filter(F.contains("body", "literal"))
    # an id that several passages have is not looked up, only scanned for
    return hits.groupBy("literal", "passage_id").agg(F.count("*").alias("n")).filter("n = 1").select("literal", "passage_id")
