"""Byte-level BPE of whole texts through a table of distinct words."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.common import most_frequent, small_batches
from passagework.operators.common import materialize

#: White space of the byte-level pre-tokenizer.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words: a run of other characters with the space before it, or white space that no run takes.
#: A pre-token never crosses the ends of such a word, so words can be encoded on their own.
WORD = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"
CHARS_PER_STEP = 1_000_000
WORDS_HELD = 200_000  # distinct words that a task counts before it passes them on
#: Pre-tokens of byte-level BPE files (a fixed value of the format).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> Tokenizer:
    """The tokenizer of a file, kept as long as the Python worker."""
    return Tokenizer(path)


class Tokenizer:
    """A byte-level BPE file in memory: encodes words, knows special tokens and pieces.

    The file's ids must follow its merges, which makes an id the rank of its merge.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        rest = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in said["model"]["vocab"].items() if piece not in self.special}
        merges = ("".join(m.split(" ") if isinstance(m, str) else m) for m in said["model"]["merges"])
        order = [said["model"]["vocab"][m] for m in merges]
        if order != sorted(order) or said["normalizer"] or said["pre_tokenizer"]["type"] != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no byte-level BPE whose ids follow its merges")
        self.pieces = [b""] * (1 + max(*ranks.values(), *self.special.values()))
        for piece, i in [*ranks.items(), *((text.encode(), i) for text, i in self.special.items())]:
            self.pieces[i] = piece
        self.merge = tiktoken.Encoding("words", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.find = re.compile(WORD).findall

    def words(self, text: str) -> list[str]:
        """Words of a text in their order; a special token is a word of its own."""
        if self.cut is None or not self.cut.search(text):
            return self.find(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.find(part))]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [[self.special[w]] if w in self.special else self.merge(w) for w in words]


class Table:
    """Words and their ids as flat arrays, with the place of each word."""

    def __init__(self, words: list[str], sizes: np.ndarray, flat: np.ndarray):
        self.place = dict(zip(words, range(len(words))))
        self.sizes, self.flat = sizes, flat
        self.starts = np.cumsum(sizes) - sizes


def joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start..start+size of one range after another."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def steps(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch in runs of bounded length; null is the empty text."""
    run, held = [], 0
    for value in texts:
        body = value.as_py() or ""
        if run and held + len(body) > CHARS_PER_STEP:
            yield run
            run, held = [], 0
        run.append(body)
        held += len(body)
    if run:
        yield run


def word_table(docs: DataFrame, tokenizer: str, text: str = "text", words: int = 200_000, longest: int = 64) -> DataFrame:
    """Distinct words of all texts, counted in Spark and encoded once: ``word``, ``n``, ``ids``.

    Returns the most frequent that occur twice or more, at most ``words`` and of at most
    ``longest`` characters, which bounds the table at about 40 MB whatever the corpus.
    """

    def count(batches):
        own = tokenizer_of(tokenizer)
        seen = Counter()

        def told():
            kept = [(w, n) for w, n in seen.items() if len(w) <= longest]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for run in steps(batch.column(0)):
                for body in run:
                    seen.update(own.words(body))
                if len(seen) > WORDS_HELD:
                    yield told()
                    seen.clear()
        yield told()

    def encode(batches):
        own = tokenizer_of(tokenizer)
        for batch in batches:
            ids = own.encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    small_batches(docs.sparkSession)
    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = most_frequent(materialize(counts.filter("n > 1"), "bpe-counts"), "n", words)
    return materialize(frequent.mapInArrow(encode, "word string, n long, ids array<int>"), "bpe-words")


def encoded(spark: SparkSession, table: DataFrame, tokenizer: str, text: Column) -> Column:
    """Ids of a text as the tokenizer gives them for the whole text; null is the empty text.

    Frequent words are joined by position from the broadcast ``word_table``. A word beyond
    it is encoded once in each step of its task (a million characters) and joined the same way, so every
    word of every text has its ids and nothing is moved.
    """
    rows = table.toArrow()
    ids = rows["ids"].combine_chunks()
    sizes = pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    shared = spark.sparkContext.broadcast((rows["word"].to_pylist(), sizes, ids.flatten().to_numpy()))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, known = tokenizer_of(tokenizer), Table(*shared.value)
        for texts in batches:
            flats, sizes, base = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], len(known.place)
            for bodies in steps(texts):
                words = [own.words(body) for body in bodies]
                flat = [w for ws in words for w in ws]
                place = known.place.get
                rare = [w for w, at in zip(flat, map(place, flat)) if at is None]
                rare = dict(zip(rare, range(len(rare))))
                rare = dict(zip(rare, range(base, base + len(rare))))
                coded = own.encode(list(rare))
                extra = np.fromiter(map(len, coded), np.int64, len(coded))
                at = np.fromiter((rare[w] if i is None else i for w, i in zip(flat, map(place, flat))), np.int64, len(flat))
                more = np.fromiter(chain.from_iterable(coded), np.int32, int(extra.sum()))
                all_sizes = np.concatenate((known.sizes, extra))
                all_starts = np.concatenate((known.starts, np.cumsum(extra) - extra + len(known.flat)))
                ids = np.concatenate((known.flat, more))
                each = all_sizes[at]
                flats.append(ids[joined(all_starts[at], each)])
                ends = np.cumsum([len(ws) for ws in words])
                total = np.concatenate(([0], np.cumsum(each)))[ends]
                sizes.append(np.diff(total, prepend=0))
            offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats)))

    return run(text)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "ids", words: int = 200_000) -> DataFrame:
    """Add ``into``: the ids of every whole text (null: those of the empty text, none).

    ``tokenizer`` is the path of a byte-level BPE file that all executors have. Equal rows
    get equal ids; an empty table gives an empty table; a column of that name is replaced.
    """
    table = word_table(docs, tokenizer, text, words)
    return docs.withColumn(into, encoded(docs.sparkSession, table, tokenizer, F.col(text)))


def decoded(tokenizer: str, ids: Column) -> Column:
    """Text of an id array, special tokens included: the bytes of the pieces, read as UTF-8.

    Each id is joined with the id-to-piece table (as large as the vocabulary) in the task.
    Bytes that are no UTF-8 become U+FFFD; unknown and null ids have no bytes. A null
    array is null.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = tokenizer_of(tokenizer).pieces + [b""]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8)
        for rows in batches:
            out = []
            for row in rows:
                if not row.is_valid:
                    out.append(None)
                    continue
                at = row.values.to_numpy(zero_copy_only=False)
                at = np.nan_to_num(at, nan=-1).astype(np.int64)
                at = np.where((at < 0) | (at >= len(pieces)), len(pieces) - 1, at)
                out.append(data[joined(starts[at], sizes[at])].tobytes().decode("utf-8", "replace"))
            yield pa.array(out, pa.string())

    return run(ids)


def decode(encoded_docs: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the text of every id array."""
    return encoded_docs.withColumn(into, decoded(tokenizer, F.col(ids)))
