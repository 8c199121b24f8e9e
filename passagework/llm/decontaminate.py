"""Benchmark decontamination: a prefix-filtered join of item windows with document words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.common import fresh, without
from passagework.operators.common import join_sized, materialize, small_enough

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows are broadcast in blocks of about this many bytes of text.
BLOCK_BYTES = 32 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` is the faster way where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """The words of a text; an empty string stands before the first and after the last where the text starts or ends between words."""
    return F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN)


def word_count(words: Column) -> Column:
    edges = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (F.size(words) - edges).cast("long")


def shingle_at(words: Column, at: Column, size: int) -> Column:
    """``size`` words from place ``at`` (from 0), joined by blanks; null beyond the end."""
    return F.concat(*[x for i in range(size) for x in (F.lit(" "), F.get(words, at + i))][1:])


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``win, words, length``) and which items have them (``win, item``).

    A window is ``window`` consecutive words; an item of fewer, but not none, is one.
    """
    words = F.filter(split_words(F.col(text)), lambda w: w != "")
    own = items.select(F.col(item_id).cast("string").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(window)))).alias("words"))
    cut = materialize(cut.withColumn("win", F.array_join("words", " ")), "leak-cut")
    distinct = cut.groupBy("win").agg(F.first("words").alias("words")).withColumn("length", F.size("words"))
    return materialize(distinct, "leak-windows"), materialize(cut.select("win", "item").distinct(), "leak-items")


def shingles_of(windows: DataFrame, size: int) -> DataFrame:
    """``win, offset, shingle``: every shingle of the windows whose shingles have ``size`` words."""
    places = F.sequence(F.lit(0), F.size("words") - size)
    return windows.select("win", "length", F.explode(F.transform(places, lambda i: F.struct(i.alias("offset"), shingle_at(F.col("words"), i, size).alias("shingle")))).alias("s")).select(
        "win", "length", "s.offset", "s.shingle"
    )


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hits_by_text(spark: SparkSession, found: list[DataFrame], owners: DataFrame) -> DataFrame:
    """``digest, n_hit, items`` from occurrences (``digest, start, length, win``) of windows and their items."""
    hits = spark.createDataFrame([], "digest binary, start int, length int, win string")
    for more in found:
        hits = hits.unionByName(more)
    spans = hits.groupBy("digest", "start").agg(F.max("length").alias("length"))
    covered = spans.select("digest", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct()
    named = join_sized(hits.select("digest", "win").distinct(), owners.filter("item is not null"), ["win"]).select("digest", "item").distinct()
    items = named.groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return covered.groupBy("digest").agg(F.count("*").alias("n_hit")).join(items, "digest", "left")


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, shingle: int = 3, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_words, n_hit, n_items, items, contaminated`` to every document.

    A word inside any occurrence of an item window is hit; ``items`` are the ids with an
    occurring window, sorted as strings. Exact, by a set join with prefix filter:

    1. The shingles of all windows (``shingle`` words, or the whole of a shorter window)
       are counted in all documents, which orders them by rarity.
    2. As a window must be contained whole, its prefix is one shingle: the rarest. Only texts
       that hold a prefix are read again, and of their shingles only the prefixes go on.
    3. Length and place: the document must have room for the window around the shingle.
    4. The words around it are compared with the window's. Hit places are counted once.

    All steps are DataFrame functions. Windows are broadcast, in blocks of at most about ``block_bytes``
    of text, each of which is two scans of the documents; document words never leave
    their row but for the matches. Results belong to texts (met by digest), so copies of a text share them
    before the shuffle, and null or repeated ids do no harm.

    Null and empty texts have no words. Items without words match nothing; an item without
    id marks words and is in no list; rows of one id are one item. An empty table on either
    side gives zeros. A column with an added name (in any case) is replaced; others stay.
    A task holds one text's words.
    """
    added = ("n_words", "n_hit", "n_items", "items", "contaminated")
    kept = without(docs, added)
    windows, owners = windows_of(items, item_id, item_text, window)
    total = windows.agg(F.sum(F.octet_length("win")).alias("b"), F.collect_set(F.least("length", F.lit(shingle))).alias("sizes")).first()
    blocks = max(1, -(-(total["b"] or 0) // block_bytes))
    texts = docs.select(F.col(text).alias("body")).filter("body is not null").withColumn("digest", digest_of(F.col("body")))

    def places(bodies: DataFrame, size: int) -> DataFrame:
        """``digest, w, at, shingle``: one row for every shingle of every document."""
        worded = bodies.select("digest", split_words(F.col("body")).alias("w")).filter(F.size("w") >= size)
        return worded.select("digest", "w", F.posexplode("w").alias("at", "word")).select("digest", "w", "at", shingle_at(F.col("w"), F.col("at"), size).alias("shingle"))

    found = []
    for size in sorted(total["sizes"]):
        for block in range(blocks):
            own = windows.filter((F.least("length", F.lit(shingle)) == size) & (F.pmod(F.xxhash64("win"), F.lit(blocks)) == block))
            marks = materialize(shingles_of(own, size), "leak-shingles")
            met = places(texts, size).select("digest", "shingle").join(F.broadcast(marks.select("shingle").distinct()), "shingle")
            seen = materialize(met.groupBy("digest", "shingle").agg(F.count("*").alias("n")), "leak-seen")
            rarity = materialize(seen.groupBy("shingle").agg(F.sum("n").alias("n")), "leak-rarity")
            # windows with a shingle that no document has cannot occur
            ranked = join_sized(marks, rarity, ["shingle"]).groupBy("win").agg(
                F.count("*").alias("k"), F.max("length").alias("length"), F.min(F.struct("n", "shingle", "offset")).alias("rarest")
            )
            prefix = materialize(ranked.filter(F.col("k") == F.col("length") - size + 1).select("win", "length", "rarest.shingle", "rarest.offset"), "leak-prefixes")
            holding = materialize(seen.join(F.broadcast(prefix.select("shingle").distinct()), "shingle").select("digest").distinct(), "leak-holding")
            few = small_enough(holding)  # beyond that the texts are read again whole rather than shuffled
            again = places(texts.join(F.broadcast(holding), "digest", "left_semi") if few else texts, size)
            start = F.col("at") - F.col("offset")
            fits = (start >= 0) & (start + F.col("length") <= F.size("w"))
            met = again.join(F.broadcast(prefix), "shingle").filter(fits)
            met = met.filter(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("length")), " ") == F.col("win"))
            found.append(materialize(met.select("digest", start.alias("start"), "length", "win"), "leak-found"))
    digest, words = fresh(docs, "_digest", "_words")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*kept, F.split(body, BETWEEN).alias(words), digest_of(body).alias(digest))
    rows = rows.select(*kept, word_count(F.col(words)).alias("n_words"), digest)
    result = materialize(hits_by_text(docs.sparkSession, found, owners).withColumnRenamed("digest", digest), "leak-results")
    joined = join_sized(rows, result, [digest], "left")
    return joined.select(
        *kept, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
