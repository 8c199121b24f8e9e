"""What each filter of a chain removes, in every order: a removal game and its potential."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import small_batches
from passagework.operators.common import materialize

CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def too_short(raw: bytes, words: list[bytes], chars: int) -> bool:
    return len(words) < 50


def repeating(raw: bytes, words: list[bytes], chars: int) -> bool:
    return 100 * len(set(words)) < 65 * len(words)


def shouting(raw: bytes, words: list[bytes], chars: int) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * chars


def with_signs(raw: bytes, words: list[bytes], chars: int) -> bool:
    return any(sign in raw for sign in SIGNS)


#: The failure condition of each filter on a text's UTF-8 bytes, words (split at ASCII white space) and number of code points.
CONDITIONS: dict[str, Callable[[bytes, list[bytes], int], bool]] = {"A": too_short, "B": repeating, "C": shouting, "D": with_signs}
#: The filter that drops copies.
COPIES = "E"
NAMES = ("docs", "good", "toxic")


def judged(texts: pa.Array) -> pa.Array:
    """Which of ``CONDITIONS`` a text fails, as bits, and its digest; null counts as empty."""
    masks, digests = [], []
    for text in texts:
        body = text.as_py() or ""
        raw = body.encode("utf-8", "surrogatepass")
        words = raw.split()  # of bytes: runs of anything but x20 and x09 to x0D
        masks.append(sum(1 << i for i, fails in enumerate(CONDITIONS.values()) if fails(raw, words, len(body))))
        digests.append(hashlib.sha256(raw).digest())
    return pa.StructArray.from_arrays([pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["mask", "digest"])


def failing(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, part: str) -> DataFrame:
    """``part, mask, docs, good, toxic``: documents by the set of filters that they fail.

    Equal texts meet as digests, counted within (digest, part, id) before the shuffle, so
    a group of copies is a few rows. Of a digest only the smallest id passes filter E.
    """
    read = F.arrow_udf(judged, "struct<mask:int,digest:binary>")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), read(F.col(text)).alias("read")
    ).select("doc_id", "part", "read.*")
    each = materialize(rows.groupBy("digest", "mask", "part", "doc_id").agg(F.count("*").alias("docs")), "audit-rows")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad")
    )
    # rows without an id meet no label; a salt keeps them from one task
    salted = each.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0)))
    marked = salted.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    counts = [F.col("docs"), *[F.when(F.col(c), F.col("docs")).otherwise(0).alias(n) for c, n in (("good", "good"), ("bad", "toxic"))]]
    marked = materialize(marked.select("digest", "mask", "part", "doc_id", *counts), "audit-marked")
    # of one (digest, part): all rows, and those of its smallest id
    row = F.struct(*NAMES)
    known = F.col("doc_id").isNotNull()
    of_part = marked.groupBy("digest", "mask", "part", known.alias("known")).agg(
        F.min("doc_id").alias("least"), F.min_by(row, F.col("doc_id")).alias("first"), *[F.sum(n).alias(n) for n in NAMES]
    )
    of_part = materialize(of_part, "audit-parts")
    least = of_part.filter("known").groupBy("digest").agg(F.min("least").alias("of_all"), F.count("*").alias("k"))
    several = least.filter("k > 1").select("digest", "of_all")
    # digests of one part need no join; the others have a row per part, not per copy
    first_of = of_part.filter("known").join(several, "digest", "left").withColumn("leads", F.coalesce(F.col("of_all") == F.col("least"), F.lit(True)))
    copy = 1 << len(CONDITIONS)

    def some(rows: DataFrame, mask: Column, count: Callable[[str], Column]) -> DataFrame:
        return rows.select("part", mask.alias("mask"), *[count(n).alias(n) for n in NAMES])

    leading, lagging = first_of.filter("leads"), first_of.filter("not leads")
    groups = some(leading, F.col("mask"), lambda n: F.col("first")[n])
    groups = groups.unionByName(some(leading, F.col("mask") + copy, lambda n: F.col(n) - F.col("first")[n]))
    groups = groups.unionByName(some(lagging, F.col("mask") + copy, F.col))
    groups = groups.unionByName(some(of_part.filter("not known"), F.col("mask"), F.col))
    return groups.groupBy("part", "mask").agg(*[F.sum(n).alias(n) for n in NAMES])


def coalitions(masks: DataFrame, filters: int) -> DataFrame:
    """One row per part: for each count the array of what every set of filters removes, and the total.

    A set is a number with a bit for each filter; it removes what fails any of its filters.
    """

    def removed(name: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(name)).otherwise(0)) for s in range(1 << filters)]).alias(name)

    return masks.groupBy("part").agg(*[removed(n) for n in NAMES], F.sum(NAMES[0]).alias("total"))


def potentials(removed: Column, filters: int) -> Column:
    """Hart-Mas-Colell potential of every set, times ``filters!``, exact.

    P of nothing is 0; P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, so that P(S) less
    P(S without i) is what i gets in S, and all of them add up to v(S). A set's subsets are
    smaller numbers, so one pass in numeric order is the recursion; the factor keeps every step whole.
    """

    def step(p: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(1 << i) != 0, F.get(p, s - (1 << i))).otherwise(0) for i in range(filters)]
        whole = F.get(removed, s) * factorial(filters) + sum(without[1:], without[0])
        return F.concat(p, F.array(F.call_function("div", whole, F.bit_count(s))))

    return F.reduce(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), step)


def audit_filters(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """What each filter removes at every step of every order, by part, with its Shapley value.

    Five filters: ``CONDITIONS`` A to D on the text alone, E for texts that a smaller id has
    too, anywhere in the table and removed or not. One row per part, ``filter_order`` (all 120) and ``step``:
    ``kept`` after it, ``removed`` by it, ``redundant`` (failing it, removed before),
    ``unique_fails`` (failing it alone), ``good_lost`` and ``toxic_lost`` (removed by it, labelled quality or toxic 1)
    and ``shapley`` (its removals summed over all orders). ``labels`` has ``doc_id``, ``quality``, ``toxic``.

    Documents are counted by the set of filters that they fail, so each of the 32 coalitions' removals is a sum of
    32 counts. Steps are differences of coalitions; the Shapley value is the potential of all filters less the one
    without that filter.

    A null text is the empty one, a null part the empty string. A row without an id neither is a copy nor has one,
    and meets no label. Rows of one id and text are no copies of each other and count each. Of several
    labels of one id any 1 counts; null labels are none. Other columns are not read. An empty table gives an empty table.
    A part's row holds 97 numbers, whatever its size; copies are counted before they are shuffled.
    """
    small_batches(docs.sparkSession)
    letters = [*CONDITIONS, COPIES]
    n = len(letters)
    everything = (1 << n) - 1
    orders = list(permutations(range(n)))
    before = [sum(1 << i for i in order[:at]) for order in orders for at in range(n)]
    letter = [i for order in orders for i in order]
    game = coalitions(failing(docs, labels, text, doc_id, part), n).withColumn("potential", potentials(F.col("docs"), n))
    game = materialize(game, "audit-game")
    steps = game.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(before) - 1))).alias("place"))
    own = F.get(F.lit([1 << i for i in letter]), F.col("place"))
    steps = steps.withColumns({"before": F.get(F.lit(before), F.col("place")), "own": own})

    def lost(name: str) -> Column:
        return F.get(name, F.col("before") + F.col("own")) - F.get(name, F.col("before"))

    return steps.select(
        "part",
        F.get(F.lit(["".join(letters[i] for i in order) for order in orders]), F.floor(F.col("place") / n).cast("int")).alias("filter_order"),
        (F.col("place") % n + 1).alias("step"),
        (F.col("total") - F.get("docs", F.col("before") + F.col("own"))).alias("kept"),
        lost("docs").alias("removed"),
        (F.get("docs", "own") - lost("docs")).alias("redundant"),
        (F.get("docs", F.lit(everything)) - F.get("docs", F.lit(everything) - F.col("own"))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(everything)) - F.get("potential", F.lit(everything) - F.col("own"))).alias("shapley"),
    )
