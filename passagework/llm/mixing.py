"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagework.llm.common import fresh, numbered, without, words_of
from passagework.operators.common import join_sized, materialize


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Target of each source: columns ``source``, ``source_size`` and ``target``.

    ``sizes`` has one row per source (``source``, ``source_size``). Sources in code-point
    order, null last, take the weights in turn. Together they get ``share`` of all sizes;
    no target exceeds ``cap`` times its source, and what is above is dealt again by weight.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last())
    schema = "source string, source_size long, place long"
    placed = spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], x[1])), schema)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(
        placed.select("source", "source_size", F.get(turn, (F.col("place") % len(weights)).cast("int")).alias("weight")), "mix-sources"
    )
    limit, given = F.col("source_size") * cap, F.col("weight")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, open_weight = 0.0, None
    while True:  # each round closes at least one source; the driver sees two sums
        full = (given * level > limit) if open_weight is not None else F.lit(False)
        seen = table.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(given))).first()
        closed, rest = seen[0] or 0.0, seen[1] or 0.0
        if rest == 0 or rest == open_weight:
            break
        level, open_weight = (total * share - closed) / rest, rest
    return table.select("source", "source_size", F.least(given * level, limit).alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    offset: float = 0.37,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` to every document.

    A document's expected copies are target / source_size, the same for all of a source.
    Their prefix sums run over the source's documents ordered by size, so that every size
    is drawn at the same rate and the words taken differ from the target by little more
    than the largest document. ``offset`` is the random start in [0, 1); a document is
    emitted once per integer that its stretch of the prefix sum crosses, ``cap`` times
    at most.

    A null source is a source of its own. Null texts have size 0 and are drawn like
    others. Repeated rows count as often as they occur; ties in size go by md5 of the id.
    An empty table gives an empty table. Columns that have one of the added names are
    replaced, in upper or lower case. A source's rows are numbered by size and by 4,096 cells within a size, so a
    hot source, or a hot size, is never in one task.
    """
    size = words_of(F.col("text")) if size is None else size
    key, mark, cell, place, start, n = fresh(docs, "_source", "_mark", "_cell", "_place", "_start", "_n")
    kept = without(docs, ("size", "source_size", "target", "copies"))
    named = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    rows = materialize(
        docs.select(*kept, size.alias("size"), named.alias(key), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias(mark)), "mix-rows"
    ).withColumn(cell, F.substring(mark, 1, 3))
    by_size = rows.groupBy(key, "size").agg(F.count("*").alias(n))
    sizes = by_size.groupBy(key).agg(F.sum(F.col("size") * F.col(n)).alias("source_size"))
    plain = F.when(F.col(key) != "n", F.expr(f"substring(`{key}`, 2)"))
    targets = source_targets(sizes.select(plain.alias("source"), "source_size"), weights, share, cap).select(
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias(key), "source_size", "target"
    )
    before = W.partitionBy(key).orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    starts = by_size.select(key, "size", F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start)).join(targets, key)
    # one row per source and size: small beside the documents, so these are not dealt out again
    out = join_sized(numbered(rows, [key, "size"], cell, [F.col(mark), F.col(doc_id)], place), materialize(starts, "mix-starts"), [key, "size"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col(start) + F.col(place)
    copies = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    return out.select(*kept, "size", "source_size", "target", copies.cast("long").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies."""
    return mixed.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
