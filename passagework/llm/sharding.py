"""Shards of near equal bytes by longest-processing-time scheduling."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import fresh, numbered, without
from passagework.operators.common import materialize

CLASSES_PER_OCTAVE = 32


def _spread(loads: list[float], count: int, each: float) -> list[int]:
    """Longest-processing-time result for ``count`` groups of one size, without a loop over them.

    Raises the least loaded shards to one level in whole groups; the few left over go
    through the heap.
    """
    order = sorted(range(len(loads)), key=lambda s: (loads[s], s))
    level, used = loads[order[0]], 0.0
    for k, shard in enumerate(order):  # highest level that count groups can pay for
        room = count * each - used
        nxt = loads[order[k + 1]] if k + 1 < len(order) else math.inf
        if (nxt - level) * (k + 1) >= room:
            level += room / (k + 1)
            break
        used += (nxt - level) * (k + 1)
        level = nxt
    taken = [max(0, math.floor((level - load) / each)) for load in loads]
    while sum(taken) > count:  # rounding of the level
        taken[taken.index(max(taken))] -= 1
    heap = [(load + t * each, s) for s, (load, t) in enumerate(zip(loads, taken))]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, s = heapq.heappop(heap)
        taken[s] += 1
        heapq.heappush(heap, (load + each, s))
    return taken


def plan_groups(groups: DataFrame, shards: int, exact_groups: int) -> DataFrame:
    """Shard of each group: ``groups`` (``group``, ``bytes``) with a column ``shard``.

    Groups of at least ``total / exact_groups`` bytes, of which there can be no more than
    ``exact_groups``, are sorted by size on the driver and go one by one to the least
    loaded shard through a heap. All smaller groups go through the same heap by size
    class (2 % wide, at most 64 x 32 classes): a class deals its groups, largest class
    first, and the groups find their shard by their number within the class.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    cut = total / exact_groups
    size_class = F.floor(F.log2(F.col("bytes").cast("double")) * CLASSES_PER_OCTAVE).cast("int")
    small = groups.filter(F.col("bytes") < cut).withColumn("class", size_class)
    big = groups.filter(F.col("bytes") >= cut).orderBy(F.desc("bytes"), "group").toPandas()
    heap = [(0, s) for s in range(shards)]
    where = []
    for size in big["bytes"]:
        load, s = heapq.heappop(heap)
        where.append(s)
        heapq.heappush(heap, (load + int(size), s))
    loads = [0.0] * shards
    for load, s in heap:
        loads[s] = float(load)
    ends = []
    for row in sorted(small.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect(), key=lambda r: -r["class"]):
        taken, each = _spread(loads, row["n"], row["b"] / row["n"]), row["b"] / row["n"]
        loads = [load + t * each for load, t in zip(loads, taken)]
        so_far, bounds = 0, []
        for t in taken[:-1]:
            so_far += t
            bounds.append(so_far)
        ends.append((row["class"], bounds))
    placed = spark.createDataFrame([(g, s) for g, s in zip(big["group"], where)], "group string, shard int")
    limits = spark.createDataFrame(ends, "class int, bounds array<long>")
    ranked = numbered(small.withColumn("cell", F.substring("group", 2, 3)), ["class"], "cell", [F.col("group")], "place")
    dealt = ranked.join(F.broadcast(limits), "class").select("group", F.size(F.filter("bounds", lambda b: b <= F.col("place"))).alias("shard"))
    return placed.unionByName(dealt)


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", exact_groups: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """Add ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``bytes``: the shards' sizes are near equal. Rows of one text stay
    together; a group larger than a shard's share keeps its shard to itself. ``slot``
    numbers the rows of a shard from 0 without gaps. ``grown_shard`` is null, since
    another shard would move groups.

    Null texts have size 1 and checksum 0 and are a group apart from the empty text.
    Repeated rows and repeated or null ids get slots of their own. An empty table gives
    an empty table. Columns with one of the added names, in upper or
    lower case, are replaced. ``keep`` names the
    input columns to return (all); without the text, no text is written or shuffled.
    """
    group, cell = fresh(docs, "_group", "_cell")
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = without(docs if keep is None else docs.select(*keep), added)
    body = F.col(text)
    rows = materialize(
        docs.select(
            *kept,
            (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(body.isNull(), "n").otherwise(F.concat(F.lit("t"), F.sha2(body.cast("binary"), 256))).alias(group),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy(F.col(group).alias("group")).agg(F.sum("size").alias("bytes")), "shard-groups")
    plan = plan_groups(groups, shards, exact_groups).withColumnRenamed("group", group)
    spread = F.pmod(F.xxhash64(F.col(doc_id), F.col(group)), F.lit(4096))
    where = materialize(rows.join(plan, group).withColumn(cell, spread), "shard-placed")
    out = numbered(where, ["shard"], cell, [F.col(doc_id), F.col(group)], "slot")
    return out.select(*kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
