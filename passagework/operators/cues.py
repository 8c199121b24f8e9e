"""Pack timed cues into passages, also when one asset holds most of the cues.

Packing is sequential: whether a cue opens a passage depends on the passage before it.
Cue numbers are dense inside an asset, so cues fall into blocks of ``block`` numbers. A
block needs only one thing from the blocks before it: how many characters the open
passage holds. Every block is therefore summed up as a table from that length to the
length it leaves behind and the passages it opens; tables of neighbouring blocks compose.
All lengths at which the same cue is the first not to fit share a row of a table, so it has
about as many rows as cues, and never more than lengths. Composition runs level by level
over ``fan`` blocks at a time, up to one table per asset and down again with the known
start; an asset leaves at the level where its blocks are one group. No row ever holds more
than ``block`` cues or ``fan`` tables. Only cue lengths travel through this; the texts are shuffled once, by
(asset, passage), and a passage is bounded by ``max_chars`` or one cue.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.packing import CHUNK_CHARS
from ..functions.text import strip
from .common import join_sized, materialize

BLOCK = 4096
FAN = 1024


def pack_cues(
    cues: DataFrame,
    keys: list[str],
    max_chars: int = CHUNK_CHARS,
    order: str = "ord",
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """``keys, chunk_index, text, start_ms, end_ms, n_cues`` from cues numbered per asset.

    ``order`` numbers the cues of an asset; gaps, repeated numbers (then in the order of
    their times and texts) and nulls (first) are allowed, and so are null keys. Blank cues
    are dropped; one cue longer than ``max_chars`` stays whole.
    """
    placed = _placed(cues, keys, order, block)
    last = placed.agg(F.max("_ord").alias("n")).first()["n"] or 0
    names = placed.groupBy("_key").agg(*[F.first(k, ignorenulls=True).alias(k) for k in keys])
    if last < block:
        packed = _pack_short(placed, ["_key"], max_chars)
    else:
        packed = _pack_blocks(placed, ["_key"], max_chars, block, fan, last)
    return packed.join(names, "_key").select(*keys, "chunk_index", "text", "start_ms", "end_ms", "n_cues")


def _placed(cues: DataFrame, keys: list[str], order: str, block: int) -> DataFrame:
    """Cues with text under one never-null ``_key``, numbered densely from 0 (``_ord``).

    Numbers are given inside ranges of ``block`` order values, and each range starts where
    the counts of the ones before it end, so no task sorts a whole asset.
    """
    parts = [F.when(F.col(k).isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string"))) for k in keys]
    rows = cues.select(
        F.concat(*parts).alias("_key"), *keys, F.col(order).cast("long").alias("_at"), strip(F.col("text")).alias("text"), "start_ms", "end_ms"
    ).filter("text <> ''").withColumn("_cell", F.coalesce(F.floor(F.col("_at") / block), F.lit(-(2**62))))
    before = W.partitionBy("_key").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("_key", "_cell").agg(F.count("*").alias("_n")).select(
        "_key", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    within = F.row_number().over(W.partitionBy("_key", "_cell").orderBy("_at", "start_ms", "end_ms", "text"))
    numbered = rows.withColumn("_row", within).join(starts, ["_key", "_cell"])
    dense = numbered.withColumn("_ord", (F.col("_first") + F.col("_row") - 1).cast("long"))
    table = dense.select("_key", *keys, "_ord", "text", "start_ms", "end_ms", F.floor((F.col("_first") + F.col("_row") - 1) / block).alias("_block"))
    return materialize(table, "cues")


def _pack_blocks(placed: DataFrame, keys: list[str], max_chars: int, block: int, fan: int, last: int) -> DataFrame:
    """Assets of more than one block: tables of blocks, composed, then one group per passage."""
    lengths = placed.groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.struct("_ord", F.length("text").alias("n")))).alias("cues")
    )
    entries = _entries(lengths, keys, max_chars, last // block + 1, fan)
    numbered = lengths.join(entries, [*keys, "_block"]).select(*keys, F.inline(_numbers(max_chars)))
    return (
        placed.join(numbered, [*keys, "_ord"])
        .groupBy(*keys, "chunk_index")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_ord", "text"))), lambda c: c["text"]), " "
            ).alias("text"),
            F.min_by("start_ms", "_ord").alias("start_ms"),
            F.max_by("end_ms", "_ord").alias("end_ms"),
            F.count("*").cast("int").alias("n_cues"),
        )
    )


def _pack_short(placed: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """All cues of an asset fit one block: one shuffle, one fold."""
    cues = F.array_sort(F.collect_list(F.struct("_ord", "text", "start_ms", "end_ms")))
    piece = "struct<text:string,start_ms:bigint,end_ms:bigint,n_cues:int>"
    zero = F.struct(
        F.lit(None).cast(piece).alias("open"), F.array().cast(f"array<{piece}>").alias("done")
    )

    def add(s: Column, cue: Column) -> Column:
        now = s["open"]
        fits = F.length(now["text"]) + 1 + F.length(cue["text"]) <= max_chars

        def one(text: Column, start: Column, n: Column) -> Column:
            return F.struct(
                text.alias("text"), start.cast("long").alias("start_ms"),
                cue["end_ms"].cast("long").alias("end_ms"), n.alias("n_cues"),
            )

        fresh = one(cue["text"], cue["start_ms"], F.lit(1))
        longer = one(F.concat(now["text"], F.lit(" "), cue["text"]), now["start_ms"], now["n_cues"] + 1)
        return (
            F.when(now.isNull(), F.struct(fresh.alias("open"), s["done"].alias("done")))
            .when(fits, F.struct(longer.alias("open"), s["done"].alias("done")))
            .otherwise(F.struct(fresh.alias("open"), F.array_append(s["done"], now).alias("done")))
        )

    packed = F.aggregate("cues", zero, add, lambda s: F.array_append(s["done"], s["open"]))
    return (
        placed.groupBy(*keys)
        .agg(cues.alias("cues"))
        .select(*keys, F.posexplode(packed).alias("chunk_index", "p"))
        .select(*keys, "chunk_index", "p.*")
    )


def _numbers(max_chars: int) -> Column:
    """Passage number of every cue of a block, from the length held open before it."""
    zero = F.struct(
        F.col("held").cast("int").alias("held"),
        F.col("before").cast("long").alias("opened"),
        F.array().cast("array<struct<_ord:bigint,chunk_index:int>>").alias("out"),
    )

    def add(s: Column, cue: Column) -> Column:
        fits = (s["held"] > 0) & (s["held"] + 1 + cue["n"] <= max_chars)
        opened = s["opened"] + F.when(fits, 0).otherwise(1)
        number = F.struct(cue["_ord"].alias("_ord"), (opened - 1).cast("int").alias("chunk_index"))
        return F.struct(
            F.when(fits, s["held"] + 1 + cue["n"]).otherwise(cue["n"]).cast("int").alias("held"),
            opened.alias("opened"),
            F.array_append(s["out"], number).alias("out"),
        )

    return F.aggregate("cues", zero, add, lambda s: s["out"])


class Table(NamedTuple):
    """For every length held open before some cues: the length after them, and passages opened.

    Row i holds from length ``starts[i]`` up to the next start. If it opens no passage,
    the length grows by ``leaves[i]``, otherwise it becomes ``leaves[i]``.
    """

    starts: list[int]
    leaves: list[int]
    opens: list[int]

    def add(self, start: int, leaves: int, opens: int) -> None:
        if not (self.starts and self.leaves[-1] == leaves and self.opens[-1] == opens):
            self.starts.append(start)
            self.leaves.append(leaves)
            self.opens.append(opens)

    def after(self, held: int) -> tuple[int, int]:
        i = bisect_right(self.starts, held) - 1
        return self.leaves[i] + (0 if self.opens[i] else held), self.opens[i]


def _table_of(lengths: Sequence[int], cap: int) -> Table:
    """Cues of the given lengths as a table; a length over ``cap`` counts as ``cap + 1``."""
    n, sums, table = len(lengths), [0], Table([], [], [])
    for x in lengths:
        sums.append(sums[-1] + 1 + x)
    if not n:
        table.add(0, 0, 0)
        return table
    # from each cue that opens a passage: what the last cue leaves, and passages opened
    leaves, opens = [0] * n, [1] * n
    for i in range(n - 1, -1, -1):
        late = bisect_right(sums, cap - lengths[i] + sums[i + 1], i + 2) - 1
        if late < n:
            leaves[i], opens[i] = leaves[late], opens[late] + 1
        else:
            leaves[i] = min(lengths[i], cap + 1) + sums[n] - sums[i + 1]
    table.add(0, leaves[0], opens[0])
    if sums[n] < cap:
        table.add(1, sums[n], 0)
    for i in range(max(0, min(n, bisect_left(sums, cap)) - 1), -1, -1):
        table.add(max(1, cap - sums[i + 1] + 1), leaves[i], opens[i])
    return table


def _composed(first: Table, then: Table) -> Table:
    """The table of two neighbouring runs of cues."""
    table = Table([], [], [])
    for i, (start, leaves, opens) in enumerate(zip(*first)):
        if opens:
            left, opened = then.after(leaves)
            table.add(start, left, opens + opened)
            continue
        end = first.starts[i + 1] + leaves if i + 1 < len(first.starts) else None
        for k in range(bisect_right(then.starts, start + leaves) - 1, len(then.starts)):
            if end is not None and then.starts[k] >= end:
                break
            table.add(max(start, then.starts[k] - leaves), then.leaves[k] + (0 if then.opens[k] else leaves), then.opens[k])
    return table


_TABLE = "struct<starts:array<int>,leaves:array<int>,opens:array<bigint>>"
_ENTRIES = "array<struct<_block:bigint,held:int,before:bigint>>"


def _as_arrow(tables: list[Table]) -> pa.Array:
    types = {"starts": pa.list_(pa.int32()), "leaves": pa.list_(pa.int32()), "opens": pa.list_(pa.int64())}
    return pa.StructArray.from_arrays([pa.array([t[k] for t in tables], kind) for k, kind in enumerate(types.values())], list(types))


def _groups(tables: pa.Array) -> Iterator[list[tuple[int, Table]]]:
    """The numbered tables of each row."""
    rows = zip(*[column.to_pylist() for column in tables.flatten().flatten()])
    for n in pc.list_value_length(tables).to_pylist():
        yield [(number, Table(*table)) for number, *table in (next(rows) for _ in range(n))]


def _entries(lengths: DataFrame, keys: list[str], cap: int, n_blocks: int, fan: int) -> DataFrame:
    """``keys, _block, held, before``: what every block finds open, and passages before it."""

    @F.arrow_udf(_TABLE)
    def table(counts: pa.Array) -> pa.Array:
        return _as_arrow([_table_of(c, cap) for c in counts.to_pylist()])

    @F.arrow_udf(_TABLE)
    def compose(tables: pa.Array) -> pa.Array:
        out = []
        for group in _groups(tables):
            whole = group[0][1]
            for _, then in group[1:]:
                whole = _composed(whole, then)
            out.append(whole)
        return _as_arrow(out)

    @F.arrow_udf(_ENTRIES)
    def descend(tables: pa.Array, held: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for group, now, opened in zip(_groups(tables), held.to_pylist(), before.to_pylist()):
            found = []
            for number, then in group:
                found.append({"_block": number, "held": now, "before": opened})
                now, more = then.after(now)
                opened += more
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("_block", pa.int64()), ("held", pa.int32()), ("before", pa.int64())])))

    def grouped(level: DataFrame) -> DataFrame:
        each = F.array_sort(F.collect_list(F.struct("_block", "t.starts", "t.leaves", "t.opens")))
        return materialize(level.groupBy(*keys, F.floor(F.col("_block") / fan).alias("_up")).agg(each.alias("tables")), "cue-tables")

    levels = [grouped(lengths.select(*keys, "_block", table(F.transform("cues", lambda c: c["n"])).alias("t")))]
    while n_blocks > fan:
        n_blocks = -(-n_blocks // fan)
        several = levels[-1].filter("_up > 0").select(*keys).distinct()
        rising = join_sized(levels[-1], several, keys, "left_semi")
        levels.append(grouped(rising.select(*keys, F.col("_up").alias("_block"), compose("tables").alias("t"))))
    entries = None
    for level in reversed(levels):
        # the first group of an asset that did not rise starts with nothing
        rows = level.withColumns({"held": F.lit(None).cast("int"), "before": F.lit(None).cast("long")})
        if entries is not None:
            rows = level.join(entries.withColumnRenamed("_block", "_up"), [*keys, "_up"], "left")
        found = descend("tables", F.coalesce("held", F.lit(0)), F.coalesce("before", F.lit(0).cast("long")))
        entries = rows.select(*keys, F.inline(found))
    return entries
