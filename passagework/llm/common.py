"""Names, positions and labels shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagework.operators.common import materialize

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names) -> list[str]:
    """Columns of ``df`` but those called one of ``names``, in upper or lower case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows, if they may hold more now.

    Whole texts go through them, in every task at once; Spark's own bound is ten times as
    many rows. The setting stays, as plans made here run later.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def words_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, keys: list[str], cell: str, order: list[Column], name: str) -> DataFrame:
    """Gapless position from 0 of every row within its key, ordered by ``cell``, then ``order``.

    Counts by (key, cell) give each cell its first position, so a key that holds most
    rows is numbered by as many tasks as it has cells. Keys and cells must not be null.
    ``df`` is read twice and should be a table.
    """
    n, first = fresh(df, "_cell_rows", "_cell_first")
    before = W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*keys, cell).agg(F.count("*").alias(n))
    firsts = counts.select(*keys, cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = F.row_number().over(W.partitionBy(*keys, cell).orderBy(*order))
    ranked = df.withColumn(name, within.cast("long"))
    return ranked.join(firsts, [*keys, cell]).withColumn(name, F.col(name) + F.col(first) - 1).drop(first)


def most_frequent(df: DataFrame, n: str, limit: int, key: str | None = None) -> DataFrame:
    """Rows with the largest counts ``n``, at most ``limit`` (for each value of ``key``).

    A histogram of the counts, 16 classes to a doubling, says from which class on all rows
    still fit; the rows are then filtered where they lie, and nothing is sorted or gathered.
    The driver sees a thousand classes at most for each key. ``df`` should be a table.
    """
    (size,) = fresh(df, "_class")
    classed = df.withColumn(size, F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int"))
    keys = [key] if key else []
    least: dict = {}
    held: dict = {}
    for row in sorted(classed.groupBy(*keys, size).count().collect(), key=lambda r: -r[size]):
        owner = row[key] if key else None
        held[owner] = held.get(owner, 0) + row["count"]
        if held[owner] <= limit:
            least[owner] = row[size]
    keep = F.lit(False)
    for owner, start in sorted(least.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(key) == owner if key else F.lit(True)) & (F.col(size) >= start))
    return classed.filter(keep).drop(size)


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "component") -> DataFrame:
    """Smallest id reachable over ``links``: columns ``id`` and ``label``.

    Distributed union-find: in each round every node takes the smallest root among its own
    and its neighbours' (hooking), then follows its root's root (path halving). Rounds are
    written to the shared folder, so lineage stays short; ids in no link are not returned.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    roots = materialize(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("root")), "roots")
    while True:
        seen = edges.join(roots, edges["v"] == roots["id"]).groupBy("u").agg(F.min("root").alias("other"))
        hooked = roots.join(seen, roots["id"] == seen["u"]).select("id", F.least("root", "other").alias("root"), F.col("root").alias("was"))
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        halved = hooked.join(up, "root").select("id", F.least("root", "above").alias("root"), "was")
        done = materialize(halved, "roots")
        moved = done.filter("root < was").limit(1).count()
        roots = done.select("id", "root")
        if not moved:
            return roots.withColumnRenamed("root", label)
