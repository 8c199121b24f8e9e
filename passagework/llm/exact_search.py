"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.vectors import clean_vectors, search_in_blocks
from passagework.operators.common import materialize

WINDOW_ROWS = 65_536


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; exact, beyond 2**53 by Python integers."""
    most = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    return np.array([[float(sum(int(x) * int(y) for x, y in zip(r, c))) for c in b] for r in a]).reshape(len(a), len(b))


def gaps(rows: np.ndarray, pivots: np.ndarray, square: float, lift: bool) -> np.ndarray:
    """Distances from rows to pivots in the space where nearest means largest inner product.

    Every indexed vector gets one more component, sqrt(square - |x|^2), a query gets 0;
    then all indexed vectors have the same length and |x - q|^2 = square + |q|^2 - 2 x.q.
    """
    own, theirs = (rows**2).sum(1), (pivots**2).sum(1)
    extra = np.sqrt(np.maximum(square - own, 0)) if lift else np.zeros(len(rows))
    cross = rows @ pivots.T + np.outer(extra, np.sqrt(np.maximum(square - theirs, 0)))
    return np.sqrt(np.maximum((own + extra**2)[:, None] + square - 2 * cross, 0))


def build_index(vectors: DataFrame, pivots: np.ndarray, square: float) -> DataFrame:
    """Vectors keyed by nearest pivot and distance: ``pivot, gap, vec_id, vec``, sorted.

    The table is partitioned by range of (pivot, gap, id), so a pivot with a third of all
    vectors, or a vector that occurs as often, is spread over many partitions.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def key(batches):
        for batch in batches:
            if batch.num_rows:
                far = gaps(matrix(batch.column(1)), shared.value, square, lift=True)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near]), *batch.columns], ["pivot", "gap", "vec_id", "vec"]
                )

    keyed = materialize(vectors.select("vec_id", "vec").mapInArrow(key, "pivot int, gap double, vec_id long, vec array<double>"), "pivot-keys")
    parts = max(spark.sparkContext.defaultParallelism, -(-keyed.count() // WINDOW_ROWS))
    return materialize(keyed.repartitionByRange(parts, "pivot", "gap", "vec_id").sortWithinPartitions("pivot", "gap", "vec_id"), "pivot-index")


class Block:
    """Best scores of a block of queries while annuli are read."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, pivot_ids: np.ndarray, square: float, k: int, annulus: int):
        self.ids, self.rows, self.k, self.annulus, self.square = ids, rows, k, annulus, square
        self.norms = (rows**2).sum(1)
        self.gap = gaps(rows, pivots, square, lift=False)
        known = dots(rows, pivots)
        known[ids[:, None] == pivot_ids[None, :]] = -np.inf
        # pivots are candidates too: their k-th best score is a lower bound from the start
        self.least = np.sort(known, 1)[:, -k] if len(pivot_ids) > k else np.full(len(ids), -np.inf)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def reach(self) -> np.ndarray:
        """Distance beyond which no vector can enter a query's list, with room for rounding."""
        square = np.maximum(self.square + self.norms - 2 * self.least, 0)
        return np.sqrt(square) * (1 + 1e-9) + 1e-6

    def read(self, pivot: np.ndarray, gap: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Take in rows sorted by (pivot, gap): annuli in the order of their lower bounds."""
        turns = np.flatnonzero(np.diff(pivot)) + 1
        starts = np.concatenate([np.arange(a, b, self.annulus) for a, b in zip(np.r_[0, turns], np.r_[turns, len(pivot)])])
        ends = np.r_[starts[1:], len(pivot)]
        at = self.gap[:, pivot[starts]]
        bound = np.maximum(np.maximum(at - gap[ends - 1], gap[starts] - at), 0)
        order = np.argsort(bound, axis=1, kind="stable")
        open_rows = np.arange(len(self.ids))
        for turn in range(len(starts)):
            ring = order[open_rows, turn]
            open_rows = open_rows[bound[open_rows, ring] <= self.reach()[open_rows]]  # bounds only rise: others stop
            if not len(open_rows):
                return
            ring = order[open_rows, turn]
            for one in np.unique(ring):
                self.take(open_rows[ring == one], ids[starts[one] : ends[one]], vecs[starts[one] : ends[one]])

    def take(self, rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        scores = dots(self.rows[rows], vecs)
        scores[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        rising = (scores >= self.least[rows][:, None]).any(1)
        rows, scores = rows[rising], scores[rising]
        if not len(rows):
            return
        scores = np.concatenate((self.scores[rows], scores), 1)
        found = np.concatenate((self.found[rows], np.broadcast_to(ids, (len(rows), len(ids)))), 1)
        best = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, best, 1)
        self.found[rows] = np.take_along_axis(found, best, 1)
        self.least[rows] = np.maximum(self.least[rows], self.scores[rows, -1])


def exact_top_k(
    vectors: DataFrame, queries: Column, k: int = 5, value=lambda x: x, vec_id: str = "vec_id", embedding: str = "embedding",
    pivots: int = 64, annulus: int = 256, block_rows: int = 8192,
) -> DataFrame:
    """Each query's ``k`` largest inner products: ``query_id, rank, vec_id, score`` (long).

    Queries are the rows for which ``queries`` (over ``vec_id``) holds; candidates are all
    rows but the query's own. Components are doubles through ``value``, which must give
    whole numbers. The index keys every vector by its nearest of ``pivots`` pivots (those
    first by hash of the id) and its distance. A task reads its sorted part and expands
    annuli of ``annulus`` vectors in the order of their distance bound, query by query,
    until the triangle inequality shows that no vector of the rest can enter; ties stay in.

    Ties go to the smaller id. Fewer candidates give fewer rows. Which vectors take no
    part is said in ``clean_vectors``; an empty table, or no query, gives an empty table.
    Other columns are not read. Work and memory: an index part of at most 65,536 rows and
    one block of queries in a task, whatever the number of rows or of equal vectors.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score long"
    clean = clean_vectors(vectors, vec_id, embedding, value)
    picked = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], schema)
    centres, centre_ids = np.array(picked["vec"].to_pylist()), np.array(picked["vec_id"].to_pylist())
    square = float(clean.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    index = build_index(clean, centres, square)

    def answer(ids: list[int], vecs: list[list[float]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(vecs, float), centres, centre_ids))

        def run(batches):
            block, held, rows = Block(*shared.value, square, k, annulus), [], 0

            def read():
                part = pa.Table.from_batches(held).combine_chunks()
                cols = [part[c].combine_chunks() if part[c].num_chunks != 1 else part[c].chunk(0) for c in ("pivot", "gap", "vec_id", "vec")]
                block.read(*[c.to_numpy(zero_copy_only=False) for c in cols[:3]], matrix(cols[3]))

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    rows += batch.num_rows
                if rows >= WINDOW_ROWS:
                    read()
                    held, rows = [], 0
            if rows:
                read()
            has = np.isfinite(block.scores)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(block.ids[:, None], has.shape)[has]), pa.array(block.found[has]), pa.array(block.scores[has].astype(np.int64))],
                ["query_id", "vec_id", "score"],
            )

        return index.mapInArrow(run, "query_id long, vec_id long, score long")

    return search_in_blocks(clean.filter(queries), block_rows, answer, k, schema)
