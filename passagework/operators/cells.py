"""Vectors stored by cell: cosine neighbours from the cells that can hold them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, top_per
from .vector import QUERIES_PER_SCAN, _unit_rows, with_filters

MAX_CELLS = 4096
SAMPLE = 100_000  # rows the centroids are fitted on; every vector is indexed
#: What rounding of angles and of scores (six digits) may hide.
SLACK = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: the vectors with their ``cell``, a table partitioned by it. ``cells``: ``cell, centroid, radius, n``.

    ``radius`` is the largest angle between the centroid and a vector of the cell.
    """

    rows: DataFrame
    cells: DataFrame


def build_vector_index(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
    """Deal ``vectors`` (``vec_id, embedding`` and filter columns) out to cells around centroids.

    Centroids are k-means centres of at most ``sample`` rows, by default as many as the
    root of the number of rows, ``MAX_CELLS`` at most. Rows without an embedding are left out; zero
    vectors have a cell of their own. The table is range-partitioned by cell
    and id, so a cell that holds most vectors is spread over many tasks and files.
    """
    source = vectors.filter(F.col("embedding").isNotNull())
    n = source.count()
    usable = source.filter(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull()))
    fit = usable.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    wanted = min(cells or max(1, int(np.sqrt(n))), MAX_CELLS)
    share = materialize(fit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample), "cell-sample")
    first = source.select(F.size("embedding")).first()
    centers = np.zeros((0, first[0] if first else 1))
    if not share.isEmpty():
        model = KMeans(k=max(2, wanted), seed=seed, maxIter=10, distanceMeasure="cosine").fit(share)
        centers = np.array(model.clusterCenters())
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    # the last cell is that of zero vectors, at a right angle to all others
    centers = np.concatenate([centers, np.zeros((1, centers.shape[1]))])

    @F.arrow_udf("struct<cell:int,angle:double>")
    def place(embedding: pa.Array) -> pa.Array:
        unit = _unit_rows(embedding) if len(embedding) else np.zeros((0, centers.shape[1]))
        near = unit @ centers.T
        near[:, -1] = -2
        zero = ~unit.any(axis=1)
        cell = np.where(zero, len(centers) - 1, near.argmax(axis=1)).astype(np.int32)
        angle = np.where(zero, 0.0, np.arccos(np.clip(near.max(axis=1), -1, 1)))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], names=["cell", "angle"])

    placed = source.withColumn("_at", place("embedding")).select(
        "*", F.col("_at.cell").alias("cell"), F.col("_at.angle").alias("angle")
    ).drop("_at")
    dealt = placed.repartitionByRange(F.col("cell"), F.col("vec_id")).sortWithinPartitions("cell", "vec_id")
    rows = materialize(dealt, "vector-cells", "cell")
    sizes = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    middle = source.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>")
    return VectorIndex(rows, materialize(sizes.join(F.broadcast(middle), "cell"), "cells"))


def search_vectors(
    queries: DataFrame, index: VectorIndex, limit: int = 10, filters: dict[str, object] | None = None,
    probes: int = 8, exact: bool = True,
) -> DataFrame:
    """``query_id, vec_id, score, rank``: cosine neighbours out of the index.

    A query reads its ``probes`` nearest cells first. With ``exact`` it then reads the cells
    that can still hold a better row: angles obey the triangle inequality, so no vector of a
    cell is nearer than the centroid's angle less the cell's radius. The result is that of
    ``knn_exact``. Without ``exact`` only queries that found fewer than ``limit`` rows go on.
    Only the asked cells' partitions are read; filters are pushed into that scan.
    """
    queries = materialize(queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull()), "vector-queries")
    source = with_filters(index.rows, filters)
    cells = index.cells.orderBy("cell").toArrow()
    numbers = cells.column("cell").to_numpy()
    id_type, key_type = dict(queries.dtypes)["query_id"], dict(source.dtypes)["vec_id"]
    none = source.limit(0).select(F.lit(None).cast(id_type).alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if not len(numbers):
        return none
    centers = np.array(cells.column("centroid").to_pylist())
    radii = cells.column("radius").to_numpy()
    scans = max(1, -(-queries.count() // QUERIES_PER_SCAN))
    found = None
    for part in range(scans):
        share = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == part).toArrow()
        if not share.num_rows:
            continue
        matrix = _unit_rows(share.column("embedding"))
        angles = np.arccos(np.clip(matrix @ centers.T, -1, 1))
        first = np.zeros(angles.shape, bool)
        np.put_along_axis(first, np.argsort(angles, axis=1, kind="stable")[:, :probes], True, axis=1)
        near = materialize(_ranked(source, share, matrix, numbers, first, limit, id_type, key_type), "near-cells")
        last = near.filter(F.col("rank") == limit).select("query_id", "score").toArrow()
        bar = dict(zip(last.column("query_id").to_pylist(), last.column("score").to_pylist()))
        worst = np.array([bar.get(q, -np.inf) for q in share.column("query_id").to_pylist()])[:, None]
        best = np.cos(np.maximum(angles - radii[None, :] - SLACK, 0)) + SLACK
        # a zero query scores 0 everywhere, whatever its angles say
        best[np.linalg.norm(matrix, axis=1) == 0] = SLACK
        more = ~first & ((best >= worst) if exact else np.isneginf(worst))
        if more.any():
            rest = _ranked(source, share, matrix, numbers, more, limit, id_type, key_type)
            both = near.drop("rank").unionByName(rest.drop("rank"))
            near = top_per(both, ["query_id"], [F.col("score").desc(), F.col("vec_id")], limit)
        found = near if found is None else found.unionByName(near)
    return none if found is None else found


def _ranked(
    source: DataFrame, share: pa.Table, matrix: np.ndarray, numbers: np.ndarray, wanted: np.ndarray, limit: int, id_type: str, key_type: str
) -> DataFrame:
    """The best rows of each query in its ``wanted`` cells; a batch passes on ``limit`` rows per query and cell."""
    asked = {int(cell): np.flatnonzero(wanted[:, i]) for i, cell in enumerate(numbers) if wanted[:, i].any()}
    ids = share.column("query_id").combine_chunks()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("cell").to_numpy()
            unit = _unit_rows(batch.column("embedding")) if batch.num_rows else None
            for cell in np.unique(at):
                rows, cols = np.flatnonzero(at == cell), asked[int(cell)]
                keys = batch.column("vec_id").take(pa.array(rows))
                # by id first, so that a stable sort by score leaves ties to the smaller id
                order = pc.sort_indices(keys).to_numpy()
                rows = rows[order]
                scores = np.round(unit[rows] @ matrix[cols].T, 6)
                top = np.argsort(-scores, axis=0, kind="stable")[:limit]
                kept = np.take_along_axis(scores, top, axis=0).T.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(cols, len(top)))),
                        batch.column("vec_id").take(pa.array(rows[top.T.ravel()])),
                        pa.array(kept),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    some = source.filter(F.col("cell").isin(*asked)).select("vec_id", "embedding", "cell")
    scored = some.mapInArrow(rank, f"query_id {id_type}, vec_id {key_type}, score double")
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("vec_id")], limit)
