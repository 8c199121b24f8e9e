"""Similarity ranking: term vectors from postings, and supplied dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_sized, materialize, top_per
from .index import Index, analyze
from .scoring import top_passages

QUERIES_PER_SCAN = 4096


def candidate_count(limit: int) -> int:
    """How many candidates an approximate search ranks exactly: never fewer than it returns."""
    return max(limit, min(max(10 * limit, 40), 10_000))


def term_vector_search(
    queries: DataFrame, index: Index, limit: int = 10, field: str = "text", analyzer: str = "english", filters: dict[str, object] | None = None
) -> DataFrame:
    """``query_id, passage_id, score, rank``: cosine of query and passage term vectors.

    Weights are ``1 + ln(tf)`` for passages and ``(1 + ln(tf)) * ln(1 + n / df)`` for
    queries (the lnc.ltc scheme), so passage norms need no corpus statistics and only the
    query's own terms are looked up.
    """
    counts = (
        queries.select("query_id", F.explode_outer(analyze(F.col("q"), analyzer)).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
    terms = index.vocabulary.filter(F.col("field") == field).select("term", "df", "field")
    stats = F.broadcast(index.stats)  # one row per searched field
    idf = F.log(1 + F.col("n_passages") / F.col("df"))
    weighted = (
        counts.join(terms, "term")
        .join(stats, "field")
        .select("query_id", "field", "term", "df", "avg_len", ((1 + F.log(F.col("qtf").cast("double"))) * idf).alias("weight"))
    )
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("query_id")))
    return top_passages(index, weighted.withColumn("weight", F.col("weight") / norm), limit, filters=filters)


def with_filters(vectors: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """Keep vectors whose filter columns equal the given values, before any scoring."""
    for column, value in (filters or {}).items():
        vectors = vectors.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return vectors


def _unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(array), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def knn_exact(
    queries: DataFrame,
    vectors: DataFrame,
    limit: int = 10,
    filters: dict[str, object] | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """``query_id, vec_id, score, rank``: exact cosine neighbours.

    ``queries`` has ``query_id, embedding`` and ``vectors`` has ``vec_id, embedding``. The
    vectors are read once per ``QUERIES_PER_SCAN`` queries; every Arrow batch is one matrix
    product and passes on only its own best rows per query, ties included.
    """
    source = with_filters(vectors, filters).select("vec_id", "embedding").filter(F.col("embedding").isNotNull())
    key_type = dict(source.dtypes)["vec_id"]
    id_type = dict(queries.dtypes)["query_id"]
    scans = max(1, -(-queries.count() // QUERIES_PER_SCAN))
    keep = limit + 1 if exclude_self else limit

    def scan(part: int) -> DataFrame:
        share = queries.select("query_id", "embedding").filter(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == part)
        table = share.toArrow()
        ids = table.column("query_id").to_pylist()
        if not ids:
            return None
        matrix = _unit_rows(table.column("embedding")).T

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                scores = np.round(_unit_rows(batch.column("embedding")) @ matrix, 6)
                n = scores.shape[0]
                floor = np.partition(scores, n - keep, axis=0)[n - keep] if n > keep else scores.min(axis=0)
                rows, cols = np.nonzero(scores >= floor)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[c] for c in cols]).cast(table.schema.field("query_id").type),
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array(scores[rows, cols]),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

        return source.mapInArrow(rank, f"query_id {id_type}, vec_id {key_type}, score double")

    parts = [p for p in (scan(i) for i in range(scans)) if p is not None]
    if not parts:
        return source.limit(0).select(
            F.lit(None).cast(id_type).alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")
        )
    scored = parts[0]
    for other in parts[1:]:
        scored = scored.unionByName(other)
    if exclude_self:
        scored = scored.filter(F.col("query_id") != F.col("vec_id"))
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("vec_id")], limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def band_keys(embedding: Column, dims: int, bands: int = 16, bits: int = 8, seed: int = 7) -> Column:
    """Bucket keys of a vector: ``bands`` groups of ``bits`` random-hyperplane signs."""
    planes = np.random.default_rng(seed).standard_normal((dims, bands * bits))
    powers = 1 << np.arange(bits)

    @F.arrow_udf("array<int>")
    def keys(vectors: pa.Array) -> pa.Array:
        signs = (_unit_rows(vectors) @ planes >= 0).reshape(-1, bands, bits)
        codes = (signs * powers).sum(axis=2) + (np.arange(bands) << bits)
        return pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))

    return keys(embedding)


def knn_approximate(
    queries: DataFrame, vectors: DataFrame, dims: int, limit: int = 10, filters: dict[str, object] | None = None,
    bands: int = 16, bits: int = 8,
) -> DataFrame:
    """``query_id, vec_id, score, rank``: nearest neighbours through shared buckets.

    The vectors sharing most bucket keys with a query are the candidates
    (:func:`candidate_count` of them, the over-fetch of the search); their cosine is then
    computed exactly. Queries that find fewer than ``limit`` rows are asked again with
    wider buckets (fewer bits), and what is still short is searched exactly, so every
    query gets ``limit`` rows if the table has them.
    """
    source = with_filters(vectors, filters).filter(F.col("embedding").isNotNull())
    found, rest = None, materialize(queries.select("query_id", "embedding"), "knn-queries")
    for width in sorted({bits, max(1, bits // 2), max(1, bits // 4)}, reverse=True):
        hits = materialize(_in_buckets(rest, source, dims, limit, bands, width), "knn-hits")
        full = hits.groupBy("query_id").count().filter(F.col("count") >= limit).select("query_id")
        done = hits.join(full, "query_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        rest = materialize(rest.join(full, "query_id", "left_anti"), "knn-queries")
        if rest.isEmpty():
            return found
    return found.unionByName(knn_exact(rest, source, limit).select(*found.columns))


def _in_buckets(queries: DataFrame, source: DataFrame, dims: int, limit: int, bands: int, bits: int) -> DataFrame:
    """Neighbours among vectors of a shared bucket.

    A bucket holding many copies is no hot spot: the query side is the one that is
    broadcast or split, and shared keys are counted map-side.
    """
    keys = lambda: F.explode(band_keys(F.col("embedding"), dims, bands, bits)).alias("band")
    asked = materialize(queries.select("query_id", keys()), "query-bands")
    shared = join_sized(source.select("vec_id", keys()), asked, ["band"]).groupBy("query_id", "vec_id").agg(F.count("*").alias("shared"))
    chosen = top_per(
        shared, ["query_id"], [F.col("shared").desc(), F.col("vec_id")], candidate_count(limit), "_n"
    ).select("query_id", "vec_id")
    scored = (
        source.select("vec_id", "embedding")
        .join(chosen, "vec_id")
        .join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")
        .select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("score"))
    )
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("vec_id")], limit)
