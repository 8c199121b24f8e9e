"""What the vector searches share: clean vectors, query blocks, merged answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.common import materialize, scratch_dir, top_per


def clean_vectors(vectors: DataFrame, vec_id: str, embedding: str, value: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles, each through ``value``), one row per id.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite component,
    and vectors of another length than most (the longer one in a tie). Of several rows with
    one id the greatest vector counts.
    """
    vec = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    )
    rows = rows.filter(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    one = rows.groupBy("vec_id").agg(F.max("vec").alias("vec"))
    table = materialize(one.select("vec_id", F.transform("vec", value).alias("vec")), "vectors")
    usual = table.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return table.filter(F.size("vec") == usual["n"]) if usual else table


def search_in_blocks(queries: DataFrame, block_rows: int, answer: Callable[[list, object], DataFrame], limit: int, schema: str) -> DataFrame:
    """Answers to all queries (``vec_id``, ``vec``), block by block.

    Blocks of about ``block_rows`` queries are broadcast one after another; ``answer``
    scans the whole index for one block and returns (``query_id``, ``vec_id``, ``score``)
    rows, at most a few per query and task. The best ``limit`` of each query are written
    as ``query_id, rank, vec_id, score``, ties to the smaller ``vec_id``.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block_rows))
    asked = queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    path = f"{scratch_dir(spark)}/passagework-{spark.sparkContext.applicationId}/answers-{uuid.uuid4().hex}"
    for block in range(blocks):
        rows = asked.filter(F.col("_block") == block).select("vec_id", "vec").toArrow()
        if rows.num_rows:
            found = answer(rows["vec_id"].to_pylist(), rows["vec"].to_pylist())
            best = top_per(found, ["query_id"], [F.desc("score"), F.col("vec_id")], limit)
            best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if asked.limit(1).count() else spark.createDataFrame([], schema)
