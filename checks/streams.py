"""Incremental ingest replayed from a table, and snippets of ranked hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators.common import scratch_dir
from passagework.operators.index import build_index
from passagework.operators.lexical import fragments, highlight_html, keyword_search
from passagework.streaming.ingest import ingest_stream, read_table as read_stream_table

from .base import benchmark_queries, document_passages, query
from .ranking import TEXT_ONLY


_DAY = "(epoch_us(ts) // 86400000000)::INT"


@query(
    "stream_upsert",
    f"""WITH e AS (SELECT user_id::VARCHAR AS asset_id, {_DAY} AS chunk_index, event_type, value, ts, event_id, (SELECT max({_DAY}) FROM events) - user_id % 4 AS n_chunks FROM events)
SELECT asset_id, chunk_index, arg_max(event_type, (ts, event_id)) AS text, arg_max(value, (ts, event_id)) AS value FROM e
WHERE chunk_index < n_chunks GROUP BY ALL""",
)
def stream_upsert(spark, sf):
    """Events in seven batches, newest first, so that assets are split and rows come late; then trimmed."""
    import uuid

    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("int")
    last = events.agg(F.max(day)).first()[0]
    for part in range(7):  # one file each, in the order of their names and times
        some = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(7)) == part).orderBy(F.desc("ts")).coalesce(1)
        some.write.mode("append").parquet(f"{root}/landed")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")

    def prepare(df):
        return df.select(
            F.col("user_id").cast("string").alias("asset_id"), day.alias("chunk_index"),
            F.col("event_type").alias("text"), "value", "ts", "event_id", (F.lit(last) - F.col("user_id") % 4).cast("int").alias("n_chunks"),
        )

    stream = ingest_stream(
        source, f"{root}/table", f"{root}/progress", ["asset_id"], order=["ts", "event_id"], prepare=prepare, buckets=16, ends="n_chunks"
    )
    stream.awaitTermination()
    shape = prepare(spark.createDataFrame([], events.schema)).schema
    return read_stream_table(spark, f"{root}/table", shape).select("asset_id", "chunk_index", "text", "value")


@query("snippets")
def snippets(spark, sf):
    passages = document_passages(spark, sf)
    queries = benchmark_queries(spark, sf)
    ranked = keyword_search(queries, build_index(passages, TEXT_ONLY), 10, TEXT_ONLY)
    from passagework.operators.common import join_sized, materialize
    from passagework.operators.index import analyze

    asked = materialize(queries.select("query_id", analyze(F.col("q"), "english").alias("terms")), "query-stems")
    hits = join_sized(passages, materialize(ranked, "ranked").join(asked, "query_id"), ["passage_id"])
    marked = fragments(F.col("text"), F.col("terms"), "english")
    return hits.select("query_id", "passage_id", highlight_html(marked, F.col("text")).alias("snippet_html"))
