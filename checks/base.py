"""Registry, shared inputs and shared SQL of the checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.packing import pack_prose
from passagework.functions.text import WS
from passagework.operators.schema import attrs, node, to_passages
from passagework.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


BLOG = "/company/blog/"
ORIGIN = "https://www.example.org"


def first_sentence(text):
    return F.regexp_extract(text, r"^[^.!?\n]*", 0)


def document_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as blog posts: one passage per packed chunk."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    pieces = docs.select("*", F.posexplode(pack_prose(F.col("text"))).alias("chunk_index", "piece"))
    url = F.concat(F.lit(ORIGIN + BLOG), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    title = F.coalesce(F.nullif(first_sentence(F.col("text")), F.lit("")), F.lit("untitled"))
    return to_passages(
        pieces.select(
            node("post", F.col("doc_id"), title, url).alias("asset"),
            node("blog", F.col("source"), F.col("source")).alias("parent"),
            attrs(channel=F.col("lang"), path=F.concat(F.col("source"), F.lit("/"), F.col("lang"))).alias("attrs"),
            "chunk_index",
            F.col("piece").alias("text"),
        )
    )


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.trim("text").alias("q")
    )


# --- SQL fragments (CTE lists without WITH) --------------------------------------------


def fold_sql(source: str, cap: int = 900, sep: str = " ") -> str:
    """Greedy packing of a string list expression."""
    joiner = "chr(10)" if sep == "\n" else "' '"
    return f"""list_reduce(list_transform({source}, lambda x: {{'cur': x, 'done': []::VARCHAR[]}}),
        lambda a, x: CASE WHEN a.cur = '' THEN {{'cur': x.cur, 'done': a.done}}
          WHEN length(a.cur) + 1 + length(x.cur) <= {cap} THEN {{'cur': a.cur || {joiner} || x.cur, 'done': a.done}}
          ELSE {{'cur': x.cur, 'done': list_append(a.done, a.cur)}} END)"""


def packed_sql(source: str, cap: int = 900, sep: str = " ") -> str:
    """All pieces of the packing as one list."""
    return f"""list_transform([{fold_sql(source, cap, sep)}],
        lambda f: CASE WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END)[1]"""


def squeeze_sql(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


def sentences_sql(column: str) -> str:
    return f"string_split(regexp_replace({column}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))"


#: A sentence as pieces of 900 characters.
SLICES = "list_transform(range(greatest(1, ceil(length(s) / 900.0))::BIGINT), lambda i: s[i * 900 + 1 : (i + 1) * 900])"

CHUNKS = f"""
sq AS (SELECT doc_id, text AS raw, lang, source, {squeeze_sql('text')} AS body FROM documents),
sents AS (SELECT *, flatten(list_transform({sentences_sql('body')}, lambda s: {SLICES})) AS parts FROM sq WHERE body <> ''),
packs AS (SELECT doc_id, raw, lang, source, {packed_sql('parts')} AS pieces FROM sents),
chunks AS (SELECT doc_id, raw, lang, source, unnest(range(len(pieces))) AS chunk_index, unnest(pieces) AS text FROM packs),
passages AS (SELECT 'post' || chr(31) || doc_id || chr(31) || chunk_index AS passage_id, doc_id, lang, source, chunk_index, text,
  coalesce(nullif(regexp_extract(raw, '^[^.!?\\n]*'), ''), 'untitled') AS title, source || '/' || lang AS path FROM chunks)"""
