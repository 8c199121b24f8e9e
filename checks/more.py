"""Projections, keys, links, linked data, symbols, feed ids and file states."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import urls
from passagework.functions.packing import pack_source
from passagework.operators import enrich, state
from passagework.operators.schema import hit_projection, passage_filter, wide_projection
from passagework.operators.upsert import update_attrs
from passagework.sources import feeds, pages
from passagework.sources.tables import read_table

from .base import CHUNKS, document_passages, query, squeeze_sql, strip_sql
from .tables import _legacy


@query(
    "hit_columns",
    f"WITH {CHUNKS} SELECT passage_id, 3 AS schema_version, title, source AS parent_id, chunk_index::INT AS chunk_index, text, lang AS channel, NULL::VARCHAR AS code FROM passages",
)
def hit_columns(spark, sf):
    hits = hit_projection(document_passages(spark, sf))
    return hits.select(
        "passage_id", "schema_version", F.col("asset.title").alias("title"), F.col("parent.id").alias("parent_id"), "chunk_index", "text",
        F.col("attrs.channel").alias("channel"), "code",
    )


@query(
    "wide_columns",
    """SELECT doc_id::VARCHAR AS episode_id, CASE WHEN doc_id % 2 = 1 THEN doc_id::VARCHAR END AS item_id, source AS podcast_id, 0 AS chunk_index,
  text, NULL::VARCHAR AS apple_track_id, NULL::VARCHAR AS media_kind FROM documents""",
)
def wide_columns(spark, sf):
    return wide_projection(_legacy(spark, sf)).select("episode_id", "item_id", "podcast_id", "chunk_index", "text", "apple_track_id", "media_kind")


@query(
    "one_asset",
    f"WITH {CHUNKS}, k AS (SELECT max(doc_id) AS d FROM documents) SELECT chunk_index::INT AS chunk_index, text FROM passages, k WHERE doc_id = d AND chunk_index = 0",
)
def one_asset(spark, sf):
    last = read_table(spark, sf, "documents", "doc_id").agg(F.max("doc_id")).first()[0]
    return passage_filter(document_passages(spark, sf), "post", str(last), 0).select("chunk_index", "text")


@query(
    "show_and_audio",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR END AS show_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'a' || o_custkey END AS audio FROM orders""",
)
def show_and_audio(spark, sf):
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey")
    key, other = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    page = F.concat(F.lit("https://shop.example/us/podcast/x/"), F.when(key % 2 == 0, "id").otherwise("show"), other, F.lit("?id=1"))
    links = F.array(
        F.struct(F.lit("page").alias("href"), F.lit("text/html").alias("type")),
        F.struct(F.concat(F.lit("a"), other).alias("href"), F.when(key % 3 == 1, "audio/mpeg").alias("type")),
        F.struct(F.when(key % 3 == 1, "later").alias("href"), F.when(key % 3 == 1, "audio/ogg").alias("type")),
    )
    enclosure = F.when(key % 3 == 0, F.concat(F.lit("e"), key.cast("string"))).otherwise("")
    return orders.select("o_orderkey", urls.show_id(page).alias("show_id"), feeds.first_audio_link(enclosure, links).alias("audio"))


@query(
    "linked_articles",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'Tab ' || doc_id ELSE 'Head ' || doc_id END AS title,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE source || ', Bo' END AS author, {squeeze_sql('text')} AS text FROM documents WHERE {squeeze_sql('text')} <> ''""",
)
def linked_articles(spark, sf):
    """Articles with linked data of four shapes: plain, in a list, in a graph behind a broken block, none."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "source")
    key = F.col("doc_id").cast("string")
    node = F.to_json(F.struct(F.lit("Article").alias("@type"), F.concat(F.lit("Head "), key).alias("headline"), F.array("source", F.lit("Bo")).alias("author")))
    other = F.lit('{"@type":"Person","name":"no"}')
    data = (
        F.when(F.col("doc_id") % 4 == 0, node)
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("["), other, F.lit(","), node, F.lit("]")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{bad</script><script type="application/ld+json">{"@graph":['), other, F.lit(","), node, F.lit("]}")))
        .otherwise(other)
    )
    from passagework.functions.text import escape_html

    html = F.concat(
        F.lit("<title>Tab "), key, F.lit('</title><script type="application/ld+json">'), data, F.lit("</script><article><p>"), escape_html(F.col("text")), F.lit("</p></article>")
    )
    made = docs.select(F.concat(F.lit("https://w.example/blog/"), key).alias("url"), html.alias("html"))
    found = pages.html_articles(made, "/blog/", "https://w.example")
    return found.select(
        F.substring_index("slug", "/", -1).cast("long").alias("doc_id"), "title", "author", F.element_at("blocks", 1)["text"].alias("text")
    )


_LINE = "regexp_replace(text, '[\\n-\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', ' ', 'g')"


@query(
    "symbol_segments",
    f"""WITH d AS (SELECT doc_id, {_LINE} AS t FROM documents),
head AS (SELECT doc_id, 1 AS start_line, NULL::VARCHAR AS symbol, 'use x' AS code FROM d),
first AS (SELECT doc_id, 2 AS start_line, 'a_' || doc_id AS symbol, CASE WHEN length(t) + length('fn a_() {{' || doc_id) + 1 <= 3500 THEN 'fn a_' || doc_id || '() {{' || chr(10) || t ELSE 'fn a_' || doc_id || '() {{' END AS code FROM d),
rest AS (SELECT doc_id, 3 AS start_line, 'a_' || doc_id AS symbol, unnest(list_transform(range(greatest(1, ceil(length(t) / 3500.0))::BIGINT), lambda i: t[i * 3500 + 1 : (i + 1) * 3500])) AS code
  FROM d WHERE length(t) + length('fn a_() {{' || doc_id) + 1 > 3500),
last AS (SELECT doc_id, 4 AS start_line, 'b' AS symbol, 'class b:' || chr(10) || '  end' AS code FROM d)
SELECT * FROM head UNION ALL SELECT * FROM first UNION ALL SELECT * FROM rest WHERE {strip_sql('code')} <> '' UNION ALL SELECT * FROM last""",
)
def symbol_segments(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    line = F.regexp_replace("text", r"[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]", " ")
    source = F.concat(F.lit("use x\nfn a_"), F.col("doc_id").cast("string"), F.lit("() {\n"), line, F.lit("\nclass b:\n  end"))
    return docs.select("doc_id", F.inline(pack_source(source))).select("doc_id", "start_line", "symbol", "code")


@query(
    "feed_ids",
    """SELECT o_orderkey::VARCHAR AS asset_id, CASE WHEN o_orderkey % 2 = 0 THEN 'New ' || o_custkey ELSE 'Old' END AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ep' || o_custkey WHEN o_orderkey % 4 = 1 THEN 'stored' END AS spotify_episode_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'e' || o_custkey || 'f' ELSE 'e0' END AS anchor_id FROM orders""",
)
def feed_ids(spark, sf):
    """Every second order is in the feed, twice; the found ids are then written to the passages."""
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey")
    key, other = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    stored = orders.select(key.alias("asset_id"), F.lit("Old").alias("title"), F.lit("https://pod.example/x-e0").alias("url"))
    item = orders.filter("o_orderkey % 2 = 0").select(
        key.alias("guid"), F.concat(F.lit("New "), other).alias("title"), F.concat(F.lit("https://pod.example/y-e"), other, F.lit("f/")).alias("link"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("https://t.example/show/ep"), other, F.lit("/transcript.srt"))).otherwise("https://t.example/show/transcript.srt").alias("transcript_url"),
        F.lit(2).alias("seq"),
    )
    older = item.withColumns({"title": F.lit("Older"), "link": F.lit(""), "seq": F.lit(1)})
    changes = enrich.feed_ids(stored, item.unionByName(older), ["seq"])
    attrs = F.struct(F.when(F.col("o_orderkey") % 4 == 1, "stored").alias("spotify_episode_id"), F.lit(None).cast("string").alias("anchor_id"))
    passages = orders.select(F.struct(F.lit("episode").alias("type"), key.alias("id")).alias("asset"), attrs.alias("attrs"))
    written = update_attrs(passages, changes, ("spotify_episode_id", "anchor_id"), kind="episode")
    return written.select(F.col("asset.id").alias("asset_id"), "attrs.*").join(changes.select("asset_id", "title"), "asset_id").select(
        "asset_id", "title", "spotify_episode_id", "anchor_id"
    )


@query(
    "file_states",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND text IS NOT NULL THEN 'complete' ELSE 'missing' END AS state FROM documents""",
)
def file_states(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    ref = F.sha1(F.col("text").cast("binary"))
    stored = F.when(F.col("doc_id") % 3 == 1, ref).when(F.col("doc_id") % 3 == 2, ref).when(F.col("doc_id") % 2 == 0, "other")
    return docs.select("doc_id", state.file_state(stored, ref).alias("state"))


@query(
    "considered",
    """WITH c AS (SELECT o_orderkey AS asset_key, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100)
SELECT asset_key, CASE WHEN asset_key IN (SELECT l_orderkey FROM lineitem) THEN 'complete' ELSE 'missing' END AS state FROM c""",
)
def considered(spark, sf):
    """The hundred newest orders are considered, whatever is stored of them."""
    catalog = read_table(spark, sf, "orders", "o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "asset_key")
    chunks = read_table(spark, sf, "lineitem", "l_orderkey").select(
        F.col("l_orderkey").alias("asset_key"), F.lit(0).alias("chunk_index"), F.lit("").alias("lastmod"), F.lit(True).alias("complete"), F.lit(0).alias("start_ms")
    )
    newest = [F.desc("o_orderdate"), F.col("asset_key")]
    plan = state.ingest_plan(catalog, state.stored_state(chunks, ["asset_key"]), ["asset_key"], state.episode_state(), consider=100, newest=newest)
    return plan.select("asset_key", "state")
