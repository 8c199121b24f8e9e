"""Table maintenance, states, counts, migration and matching on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import enrich, state
from passagework.operators.common import latest_per, materialize
from passagework.operators.grams import build_gram_index
from passagework.operators.lexical import substring_search, title_one_edit
from passagework.operators.schema import (
    construction_errors, from_legacy, to_passages, validation_errors,
)
from passagework.operators.upsert import missing_assets, replace_rows, update_attrs, upsert
from passagework.sources.tables import read_table

from .base import CHUNKS, ORACLES, benchmark_queries, document_passages, query


@query(
    "passages_by_type",
    f"WITH {CHUNKS} SELECT 'post' AS asset_type, count(*) AS n FROM passages UNION ALL SELECT 'episode', count(*) FROM conversations WHERE text <> '' UNION ALL SELECT 'doc', count(*) FROM pages WHERE html <> ''",
)
def passages_by_type(spark, sf):
    posts = document_passages(spark, sf).select("asset")
    episodes = read_table(spark, sf, "conversations", "text").filter("text <> ''").select(_kind("episode"))
    docs = read_table(spark, sf, "pages", "html").filter("html <> ''").select(_kind("doc"))
    return state.count_by_type(posts.select(F.struct("asset.type").alias("asset")).unionByName(episodes).unionByName(docs))


def _kind(name):
    return F.struct(F.lit(name).alias("type")).alias("asset")


@query(
    "container_counts",
    f"""WITH {CHUNKS} SELECT 'blog' AS parent_type, source AS parent_id, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_assets,
  count(DISTINCT doc_id) FILTER (lang <> '') AS n_with_attr FROM passages GROUP BY source""",
)
def container_counts(spark, sf):
    return state.count_by_container(document_passages(spark, sf), "channel")


@query(
    "container_sketches",
    f"""WITH {CHUNKS} SELECT 'blog' AS parent_type, source AS parent_id, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_assets,
  count(DISTINCT doc_id) FILTER (lang <> '') AS n_with_attr, true AS near FROM passages GROUP BY source""",
)
def container_sketches(spark, sf):
    """Exact counts, and whether merged sketches of overlapping changes are within 4 % of them."""
    passages = document_passages(spark, sf)
    at = F.pmod(F.xxhash64("asset.id"), F.lit(10))
    # a third of what is stored comes in again with the new rows
    parts = [passages.filter(at < 6), passages.filter(at >= 4), passages.filter(F.col("chunk_index") == 0)]
    merged = state.merge_sketches(*[state.container_sketches(p, "channel") for p in parts])
    counted = state.sketched_counts(merged).toDF("parent_type", "parent_id", "c", "a", "w")
    exact = state.count_by_container(passages, "channel")
    close = [F.abs(F.col(e) - F.col(n)) <= 0.04 * F.col(n) for e, n in (("c", "n_chunks"), ("a", "n_assets"), ("w", "n_with_attr"))]
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("parent_type", "parent_id")]
    near = F.coalesce(close[0] & close[1] & close[2], F.lit(False)).alias("near")
    return exact.alias("x").join(counted.alias("s"), same[0] & same[1], "left").select("x.*", near)


@query(
    "attribute_coverage",
    f"WITH {CHUNKS} SELECT count(DISTINCT doc_id) AS n_assets, count(DISTINCT doc_id) FILTER (lang <> '') AS n_channel, 0::BIGINT AS n_anchor FROM passages",
)
def coverage(spark, sf):
    return enrich.attribute_coverage(document_passages(spark, sf), ("channel", "anchor"))


def _stored_chunks(spark, sf):
    """Line items as stored chunks of their order; a returned line is an unfinished one."""
    return read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag").select(
        F.col("l_orderkey").alias("asset_key"),
        (F.col("l_linenumber") - 1).alias("chunk_index"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("lastmod"),
        (F.col("l_returnflag") != "R").alias("complete"),
        F.when(F.col("l_returnflag") != "A", F.lit(0)).alias("start_ms"),
    )


def _catalog(spark, sf):
    return read_table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").select(
        F.col("o_orderkey").alias("asset_key"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("lastmod"),
    )


_STATE = """
st AS (SELECT l_orderkey AS asset_key, count(*) AS n_chunks,
  min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous,
  min(strftime(l_shipdate, '%Y-%m-%d')) AS oldest, bool_and(l_returnflag <> 'R') AS all_complete, bool_or(l_returnflag <> 'R') AS any_complete,
  bool_or(l_returnflag <> 'A') AS timed FROM lineitem GROUP BY l_orderkey),
cat AS (SELECT o_orderkey AS asset_key, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS lastmod FROM orders),
plan AS (SELECT asset_key, lastmod, CASE WHEN n_chunks IS NULL THEN 'missing'
  WHEN contiguous AND lastmod IS NOT NULL AND oldest >= lastmod AND all_complete THEN 'complete' WHEN NOT contiguous THEN 'partial' ELSE 'stale' END AS post_state,
  CASE WHEN n_chunks IS NULL THEN 'missing' WHEN any_complete OR contiguous THEN 'complete' ELSE 'partial' END AS video_state,
  CASE WHEN timed THEN 'complete' ELSE 'missing' END AS episode_state,
  CASE WHEN oldest >= lastmod THEN 'complete' ELSE 'missing' END AS doc_state FROM cat LEFT JOIN st USING (asset_key))"""


@query("ingest_plan", f"WITH {_STATE} SELECT * FROM plan")
def ingest_plan(spark, sf):
    stored = state.stored_state(_stored_chunks(spark, sf), ["asset_key"])
    plan = state.ingest_plan(_catalog(spark, sf), stored, ["asset_key"], state.post_state(F.col("lastmod")))
    return plan.select(
        "asset_key", "lastmod", F.col("state").alias("post_state"), state.video_state().alias("video_state"),
        state.episode_state().alias("episode_state"),
        state.doc_state(F.col("oldest_lastmod"), F.col("lastmod")).alias("doc_state"),
    )


@query(
    "ingest_batch",
    f"""WITH {_STATE} SELECT asset_key, lastmod, post_state AS state FROM plan WHERE post_state <> 'complete'
ORDER BY lastmod DESC NULLS LAST, asset_key LIMIT 40""",
)
def ingest_batch(spark, sf):
    stored = state.stored_state(_stored_chunks(spark, sf), ["asset_key"])
    newest = [F.col("lastmod").desc_nulls_last(), F.col("asset_key")]
    return state.ingest_plan(
        _catalog(spark, sf), stored, ["asset_key"], state.post_state(F.col("lastmod")), most_new=40, newest=newest
    ).select("asset_key", "lastmod", "state")


@query(
    "ingest_summary",
    f"""WITH {_STATE}, oc AS (SELECT l_orderkey AS asset_key, count(*) AS w FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL)
SELECT count(*) FILTER (post_state <> 'complete' AND coalesce(w, 0) > 0) AS ingested, count(*) FILTER (post_state = 'complete') AS skipped,
  count(*) FILTER (post_state <> 'complete' AND coalesce(w, 0) = 0) AS failed, count(*) FILTER (post_state IN ('partial', 'stale') AND coalesce(w, 0) > 0) AS rewritten,
  coalesce(sum(w) FILTER (post_state <> 'complete'), 0)::BIGINT AS chunks FROM plan LEFT JOIN oc USING (asset_key)""",
)
def ingest_summary(spark, sf):
    stored = state.stored_state(_stored_chunks(spark, sf), ["asset_key"])
    plan = state.ingest_plan(_catalog(spark, sf), stored, ["asset_key"], state.post_state(F.col("lastmod")))
    outcome = (
        read_table(spark, sf, "lineitem", "l_orderkey", "l_discount").filter("l_discount > 0.02")
        .groupBy(F.col("l_orderkey").alias("asset_key")).agg(F.count("*").alias("chunks_written"))
    )
    return state.run_summary(plan, outcome, ["asset_key"])


_SPLIT = "1998-01-01"


def _versions(spark, sf):
    """Older deliveries as the stored table, newer ones as the incoming rewrite."""
    rows = read_table(
        spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice"
    ).select(
        F.col("l_orderkey").alias("asset_key"), (F.col("l_linenumber") - 1).alias("chunk_index"),
        F.col("l_partkey").alias("text"), F.nullif("l_returnflag", F.lit("N")).alias("audio"),
        F.nullif("l_linestatus", F.lit("O")).alias("attrs"), "l_shipdate", "l_extendedprice", "l_suppkey",
    )
    order = ["l_shipdate", "l_extendedprice", "l_suppkey"]
    old = latest_per(rows.filter(F.col("l_shipdate") < _SPLIT), ["asset_key", "chunk_index"], order).drop(*order)
    new = rows.filter(F.col("l_shipdate") >= _SPLIT)
    return old, new, order


_VERSIONS = f"""
rows AS (SELECT l_orderkey AS asset_key, l_linenumber - 1 AS chunk_index, l_partkey AS text, nullif(l_returnflag, 'N') AS audio,
  nullif(l_linestatus, 'O') AS attrs, l_shipdate >= TIMESTAMP '{_SPLIT}' AS is_new, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_shipdate >= TIMESTAMP '{_SPLIT}'
    ORDER BY l_shipdate DESC, l_extendedprice DESC, l_suppkey DESC, l_partkey DESC, nullif(l_returnflag, 'N') DESC NULLS LAST, nullif(l_linestatus, 'O') DESC NULLS LAST) AS n FROM lineitem),
old AS (SELECT * FROM rows WHERE NOT is_new AND n = 1), new AS (SELECT * FROM rows WHERE is_new AND n = 1)"""


@query(
    "upsert_trim",
    f"""WITH {_VERSIONS}, ends AS (SELECT asset_key, max(chunk_index) AS e FROM new GROUP BY ALL),
kept AS (SELECT old.* FROM old LEFT JOIN ends USING (asset_key) WHERE e IS NULL OR chunk_index <= e)
SELECT asset_key, chunk_index, coalesce(new.text, kept.text) AS text, coalesce(new.audio, kept.audio) AS audio,
  CASE WHEN new.is_new THEN new.attrs ELSE kept.attrs END AS attrs FROM kept FULL JOIN new USING (asset_key, chunk_index)""",
)
def upsert_trim(spark, sf):
    old, new, order = _versions(spark, sf)
    return upsert(old, new, ["asset_key"], order=order)


@query(
    "replace_rows",
    f"""WITH {_VERSIONS} SELECT asset_key, chunk_index, text, audio, attrs FROM new
UNION ALL SELECT asset_key, chunk_index, text, audio, attrs FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.asset_key = old.asset_key AND new.chunk_index = old.chunk_index)""",
)
def replaced(spark, sf):
    old, new, order = _versions(spark, sf)
    fresh = latest_per(new, ["asset_key", "chunk_index"], order).drop(*order)
    return replace_rows(old, fresh, ["asset_key", "chunk_index"])


@query("missing_assets", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_stored(spark, sf):
    known = read_table(spark, sf, "orders", "o_orderkey")
    stored = read_table(spark, sf, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    return missing_assets(known, stored, ["o_orderkey"])


@query(
    "partial_update",
    """SELECT kind AS asset_type, o_orderkey::VARCHAR AS asset_id,
  coalesce(CASE WHEN kind = 'episode' AND o_orderstatus <> 'P' THEN 'sp-' || o_custkey END, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END) AS spotify_episode_id,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS duration FROM orders CROSS JOIN (VALUES ('episode'), ('video')) t(kind)""",
)
def partial_update(spark, sf):
    """Two types share their ids, every third asset has no attributes, every change comes twice."""
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    stored = F.struct(F.col("o_orderpriority").alias("spotify_episode_id"), F.col("o_orderpriority").alias("duration"))
    passages = orders.select(F.explode(F.array(F.lit("episode"), F.lit("video"))).alias("kind"), "*").select(
        F.struct(F.col("kind").alias("type"), F.col("o_orderkey").cast("string").alias("id")).alias("asset"),
        F.when(F.col("o_orderkey") % 3 > 0, stored).alias("attrs"),
    )
    change = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("sp-"), F.col("o_custkey").cast("string")))
    changes = orders.select(F.col("o_orderkey").cast("string").alias("asset_id"), F.lit(2).alias("seq"), change.alias("spotify_episode_id"))
    older = changes.withColumn("seq", F.lit(1)).withColumn("spotify_episode_id", F.lit("old"))
    updated = update_attrs(passages, changes.unionByName(older), ("spotify_episode_id",), kind="episode", order=["seq"])
    return updated.select(F.col("asset.type").alias("asset_type"), F.col("asset.id").alias("asset_id"), "attrs.spotify_episode_id", "attrs.duration")


@query(
    "newest_assets",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS published_at FROM orders
ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey LIMIT 50""",
)
def newest_assets(spark, sf):
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    dated = orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"))
    return state.newest_first(dated, "published_at", "o_orderkey", 50)


# --- migration and validation ---------------------------------------------------------


def _legacy(spark, sf):
    """Documents in the older flat layout, of several kinds."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    kind = F.when(F.col("lang") == "en", None).when(F.col("lang") == "fr", F.lit("youtube")).when(F.col("lang") == "de", F.lit("github")).otherwise(F.lit("snippet"))
    key = F.col("doc_id").cast("string")
    odd = F.col("doc_id") % 2 == 1
    return docs.select(
        kind.alias("source_kind"),
        F.when(odd, key).alias("item_id"),
        key.alias("episode_id"),
        F.when(odd, F.lit("")).otherwise(F.concat(F.lit("Title "), key)).alias("item_title"),
        F.col("source").alias("podcast_id"),
        F.when(odd, F.concat(F.lit("Show "), F.col("source"))).alias("podcast_title"),
        F.concat(F.lit("https://example.org/"), key).alias("episode_url"),
        F.when(odd, F.lit("600")).otherwise("").alias("duration"),
        F.col("lang").alias("source"),
        F.lit(0).alias("chunk_index"),
        F.length("text").cast("string").alias("n_letters"),
        "text",
    )


_LEGACY = """
k AS (SELECT *, CASE lang WHEN 'fr' THEN 'video' WHEN 'de' THEN 'repo' WHEN 'en' THEN 'episode' ELSE 'snippet' END AS kind, doc_id % 2 = 1 AS odd FROM documents),
m AS (SELECT kind AS asset_type, doc_id::VARCHAR AS asset_id, CASE WHEN odd THEN doc_id::VARCHAR ELSE 'Title ' || doc_id END AS title,
  'https://example.org/' || doc_id AS url, CASE kind WHEN 'video' THEN 'channel' WHEN 'episode' THEN 'podcast' END AS parent_type,
  CASE WHEN kind IN ('video', 'episode') THEN source END AS parent_id,
  CASE WHEN kind IN ('video', 'episode') THEN CASE WHEN odd THEN 'Show ' || source ELSE source END END AS parent_title,
  CASE WHEN odd THEN '600' END AS duration, CASE WHEN kind = 'video' THEN doc_id::VARCHAR END AS video_id, lang AS ingest_source,
  length(text)::VARCHAR AS n_letters, nullif(text, '') AS text, length(text) AS n FROM k)"""


def _flat(df):
    return df.select(
        F.col("asset.type").alias("asset_type"), F.col("asset.id").alias("asset_id"), F.col("asset.title").alias("title"),
        F.col("asset.url").alias("url"), F.col("parent.type").alias("parent_type"), F.col("parent.id").alias("parent_id"),
        F.col("parent.title").alias("parent_title"), F.col("attrs.duration").alias("duration"),
        F.col("attrs.youtube_video_id").alias("video_id"), "ingest_source",
        F.col("attrs_extra")["n_letters"].alias("n_letters"), "text",
    )


@query("migrate_legacy", f"WITH {_LEGACY} SELECT * EXCLUDE (n) FROM m")
def migrate_legacy(spark, sf):
    return _flat(from_legacy(_legacy(spark, sf)))


@query("migrate_twice", f"WITH {_LEGACY} SELECT * EXCLUDE (n) FROM m")
def migrate_twice(spark, sf):
    return _flat(from_legacy(from_legacy(_legacy(spark, sf))))


@query("migrate_steps", f"WITH {_LEGACY} SELECT * EXCLUDE (n), n NOT BETWEEN 1 AND 8000 AS rejected FROM m")
def migrate_steps(spark, sf):
    """The migration, stopped after two steps and gone on with."""
    import uuid

    from passagework.operators.common import materialize, scratch_dir
    from passagework.plans.migrate import migrate_in_steps

    old = materialize(_legacy(spark, sf).repartition(8), "legacy-table")
    source = old.inputFiles()[0].rsplit("/", 1)[0]
    target = f"{scratch_dir(spark)}/migrated-{uuid.uuid4().hex}"
    migrate_in_steps(spark, source, target, files_per_step=2, at_most=2)
    valid, rejected, _ = migrate_in_steps(spark, source, target, files_per_step=2)
    return _flat(valid).withColumn("rejected", F.lit(False)).unionByName(_flat(rejected).withColumn("rejected", F.lit(True)))


@query(
    "migrate_report",
    f"WITH {_LEGACY} SELECT asset_type, count(*) AS scanned, count(*) FILTER (n BETWEEN 1 AND 8000) AS replaced, count(*) FILTER (n NOT BETWEEN 1 AND 8000) AS rejected FROM m GROUP BY asset_type",
)
def migrate_report(spark, sf):
    from passagework.plans.migrate import migration_report

    return migration_report(_legacy(spark, sf))


@query(
    "validate_passages",
    """WITH k AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'song' ELSE 'post' END AS type, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'T' END AS title, source, doc_id % 5 - 1 AS chunk_index, text FROM documents),
e AS (SELECT doc_id, [CASE WHEN type = 'song' THEN 'asset.type' END, CASE WHEN title = '' THEN 'asset.title' END, CASE WHEN doc_id % 11 = 0 THEN 'parent.type' END,
  CASE WHEN chunk_index < 0 THEN 'chunk_index' END, CASE WHEN length(text) NOT BETWEEN 1 AND 8000 THEN 'text' END] AS l FROM k)
SELECT doc_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS errors FROM e""",
)
def validate(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    rows = docs.select(
        "doc_id", F.lit(3).alias("schema_version"),
        F.struct(
            F.when(F.col("lang") == "es", "song").otherwise("post").alias("type"), F.col("doc_id").cast("string").alias("id"),
            F.when(F.col("doc_id") % 7 == 0, "").otherwise("T").alias("title"),
        ).alias("asset"),
        F.struct(
            F.when(F.col("doc_id") % 11 == 0, "shelf").otherwise("blog").alias("type"), F.col("source").alias("id"), F.col("source").alias("title")
        ).alias("parent"),
        (F.col("doc_id") % 5 - 1).alias("chunk_index"), "text", F.lit(None).cast("string").alias("code"),
    )
    return rows.select("doc_id", F.array_join(validation_errors(), ",").alias("errors"))


@query(
    "construct_passages",
    """SELECT doc_id, CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN 'wrong parent type' WHEN 'de' THEN 'parent not allowed' ELSE 'parent required' END
  || CASE WHEN text = '' THEN ',text required' ELSE '' END AS errors FROM documents""",
)
def construct(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    parent = F.struct(F.when(F.col("lang") == "fr", "manual").otherwise("blog").alias("type"), F.col("source").alias("id"), F.col("source").alias("title"))
    rows = docs.select(
        "doc_id",
        F.struct(
            F.when(F.col("lang") == "de", "repo").otherwise("post").alias("type"), F.col("doc_id").cast("string").alias("id"), F.lit("T").alias("title")
        ).alias("asset"),
        F.when(F.col("lang").isin("en", "fr", "de"), parent).alias("parent"), "text",
    )
    return rows.select("doc_id", F.array_join(construction_errors(), ",").alias("errors"))


# --- title matching -------------------------------------------------------------------

_NORM = "lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g')))"


@query(
    "title_exact",
    f"""WITH c AS (SELECT {_NORM} AS k, max(p_partkey) AS track FROM part GROUP BY 1)
SELECT p_partkey, track FROM part JOIN c ON c.k = {_NORM}""",
)
def title_exact(spark, sf):
    parts = read_table(spark, sf, "part", "p_partkey", "p_name")
    assets = parts.select("p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit("  ")).alias("asset_title"))
    catalog = parts.select(F.col("p_partkey").alias("track"), "p_name")
    return enrich.match_exact(assets, catalog, "asset_title", "p_name", "track").select("p_partkey", "track")


@query(
    "title_contains",
    """WITH a AS (SELECT DISTINCT lower(p_type || ' ' || p_name) AS t FROM part),
c AS (SELECT lower(p_name) AS k, min(p_partkey) AS track FROM part GROUP BY 1),
b AS (SELECT t, arg_min(track, CASE WHEN t = k THEN 0 ELSE 1000000000 END + track) AS track FROM a JOIN c ON contains(t, k) OR contains(k, t) GROUP BY t)
SELECT p_partkey, track FROM part LEFT JOIN b ON t = lower(p_type || ' ' || p_name)""",
)
def title_contains(spark, sf):
    parts = read_table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    assets = parts.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("asset_title"))
    catalog = parts.select(F.col("p_partkey").alias("track"), "p_name")
    return enrich.match_contained(assets, catalog, "asset_title", "p_name", "track").select("p_partkey", "track")


# One query per word of a part name with two letters swapped out: last letter replaced.
@query(
    "title_one_edit",
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
q AS (SELECT word AS query_id, left(word, length(word) - 1) || 'x' AS token FROM w WHERE regexp_matches(word, '^[a-z]{4,16}$')),
h AS (SELECT query_id, p_partkey::VARCHAR AS asset_id FROM q JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) p ON abs(length(p.word) - length(token)) <= 1 AND levenshtein(p.word, token) = 1 GROUP BY ALL)
SELECT query_id, asset_id, 0.5::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY asset_id) AS rank FROM h) WHERE rank <= 10""",
)
def one_edit(spark, sf):
    parts = read_table(spark, sf, "part", "p_partkey", "p_name")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    queries = words.select(F.col("word").alias("query_id"), F.concat(F.expr("left(word, length(word) - 1)"), F.lit("x")).alias("q"))
    assets = parts.select(
        F.lit("post").alias("asset_type"), F.col("p_partkey").cast("string").alias("asset_id"), F.col("p_name").alias("title"), F.lit(0).alias("chunk_index")
    )
    return title_one_edit(queries, assets, 10).select("query_id", "asset_id", "score", "rank")


@query(
    "substring_search",
    f"""WITH {CHUNKS},
parts AS (SELECT item_id, unnest(string_split(regexp_replace(text, '[.!?]', chr(1), 'g'), chr(1))) AS s FROM benchmark),
lit AS (SELECT DISTINCT lower(trim(s)) AS l FROM parts WHERE length(trim(s)) > 0),
hits AS (SELECT l, passage_id FROM lit JOIN passages ON contains(lower(text), l) OR contains(lower(title), l) OR contains(lower(source), l))
SELECT l AS query_id, passage_id, 1.0::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY passage_id) AS rank FROM hits) WHERE rank <= 10""",
)
def substring(spark, sf):
    return substring_search(literals_of(spark, sf), document_passages(spark, sf), 10)


def literals_of(spark, sf):
    sentence = F.explode(F.split(F.regexp_replace("q", "[.!?]", "\u0001"), "\u0001"))
    literals = benchmark_queries(spark, sf).select(sentence.alias("s")).select(F.lower(F.trim("s")).alias("q")).filter("q <> ''").distinct()
    return literals.select(F.col("q").alias("query_id"), "q")


@query("substring_indexed", ORACLES["substring_search"])
def substring_indexed(spark, sf):
    """The same literals through the stored letter triples."""
    passages = materialize(document_passages(spark, sf).select("passage_id", "asset", "parent", "text"), "passages")
    return substring_search(literals_of(spark, sf), passages, 10, grams=build_gram_index(passages))


@query(
    "gram_counts",
    f"""WITH {CHUNKS},
bodies AS (SELECT passage_id, unnest([lower(title), lower(source), lower(text)]) AS body FROM passages),
letters AS (SELECT passage_id, string_split(body, '') AS l FROM bodies),
places AS (SELECT passage_id, unnest(list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2]))) AS gram FROM letters)
SELECT gram, count(DISTINCT passage_id) AS n FROM places GROUP BY gram""",
)
def gram_counts(spark, sf):
    return build_gram_index(document_passages(spark, sf)).counts.select("gram", "n")
