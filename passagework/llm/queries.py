"""One query per operator over the whole of its table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import bpe, decontaminate, exact_search, filter_audit, hnsw, langid, mixing, near_dups, secrets, sharding, toxicity, urls, whitening
from passagework.llm.common import words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(column: str, n: int):
    """crc32 of an id as text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op2_mixing",
    r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS mark FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM sources),
closed AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER w, 0) AS caps_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
    sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM weighed WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT (total - caps_before) / weight_left AS level FROM closed WHERE (total - caps_before) / weight_left * weight <= cap ORDER BY cap / weight LIMIT 1),
targets AS (SELECT source, source_size, least(weight * coalesce((SELECT level FROM levels), 1e300), cap) AS target FROM closed),
placed AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY size, mark, doc_id) - 1 AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor((place + 1) * rate + 0.37::DOUBLE) - floor(place * rate + 0.37::DOUBLE)))::BIGINT AS taken FROM placed
""",
)
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", words_of(F.col("text")).alias("words"))
    mixed = mixing.mix(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "llr")


@query("op5_language")
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    models = langid.train(docs.filter(fold("doc_id", 3) != 1).select("lang", "text"))
    said = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), langid.predicted(spark, models, F.col("text")).alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).select("doc_id", "secrets")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("secrets")).alias("spans"),
    )


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, keep=["doc_id"])


@query(
    "op3_exact_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""",
)
def op3_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return exact_search.exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5, lambda x: F.floor(x * 256).cast("double"))


@query("op9_nearest")
def op9_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query(
    "op10_near_dups",
    r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
rare AS (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1),
shared AS (SELECT tokens.* FROM tokens JOIN rare USING (t)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) + any_value(b.n) - count(*) AS u
  FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * i >= 85 * u),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
""",
)
def op10_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = near_dups.near_duplicates(docs, shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")).filter(fold("doc_id", 4) != 2)
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf, "embeddings"), 8, whitening.floored(1024, 100_000))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


@query(
    "op13_filter_audit",
    r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
failed AS (SELECT d.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad,
    {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, false)} AS f FROM worded d LEFT JOIN labels l ON d.doc_id = l.doc_id),
classes AS (SELECT part, f['A'] AS a, f['B'] AS b, f['C'] AS c, f['D'] AS d, f['E'] AS e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
sets AS (SELECT part, n, good, bad, list_concat(CASE WHEN a THEN ['A'] ELSE [] END, CASE WHEN b THEN ['B'] ELSE [] END, CASE WHEN c THEN ['C'] ELSE [] END,
    CASE WHEN d THEN ['D'] ELSE [] END, CASE WHEN e THEN ['E'] ELSE [] END) AS fails FROM classes),
seen AS (SELECT part, o, step, n, good, bad, list_contains(fails, o[step]) AS own, len(fails) AS k,
    len(list_filter(fails, lambda x: strpos(o, x) < step)) AS earlier FROM sets, steps),
counted AS (SELECT part, o AS filter_order, step::INTEGER AS step,
    coalesce(sum(n) FILTER (NOT own AND earlier = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (own AND earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (own AND k = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (own AND earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (own AND earlier = 0), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted
""",
)
def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return filter_audit.audit_filters(docs, table(spark, sf, "labels"))


@query(
    "op12_decontamination",
    r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM item_words WHERE len(w) > 0),
doc_words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM doc_words, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m),
occurs AS (SELECT DISTINCT doc_id, item_id, i, m FROM grams JOIN windows USING (g, m)),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occurs) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS named FROM (SELECT DISTINCT doc_id, item_id FROM occurs) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
