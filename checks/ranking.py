"""Index, keyword and vector ranking, fusion, grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import fuse as fusing
from passagework.operators.group import flat_results, result_counts
from passagework.operators.index import FIELDS, build_index, field_stats, index_rows, postings
from passagework.operators.lexical import expand_terms, keyword_search, query_terms
from passagework.operators.vector import knn_approximate, knn_exact, term_vector_search
from passagework.sources.tables import read_table

from .base import CHUNKS, benchmark_queries, document_passages, query
from .terms import english_sql, standard_sql

# Fields of the document passages with their text in SQL.
PROSE = tuple(f for f in FIELDS if f.name != "code")
TEXT_ONLY = tuple(f for f in FIELDS if f.name in ("text", "asset.title", "parent.title"))
_SOURCE = {"code": "code", "text": "text", "asset.title": "title", "parent.title": "source", "attrs.path": "path"}


def postings_sql(fields) -> str:
    """CTEs up to ``post(field, term, passage_id, tf)``."""
    ctes, parts = [], []
    for i, field in enumerate(fields):
        src, name = f"src{i}", f"terms{i}"
        ctes.append(f"{src} AS (SELECT passage_id, {_SOURCE[field.source]} AS text FROM passages)")
        if field.analyzer == "english":
            ctes.append(english_sql(src, name, "passage_id", f"a{i}_"))
        else:
            ctes.append(standard_sql(src, name, "passage_id"))
        parts.append(f"SELECT '{field.name}' AS field, term, passage_id, tf FROM {name}")
    ctes.append(f"post AS ({' UNION ALL '.join(parts)})")
    ctes.append("lens AS (SELECT field, passage_id, sum(tf) AS len, sqrt(sum((1 + ln(tf)) ** 2)) AS norm FROM post GROUP BY ALL)")
    ctes.append("vocab AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL)")
    ctes.append("stats AS (SELECT field, count(*) AS n, avg(len) AS avg_len FROM lens GROUP BY field)")
    return ",\n".join(ctes)


def query_terms_sql(fields) -> str:
    """CTEs up to ``qt(query_id, field, term, qtf, boost, fuzzy)``."""
    ctes, parts = ["qsrc AS (SELECT item_id AS query_id, text FROM benchmark)"], []
    ctes.append(english_sql("qsrc", "q_english", "query_id", "q_"))
    ctes.append(standard_sql("qsrc", "q_standard", "query_id"))
    for field in fields:
        parts.append(
            f"SELECT query_id, '{field.name}' AS field, term, tf AS qtf, {field.boost}::DOUBLE AS boost, {str(field.fuzzy).lower()} AS fuzzy FROM q_{field.analyzer}"
        )
    ctes.append(f"qt AS ({' UNION ALL '.join(parts)})")
    return ",\n".join(ctes)


def letters(column: str) -> str:
    """DuckDB's levenshtein counts bytes: give every accented small letter one byte."""
    accented = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
    return f"translate({column}, '{accented}', {' || '.join(f'chr({i})' for i in [*range(1, 32), 127])})"


EXPANSIONS = f"""
tokens AS (SELECT DISTINCT field, term AS token FROM qt WHERE fuzzy),
sized AS (SELECT field, token, unnest([-2, -1, 0, 1, 2]) + length(token) AS size, {letters("token")} AS plain FROM tokens),
words AS (SELECT field, term, df, length(term) AS size, {letters("term")} AS plain FROM vocab),
near AS (SELECT t.field, t.token, v.term, v.df, levenshtein(t.plain, v.plain) AS edits
  FROM sized t JOIN words v ON v.field = t.field AND v.size = t.size),
close AS (SELECT *, row_number() OVER (PARTITION BY field, token ORDER BY edits, df DESC, term) AS n FROM near
  WHERE edits <= 2 AND edits < least(length(token), length(term))),
expanded AS (SELECT * FROM close WHERE n <= 50)"""

SCORES = """
pairs AS (
  SELECT query_id, qt.field, qt.term, boost, v.df, qtf * 1.0::DOUBLE AS part FROM qt JOIN vocab v ON v.field = qt.field AND v.term = qt.term WHERE NOT fuzzy
  UNION ALL
  SELECT query_id, qt.field, e.term, boost, e.df, qtf * (1 - edits / least(length(e.token), length(e.term))::DOUBLE) AS part
  FROM qt JOIN expanded e ON e.field = qt.field AND e.token = qt.term WHERE fuzzy),
weights AS (SELECT query_id, p.field, term, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * sum(part) AS weight, any_value(avg_len) AS avg_len
  FROM pairs p JOIN stats USING (field) GROUP BY query_id, p.field, term, boost, df, n),
scores AS (SELECT query_id, passage_id, round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM weights w JOIN post USING (field, term) JOIN lens USING (field, passage_id) GROUP BY ALL),
keyword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM scores) WHERE rank <= 10)"""

SEMANTIC = """
qv AS (SELECT query_id, q.term, (1 + ln(qtf)) * ln(1 + n / df::DOUBLE) AS w FROM qt q JOIN vocab v ON v.field = 'text' AND v.term = q.term
  JOIN stats s ON s.field = 'text' WHERE q.field = 'text'),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY query_id),
cosines AS (SELECT query_id, passage_id, round(sum(w / qn.norm * (1 + ln(tf)) / lens.norm), 6) AS score
  FROM qv JOIN qn USING (query_id) JOIN post p ON p.field = 'text' AND p.term = qv.term JOIN lens USING (field, passage_id) GROUP BY ALL),
semantic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM cosines) WHERE rank <= 10)"""

NO_EXPANSIONS = "expanded AS (SELECT '' AS field, '' AS token, '' AS term, 1 AS df, 0 AS edits WHERE false)"


@query(
    "postings",
    f"""WITH {CHUNKS}, {postings_sql(TEXT_ONLY)}
SELECT field, term, passage_id, tf::INT AS tf, len::INT AS len, round(norm, 6) AS norm FROM post JOIN lens USING (field, passage_id)""",
)
def index_postings(spark, sf):
    return postings(index_rows(document_passages(spark, sf), TEXT_ONLY)).withColumn("norm", F.round("norm", 6))


@query(
    "field_stats",
    f"""WITH {CHUNKS}, {postings_sql(PROSE)}
SELECT field, n AS n_passages, round(avg_len, 6) AS avg_len FROM stats""",
)
def index_field_stats(spark, sf):
    return field_stats(index_rows(document_passages(spark, sf), PROSE)).withColumn("avg_len", F.round("avg_len", 6))


@query(
    "vocabulary",
    f"""WITH {CHUNKS}, {postings_sql(PROSE)} SELECT field, term, df FROM vocab""",
)
def index_vocabulary(spark, sf):
    return build_index(document_passages(spark, sf), PROSE).vocabulary


@query(
    "fuzzy_terms",
    f"""WITH {CHUNKS}, {postings_sql([f for f in PROSE if f.fuzzy])}, {query_terms_sql([f for f in PROSE if f.fuzzy])}, {EXPANSIONS}
SELECT field, token, term, edits::INT AS edits, df FROM expanded""",
)
def fuzzy_terms(spark, sf):
    fields = tuple(f for f in PROSE if f.fuzzy)
    index = build_index(document_passages(spark, sf), fields)
    tokens = query_terms(benchmark_queries(spark, sf), fields).withColumnRenamed("term", "token")
    return expand_terms(tokens, index.vocabulary, parts=index.parts)


@query(
    "bm25_topk",
    f"""WITH {CHUNKS}, {postings_sql(TEXT_ONLY)}, {query_terms_sql(TEXT_ONLY)}, {NO_EXPANSIONS}, {SCORES}
SELECT query_id, passage_id, score, rank::INT AS rank FROM keyword""",
)
def bm25_topk(spark, sf):
    index = build_index(document_passages(spark, sf), TEXT_ONLY)
    return keyword_search(benchmark_queries(spark, sf), index, 10, TEXT_ONLY)


@query(
    "keyword_search",
    f"""WITH {CHUNKS}, {postings_sql(PROSE)}, {query_terms_sql(PROSE)}, {EXPANSIONS}, {SCORES}
SELECT query_id, passage_id, score, rank::INT AS rank FROM keyword""",
)
def keyword_search_all(spark, sf):
    index = build_index(document_passages(spark, sf), PROSE)
    return keyword_search(benchmark_queries(spark, sf), index, 10, PROSE)


_TITLE = tuple(f for f in FIELDS if f.name == "asset.title")
_SOME = "('src1', 'src3', 'src5')"


@query(
    "keyword_filtered",
    f"""WITH {CHUNKS}, {postings_sql(_TITLE)}, {query_terms_sql(_TITLE)}, {NO_EXPANSIONS},
{SCORES.replace("FROM scores)", f"FROM scores WHERE passage_id IN (SELECT passage_id FROM passages WHERE source IN {_SOME}))")}
SELECT query_id, passage_id, score, rank::INT AS rank FROM keyword""",
)
def keyword_filtered(spark, sf):
    """Keyword search within three sources; statistics are those of all passages."""
    passages = document_passages(spark, sf)
    index = build_index(passages, _TITLE)
    return keyword_search(benchmark_queries(spark, sf), index, 10, _TITLE, {"asset_type": "post", "parent_id": ["src1", "src3", "src5"]})


_TEXT = tuple(f for f in FIELDS if f.name == "text")


@query(
    "semantic_topk",
    f"""WITH {CHUNKS}, {postings_sql(_TEXT)}, {query_terms_sql(_TEXT)}, {SEMANTIC}
SELECT query_id, passage_id, score, rank::INT AS rank FROM semantic""",
)
def semantic_topk(spark, sf):
    index = build_index(document_passages(spark, sf), _TEXT)
    return term_vector_search(benchmark_queries(spark, sf), index, 10)


# One query vector per label: the mean of the label's vectors.
_CENTROIDS = """
n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS s FROM n),
dim AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM n),
mean AS (SELECT label, i, avg(x) AS x FROM dim GROUP BY ALL),
q0 AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM mean GROUP BY label),
q AS (SELECT query_id, v, sqrt(list_inner_product(v, v)) AS s FROM q0)"""


def _knn_sql(limit: int, keep: str) -> str:
    return f"""WITH {_CENTROIDS},
d AS (SELECT query_id, vec_id, round(list_inner_product(q.v, u.v) / (q.s * u.s), 6) AS score FROM q CROSS JOIN u WHERE {keep})
SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= {limit}"""


def _vectors(spark, sf):
    vectors = read_table(spark, sf, "embeddings")
    mean = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x")
    )
    # one row per dimension, so a list is as long as a vector
    centroids = mean.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda d: d["x"]).alias("embedding")
    )
    return centroids, vectors


@query("knn_exact", _knn_sql(50, "true"))
def knn_all(spark, sf):
    return knn_exact(*_vectors(spark, sf), 50)


@query("knn_filtered", _knn_sql(20, "u.label = (SELECT max(label) FROM embeddings)"))
def knn_filtered(spark, sf):
    centroids, vectors = _vectors(spark, sf)
    label = vectors.agg(F.max("label")).first()[0]
    return knn_exact(centroids, vectors, 20, filters={"label": label})


@query("knn_approximate")
def knn_buckets(spark, sf):
    return knn_approximate(*_vectors(spark, sf), 64, 50)


@query(
    "knn_approximate_recall",
    "SELECT label AS query_id, least(50, (SELECT count(*) FROM embeddings)) AS n, true AS recalled FROM embeddings GROUP BY label",
)
def knn_recall(spark, sf):
    """Rows per query, and whether at least half of the exact neighbours are among them."""
    centroids, vectors = _vectors(spark, sf)
    near = knn_approximate(centroids, vectors, 64, 50, bands=32, bits=6).select("query_id", "vec_id", F.lit(1).alias("near"))
    exact = knn_exact(centroids, vectors, 50).select("query_id", "vec_id", F.lit(1).alias("exact"))
    both = near.join(exact, ["query_id", "vec_id"], "full").groupBy("query_id")
    return both.agg(F.count("near").alias("n"), (F.sum(F.col("near") * F.col("exact")) >= 0.5 * F.count("exact")).alias("recalled"))


@query("vector_index", _knn_sql(50, "true"))
def vector_index(spark, sf):
    """Neighbours out of stored cells: the cells that the bound leaves open are read too."""
    from passagework.operators.cells import build_vector_index, search_vectors

    centroids, vectors = _vectors(spark, sf)
    return search_vectors(centroids, build_vector_index(vectors), 50)


@query("vector_index_filtered", _knn_sql(20, "u.label = (SELECT max(label) FROM embeddings)"))
def vector_index_filtered(spark, sf):
    from passagework.operators.cells import build_vector_index, search_vectors

    centroids, vectors = _vectors(spark, sf)
    label = vectors.agg(F.max("label")).first()[0]
    return search_vectors(centroids, build_vector_index(vectors), 20, filters={"label": label})


def _lists(spark, sf):
    index = build_index(document_passages(spark, sf), TEXT_ONLY)
    queries = benchmark_queries(spark, sf)
    return keyword_search(queries, index, 10, TEXT_ONLY), term_vector_search(queries, index, 10)


def fused_sql(name: str, lists: list[tuple[str, str, float]], limit: int | None = None) -> str:
    """CTEs up to ``name(query_id, passage_id, score, match_types, rank)``.

    ``lists`` has (CTE, SQL giving its labels, weight) in order.
    """
    parts = [
        f"SELECT query_id, passage_id, {i} AS list, rank, {labels} AS labels, {weight}::DOUBLE AS weight FROM {cte}"
        for i, (cte, labels, weight) in enumerate(lists)
    ]
    score = " + ".join(
        f"coalesce({weight}::DOUBLE * (1.0::DOUBLE / (60 + min(rank) FILTER (list = {i}))), 0)" for i, (_, _, weight) in enumerate(lists)
    )
    cut = f" WHERE rank <= {limit}" if limit else ""
    return f"""{name}_all AS ({' UNION ALL '.join(parts)}),
{name}_sum AS (SELECT query_id, passage_id, round({score}, 9) AS score, list_sort(list_distinct(flatten(list(labels)))) AS match_types,
  min(list * 1000000 + rank) AS seen FROM {name}_all GROUP BY query_id, passage_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, passage_id) AS rank FROM {name}_sum){cut})"""


_BOTH = f"{CHUNKS}, {postings_sql(TEXT_ONLY)}, {query_terms_sql(TEXT_ONLY)}, {NO_EXPANSIONS}, {SCORES}, {SEMANTIC}"
PROSE_LISTS = [("keyword", "['keyword']", 1.0), ("semantic", "['semantic']", 1.2)]
# The code stage is exercised with the title ranking as its code list.
_TITLE_CODE = """
tv AS (SELECT query_id, q.term, (1 + ln(qtf)) * ln(1 + n / df::DOUBLE) AS w FROM qt q JOIN vocab v ON v.field = 'asset.title' AND v.term = q.term
  JOIN stats s ON s.field = 'asset.title' WHERE q.field = 'asset.title'),
tn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM tv GROUP BY query_id),
tc AS (SELECT query_id, passage_id, round(sum(w / tn.norm * (1 + ln(tf)) / lens.norm), 6) AS score
  FROM tv JOIN tn USING (query_id) JOIN post p ON p.field = 'asset.title' AND p.term = tv.term JOIN lens USING (field, passage_id) GROUP BY ALL),
code AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM tc) WHERE rank <= 10)"""
_FUSED_COLUMNS = "query_id, passage_id, score, array_to_string(match_types, ',') AS match_types, rank::INT AS rank"


@query("rrf", f"WITH {_BOTH}, {fused_sql('fused', PROSE_LISTS, 10)} SELECT {_FUSED_COLUMNS} FROM fused")
def rrf(spark, sf):
    keyword, semantic = _lists(spark, sf)
    return fusing.fuse_prose(keyword, semantic, 10).withColumn("match_types", F.array_join("match_types", ","))


CODE_LISTS = [("prose", "match_types", 1.0), ("code", "['code']", 0.8)]


@query(
    "rrf_code_stage",
    f"WITH {_BOTH}, {_TITLE_CODE}, {fused_sql('prose', PROSE_LISTS)}, {fused_sql('fused', CODE_LISTS, 10)} SELECT {_FUSED_COLUMNS} FROM fused",
)
def rrf_code_stage(spark, sf):
    index = build_index(document_passages(spark, sf), TEXT_ONLY)
    queries = benchmark_queries(spark, sf)
    keyword, semantic = keyword_search(queries, index, 10, TEXT_ONLY), term_vector_search(queries, index, 10)
    code = term_vector_search(queries, index, 10, field="asset.title")
    prose = fusing.fuse_prose(keyword, semantic)
    return fusing.fuse_code(prose, code, 10).withColumn("match_types", F.array_join("match_types", ","))


def hybrid(spark, sf):
    from passagework.plans.search import search

    passages = document_passages(spark, sf)
    index = build_index(passages, TEXT_ONLY)
    return search(benchmark_queries(spark, sf), passages, index, 10, 3, TEXT_ONLY)


_HYBRID = f"""{_BOTH}, {fused_sql('fused', PROSE_LISTS, 10)},
hits AS (SELECT f.*, p.doc_id, p.source, p.chunk_index FROM fused f JOIN passages p USING (passage_id)),
assets AS (SELECT query_id, source, doc_id, min(rank) AS first_rank, max(score) AS score, list_sort(list_distinct(flatten(list(match_types)))) AS mt FROM hits GROUP BY ALL),
groups AS (SELECT query_id, source, min(first_rank) AS first_rank, max(score) AS score FROM assets GROUP BY ALL),
gno AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS group_no FROM groups),
ano AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY first_rank) AS asset_no FROM assets),
pno AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS passage_no FROM hits)"""


@query(
    "hybrid_grouped",
    f"""WITH {_HYBRID} SELECT p.query_id, group_no::INT AS group_no, 'blog' AS group_type, g.source AS group_id, g.score AS group_score, asset_no::INT AS asset_no,
'post' AS asset_type, p.doc_id::VARCHAR AS asset_id, a.score AS asset_score, array_to_string(a.mt, ',') AS asset_match_types,
passage_no::INT AS passage_no, p.rank::INT AS rank, p.chunk_index::INT AS chunk_index
FROM pno p JOIN ano a ON a.query_id = p.query_id AND a.doc_id = p.doc_id JOIN gno g ON g.query_id = p.query_id AND g.source = p.source WHERE passage_no <= 3""",
)
def hybrid_grouped(spark, sf):
    return flat_results(hybrid(spark, sf)).select(
        "*", F.col("hit.rank").alias("rank"), F.col("hit.passage.chunk_index").alias("chunk_index")
    ).drop("hit")


@query(
    "search_modes",
    f"""WITH {_HYBRID}, has AS (SELECT item_id AS query_id, item_id IN (SELECT query_id FROM keyword) AS k, item_id IN (SELECT query_id FROM semantic) AS s FROM benchmark)
SELECT h.query_id, CASE WHEN k AND s THEN 'rrf' WHEN k THEN 'keyword' WHEN s THEN 'semantic' END AS mode, false AS used_fallback,
  (SELECT count(*) FROM fused f WHERE f.query_id = h.query_id) AS total,
  (SELECT count(*) FROM groups g WHERE g.query_id = h.query_id)::INT AS n_groups, (SELECT count(*) FROM assets a WHERE a.query_id = h.query_id)::INT AS n_assets FROM has h""",
)
def search_modes(spark, sf):
    results = hybrid(spark, sf)
    return results.select("query_id", "mode", "used_fallback", "total").join(result_counts(results), "query_id")


@query(
    "json_results",
    f"""WITH {_HYBRID}, has AS (SELECT item_id AS query_id, item_id IN (SELECT query_id FROM keyword) AS k, item_id IN (SELECT query_id FROM semantic) AS s FROM benchmark)
SELECT h.query_id, CASE WHEN k AND s THEN 'rrf' WHEN k THEN 'keyword' WHEN s THEN 'semantic' END AS mode, 'false' AS used_fallback,
  (SELECT count(*) FROM fused f WHERE f.query_id = h.query_id) AS total,
  nullif((SELECT count(*) FROM groups g WHERE g.query_id = h.query_id), 0)::INT AS n_groups FROM has h""",
)
def json_results(spark, sf):
    """The JSON documents of a whole search, read back."""
    from passagework.plans.search import result_json

    value = F.col("value")
    return result_json(hybrid(spark, sf)).select(
        "query_id",
        F.get_json_object(value, "$.mode").alias("mode"),
        F.get_json_object(value, "$.used_fallback").alias("used_fallback"),
        F.get_json_object(value, "$.total").cast("long").alias("total"),
        F.json_array_length(F.get_json_object(value, "$.groups")).alias("n_groups"),
    )
