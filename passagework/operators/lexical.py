"""Keyword ranking: BM25 over weighted fields, typo expansion, highlights, fallbacks."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SNIPPET_CHARS, escape_html, sentences, squeeze, strip
from .common import materialize, top_per
from .grams import GramIndex, containing, split_literals
from .index import FIELDS, Field, Index, analyze
from .scoring import top_passages
from .typos import MAX_EDITS, asked_parts, probes_of, segments_of

# BM25 parameters (Robertson and Walker) and the typo limit.
K1 = 1.2
B = 0.75
MAX_EXPANSIONS = 50


def search_texts(requests: DataFrame) -> DataFrame:
    """``query_id, q`` from requests with ``q`` and ``query``: ``q`` wins, blanks dropped."""
    text = strip(F.coalesce(F.col("q"), F.col("query"), F.lit("")))
    return requests.select("query_id", text.alias("q")).filter(F.col("q") != "")


def query_terms(queries: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """``query_id, field, term, qtf, boost, fuzzy``: analysed query words per clause."""
    analyzers = sorted({f.analyzer for f in fields})
    rows = queries.select("query_id", "q", F.explode(F.array(*map(F.lit, analyzers))).alias("analyzer"))
    terms = (
        rows.select("query_id", "analyzer", F.explode_outer(analyze(F.col("q"), F.col("analyzer"))).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("query_id", "analyzer", "term")
        .agg(F.count("*").alias("qtf"))
    )
    clauses = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("field"), F.lit(f.boost).alias("boost"), F.lit(f.fuzzy).alias("fuzzy"),
                F.lit(f.analyzer).alias("_analyzer"),
            )
            for f in fields
        ]
    )
    return terms.select("*", F.inline(clauses)).filter(F.col("analyzer") == F.col("_analyzer")).select(
        "query_id", "field", "boost", "fuzzy", "term", "qtf"
    )


def near_terms(tokens: DataFrame, vocab: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``field, token, term, edits, df``: vocabulary terms within two edits of a token.

    The distance must stay below the length of the shorter word, so one-letter words only
    match themselves. Candidates come from an equi-join on word parts (a word within k
    edits shares one of k+1 parts), so neither side is compared with all of the other.
    ``parts`` is the vocabulary's stored part table (``typos.write_parts``), of which only the buckets
    that the tokens ask for are read; without it the vocabulary is cut here.
    """
    words = tokens.select("field", "token").distinct()
    probes = words.select("field", "token", F.inline(probes_of(F.col("token"))))
    edits = F.levenshtein("token", "term")
    reach = F.least(F.lit(MAX_EDITS + 1), F.length("token"), F.length("term"))
    if parts is None:
        met = vocab.select("field", "term", "df", F.inline(segments_of(F.col("term")))).join(probes, ["field", "len", "part", "segment"])
    else:
        met = asked_parts(parts, materialize(probes, "probes"))
    return (
        met.filter(edits < reach)
        .select("field", "token", "term", "df", edits.alias("edits"))
        .groupBy("field", "token", "term")
        .agg(F.first("edits").alias("edits"), F.first("df").alias("df"))
    )


def expand_terms(tokens: DataFrame, vocab: DataFrame, limit: int = MAX_EXPANSIONS, parts: DataFrame | None = None) -> DataFrame:
    """The ``limit`` near terms of every token: nearest first, then most frequent."""
    best = [F.col("edits"), F.col("df").desc(), F.col("term")]
    return top_per(near_terms(tokens, vocab, parts), ["field", "token"], best, limit, "_n").drop("_n")


def term_weights(queries: DataFrame, index: Index, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """``query_id, field, term, weight``: what one matching term adds before length scaling.

    A typo match counts ``1 - edits / length of the shorter word``.
    """
    wanted = materialize(query_terms(queries, fields), "query-terms")
    exact = wanted.filter(~F.col("fuzzy")).join(index.vocabulary, ["field", "term"]).withColumn("share", F.lit(1.0))
    typos = wanted.filter("fuzzy").withColumnRenamed("term", "token")
    expanded = expand_terms(typos, index.vocabulary, parts=index.parts)
    share = 1 - F.col("edits") / F.least(F.length("token"), F.length("term"))
    typo = typos.join(expanded, ["field", "token"]).withColumn("share", share)
    columns = ["query_id", "field", "term", "boost", "df", "qtf", "share"]
    both = exact.select(*columns).unionByName(typo.select(*columns))
    n, df = F.col("n_passages"), F.col("df")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return (
        both.groupBy("query_id", "field", "term", "boost", "df")
        .agg(F.sum(F.col("qtf") * F.col("share")).alias("strength"))
        .join(F.broadcast(index.stats), "field")  # one row per searched field
        .select("query_id", "field", "term", "df", "avg_len", (F.col("boost") * idf * F.col("strength")).alias("weight"))
    )


def keyword_search(
    queries: DataFrame, index: Index, limit: int = 10, fields: tuple[Field, ...] = FIELDS, filters: dict[str, object] | None = None
) -> DataFrame:
    """``query_id, passage_id, score, rank``: BM25 summed over the clauses, best first."""
    return top_passages(index, term_weights(queries, index, fields), limit, K1, B, filters)


# --- highlights -----------------------------------------------------------------------


def fragments(text: Column, terms: Column, analyzer: str, most: int = 2, words: Column | None = None) -> Column:
    """The ``most`` sentences with most matching words, in reading order.

    Returns ``array<struct<texts: array<struct<value, type>>>>`` where words whose
    analysed form is in ``terms``, or which are in ``words`` (lower case: what typos were
    expanded to), have type ``hit``.
    """
    from ..functions.analysis import STOP_WORDS, TOKEN

    def hit(word: Column) -> Column:
        exact = F.arrays_overlap(analyze(word, analyzer), terms)
        if words is None:
            return exact
        plain = F.lower(word)
        return exact | (~plain.isin(*STOP_WORDS) & F.array_contains(words, plain))

    def pieces(sentence: Column) -> Column:
        gaps = F.split(sentence, TOKEN)
        found = F.regexp_extract_all(sentence, F.lit(TOKEN), 0)
        return F.flatten(
            F.zip_with(
                gaps,
                found,
                lambda gap, word: F.filter(
                    F.array(
                        F.struct(gap.alias("value"), F.lit("text").alias("type")),
                        F.struct(word.alias("value"), F.when(hit(word), "hit").otherwise("text").alias("type")),
                    ),
                    lambda p: p["value"].isNotNull() & (p["value"] != ""),
                ),
            )
        )

    scored = F.filter(
        F.transform(
            sentences(squeeze(F.coalesce(text, F.lit("")))),
            lambda s, i: F.struct(
                F.size(F.filter(F.regexp_extract_all(s, F.lit(TOKEN), 0), hit)).alias("n"), (-i).alias("order"), s.alias("sentence")
            ),
        ),
        lambda s: s["n"] > 0,
    )
    best = F.slice(F.reverse(F.array_sort(scored)), 1, most)
    ordered = F.array_sort(F.transform(best, lambda s: F.struct((-s["order"]).alias("at"), s["sentence"].alias("sentence"))))
    return F.transform(ordered, lambda s: F.struct(pieces(s["sentence"]).alias("texts")))


# The highlighted fields in their order, with the analyzer of their words.
HIGHLIGHTED = (("text", "english"), ("asset.title", "english"), ("parent.title", "english"), ("code", "standard"))


def typo_words(weights: DataFrame) -> DataFrame:
    """``query_id, words``: vocabulary words that a query's words stand for in its fuzzy clauses.

    At most ``MAX_EXPANSIONS`` for each word of the query.
    """
    return weights.filter(F.col("field").endswith(".fuzzy")).groupBy("query_id").agg(F.collect_set("term").alias("words"))


def highlight_html(highlights: Column, fallback: Column) -> Column:
    """Snippet markup: marked fragments joined by an ellipsis, or the start of the text."""

    def fragment(h: Column) -> Column:
        return strip(
            F.array_join(
                F.transform(
                    h["texts"],
                    lambda p: F.when(
                        p["type"] == "hit", F.concat(F.lit("<mark>"), escape_html(p["value"]), F.lit("</mark>"))
                    ).otherwise(escape_html(p["value"])),
                ),
                "",
            )
        )

    shown = F.filter(F.transform(highlights, fragment), lambda t: t != "")
    body = strip(F.coalesce(fallback, F.lit("")))
    head = F.regexp_replace(F.left(body, F.lit(SNIPPET_CHARS)), r" [^ ]*$", "")
    plain = F.when(F.length(body) > SNIPPET_CHARS, F.concat(head, F.lit("…"))).otherwise(body)
    empty = F.left(F.coalesce(fallback, F.lit("")), F.lit(SNIPPET_CHARS))
    return (
        F.when(highlights.isNull() | (F.size(highlights) == 0), escape_html(plain))
        .when(F.size(shown) > 0, F.array_join(shown, " … "))
        .otherwise(escape_html(empty))
    )


def display_text(text: Column, code: Column) -> Column:
    """Code instead of a short label."""
    has_code = F.coalesce(code, F.lit("")) != ""
    return F.when(has_code & (F.length(F.coalesce(text, F.lit(""))) < 180), code).otherwise(F.coalesce(text, F.lit("")))


# --- fallbacks ------------------------------------------------------------------------

PATTERNS_PER_SCAN = 50_000


def _finder(patterns: list[str]):
    """Function from a text to the patterns it contains, in one pass over the text."""
    import ahocorasick

    if not patterns:  # an automaton without words cannot be asked
        return lambda text: ()
    automaton = ahocorasick.Automaton()
    for pattern in patterns:
        automaton.add_word(pattern, pattern)
    automaton.make_automaton()
    return lambda text: {found for _, found in automaton.iter(text)}


class _Last:
    """A passage key that a heap takes for smaller the later it sorts."""

    __slots__ = ("key",)

    def __init__(self, key: str):
        self.key = key

    def __lt__(self, other: _Last) -> bool:
        return self.key > other.key


def substring_matches(queries: DataFrame, passages: DataFrame, columns: tuple[str, ...], limit: int) -> DataFrame:
    """``query_id, passage_id`` where a column contains the query, ignoring case.

    A task passes on the ``limit`` first passages of each literal, which is all a search
    can use of it.

    Every text is read once for all queries: the literals form one automaton per scan, at
    most ``PATTERNS_PER_SCAN`` of them, so the cost does not grow with queries x passages.
    """
    literals = queries.select("query_id", F.lower("q").alias("literal"))
    distinct = literals.select("literal").filter("literal <> ''").distinct()
    scans = max(1, -(-distinct.count() // PATTERNS_PER_SCAN))
    # NUL keeps columns apart; it cannot occur in a trimmed query
    texts = passages.select("passage_id", F.lower(F.concat_ws("\0", *[F.col(c) for c in columns])).alias("body"))

    def scan(part: int) -> DataFrame:
        share = distinct.filter(F.pmod(F.xxhash64("literal"), F.lit(scans)) == part)
        patterns = [row["literal"] for row in share.toLocalIterator()]

        def find(batches):
            contained, best = _finder(patterns), {}
            for batch in batches:
                for key, text in zip(batch["passage_id"], batch["body"]):
                    for literal in contained(text):
                        held = best.setdefault(literal, [])
                        if len(held) < limit:
                            heapq.heappush(held, _Last(key))
                        elif key < held[0].key:
                            heapq.heapreplace(held, _Last(key))
            rows = [(h.key, literal) for literal, held in best.items() for h in held]
            yield pd.DataFrame(rows, columns=["passage_id", "literal"]).astype(object)

        return texts.mapInPandas(find, "passage_id string, literal string")

    found = scan(0)
    for part in range(1, scans):
        found = found.unionByName(scan(part))
    return found.join(literals, "literal").select("query_id", "passage_id")


def substring_search(
    queries: DataFrame,
    passages: DataFrame,
    limit: int = 10,
    columns: tuple[str, ...] = ("asset.title", "parent.title", "text"),
    grams: GramIndex | None = None,
) -> DataFrame:
    """``query_id, passage_id, score, rank``: literal matches, score 1, by passage key.

    With ``grams``, the stored triples of the same columns, only literals that are common
    or shorter than three letters need a scan of all texts; the result is the same. An
    empty query matches nothing.
    """
    if grams is None:
        found = substring_matches(queries, passages, columns, limit)
    else:
        if grams.columns != columns:
            raise ValueError(f"the stored triples are of {grams.columns}")
        literals = queries.select("query_id", F.lower("q").alias("literal"))
        meet, scanned = split_literals(literals.select("literal").distinct(), grams)
        found = containing(meet, passages, grams).join(literals, "literal").select("query_id", "passage_id")
        if not scanned.isEmpty():
            asked = literals.join(scanned, "literal", "left_semi").select("query_id", F.col("literal").alias("q"))
            found = found.unionByName(substring_matches(asked, passages, columns, limit))
    return top_per(found.withColumn("score", F.lit(1.0)), ["query_id"], [F.col("passage_id")], limit)


def marked_snippet(text: Column, query: Column) -> Column:
    """Text with the literal matches of ``query`` marked, cut around the first mark."""
    literal = F.regexp_replace(escape_html(query), r"([^\p{L}\p{N}])", r"\\$1")
    safe = escape_html(F.coalesce(text, F.lit("")))
    marked = F.regexp_replace(safe, F.concat(F.lit("(?iu)"), literal), F.lit("<mark>$0</mark>"))
    at = F.instr(marked, "<mark>") - 1
    start = F.greatest(F.lit(0), at - 120)
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(marked, start + 1, F.lit(600)))
    return (
        F.when(at < 0, escape_html(F.left(F.coalesce(text, F.lit("")), F.lit(SNIPPET_CHARS))))
        .when(F.length(marked) > 800, window)
        .otherwise(marked)
    )


def title_one_edit(queries: DataFrame, assets: DataFrame, limit: int = 10) -> DataFrame:
    """Assets with a title word exactly one edit away from a one-word query.

    Only alphabetic queries of 4 to 16 letters take part. ``assets`` has one row per
    passage (``asset_type, asset_id, title, chunk_index``); one row per asset is returned.
    """
    token = F.lower(strip(F.col("q")))
    tokens = (
        queries.select("query_id", token.alias("token"))
        .filter(F.col("token").rlike(r"^\p{L}{4,16}$"))
        .withColumn("field", F.lit("title"))
    )
    titles = assets.groupBy("asset_type", "asset_id", "title").agg(F.min("chunk_index").alias("chunk_index"))
    words = titles.select(
        "asset_type", "asset_id", "chunk_index",
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9']+"), 0))).alias("term"),
    )
    vocab = words.select(F.lit("title").alias("field"), "term").distinct().withColumn("df", F.lit(1))
    near = near_terms(tokens, vocab).filter("edits = 1").select("token", "term")
    hits = (
        tokens.select("query_id", "token")
        .join(near, "token")
        .join(words, "term")
        .groupBy("query_id", "asset_type", "asset_id")
        .agg(F.min("chunk_index").alias("chunk_index"))
        .withColumn("score", F.lit(0.5))
    )
    order = [F.col("asset_type"), F.col("asset_id"), F.col("chunk_index")]
    return top_per(hits, ["query_id"], order, limit)
