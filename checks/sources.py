"""Sources. Landed files are derived from the tables row by row, whole texts included."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.functions import urls
from passagework.functions.text import escape_html
from passagework.functions.links import passage_link
from passagework.functions.packing import pack_sections
from passagework.operators import clips
from passagework.operators.common import materialize
from passagework.operators.lexical import search_texts
from passagework.operators.schema import attrs, lookup_asset, shape_hit
from passagework.sources import captions, feeds, markdown, pages, repo, sitemaps
from passagework.sources.tables import read_table

from .base import BLOG, CHUNKS, ORIGIN, SLICES, document_passages, packed_sql, query, sentences_sql, squeeze_sql, strip_sql
from .chunking import lines_sql

# --- captions -------------------------------------------------------------------------


def _sentences(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", tx.sentences(tx.squeeze(F.col("text"))).alias("parts"))


def _stamp(ms, mark):
    whole = (ms / 1000).cast("long")
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d", (whole / 3600).cast("long"), ((whole % 3600) / 60).cast("long"), whole % 60, ms % 1000
    )


def _subtitle(mark):
    def block(part, i):
        start = i.cast("long") * 5000 + 120
        return F.concat(
            (i + 1).cast("string"), F.lit("\n"), _stamp(start, mark), F.lit(" --> "), _stamp(start + 4000, mark),
            F.lit("\n<b>"), part, F.lit("</b>"),
        )

    return F.array_join(F.transform("parts", block), "\n\n")


_SENTENCES = f"""
p AS (SELECT doc_id, {sentences_sql(squeeze_sql('text'))} AS parts FROM documents),
s AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM p)"""


def _cues_sql(text: str, start: str = "i * 5000 + 120", end: str = "i * 5000 + 4120") -> str:
    return f"""WITH {_SENTENCES}, c AS (SELECT doc_id, i, ({start})::BIGINT AS start_ms, ({end})::BIGINT AS end_ms, {text} AS text FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ord, start_ms, end_ms, text FROM c WHERE text <> ''"""


_TAGLESS = squeeze_sql("regexp_replace(part, '<[^>]+>', '', 'g')")


@query("srt_cues", _cues_sql(_TAGLESS))
def srt_cues(spark, sf):
    files = _sentences(spark, sf).select("doc_id", F.concat(F.lit("﻿"), _subtitle(",")).alias("value"))
    return captions.explode_cues(files, captions.subtitle_cues(F.col("value")), "doc_id")


@query("vtt_cues", _cues_sql(_TAGLESS))
def vtt_cues(spark, sf):
    head = "WEBVTT\nKind: captions\nLanguage: en\n\n"
    files = _sentences(spark, sf).select("doc_id", F.concat(F.lit(head), _subtitle(".")).alias("value"))
    return captions.explode_cues(files, captions.subtitle_cues(F.col("value")), "doc_id")


@query("caption_json_cues", _cues_sql(squeeze_sql("part")))
def caption_json(spark, sf):
    def event(part, i):
        half = (F.length(part) / 2).cast("int")
        segs = F.array(
            F.struct(F.substr(part, F.lit(1), half).alias("utf8")), F.struct(F.substr(part, half + 1).alias("utf8"))
        )
        return F.struct((i.cast("long") * 5000 + 120).alias("tStartMs"), F.lit(4000).alias("dDurationMs"), segs.alias("segs"))

    files = _sentences(spark, sf).select("doc_id", F.to_json(F.struct(F.transform("parts", event).alias("events"))).alias("value"))
    return captions.explode_cues(files, captions.caption_json_cues(F.col("value")), "doc_id")


@query("speech_cues", _cues_sql(squeeze_sql("part"), "i * 2500", "i * 2500 + 1250"))
def speech_cues(spark, sf):
    segments = F.transform(
        "parts",
        lambda part, i: F.struct((i * 2.5).alias("start"), (i * 2.5 + 1.25).alias("end"), F.concat(F.lit(" "), part).alias("text")),
    )
    files = _sentences(spark, sf).select("doc_id", F.to_json(F.struct(segments.alias("segments"))).alias("value"))
    parsed = F.from_json("value", captions.SEGMENTS_JSON)["segments"]
    return captions.explode_cues(files, captions.segment_cues(parsed), "doc_id")


@query("snippet_cues", _cues_sql(squeeze_sql("part"), "i * 2500", "i * 2500 + 1250"))
def snippet_cues(spark, sf):
    snippets = F.transform(
        "parts", lambda part, i: F.struct((i * 2.5).alias("start"), F.lit(1.25).alias("duration"), part.alias("text"))
    )
    files = _sentences(spark, sf).select("doc_id", F.to_json(snippets).alias("value"))
    return captions.explode_cues(files, captions.snippet_cues(F.from_json("value", captions.SNIPPETS_JSON)), "doc_id")


@query(
    "srt_text",
    f"WITH {_SENTENCES}, c AS (SELECT doc_id, i, {_TAGLESS} AS text FROM s) SELECT doc_id, coalesce(string_agg(text, ' ' ORDER BY i) FILTER (text <> ''), '') AS text FROM c GROUP BY doc_id",
)
def srt_text(spark, sf):
    return _sentences(spark, sf).select("doc_id", captions.subtitle_text(_subtitle(",")).alias("text"))


# --- feeds and catalogs ---------------------------------------------------------------

_VIDEO_KEY = "left(md5(o_orderkey::VARCHAR), 11)"


def _video_key():
    return F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(11))


@query(
    "feed_items",
    """SELECT o_orderkey::VARCHAR AS guid, 'Order & ' || o_orderkey AS title, 'https://example.org/episodes/order-e' || o_orderkey AS link,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS published_at, '00:10' AS duration,
  CASE WHEN o_orderstatus = 'F' THEN 'https://cdn.example.org/' || o_orderkey || '.mp3' ELSE '' END AS audio_url,
  CASE WHEN o_orderstatus = 'F' THEN 'sp' || o_custkey END AS spotify_episode_id, 'e' || o_orderkey AS anchor_id FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def feed_items(spark, sf):
    orders = read_table(spark, sf, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    is_f = F.col("o_orderstatus") == "F"
    # items of low priority have no guid and are dropped
    item = F.concat(
        F.lit("<item>"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat(F.lit("<guid isPermaLink=\"false\"> "), key, F.lit(" </guid>"))),
        F.lit("<title>Order &amp;amp; "), key, F.lit("</title><link>https://example.org/episodes/order-e"), key, F.lit("</link>"),
        F.when(F.col("o_orderstatus") == "P", "<pubDate>soon</pubDate>").otherwise(
            F.concat(F.lit("<pubDate>Mon, "), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>"))
        ),
        F.lit("<itunes:duration xmlns:itunes=\"urn:i\">00:10</itunes:duration>"),
        F.when(is_f, F.concat(
            F.lit("<enclosure url=\"https://cdn.example.org/"), key, F.lit(".mp3\" type=\"audio/mpeg\"/>"),
            F.lit("<podcast:transcript xmlns:podcast=\"urn:p\" url=\"https://t.example.org/show/sp"), cust, F.lit("/transcript.srt\"/>"),
        )).otherwise(""),
        F.lit("</item>"),
    )
    items = orders.select(feeds.item_column(item).alias("item")).select("item.*")
    return feeds.episodes(items).drop("transcript_url", "description")


@query(
    "video_catalog",
    f"""SELECT {_VIDEO_KEY} AS video_id, CASE WHEN o_orderstatus = 'O' THEN {_VIDEO_KEY} ELSE 'Video ' || o_orderkey END AS title,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS published_at FROM orders WHERE o_orderpriority <> '1-URGENT'""",
)
def video_catalog(spark, sf):
    status = F.col("o_orderstatus")
    catalog = read_table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(_video_key()).alias("id"),
        F.when(status == "O", None).otherwise(F.concat(F.lit(" Video "), F.col("o_orderkey").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("url"), F.lit(12.5).alias("duration"),
        F.when(status == "F", "").when(status == "P", "20241399").alias("upload_date"),
        F.when(status == "F", F.date_format("o_orderdate", "yyyyMMdd")).alias("release_date"),
    )
    return feeds.videos(catalog).select("video_id", "title", "published_at")


@query(
    "video_ids",
    f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' OR left(o_orderpriority, 1) = '5' THEN {_VIDEO_KEY} END AS video_id FROM orders",
)
def video_ids(spark, sf):
    key, level = _video_key(), F.left("o_orderpriority", F.lit(1))
    good = (
        F.when(level == "1", F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), key, F.lit("&t=43s")))
        .when(level == "2", F.concat(F.lit("https://youtu.be/"), key, F.lit("?t=12")))
        .when(level == "3", F.concat(F.lit("http://m.youtube.com/shorts/"), key))
        .when(level == "4", F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), key, F.lit("/")))
        .otherwise(F.concat(F.lit(" "), key, F.lit(" ")))
    )
    bad = F.concat(F.lit("https://www.youtube.com/user/"), key)
    link = F.when((F.col("o_orderstatus") == "P") & (level != "5"), bad).otherwise(good)
    return read_table(spark, sf, "orders").select("o_orderkey", urls.video_id(link).alias("video_id"))


# --- sitemaps -------------------------------------------------------------------------

_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"


def _xml_entry(loc):
    return F.concat(
        F.lit("<url><loc> "), F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit(" </loc><lastmod>"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("page_id").cast("int")), "yyyy-MM-dd'T'00:00:00")),
        F.lit("</lastmod></url>"),
    )


_LASTMOD = "CASE WHEN page_id % 3 <> 0 THEN strftime(DATE '2024-01-01' + page_id::INT, '%Y-%m-%d') END"


@query(
    "sitemap_posts",
    f"""WITH p AS (SELECT page_id, 'https://www.example.org/company/blog' || {_PATH} AS url, {_LASTMOD} AS lastmod, {_PATH} AS path FROM pages)
SELECT page_id, url, lastmod, '/company/blog' || regexp_replace(path, '/+$', '') AS slug FROM p
WHERE trim(path, '/') <> '' AND split_part(ltrim(path, '/'), '/', 1) <> 'channel' AND path LIKE '/%'""",
)
def sitemap_posts(spark, sf):
    loc = F.concat(F.lit(ORIGIN + "/company/blog"), urls.url_path(F.col("url")))
    entries = read_table(spark, sf, "pages", "page_id", "url").select("page_id", sitemaps.entry_column(_xml_entry(loc)).alias("e"))
    return sitemaps.post_entries(entries.select("page_id", "e.*"), BLOG, "page_id")


@query(
    "sitemap_docs",
    f"""WITH p AS (SELECT page_id, url AS raw, {_PATH} AS path, {_LASTMOD} AS lastmod FROM pages),
u AS (SELECT *, 'https://www.example.org/docs/manual' || path AS url FROM p WHERE regexp_extract(raw, '\\?([^#]*)', 1) = '')
SELECT page_id, url, lastmod, 'manual' AS product, CASE WHEN '/docs/manual' || path = '/' THEN '/' ELSE regexp_replace('/docs/manual' || path, '/+$', '') END AS slug FROM u
WHERE NOT regexp_matches(path, '/[vV][0-9]') AND (path = '' OR path LIKE '/%')""",
)
def sitemap_docs(spark, sf):
    query_part = F.regexp_extract("url", r"(\?[^#]*)", 1)
    loc = F.concat(F.lit(ORIGIN + "/docs/manual"), urls.url_path(F.col("url")), query_part)
    entries = read_table(spark, sf, "pages", "page_id", "url").select("page_id", sitemaps.entry_column(_xml_entry(loc)).alias("e"))
    return sitemaps.page_entries(entries.select("page_id", "e.*"), F.lit("manual"), "page_id")


@query(
    "sitemap_index",
    f"""WITH p AS (SELECT DISTINCT split_part(ltrim({_PATH}, '/'), '/', 1) AS book FROM pages),
l AS (SELECT book, 'https://www.example.org/docs/' || book || '/current/sitemap-0.xml' AS loc FROM p WHERE book <> '')
SELECT loc, book AS product FROM l WHERE NOT regexp_matches(book, '^[vV][0-9]')""",
)
def sitemap_index(spark, sf):
    book = F.try_element_at(urls.path_parts(urls.url_path(F.col("url"))), F.lit(1))
    books = read_table(spark, sf, "pages", "url").select(book.alias("book")).filter("book is not null").distinct()
    loc = F.concat(F.lit("<sitemap><loc>https://www.example.org/docs/"), F.col("book"), F.lit("/current/sitemap-0.xml</loc></sitemap>"))
    return sitemaps.current_sitemaps(books.select(sitemaps.entry_column(loc).alias("e")).select("e.*"))


@query(
    "page_slugs",
    f"""WITH p AS (SELECT page_id, {_PATH} AS path, {squeeze_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title FROM pages)
SELECT page_id, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END AS slug, title,
  regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\t-\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}-]', '', 'g'), '[_\\t-\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor,
  'https://www.example.org' || regexp_replace(path, '/+$', '') || '.md' AS markdown_url FROM p""",
)
def page_slugs(spark, sf):
    title = pages.title_tag(F.col("html"))
    return read_table(spark, sf, "pages").select(
        "page_id", urls.slug(F.col("url")).alias("slug"), F.coalesce(title, F.lit("")).alias("title"),
        F.coalesce(tx.heading_anchor(title), F.lit("")).alias("anchor"), urls.markdown_url(F.col("url"), ORIGIN).alias("markdown_url"),
    )


# --- pages ----------------------------------------------------------------------------

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape_sql(column: str) -> str:
    for name, char in _ENTITIES:
        column = f"replace({column}, '{name}', '{char}')"
    return column


_ARTICLE = f"""
a0 AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '(?is)<script\\b.*?(?:</script\\s*>|\\z)', '', 'g'), '(?is)<style\\b.*?(?:</style\\s*>|\\z)', '', 'g') AS h FROM pages),
a1 AS (SELECT *, regexp_extract_all(array_to_string(regexp_extract_all(h, '(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|\\z)', 1), ''), '{pages.CAPTURE}') AS raw FROM a0),
a2 AS (SELECT page_id, url, html, unnest(range(len(raw))) AS i, unnest(raw) AS r FROM a1),
a3 AS (SELECT *, {squeeze_sql(unescape_sql("regexp_replace(r, '(?s)<[A-Za-z/!][^>]*>', '', 'g')"))} AS text FROM a2 WHERE regexp_extract(lower(r), '</([a-z0-9]+)\\s*>\\z', 1) = lower(regexp_extract(r, '^<([A-Za-z0-9]+)', 1)))"""


@query(
    "page_sections",
    f"""WITH {_ARTICLE} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS block_no, 'prose' AS kind, text FROM a3 WHERE text <> ''""",
)
def page_sections(spark, sf):
    found = read_table(spark, sf, "pages").select("page_id", F.posexplode(pages.html_blocks(F.col("html"))).alias("block_no", "b"))
    return found.select("page_id", "block_no", "b.kind", "b.text")


@query(
    "page_chunks",
    f"""WITH {_ARTICLE}, b AS (SELECT page_id, i, flatten(list_transform({sentences_sql('text')}, lambda s: {SLICES})) AS parts FROM a3 WHERE text <> ''),
k AS (SELECT page_id, i, {packed_sql('parts')} AS pieces FROM b),
f AS (SELECT page_id, flatten(list(pieces ORDER BY i)) AS all_pieces FROM k GROUP BY page_id)
SELECT page_id, unnest(range(len(all_pieces)))::INT AS chunk_index, unnest(list_transform(all_pieces, lambda x: trim(x))) AS text FROM f""",
)
def page_chunks(spark, sf):
    blocks = read_table(spark, sf, "pages").select("page_id", pages.html_blocks(F.col("html")).alias("blocks"))
    return blocks.select("page_id", F.posexplode(pack_sections(F.col("blocks"))).alias("chunk_index", "text"))


@query(
    "page_articles",
    f"""WITH {_ARTICLE}, n AS (SELECT page_id, any_value(url) AS url, any_value(html) AS html, count(*) AS n_blocks FROM a3 WHERE text <> '' GROUP BY page_id),
t AS (SELECT *, {_PATH} AS path, {squeeze_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title FROM n)
SELECT url AS page_url, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END AS uid, title, NULL::VARCHAR AS author, 'en-us' AS locale, n_blocks::INT AS n_blocks FROM t WHERE title <> ''""",
)
def page_articles(spark, sf):
    found = pages.articles(read_table(spark, sf, "pages"), BLOG, ORIGIN)
    return found.select("page_url", "uid", "title", "author", "locale", F.size("blocks").alias("n_blocks"))


def _app_pages(spark, sf):
    """Documents as pages with embedded data: a heading, a paragraph per line, one sample."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    key = F.col("doc_id").cast("string")
    paragraph = lambda line: F.to_json(F.struct(F.lit("p").alias("type"), F.array(F.struct(line.alias("text"))).alias("children")))
    children = F.concat(
        F.array(F.concat(F.lit('{"type":"h2","children":[{"text":"Part of "},{"text":"'), F.col("source"), F.lit('"}]}'))),
        F.transform(tx.lines(F.col("text")), paragraph),
        F.array(F.lit('{"type":"reference","attrs":{"content-type-uid":"code_panel","entry-uid":"c1"}}'),
                F.lit('{"type":"reference","attrs":{"content-type-uid":"media","entry-uid":"c2"}}')),
    )
    data = F.concat(
        F.lit('{"props":{"pageProps":{"page":{"_content_type_uid":"'), F.when(F.col("lang") == "es", "page").otherwise("blog_article"),
        F.lit('","uid":"u'), key, F.lit('","title":"T '), key, F.lit('","contributors":[{"title":"Ada"},{"title":"Bo"}],"entry_settings":{"published_date":"2026-05-20"},'),
        F.lit('"entry_content":[{"side_bar":{}},{"rich_text":{"json_rich_text":{"type":"doc","children":['), F.array_join(children, ","),
        F.lit(']}}}],"_embedded_items":{"x":[{"uid":"c1","entry_content":{"code_snippets":[{"language":"Text","code":'),
        F.element_at(F.split(F.to_json(F.struct(F.col("text").alias("t"))), "^.{4,5}:", 2), 2),
        F.lit("]}},{\"uid\":\"c2\"}]}}}}}"),
    )
    # to_json of {"t": text} minus its opening leaves the quoted text and one closing brace,
    # which closes the snippet object
    return docs.select(
        "doc_id", F.concat(F.lit(ORIGIN + BLOG), F.col("lang"), F.lit("/"), key).alias("url"),
        F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>")).alias("html"),
    )


@query(
    "rich_text_sections",
    f"""WITH d AS (SELECT * FROM documents WHERE lang <> 'es'), l AS (SELECT doc_id, source, {lines_sql('text')} AS rows, text FROM d),
u AS (SELECT doc_id, source, unnest(range(len(rows))) AS i, unnest(rows) AS row FROM l),
b AS (SELECT doc_id, source, i, 'prose' AS kind, {squeeze_sql('row')} AS text FROM u UNION ALL
  SELECT doc_id, source, 1000000000, 'code', 'Text' || chr(10) || {strip_sql('text')} FROM l WHERE {strip_sql('text')} <> '')
SELECT 'u' || doc_id AS uid, 'T ' || doc_id AS title, 'Ada, Bo' AS author, TIMESTAMP '2026-05-20' AS published_at,
  (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS block_no, 'Part of ' || source AS heading, kind, text FROM b WHERE text <> ''""",
)
def rich_text_sections(spark, sf):
    landed = materialize(_app_pages(spark, sf).select("url", "html"), "landed-pages")
    found = pages.articles(landed, BLOG, ORIGIN)
    # the outer form keeps Spark from testing the size of `blocks` by parsing the page again
    return found.select(
        "uid", "title", "author", "published_at", F.posexplode_outer("blocks").alias("block_no", "b")
    ).filter("block_no IS NOT NULL").select("uid", "title", "author", "published_at", "block_no", "b.*")


@query(
    "page_transcripts",
    f"""SELECT doc_id, CASE lang WHEN 'fr' THEN text WHEN 'es' THEN NULL WHEN 'de' THEN {strip_sql('text')} || '  end'
  ELSE {strip_sql('text')} END AS transcript FROM documents""",
)
def page_transcripts(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    lang, shown = F.col("lang"), escape_html(F.col("text"))
    data = F.replace(F.to_json(F.struct(F.col("text").alias("transcript"))), F.lit("</"), F.lit("<\\/"))
    linked = F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"))
    html = (
        F.when(lang == "fr", linked)
        .when(lang == "de", F.concat(F.lit('<section class="a Transcript b"><section>'), shown, F.lit("</section><p> end</p></section><section>no</section>")))
        .when(lang == "en", F.concat(F.lit('<div>before</div><div id="transcript">'), shown, F.lit("</div><div>after</div>")))
        .otherwise(F.concat(F.lit("<div>"), F.col("text"), F.lit("</div>")))
    )
    return docs.select("doc_id", pages.page_transcript(html).alias("transcript"))


# --- Markdown and repositories --------------------------------------------------------


@query(
    "markdown_passages",
    f"""WITH t AS (SELECT doc_id, translate(text, '#`>', '   ') AS text FROM documents),
b AS (SELECT doc_id, flatten(list_transform({sentences_sql(squeeze_sql('text'))}, lambda s: {SLICES})) AS parts FROM t WHERE {squeeze_sql('text')} <> ''),
k AS (SELECT doc_id, {packed_sql('parts')} AS pieces FROM b),
p AS (SELECT doc_id, unnest(range(len(pieces))) AS i, unnest(list_transform(pieces, lambda x: trim(x))) AS piece FROM k),
m AS (SELECT doc_id, i, CASE WHEN starts_with(piece, 'Page ' || doc_id) THEN piece ELSE 'Page ' || doc_id || '. ' || piece END AS text, NULL::VARCHAR AS code,
    NULL::VARCHAR AS language, 'Page ' || doc_id AS heading, 'page-' || doc_id AS anchor FROM p
  UNION ALL SELECT doc_id, 1000000000, 'Use: it. run_' || doc_id, 'run_' || doc_id || '()' || chr(10) || '# no heading', 'python', 'Use: it', 'use-it' FROM t)
SELECT doc_id, 'Page ' || doc_id AS title, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, text, code, language, heading, anchor FROM m""",
)
def markdown_passages(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    key = F.col("doc_id").cast("string")
    md = F.concat(
        F.lit("\n> For the whole index see elsewhere\n\n# Page "), key, F.lit("\n"), F.translate("text", "#`>", "   "),
        F.lit("\n## Use: it\n```python\nrun_"), key, F.lit("()\n# no heading\n"),
    )
    page = docs.select("doc_id", markdown.page_passages(md, "for the whole index").alias("page"))
    return page.select("doc_id", "page.title", F.posexplode("page.passages").alias("chunk_index", "p")).select(
        "doc_id", "title", "chunk_index", "p.*"
    )


_EXT = "CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.ts' ELSE '.txt' END"


def _files(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".md").when(F.col("lang") == "de", ".ts").otherwise(".txt")
    # every third file ends with a byte that is no UTF-8
    content = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("E9"))).otherwise(F.unhex(F.lit(""))))
    return docs.select(
        F.col("source").alias("repo"), F.concat(F.lit("src/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), ext).alias("path"),
        content.alias("content"), F.octet_length(content).cast("long").alias("length"),
    )


_FILES = f"""
fs AS (SELECT source AS repo, 'src/' || lang || '/d' || doc_id || {_EXT} AS path, {_EXT} AS ext, doc_id,
  text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END AS text, encode(text) || CASE WHEN doc_id % 3 = 0 THEN '\\xE9'::BLOB ELSE ''::BLOB END AS body FROM documents
  WHERE lang <> 'es' AND octet_length(encode(text)) <= 200000)"""


@query(
    "repo_files",
    f"""WITH {_FILES} SELECT repo, path, ext, CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' END AS language,
  sha1(encode('blob ' || octet_length(body) || chr(0)) || body) AS ref, text FROM fs""",
)
def repo_files(spark, sf):
    return repo.repo_files(_files(spark, sf))


@query(
    "file_descriptions",
    f"""WITH {_FILES}, w AS (SELECT path, list_distinct_ordered FROM (SELECT path, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]{{3,}}$')
   AND lower(t) NOT IN ({', '.join(f"'{k}'" for k in repo.KEYWORDS)})) AS list_distinct_ordered FROM fs)),
i AS (SELECT path, list_filter(list_distinct_ordered, lambda t, n: list_position(list_distinct_ordered, t) = n)[1:6] AS names FROM w)
SELECT path, path || CASE WHEN len(names) > 0 THEN '. defines ' || array_to_string(names, ', ') ELSE '' END || '. ' || 'This store keeps passages of ' || repo || ' and serves them to anyone.' AS description
FROM fs JOIN i USING (path)""",
)
def file_descriptions(spark, sf):
    files = repo.repo_files(_files(spark, sf))
    readme = F.concat(F.lit("# Store\n\nShort one.\n\nThis store keeps passages\nof "), F.col("repo"), F.lit(" and serves them to anyone.\n## Next\nmore"))
    return files.select("path", repo.description(repo.readme_lead(readme), F.col("path"), F.col("text")).alias("description"))


@query(
    "repo_readmes",
    f"WITH {_FILES} SELECT repo, arg_min(path, path) AS readme_path FROM fs WHERE ext = '.md' GROUP BY repo",
)
def repo_readmes(spark, sf):
    files = repo.repo_files(_files(spark, sf)).withColumn("text", F.col("path"))
    named = files.withColumn("path", F.when(F.col("ext") == ".md", F.regexp_replace("path", "/d", "/readme")).otherwise(F.col("path")))
    return repo.readmes(named).select("repo", F.col("readme").alias("readme_path"))


# The README of a repository is one short line here (a path), so that is its lead.
FILE_CTES = f"""{_FILES.strip()},
lead AS (SELECT repo, min(path) AS lead FROM fs GROUP BY repo),
w0 AS (SELECT path, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]{{3,}}$')
   AND lower(t) NOT IN ({', '.join(f"'{k}'" for k in repo.KEYWORDS)})) AS found FROM fs),
names AS (SELECT path, list_filter(found, lambda t, n: list_position(found, t) = n)[1:6] AS names FROM w0),
l AS (SELECT path, {lines_sql('text')} AS rows FROM fs WHERE ext <> '.md'),
s AS (SELECT path, rows, len(rows) AS n, list_transform(rows, lambda x: length(x)) AS sizes FROM l
  WHERE len(list_filter(rows, lambda x: {strip_sql('x')} <> '')) > 0),
w AS (
  SELECT path, 0::BIGINT AS off, 0::BIGINT AS took, 0::BIGINT AS next FROM s
  UNION ALL
  SELECT path, next, k, CASE WHEN next + k >= n THEN -1 ELSE next + greatest(1, k - 10) END FROM (
    SELECT w.path, w.next, s.n, greatest(1, len(list_filter(range(1, least(80, s.n - w.next) + 1),
      lambda c: list_sum(s.sizes[w.next + 1 : w.next + c]) + c - 1 <= 3500))) AS k
    FROM w JOIN s USING (path) WHERE w.next >= 0 AND (w.took = 0 OR w.next > 0)) q),
b AS (SELECT w.path, off, took, array_to_string(rows[off + 1 : off + took], chr(10)) AS body FROM w JOIN s USING (path) WHERE took > 0),
parts AS (SELECT path, off, CASE WHEN took = 1 THEN list_transform(range(greatest(1, ceil(length(body) / 3500.0))::BIGINT), lambda i: body[i * 3500 + 1 : (i + 1) * 3500]) ELSE [body] END AS p FROM b),
r AS (SELECT path, off, unnest(range(len(p))) AS k, regexp_replace(unnest(p), '^\\n+|\\n+$', '', 'g') AS code FROM parts),
code AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY off, k) - 1)::INT AS chunk_index, (off + 1)::INT AS start_line, code FROM r WHERE {strip_sql('code')} <> ''),
sents AS (SELECT path, flatten(list_transform({sentences_sql(squeeze_sql('text'))}, lambda s: {SLICES})) AS parts FROM fs WHERE ext = '.md' AND {squeeze_sql('text')} <> ''),
prose AS (SELECT path, {packed_sql('parts')} AS pieces FROM sents),
file_pieces AS (SELECT fs.repo, path, CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' END AS language, sha1(encode('blob ' || octet_length(body) || chr(0)) || body) AS ref, chunk_index,
  CASE WHEN chunk_index > 0 THEN path ELSE path || CASE WHEN len(names) > 0 THEN '. defines ' || array_to_string(names, ', ') ELSE '' END || '. ' || lead END AS text, code, start_line
FROM code JOIN fs USING (path) JOIN names USING (path) JOIN lead USING (repo)
UNION ALL
SELECT repo, path, NULL, sha1(encode('blob ' || octet_length(body) || chr(0)) || body), unnest(range(len(pieces)))::INT, {strip_sql('unnest(pieces)')}, NULL, NULL FROM prose JOIN fs USING (path))"""


@query("file_passages", f"WITH RECURSIVE {FILE_CTES} SELECT * FROM file_pieces")
def file_passages(spark, sf):
    files = repo.repo_files(_files(spark, sf))
    readmes = files.groupBy("repo").agg(F.min("path").alias("readme"))
    return repo.file_passages(files, readmes)


# --- links, clips, exports ------------------------------------------------------------


@query(
    "deep_links",
    """WITH t AS (SELECT 'post' AS type, doc_id::VARCHAR AS id, 'https://example.org/p/' || doc_id AS href FROM documents
UNION ALL SELECT CASE role WHEN 'user' THEN 'video' ELSE 'episode' END, conv_id || ' ' || turn, CASE WHEN role = 'user' THEN 'https://www.youtube.com/watch?v=' || conv_id || ' ' || turn || '&t=' || (turn * 65) || 's'
  WHEN turn % 3 = 0 THEN 'https://open.spotify.com/episode/sp' || conv_id || '?t=' || (turn * 65) WHEN turn % 3 = 1 THEN 'https://podcasts.apple.com/us/podcast/id77?i=' || conv_id || '&t=' || (turn * 65)
  ELSE 'https://app.example.org/listen?asset=' || conv_id || '%20' || turn || '&t=' || (turn * 65) END FROM conversations
UNION ALL SELECT 'doc', page_id::VARCHAR, 'https://example.org/docs/' || page_id || '#part-' || page_id FROM pages
UNION ALL SELECT 'file', p_partkey::VARCHAR, 'https://example.org/src/' || p_partkey || '#L' || p_size FROM part) SELECT * FROM t""",
)
def deep_links(spark, sf):
    none = F.lit(None).cast("string")

    def rows(df, kind, key, url, ms, line=None, anchor=None, **ids):
        return df.select(
            F.struct(kind.alias("type"), key.alias("id"), url.alias("url")).alias("asset"), attrs(**ids).alias("attrs"),
            ms.cast("long").alias("ms"), (F.lit(None) if line is None else line).cast("int").alias("line"), (none if anchor is None else anchor).alias("anchor"),
        )

    text = lambda name: F.col(name).cast("string")
    web = lambda part, name: F.concat(F.lit("https://example.org/" + part), text(name))
    docs = rows(read_table(spark, sf, "documents", "doc_id"), F.lit("post"), text("doc_id"), web("p/", "doc_id"), F.lit(None))
    is_user = F.col("role") == "user"
    third = F.col("turn") % 3
    talks = rows(
        read_table(spark, sf, "conversations", "conv_id", "turn", "role"), F.when(is_user, "video").otherwise("episode"),
        F.concat_ws(" ", text("conv_id"), text("turn")), none, F.col("turn") * 65000 + 999,
        spotify_episode_id=F.when(~is_user & (third == 0), F.concat(F.lit("sp"), text("conv_id"))),
        apple_track_id=F.when(~is_user & (third == 1), text("conv_id")), itunes_id=F.lit("77"),
    )
    books = rows(read_table(spark, sf, "pages", "page_id"), F.lit("doc"), text("page_id"), web("docs/", "page_id"), F.lit(None), anchor=F.concat(F.lit("part-"), text("page_id")))
    files = rows(read_table(spark, sf, "part", "p_partkey", "p_size"), F.lit("file"), text("p_partkey"), web("src/", "p_partkey"), F.lit(None), line=F.col("p_size"))
    every = docs.unionByName(talks).unionByName(books).unionByName(files)
    href = passage_link(F.col("asset"), F.col("attrs"), F.col("ms"), F.col("line"), F.col("anchor"), "https://app.example.org/")
    return every.select(F.col("asset.type").alias("type"), F.col("asset.id").alias("id"), href.alias("href"))


@query(
    "clip_pack",
    f"""WITH c AS (SELECT conv_id, turn, 'https://e.org/' || conv_id AS href, turn * 400000 // 1000 AS s, {strip_sql('text')} AS t FROM conversations),
e AS (SELECT conv_id, turn, (turn + 1) || '.' || chr(10) || href || chr(10) || 'Talk ' || conv_id || chr(10) || 'At ' ||
   CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END AS entry FROM c)
SELECT conv_id AS pack_id, (turn // 500)::INT AS page, string_agg(entry, chr(10) || chr(10) ORDER BY turn) AS text FROM e GROUP BY ALL""",
)
def clip_pack(spark, sf):
    title = F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))
    packs = read_table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        F.col("conv_id").alias("pack_id"), F.col("turn").alias("ord"), F.concat(F.lit("https://e.org/"), F.col("conv_id").cast("string")).alias("href"),
        title.alias("group_title"), title.alias("asset_title"), (F.col("turn") * 400000).alias("start_ms"), tx.strip(F.col("text")).alias("text"),
    )
    return clips.clip_pages(packs)


@query(
    "transcript_export",
    f"""WITH {CHUNKS}, a AS (SELECT DISTINCT doc_id, title FROM passages),
n AS (SELECT doc_id, title, regexp_replace(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_\\t-\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}-]', '', 'g'), '[-\\t-\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '-', 'g') AS safe_title FROM a),
h AS (SELECT doc_id, safe_title, unnest([0, 1, 2, 3, 4]) AS line_no, unnest(['Episode: ' || title, 'Date: Unknown', 'URL: u' || doc_id, repeat('-', 50), '']) AS line FROM n)
SELECT doc_id::VARCHAR AS asset_id, safe_title, line_no::INT AS line_no, line FROM h UNION ALL SELECT doc_id::VARCHAR, safe_title, (chunk_index + 5)::INT, text FROM passages JOIN n USING (doc_id)""",
)
def transcript_export(spark, sf):
    passages = document_passages(spark, sf)
    assets = passages.filter("chunk_index = 0").select(
        F.col("asset.id").alias("asset_id"), F.col("asset.title").alias("title"), F.lit(None).cast("string").alias("published"),
        F.concat(F.lit("u"), F.col("asset.id")).alias("url"),
    )
    return clips.transcript_lines(assets, passages.select(F.col("asset.id").alias("asset_id"), "chunk_index", "text"))


@query(
    "query_intake",
    f"""WITH r AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text END AS q, CASE WHEN item_id % 3 <> 0 THEN '  ' || text || chr(10) END AS query FROM benchmark)
SELECT item_id AS query_id, {strip_sql("coalesce(q, query, '')")} AS q FROM r WHERE {strip_sql("coalesce(q, query, '')")} <> ''""",
)
def query_intake(spark, sf):
    rows = read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("q"),
        F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("  "), F.col("text"), F.lit("\n"))).alias("query"),
    )
    return search_texts(rows)


@query(
    "asset_lookup",
    f"""WITH {CHUNKS}, m AS (SELECT max(doc_id::VARCHAR) AS id FROM passages)
SELECT DISTINCT 'post' AS type, doc_id::VARCHAR AS id, title, source AS parent_id, '' AS audio_url FROM passages JOIN m ON doc_id::VARCHAR = m.id""",
)
def asset_lookup(spark, sf):
    passages = document_passages(spark, sf)
    key = passages.agg(F.max("asset.id")).first()[0]
    return lookup_asset(passages, key).select(
        "asset.type", "asset.id", "asset.title", F.col("parent.id").alias("parent_id"), "audio_url"
    )


@query(
    "shaped_hits",
    f"""WITH {CHUNKS} SELECT passage_id, NULL::VARCHAR AS published_at, length(text)::DOUBLE AS score, '' AS audio_url, text FROM passages""",
)
def shaped_hits(spark, sf):
    hits = document_passages(spark, sf).withColumns({"score": F.length("text"), "match_types": F.lit(None).cast("array<string>")})
    return shape_hit(hits).select("passage_id", "published_at", "score", "audio_url", "text")
