"""Sources: inputs are made from lists of parts, and what comes back must be these parts."""

import hashlib
import json
import random
from datetime import datetime, timedelta, timezone
from xml.sax.saxutils import escape, quoteattr

import pytest
from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.functions import urls
from passagework.functions.packing import pack_sections
from passagework.sources import captions, feeds, markdown, pages, repo, sitemaps

NOUNS = "harbour lantern ferry tide anchor gull rope buoy kelp dock".split()


def words(rng, n):
    return " ".join(rng.choice(NOUNS) for _ in range(n))


# --- captions -------------------------------------------------------------------------


def _clock(ms, mark, hours=True):
    h, rest = divmod(ms, 3_600_000)
    m, rest = divmod(rest, 60_000)
    s, ms = divmod(rest, 1000)
    return (f"{h:02d}:" if hours or h else "") + f"{m:02d}:{s:02d}{mark}{ms:03d}"


@pytest.mark.parametrize("kind, breaks", [("srt", "\n"), ("srt", "\r\n"), ("vtt", "\n")])
def test_subtitles_give_back_their_cues(value, kind, breaks):
    rng, at, cues = random.Random(kind + breaks), 0, []
    for _ in range(25):
        start = at + rng.randint(0, 900_000)
        at = start + rng.randint(1, 9_000)
        cues.append((start, at, words(rng, rng.randint(0, 6))))
    mark = "," if kind == "srt" else "."
    blocks = ["WEBVTT", "NOTE nothing to see"] if kind == "vtt" else []
    for i, (start, end, text) in enumerate(cues):
        shown = text.replace("gull", "<i>gull</i>").replace(" tide ", "\ntide ")
        head = [str(i + 1)] if kind == "srt" else [f"cue {i}"] * (i % 2)
        setting = " align:end" if kind == "vtt" else ""
        blocks.append("\n".join([*head, f"{_clock(start, mark, kind == 'srt')} --> {_clock(end, mark, kind == 'srt')}{setting}", shown]))
    body = ("﻿" if kind == "srt" else "") + "\n\n".join(blocks).replace("\n", breaks)
    got = [(c.start_ms, c.end_ms, c.text) for c in value(captions.subtitle_cues, body)]
    assert got == [c for c in cues if c[2]]
    assert value(captions.subtitle_text, body) == " ".join(c[2] for c in cues if c[2])


def test_subtitle_lines_of_digits_stay_text(value):
    body = "7\n00:00:03,500 --> 00:00:04,000\n1815\nbuoys 3.5\n\nlost block without a stamp"
    assert [tuple(c) for c in value(captions.subtitle_cues, body)] == [(3500, 4000, "1815 buoys 3.5")]
    assert value(captions.subtitle_cues, "") == []


def test_caption_events_and_segments(spark, value):
    rng = random.Random(2)
    events, want = [], []
    for i in range(12):
        parts = [words(rng, 1) + " " for _ in range(rng.randint(0, 3))]
        events.append({"tStartMs": i * 70, "dDurationMs": 50, "segs": [{"utf8": p} for p in parts]})
        if parts:
            want.append((i * 70, i * 70 + 50, "".join(parts).strip()))
    assert [tuple(c) for c in value(captions.caption_json_cues, json.dumps({"events": events + [{"dDurationMs": 1}]}))] == want
    assert value(captions.caption_json_cues, "no json") == []
    said = json.dumps({"segments": [{"start": 0.25, "end": 0.75, "text": "\tkelp  rope "}, {"start": 4.0, "text": "dock"}, {"text": ""}, {"start": -3.0, "end": 1.0, "text": "gull"}]})
    parsed = value(lambda t: captions.segment_cues(F.from_json(t, captions.SEGMENTS_JSON)["segments"]), said)
    assert [tuple(c) for c in parsed] == [(250, 750, "kelp rope"), (4000, 4000, "dock"), (0, 1000, "gull")]
    df = spark.createDataFrame([([(1.5, 2.0, "tide  in"), (None, 1.0, "rope"), (9.0, 1.0, " ")],)], "s array<struct<start:double,duration:double,text:string>>")
    assert [tuple(c) for c in df.select(captions.snippet_cues(F.col("s")).alias("v")).first().v] == [(1500, 3500, "tide in"), (0, 1000, "rope")]


# --- feeds and sitemaps ---------------------------------------------------------------


def test_feed_items(spark, tmp_path):
    rng, base, items, want = random.Random(4), datetime(2019, 5, 4, 6, 7, 8, tzinfo=timezone.utc), [], {}
    for i in range(30):
        guid, title = (f"g{i}" if i % 5 else ""), (words(rng, 2) + " & <co>" if i % 7 else "  ")
        day = base + timedelta(days=rng.randint(0, 2000))
        dated, audio, told = i % 3 > 0, i % 4 > 0, i % 2 > 0
        parts = [f"<guid>{guid}</guid>", f"<title>{escape(escape(title))}</title>", f"<link>https://pod.example/{i}-e{i:03x}q</link>"]
        parts += [f"<pubDate>{day:%a, %d %b %Y %H:%M:%S +0000}</pubDate>"] * dated
        parts += [f"<enclosure url={quoteattr(f'https://cdn.example/{i}.ogg?a=1&b=2')} type='audio/ogg'/>"] * audio
        parts += [f"<podcast:transcript url='https://text.example/show9/ep{i}/transcript.srt'/>"] * told
        items.append("<item>" + "".join(parts) + "</item>")
        if guid and title.strip():
            want[guid] = (
                title, day.replace(tzinfo=None) if dated else None, f"https://cdn.example/{i}.ogg?a=1&b=2" if audio else "",
                f"ep{i}" if told else None, f"e{i:03x}q",
            )
    name = "Tide Talk"
    (tmp_path / "a.xml").write_text(
        f"<rss xmlns:podcast='urn:1' xmlns:itunes='urn:2'><channel><title> {name} </title><itunes:author>Quay Crew</itunes:author>{''.join(items)}</channel></rss>"
    )
    got = {r.guid: (r.title, r.published_at, r.audio_url, r.spotify_episode_id, r.anchor_id) for r in feeds.episodes(feeds.read_items(spark, str(tmp_path))).collect()}
    assert got == want
    assert [(c.show_title, c.author) for c in feeds.read_channels(spark, str(tmp_path)).collect()] == [(name, "Quay Crew")]


def test_audio_link_and_show_id(spark, value):
    df = spark.createDataFrame([("", [("h1", "text/html"), ("h2", "audio/ogg"), ("h3", "audio/mp3")]), ("own", []), (None, [("h", None)])], "e string, l array<struct<href:string,type:string>>")
    assert [r.v for r in df.select(feeds.first_audio_link(F.col("e"), F.col("l")).alias("v")).collect()] == ["h2", "own", None]
    assert value(urls.show_id, "https://shop.example/gb/podcast/tide-talk/id00420?x=id7") == "00420"
    assert value(urls.show_id, "https://shop.example/gb/podcast/idle") is None


def test_sitemaps_of_several_files(spark, tmp_path):
    """Paths put together at random; which are posts is said by the parts they are made of."""
    rng, want = random.Random(8), set()
    for f in range(3):
        rows = []
        for i in range(20):
            section = rng.choice(["journal/", "journal/sailing/", "journal/channel/", "shop/", "journalism/"])
            leaf, day = rng.choice(["", f"n{f}-{i}", f"n{f}-{i}/"]), rng.choice([None, f"2021-0{rng.randint(1, 9)}-15"])
            rows.append(f"<url><loc> https://sea.example/{section}{leaf} </loc>" + (f"<lastmod>{day}T10:00:00Z</lastmod>" if day else "") + "</url>")
            inside = section in ("journal/", "journal/sailing/")
            if inside and (leaf or section != "journal/"):
                want.add((f"/{section}{leaf}".rstrip("/"), day))
        (tmp_path / f"{f}.xml").write_text("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(rows) + "</urlset>")
    got = sitemaps.post_entries(sitemaps.read_entries(spark, str(tmp_path)), "/journal/")
    assert {(r.slug, r.lastmod) for r in got.collect()} == want


def test_docs_pages(spark, value):
    current = ["/docs/rigging", "/docs/rigging/knots/", "/docs/charts/current/north", "/docs/vessels/a"]
    versioned = ["/docs/rigging/v2/knots", "/docs/charts/V10.1/a", "/docs/v3"]
    for path in current + versioned + ["/blog/docs/a", "/doc/a"]:
        assert value(urls.is_current_docs_url, f"https://sea.example{path}") is (path in current), path
    assert value(urls.product, "https://sea.example/docs/charts/current/sitemap-0.xml") == "charts"
    assert value(urls.product, "https://sea.example/docs/deck/sails/sitemap-0.xml") == "deck/sails"
    titles = {"charts": "Sea Charts"}
    assert [value(lambda c: urls.manual_title(c, titles), p) for p in ("charts", "deck/storm-sails", "")] == ["Sea Charts", "Storm Sails", "Docs"]
    entries = spark.createDataFrame(
        [(f"https://sea.example/docs/{p}", d) for p, d in (("rope/", None), ("rope/a?print=1", None), ("ropes/a", None), ("rope/v1/a", None), ("rope/a", "2020-02-02T01:01"))],
        "loc string, lastmod string",
    )
    assert {(r.slug, r.lastmod, r.product) for r in sitemaps.page_entries(entries, F.lit("rope")).collect()} == {("/docs/rope", None, "rope"), ("/docs/rope/a", "2020-02-02", "rope")}
    assert value(tx.heading_anchor, "  Où est l'Île?  (2nd_try) ") == "où-est-lîle-2nd-try"


def test_video_ids(value):
    rng = random.Random(6)
    for _ in range(6):
        key = "".join(rng.choices("ABCxyz019_-", k=11))
        good = [key, f"https://youtu.be/{key}", f"http://www.youtube.com/watch?list=L1&v={key}", f"https://music.youtube.com/watch?v={key}#x",
                f"https://youtube.com/shorts/{key}/", f"https://m.youtube.com/live/{key}?f=1", f"https://www.youtube-nocookie.com/embed/{key}"]
        bad = [key[:10], f"https://youtu.be.example/{key}", f"https://sea.example/watch?v={key}", "https://youtube.com/@crew", f"https://youtu.be/{key}x"]
        assert [value(urls.video_id, g) for g in good] == [key] * len(good)
        assert [value(urls.video_id, b) for b in bad] == [None] * len(bad)


# --- pages ----------------------------------------------------------------------------


def _app(page):
    return f'<script id="__NEXT_DATA__">{json.dumps({"props": {"pageProps": {"page": page}}})}</script>'


def _leaf(text):
    return {"text": text}


def test_rich_text_pages_made_from_blocks(spark):
    """A tree is built from known blocks, nested at random; the blocks come back in order."""
    rng, rows, want = random.Random(10), [], {}
    for n in range(8):
        blocks, children, heading = [], [], None
        for i in range(rng.randint(1, 12)):
            kind = rng.choice(["h2", "h3", "p", "li", "code", "lost"])
            text = words(rng, 3)
            if kind in ("h2", "h3"):
                heading = text
                node = {"type": kind, "children": [_leaf(text)]}
            elif kind in ("code", "lost"):
                node = {"type": "reference", "attrs": {"content-type-uid": "code_panel" if kind == "code" else "image", "entry-uid": f"k{n}-{i}"}}
                if kind == "code":
                    blocks.append((heading, "code", f"rs\nlet a = {i};"))
            else:
                cut = text.split(" ", 1)
                node = {"type": kind, "children": [_leaf(cut[0] + " "), {"type": "a", "children": [_leaf(cut[1])]}]}
                blocks.append((heading, "prose", text))
            for _ in range(rng.randint(0, 3)):  # wrapped so deep
                node = {"type": "box", "children": [node]}
            children.append(node)
        items = [{"uid": f"k{n}-{i}", "entry_content": {"code_snippets": [{"language": "rs", "code": f"let a = {i};\n"}, {"language": "x"}]}} for i in range(12)]
        page = {"_content_type_uid": "blog_article", "uid": f"u{n}", "title": f"Title {n}", "url": f"journal/sailing/{n}/", "contributors": [{"title": "Mo"}, {}],
                "entry_content": [{"rich_text": {"json_rich_text": {"children": children}}}, {"other": 1}], "_embedded_items": {"a": items[:6], "b": items[6:]}}
        rows.append((f"https://sea.example/{n}", _app(page)))
        want[f"u{n}"] = blocks
    rows += [("x1", _app({"_content_type_uid": "page", "uid": "no", "title": "no"}) + "<title>t</title><article><p>no</p></article>"), ("x2", _app({"_content_type_uid": "blog_article", "uid": "only"}))]
    got = pages.articles(spark.createDataFrame(rows, "url string, html string"), "/journal/", "https://sea.example").collect()
    assert {a.uid: [tuple(b) for b in a.blocks] for a in got} == want
    assert {(a.author, a.channel, a.published_at) for a in got} == {("Mo", "sailing", None)}
    assert {a.url for a in got} == {f"https://sea.example/journal/sailing/{n}" for n in range(8)}


def test_html_pages_made_from_blocks(spark):
    rng, rows, want = random.Random(12), [], {}
    tag = {"prose": "p", "code": "pre", "heading": "h3", "item": "li"}
    for n in range(6):
        body, blocks, heading = [], [], None
        for _ in range(rng.randint(1, 10)):
            kind, text = rng.choice(list(tag)), words(rng, 2) + rng.choice(["", " & <x>", " é"])
            inner = escape(text).replace("kelp", "<em class='p'>kelp</em>").replace("é", "&eacute;")
            body.append(f"<{tag[kind].upper()} id='a'>\n{inner}\n</{tag[kind]}>" + rng.choice(["", "<script>if (a<b) '<p>no</p>'</script>", "<!-- <p>no</p> -->", "<svg><p>no</p></svg>"]))
            if kind == "heading":
                heading = text
            else:
                blocks.append((heading, "code" if kind == "code" else "prose", text))
        linked = {"@graph": [{"@type": "WebPage"}, {"@type": "BlogPosting", "name": f"Name {n}", "datePublished": f"2022-03-0{n + 1}T00:00:00Z", "author": [{"name": "Mo"}, "Bea"]}]}
        data = f"<script type='application/ld+json'>oops {{</script><script type='application/ld+json'>{json.dumps(linked)}</script>" if n % 2 else ""
        rows.append((f"https://sea.example/journal/n{n}/", f"<title>Tab {n} | Sea</title>{data}<p>outside</p><article class=x>{''.join(body)}</article>"))
        if blocks:
            want[f"/journal/n{n}"] = (f"Name {n}" if n % 2 else f"Tab {n}", "Mo, Bea" if n % 2 else None, datetime(2022, 3, n + 1) if n % 2 else None, blocks)
    rows.append(("https://sea.example/journal/none", "<p>no article</p>"))
    got = pages.articles(spark.createDataFrame(rows, "url string, html string"), "/journal/", "https://sea.example", "Sea").collect()
    assert {a.uid: (a.title, a.author, a.published_at, [tuple(b) for b in a.blocks]) for a in got} == want


def test_blocks_without_end_tag_and_second_article(value):
    html = "<article><p>kept</p><p>open <b>bold</b></article><article><li>more</li></article>"
    assert [b.text for b in value(pages.html_blocks, html)] == ["kept"]
    assert [b.text for b in value(pages.html_blocks, "<article><p>one</p></article>-<article><li>two</li></article>")] == ["one", "two"]
    blocks = [("Knots", "prose", "A bowline."), (None, "code", "tie()")]
    assert value(lambda t: pack_sections(F.from_json(t, pages.BLOCKS)), json.dumps([dict(zip(("heading", "kind", "text"), b)) for b in blocks])) == ["Knots. A bowline.", "tie()"]


def test_transcript_runs_to_the_end_of_its_element(value):
    rng = random.Random(14)

    def nested(depth):
        inside = words(rng, 1) if depth == 0 else "".join(f"<{t}>{nested(depth - 1)}</{t}>" for t in rng.choices(["div", "p", "section"], k=2))
        return inside

    for tag, mark in (("div", 'class="deck transcript-body"'), ("section", 'lang="en" class="Transcript"'), ("div", 'id="transcript"')):
        inner = nested(3)
        html = f"<{tag}>before</{tag}><{tag.upper()} {mark}>{inner}</{tag}><{tag}>after</{tag}></body>"
        got = value(pages.page_transcript, html)
        assert "".join(got.split()) == "".join(__import__("re").sub("<[^>]+>", "", inner).split())
    assert value(pages.page_transcript, '<div class="transcript"><div>one</div><div>two</div></div>').split() == ["one", "two"]
    assert value(pages.page_transcript, '<div class="transcript"><div>never closed</div>') is None
    assert value(pages.page_transcript, '<div class="notes">x</div>') is None
    both = '<div class="transcript">marked</div><script type="application/ld+json">{"transcript": "linked \\u0026 data"}</script>'
    assert value(pages.page_transcript, both) == "linked & data"


# --- Markdown and repositories --------------------------------------------------------


def test_markdown_pages_made_from_sections(value):
    rng = random.Random(16)
    for n in range(6):
        out, want, heading = [f"# Guide {n}", ""], [], f"Guide {n}"
        for i in range(rng.randint(1, 8)):
            kind = rng.choice(["heading", "prose", "code"])
            if kind == "heading":
                heading = f"Part {words(rng, 1)} {i}"
                out.append("#" * rng.randint(2, 4) + f" {heading}")
            elif kind == "prose":
                text = words(rng, 4) + "."
                out += [text, ""]
                if want and want[-1][1] is None and want[-1][2] == heading and out[-3:-2] == [""]:
                    want[-1] = (want[-1][0] + " " + text, None, heading)
                else:
                    want.append((f"{heading}. {text}", None, heading))
            else:
                code = f"# note {i}\nmoor_{i}(rope)"
                out += [f"```{'py' if i % 2 else ''}", code, "```"]
                want.append((f"{heading}. note", code, heading))
        page = value(lambda t: markdown.page_passages(t, "full index"), "\n> Full INDEX elsewhere\n\n" + "\n".join(out))
        assert page.title == f"Guide {n}"
        assert [(p.text, p.code, p.heading) for p in page.passages] == want


def test_markdown_fences(value):
    page = value(markdown.page_passages, "intro\n```c\nint a;\n```c\n## inside\n```\nouter\n```\nleft open")
    assert [(p.text, p.code, p.language) for p in page.passages] == [("intro", None, None), ("int", "int a;\n```c\n## inside", "c"), ("outer", None, None), ("left", "left open", None)]
    assert value(markdown.file_texts, "lead\n## Sails\njib\n##\nmain") == ["lead", "Sails. jib", "main"]
    long = "x" * 2500
    assert "".join(value(markdown.file_texts, f"# H\n{long}")).replace("H. ", "") == long


def test_repository_files(spark, tmp_path):
    keep = {"README.md": "# Sloop\n\nToo short.\n\nSloop moors small boats in crowded harbours at night.\n", "lib/moor.go": "func Moor(b Boat) {}\nfunc Cast(b Boat) {}\n", "lib/UP.TSX": "let a"}
    drop = {"dist/a.js": "not wanted", "pnpm-lock.yaml": "not wanted", "LICENSE": "not wanted"}
    for name, body in (keep | drop).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "zero.py").write_bytes(b"\x01\x00")
    (tmp_path / "large.rs").write_bytes(b"/" * 200_001)
    (tmp_path / "latin.py").write_bytes("s = 'caf\xe9'\n".encode("latin-1"))
    files = repo.read_repo(spark, str(tmp_path), "crew/sloop")
    rows = {r.path: r for r in repo.repo_files(files).collect()}
    assert set(rows) == {*keep, "latin.py"} and rows["latin.py"].text == "s = 'caf�'\n"
    for name, body in keep.items():
        assert rows[name].ref == hashlib.sha1(f"blob {len(body)}\0{body}".encode()).hexdigest() and rows[name].text == body
    assert (rows["lib/UP.TSX"].language, rows["README.md"].language) == ("typescript", None)
    assert {r.path: r.reason for r in repo.skipped_files(files).collect()} == {**drop, "zero.py": "binary", "large.rs": "too large"}
    hidden = spark.createDataFrame([("r", p, bytearray(b"x"), 1) for p in ("a/.b.c", "x/.cache/a.py", "a/b.c")], "repo string, path string, content binary, length long")
    assert [r.path for r in repo.repo_files(hidden).collect()] == ["a/b.c"]
    readme = repo.readmes(repo.repo_files(files))
    assert [tuple(r)[2] for r in readme.collect()] == ["Sloop"]
    got = {(p.path, p.chunk_index): (p.text, p.start_line) for p in repo.file_passages(repo.repo_files(files), readme).collect()}
    assert got["lib/moor.go", 0] == ("lib/moor.go. defines func, Moor, Boat, Cast. Sloop moors small boats in crowded harbours at night.", 1)
    assert got["lib/moor.go", 1] == ("lib/moor.go Cast", 2)


def test_descriptions(value):
    assert value(lambda t: repo.identifiers(t, 2), "void moor_4(x); int abc; moor_4 keel ñkeel") == ["moor_4", "keel"]
    long = " ".join(NOUNS * 12)
    lead = value(repo.readme_lead, f"# T\n\nshort one\n\n{long}\n")
    assert len(lead) <= 320 and long.startswith(lead + " ") and len(long.split()[len(lead.split())]) + len(lead) >= 320
    assert value(repo.readme_lead, "\n\nonly this\n") == "only this"
    say = lambda given: value(lambda t: repo.description(F.lit("Lead."), F.lit("a/b.py"), t, F.lit(given)), "def hoist(): pass")
    assert say("Can  hoist it.") == "Can hoist it."
    assert say("Something else.") == "a/b.py. defines hoist, pass. Lead."


# --- plans that repeat no work --------------------------------------------------------


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_time_stamp_is_looked_for_once(spark):
    files = spark.createDataFrame([("1\n00:00:01,000 --> 00:00:02,500\n<b>buoy</b>",)], "t string")
    cues = captions.explode_cues(files, captions.subtitle_cues(F.col("t")), "t")
    assert [(r.start_ms, r.end_ms, r.text) for r in cues.collect()] == [(1000, 2500, "buoy")]
    assert _plan(cues).count("RLIKE") <= 2


def test_names_of_a_file_are_looked_for_once(spark):
    files = spark.createDataFrame([("lead", "a.py", "hull = keel + hull")], "lead string, path string, t string")
    told = files.select(repo.description(F.col("lead"), F.col("path"), F.col("t")).alias("d"))
    assert told.first()["d"] == "a.py. defines hull, keel. lead"
    assert _plan(told).count("{3,}") == 1


def test_blocks_of_a_page_are_parsed_once(spark, tmp_path):
    from checks.sources import rich_text_sections

    spark.createDataFrame([(1, "One line\n\ntwo", "en", "src1", 13), (2, "no", "es", "src1", 2)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = rich_text_sections(spark, str(tmp_path))
    assert sorted((r.block_no, r.kind, r.text) for r in found.collect()) == [(0, "prose", "One line"), (1, "prose", "two"), (2, "code", "Text\nOne line\n\ntwo")]
    assert "Filter ((size(flatten" not in _plan(found) and "size(blocks" not in _plan(found)
