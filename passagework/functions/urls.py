"""URL parts, page predicates and ids found in links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present, strip

# Hosts that carry a video id.
VIDEO_HOSTS = (
    "youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "youtu.be",
)
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"


def url_path(url: Column) -> Column:
    """Path of a URL, or of a bare path. Never fails on odd input."""
    no_tail = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(no_tail, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def is_post_url(url: Column, prefix: str) -> Column:
    """Article below ``prefix``, not a channel listing and not the index page."""
    path = url_path(url)
    parts = path_parts(F.substr(path, F.lit(len(prefix) + 1)))
    return path.startswith(prefix) & (F.size(parts) > 0) & (F.try_element_at(parts, F.lit(1)) != "channel")


def is_current_docs_url(url: Column, prefix: str = "/docs/") -> Column:
    """Docs page with no path part that looks like a version (``v7.0``)."""
    parts = path_parts(url_path(url))
    return url_path(url).startswith(prefix) & ~F.exists(parts, lambda p: p.rlike(r"^[vV][0-9]"))


def slug(url: Column) -> Column:
    """Path with a leading slash and no trailing ones."""
    path = F.coalesce(present(url_path(url)), url)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path)


def channel(slug_col: Column, prefix: str) -> Column:
    """Section name in ``<prefix><channel>/<slug>``; null for a bare slug."""
    depth = len([part for part in prefix.split("/") if part])
    parts = path_parts(slug_col)
    return F.when(
        F.startswith(slug_col, F.lit(prefix)) & (F.size(parts) >= depth + 2),
        F.try_element_at(parts, F.lit(depth + 1)),
    )


def absolute(url: Column, origin: str) -> Column:
    rooted = F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(origin), rooted))


def product(url: Column) -> Column:
    """Book id of a docs page or of its sitemap."""
    parts = path_parts(url_path(url))
    parts = F.when(F.try_element_at(parts, F.lit(1)) == "docs", F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    parts = F.filter(parts, lambda p: ~p.isin("current", "sitemap-0.xml"))
    parts = F.when(
        F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).endswith(".xml"),
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
    ).otherwise(parts)
    return F.array_join(parts, "/")


def manual_title(product_col: Column, known: Mapping[str, str], default: str = "Docs") -> Column:
    """Known book titles first, otherwise the last path part in title case."""
    leaf = F.initcap(F.replace(F.substring_index(product_col, "/", -1), F.lit("-"), F.lit(" ")))
    fallback = F.when(leaf == "", F.lit(default)).otherwise(leaf)
    if not known:
        return fallback
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, product_col), fallback)


def markdown_url(url: Column, origin: str) -> Column:
    path = url_path(url)
    page = F.concat(F.lit(origin), F.regexp_replace(path, r"/+$", ""), F.lit(".md"))
    return F.when(path.endswith(".md"), url).otherwise(page)


def query_value(url: Column, key: str) -> Column:
    return present(F.regexp_extract(url_query(url), rf"(?:^|&){key}=([^&]*)", 1))


def video_id(value: Column) -> Column:
    """Video id from a watch, short, shorts, live or embed link, or a bare id; else null."""
    text = strip(value)
    host = F.regexp_replace(
        F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""
    )
    parts = path_parts(url_path(text))

    def after(marker: str) -> Column:
        at = F.array_position(parts, F.lit(marker)).cast("int")
        return F.when(at > 0, F.try_element_at(parts, at + 1))

    first = F.try_element_at(parts, F.lit(1))
    found = F.when(host == "youtu.be", first).otherwise(
        F.coalesce(query_value(text, "v"), after("embed"), after("shorts"), after("live"), after("v"))
    )
    found = F.substring_index(found, "&", 1)
    return F.when(text.rlike(VIDEO_ID), text).when(host.isin(*VIDEO_HOSTS) & found.rlike(VIDEO_ID), found)


def show_id(url: Column) -> Column:
    """Numeric show id in a store link."""
    return present(F.regexp_extract(url, r"/id([0-9]+)", 1))


def transcript_episode_id(url: Column) -> Column:
    """Episode id: second path part of a transcript file link, unless it is the file itself."""
    parts = F.split(F.regexp_replace(url_path(url), r"^/+|/+$", ""), "/")
    second = F.try_element_at(parts, F.lit(2))
    return F.when(
        (F.try_element_at(parts, F.lit(1)) != "") & ~second.isin("transcript.srt", "transcript"), second
    )


def anchor_episode_id(url: Column) -> Column:
    """Episode id in the ``-e1abc`` suffix of an episode link."""
    return present(F.regexp_extract(url_path(url), r"(?i)-(e[0-9a-z]+)/?$", 1))
