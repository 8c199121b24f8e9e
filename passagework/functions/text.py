"""Text helpers built from JVM string functions.

White space here means the Unicode set (tabs, line and file separators, no-break
space and the other space characters), which Java's ``\\s`` does not cover.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes valid both in Java and in RE2 patterns.
WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

MAX_FIELD_CHARS = 8000  # longest `text` or `code` a passage may hold
SNIPPET_CHARS = 420


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def present(c: Column) -> Column:
    """Null for null and for the empty string."""
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def lines(c: Column) -> Column:
    """Lines without their breaks; a trailing break adds no empty line."""
    def drop_last_blank(parts: Column) -> Column:
        return F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts)

    return bind(F.split(F.coalesce(c, F.lit("")), LINE_BREAK), drop_last_blank)


def sentences(squeezed: Column) -> Column:
    """Split squeezed text after a full stop, exclamation or question mark."""
    return F.split(squeezed, r"(?<=[.!?]) ")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _entity_table() -> Column:
    table = {f"&{name}": text for name, text in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def unescape_html(c: Column) -> Column:
    """Decode named (HTML5) and numeric character references in one pass."""
    ref = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    table = _entity_table()

    def decode(e: Column) -> Column:
        decimal = F.regexp_extract(e, r"^&#([0-9]+);$", 1)
        hexa = F.regexp_extract(e, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        code = F.when(decimal != "", decimal.try_cast("int")).when(
            hexa != "", F.conv(hexa, 16, 10).try_cast("int")
        )
        # big-endian UTF-32 bytes of the code point, decoded back to a string
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        numeric = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char)
        return F.coalesce(F.when(e.startswith("&#"), numeric).otherwise(F.try_element_at(table, e)), e)

    refs = F.regexp_extract_all(c, F.lit(ref), 0)
    gaps = F.split(c, ref)
    joined = F.array_join(
        F.zip_with(
            gaps,
            refs,
            lambda gap, e: F.concat(gap, F.when(e.isNull(), F.lit("")).otherwise(decode(e))),
        ),
        "",
    )
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def slugify_title(c: Column) -> Column:
    """Name safe for a file: drop punctuation, runs of space or dash become one dash."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}_\t-\r\x1c-\x1f\x{85}\p{Z}-]", "")
    return F.regexp_replace(kept, r"[-\t-\r\x1c-\x1f\x{85}\p{Z}]+", "-")


def heading_anchor(c: Column) -> Column:
    """Fragment id of a heading: lower case, punctuation dropped, dashes for spaces."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\t-\r\x1c-\x1f\x{85}\p{Z}-]", "")
    dashed = F.regexp_replace(kept, r"[_\t-\r\x1c-\x1f\x{85}\p{Z}]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def normal_title(c: Column) -> Column:
    """Title key for matching catalogs: squeezed and lower case."""
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def clock(ms: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``; empty when there is no time."""
    total = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    hours, minutes, secs = (total / 3600).cast("long"), ((total % 3600) / 60).cast("long"), total % 60
    text = F.when(
        hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, secs)
    ).otherwise(F.format_string("%d:%02d", minutes, secs))
    return F.when(ms.isNull(), F.lit("")).otherwise(text)


def iso_timestamp(c: Column) -> Column:
    """ISO date or date-time in UTC; anything else is null."""
    return F.try_to_timestamp(strip(c))


def mail_timestamp(c: Column) -> Column:
    """Mail-style date (``Mon, 02 Mar 2026 10:00:00 +0000``); anything else is null.

    The weekday is dropped because the parser refuses it; a missing zone is UTC and
    the old zone names keep their fixed offsets.
    """
    text = F.regexp_replace(squeeze(c), r"^[A-Za-z]{3,9},? ", "")
    # Zone names of the mail date format.
    zones = {
        "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "EST": "-0500", "EDT": "-0400",
        "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800",
        "PDT": "-0700",
    }
    for name, offset in zones.items():
        text = F.regexp_replace(text, f" {name}$", f" {offset}")
    text = F.when(text.rlike(r"[0-9]{2}:[0-9]{2}$|:[0-9]{2}:[0-9]{2}$"), F.concat(text, F.lit(" +0000"))).otherwise(text)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z")),
    )
