"""Greedy packing of text pieces inside one row, as array columns.

Every function takes and returns array columns, so a whole document, page or file is
packed where it lies, without a shuffle. Cues of one asset are spread over many rows
and are packed by :mod:`passagework.operators.cues` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MAX_FIELD_CHARS, bind, lines, sentences, squeeze, strip

CHUNK_CHARS = 900
WINDOW_LINES = 80
WINDOW_OVERLAP = 10
WINDOW_CHARS = 3500

# What starts a top-level symbol, and which group holds its name.
SYMBOL = (
    r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|def|func|fn)\s+([A-Za-z_][A-Za-z0-9_]*)"
    r"|^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*="
)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def slices_of(c: Column, size: int) -> Column:
    """Consecutive slices of ``size`` characters covering the whole string."""
    count = F.greatest(F.ceil(F.length(c) / size).cast("int"), F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substr(c, i * size + 1, F.lit(size))
    )


def pack(pieces: Column, cap: int, joiner: str) -> Column:
    """Join neighbours with ``joiner`` while the result stays within ``cap`` characters."""
    empty = F.struct(F.lit("").alias("open"), no_strings().alias("done"))

    def add(state: Column, piece: Column) -> Column:
        current, done = state["open"], state["done"]
        fits = F.length(current) + len(joiner) + F.length(piece) <= cap
        return (
            F.when(current == "", F.struct(piece.alias("open"), done.alias("done")))
            .when(fits, F.struct(F.concat(current, F.lit(joiner), piece).alias("open"), done.alias("done")))
            .otherwise(F.struct(piece.alias("open"), F.concat(done, F.array(current)).alias("done")))
        )

    def close(state: Column) -> Column:
        return F.when(state["open"] == "", state["done"]).otherwise(
            F.concat(state["done"], F.array(state["open"]))
        )

    return F.aggregate(pieces, empty, add, close)


def pack_prose(text: Column, cap: int = CHUNK_CHARS, overflow: str = "split") -> Column:
    """Sentences packed up to ``cap`` characters.

    A sentence longer than ``cap`` becomes several pieces. ``overflow="truncate"`` keeps
    only its first ``cap`` characters instead; that loses text and must be asked for.
    """

    def packed(body: Column) -> Column:
        pieces = sentences(body)
        if overflow == "split":
            pieces = F.flatten(F.transform(pieces, lambda s: slices_of(s, cap)))
        else:
            pieces = F.transform(pieces, lambda s: F.left(s, F.lit(cap)))
        return (
            F.when(body == "", no_strings())
            .when(F.length(body) <= cap, F.array(body))
            .otherwise(pack(pieces, cap, " "))
        )

    return bind(squeeze(F.coalesce(text, F.lit(""))), packed)


def pack_code(code: Column, cap: int = CHUNK_CHARS) -> Column:
    """Lines packed up to ``cap`` characters, breaks kept, overlong lines cut hard."""

    def packed(body: Column) -> Column:
        pieces = F.flatten(F.transform(lines(body), lambda line: slices_of(line, cap)))
        return (
            F.when(body == "", no_strings())
            .when(F.length(body) <= cap, F.array(body))
            .otherwise(pack(pieces, cap, "\n"))
        )

    return bind(F.regexp_replace(F.coalesce(code, F.lit("")), r"^\n+|\n+$", ""), packed)


def with_heading(heading: Column, piece: Column) -> Column:
    """Put the section heading before a piece that does not start with it already.

    A heading with which the piece would not fit a passage is left to its own column.
    """
    head = strip(F.coalesce(heading, F.lit("")))
    body = strip(F.coalesce(piece, F.lit("")))
    text = F.when((head == "") | F.startswith(body, head), body).otherwise(
        strip(F.concat(head, F.lit(". "), body))
    )
    return F.when(F.length(text) <= MAX_FIELD_CHARS, text).otherwise(body)


def pack_sections(blocks: Column, cap: int = CHUNK_CHARS, overflow: str = "split") -> Column:
    """Texts of ``blocks`` (array of struct heading, kind, text) in reading order."""

    def one(block: Column) -> Column:
        pieces = F.when(block["kind"] == "code", pack_code(block["text"], cap)).otherwise(
            pack_prose(block["text"], cap, overflow)
        )
        return F.transform(pieces, lambda p: with_heading(block["heading"], p))

    return F.filter(F.flatten(F.transform(blocks, one)), lambda t: t != "")


def symbol_name(line: Column) -> Column:
    head = strip(line)
    return F.nullif(F.concat(F.regexp_extract(head, SYMBOL, 1), F.regexp_extract(head, SYMBOL, 2)), F.lit(""))


_PIECE = "array<struct<code:string,start_line:int,symbol:string>>"


def window_lines(
    rows: Column,
    symbol: Column,
    first_line: Column,
    max_lines: int = WINDOW_LINES,
    overlap: int = WINDOW_OVERLAP,
    max_chars: int = WINDOW_CHARS,
) -> Column:
    """Overlapping windows over an array of lines.

    A window shortened by ``max_chars`` moves the next one back accordingly, so no line
    is skipped: each start is the previous start plus the lines taken minus ``overlap``.
    A single line over ``max_chars`` becomes several pieces with the same first line.
    """
    total = F.size(rows)

    def taken(at: Column) -> Column:
        zero = F.struct(F.lit(-1).alias("chars"), F.lit(0).alias("n"), F.lit(True).alias("ok"))

        def count(s: Column, line: Column) -> Column:
            chars = s["chars"] + 1 + F.length(line)
            ok = s["ok"] & (chars <= max_chars)
            return F.struct(
                F.when(ok, chars).otherwise(s["chars"]).alias("chars"),
                F.when(ok, s["n"] + 1).otherwise(s["n"]).alias("n"),
                ok.alias("ok"),
            )

        return F.aggregate(F.slice(rows, at + 1, F.lit(max_lines)), zero, count, lambda s: s["n"])

    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))

    def step(s: Column, at: Column) -> Column:
        def emit(n: Column) -> Column:
            ends = at + n >= total
            return F.struct(
                F.when(ends, total).otherwise(at + F.greatest(F.lit(1), n - overlap)).alias("next"),
                F.concat(s["out"], F.array(F.struct(at.alias("at"), n.alias("n")))).alias("out"),
            )

        return F.when(at == s["next"], bind(F.greatest(taken(at), F.lit(1)), emit)).otherwise(s)

    spans = F.when(total == 0, F.array().cast("array<struct<at:int,n:int>>")).otherwise(
        F.aggregate(F.sequence(F.lit(0), total - 1), zero, step, lambda s: s["out"])
    )

    def render(span: Column) -> Column:
        body = F.array_join(F.slice(rows, span["at"] + 1, span["n"]), "\n")
        bodies = F.when(span["n"] == 1, slices_of(body, max_chars)).otherwise(F.array(body))
        return F.transform(
            bodies,
            lambda part: F.struct(
                F.regexp_replace(part, r"^\n+|\n+$", "").alias("code"),
                (first_line + span["at"]).cast("int").alias("start_line"),
                symbol.cast("string").alias("symbol"),
            ),
        )

    return F.filter(F.flatten(F.transform(spans, render)), lambda p: strip(p["code"]) != "").cast(_PIECE)


def pack_source(
    source: Column,
    max_lines: int = WINDOW_LINES,
    overlap: int = WINDOW_OVERLAP,
    max_chars: int = WINDOW_CHARS,
) -> Column:
    """Source cut on top-level symbols, then on line windows.

    Returns ``array<struct<code, start_line, symbol>>``; ``start_line`` counts from 1.
    Fewer than two symbols means windows only.
    """

    def windows(rows: Column, symbol: Column, first_line: Column) -> Column:
        return window_lines(rows, symbol, first_line, max_lines, overlap, max_chars)

    def cut(rows: Column) -> Column:
        total = F.size(rows)
        marks = F.filter(
            F.transform(rows, lambda line, i: F.struct(i.alias("at"), symbol_name(line).alias("name"))),
            lambda m: m["name"].isNotNull(),
        )

        def segments(marks: Column) -> Column:
            ends = F.concat(
                F.transform(F.slice(marks, F.lit(2), F.size(marks)), lambda m: m["at"]),
                F.array(total),
            )
            head = F.struct(F.lit(0).alias("at"), marks[0]["at"].alias("end"), F.lit(None).cast("string").alias("name"))
            tail = F.zip_with(
                marks, ends, lambda m, e: F.struct(m["at"].alias("at"), e.alias("end"), m["name"].alias("name"))
            )
            return F.filter(F.concat(F.array(head), tail), lambda s: s["end"] > s["at"])

        def split(marks: Column) -> Column:
            return F.when(F.size(marks) < 2, windows(rows, F.lit(None), F.lit(1))).otherwise(
                F.flatten(
                    F.transform(
                        segments(marks),
                        lambda s: windows(
                            F.slice(rows, s["at"] + 1, s["end"] - s["at"]), s["name"], s["at"] + 1
                        ),
                    )
                )
            )

        return bind(marks, split)

    return bind(lines(source), cut)
