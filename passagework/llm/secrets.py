"""Secrets in texts: named patterns and windows of high entropy."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import small_batches

#: Kinds in their order within one start.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A failing run of these two holds no shorter match, so the least length can be in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character classes: name, members, window, least bits per character.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 20, 3.0),
    ("alphanumeric", frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 24, 3.9),
    ("base64", frozenset("+/_=-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 24, 4.1),
)
LEAST_RUN = 20
#: Values between separators that hold one of these are placeholders or plain sequences; what stands beside them is not.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|redacted|dummy|0123456789|abcdefghij|qwertyuiop", re.I)
SEPARATORS = "/+_=-"
SEPARATOR = re.compile(r"[/+_=-]")
#: Runs that look random and are not secret: placeholders and ids in the usual forms.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i)[^/+_=-]*(example|placeholder|changeme|redacted|dummy)[^/+_=-]*",
    r"(?i)[^/+_=-]*(0123456789|abcdefghij|qwertyuiop)[^/+_=-]*",
    r"[0-9_/=+-]+",
    r"[A-Za-z]+([_/=+-][A-Za-z]+)*[0-9]{0,4}",
)


def dense(run: str, members: frozenset, window: int, bits: float) -> bool:
    """Whether some window of ``run`` inside one class has an entropy of ``bits`` or more.

    Counts change by one character in and one out; the sum of c*log2(c) follows them. A
    window must hold a digit and a letter, which plain words never do. A run shorter than
    the window is one window, with the same share of the highest entropy its length allows.
    """
    if len(run) < window:
        bits, window = bits * math.log2(len(run)) / math.log2(window), len(run)
    table = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    held, weight, digits = 0, 0.0, 0
    for i, new in enumerate(run):
        if new not in members:
            counts, held, weight, digits = {}, 0, 0.0, 0
            continue
        c = counts.get(new, 0)
        weight += table[c + 1] - table[c]
        counts[new] = c + 1
        held += 1
        digits += new.isdigit()
        if held > window:
            old = run[i - window]
            c = counts[old]
            weight += table[c - 1] - table[c]
            counts[old] = c - 1
            held -= 1
            digits -= old.isdigit()
        if held == window and 0 < digits < window and math.log2(window) - weight / window >= bits:
            return True
    return False


def placeholders_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Values between separators, inside text[start:end], that hold a ``PLACEHOLDER``.

    Each word found is widened to its separators, and the search goes on behind them, so
    every character is looked at a fixed number of times.
    """
    found, at = [], start
    while m := PLACEHOLDER.search(text, at, end):
        left = max([at, *(text.rfind(s, at, m.start()) + 1 for s in SEPARATORS)])
        right = SEPARATOR.search(text, m.end(), end)
        at = right.start() if right else end
        found.append((left, at))
    return found


def spans_of(text: str, raw: bytes, allowed: re.Pattern, placeholders: bool = True) -> list[tuple[int, int, int]]:
    """Spans (start, place of the kind, end) in their order, in code points."""
    found = []
    lowered = raw.lower()
    if any(name in lowered for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for s, _, e in found)
    starts, ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.end()
        if allowed.fullmatch(m[0]):
            continue
        taken = []
        if base:  # spans that end after the run's start and start before its end
            first, before = bisect_right(ends, start), bisect_left(starts, end)
            taken = base[first:before]
        if placeholders:
            taken = sorted(taken + placeholders_of(text, start, end))
        at = start
        for s, e in [*taken, (end, end)]:
            run = text[at:s]
            if len(run) >= LEAST_RUN and not allowed.fullmatch(run) and any(dense(run, *rule) for _, *rule in CLASSES):
                found.append((at, 3, s))
            at = max(at, e)
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def secret_spans(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Secrets of a text as an array of (kind, start, end), in code points, end exclusive.

    ``assign``, ``access`` and ``hex`` are patterns. ``entropy`` spans are runs of 20
    or more token characters, or the pieces of 20 or more that those and placeholder values
    (``PLACEHOLDER``, unless nothing is ``allowed``) leave of one, that match none of
    ``allowed`` and hold a window of high Shannon entropy in one of ``CLASSES``. Ordered by start, then kind.
    Null and empty texts have none. Whole texts are read; a task holds one batch.
    """
    pattern = "|".join(f"(?:{p.removeprefix('(?i)')})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in allowed) or r"(?!)"

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        rule = re.compile(pattern)
        names, starts, ends, offsets = [], [], [], [0]
        for value in texts:
            body = value.as_py()
            if body:
                for start, kind, end in spans_of(body, body.encode("utf-8", "surrogatepass"), rule, bool(allowed)):
                    names.append(KINDS[kind])
                    starts.append(start)
                    ends.append(end)
            offsets.append(len(names))
        parts = pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)

    return find(text)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Add the column ``into`` (``secret_spans``); a column of that name is replaced."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, secret_spans(F.col(text), allowed))


def redacted(text: Column, spans: Column, sign: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``sign``; overlapping spans become one. Null stays null.

    One pass over the spans in order: the state is the text so far and the end reached.
    """
    def step(state: Column, span: Column) -> Column:
        clear = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        fresh_span = span["start"] >= state["at"]
        done = F.when(fresh_span, F.concat(state["done"], clear, F.lit(sign))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    tail = F.reduce(spans, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.greatest(F.length(text) - s["at"], F.lit(0)))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(tail)


def span_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
