"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import small_batches
from passagework.operators.common import materialize

ORDER = 4
UNITS_PER_STEP = 300_000
GRAMS_HELD = 1_000_000
FLOOR = 1.0 / 65536


def _letters() -> np.ndarray:
    """For each 16-bit unit: itself if it is (part of) a letter, else a space."""
    table = np.full(65536, 32, np.uint16)
    for i in range(65536):
        if 0xD800 <= i < 0xE000 or chr(i).isalpha():
            table[i] = i
    return table


def unit_steps(texts: pa.Array, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Grams of whole texts in bounded steps: (gram of each unit, its row, first row, rows).

    Texts are lower-cased; what is no letter becomes one space. A gram packs four 16-bit
    units, the last one lowest; before a text stand three empty units. A text longer than
    a step is a step of its own.
    """
    parts, sizes, first, held = [], [], 0, 0

    def flush() -> tuple[np.ndarray, np.ndarray, int, int]:
        units = letters[np.concatenate(parts)] if held else np.empty(0, np.uint16)
        row = np.repeat(np.arange(len(sizes)), sizes)
        gap = units == 32
        again = gap & np.concatenate(([True], (gap[:-1]) & (row[1:] == row[:-1]))) if held else gap
        if held:  # a space that opens a text goes too
            opens = np.concatenate(([True], row[1:] != row[:-1]))
            again |= gap & opens
        units, row = units[~again].astype(np.uint64), row[~again]
        gram = units.copy()
        for back in (1, 2, 3):
            if len(units) > back:
                same = row[back:] == row[:-back]
                gram[back:] |= np.where(same, units[:-back], 0) << np.uint64(16 * back)
        return gram.view(np.int64), row, first, len(sizes)

    for i, value in enumerate(texts):
        body = value.as_py()
        raw = np.frombuffer((body or "").lower().encode("utf-16-le", "surrogatepass"), np.uint16)
        if held and held + len(raw) > UNITS_PER_STEP:
            yield flush()
            parts, sizes, first, held = [], [], i, 0
        parts.append(raw)
        sizes.append(len(raw))
        held += len(raw)
    if sizes:
        yield flush()


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Counts of four-unit grams by language over all rows: ``lang``, ``gram``, ``n``.

    Each task adds up its steps by sorting and passes on its sums, at the latest when they
    are ``GRAMS_HELD``; Spark adds up the tasks.
    """
    small_batches(labelled.sparkSession)

    def count(batches):
        letters, held = _letters(), {}

        def told():
            for lang, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for gram, _, _, _ in unit_steps(texts, letters):
                    keys, n = np.unique(gram, return_counts=True)
                    if lang in held:
                        had, counts = held[lang]
                        keys, place = np.unique(np.concatenate((had, keys)), return_inverse=True)
                        n = np.bincount(place, np.concatenate((counts, n))).astype(np.int64)
                    held[lang] = keys, n.astype(np.int64)
            if sum(len(keys) for keys, _ in held.values()) > GRAMS_HELD:
                yield from told()
                held.clear()
        yield from told()

    return labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Models:
    """Kneser-Ney models of all languages in sorted arrays of packed grams.

    ``tables`` has all grams. The log probabilities of the most frequent ones, at most
    ``max_cells`` in all, are laid up; the others are evaluated when a text has them, to
    the same values.
    """

    def __init__(self, langs: list[str], tables: dict, discounts: dict, max_cells: int = 20_000_000):
        self.langs, self.tables, self.discounts = langs, tables, discounts
        top = [tables[lang, ORDER][:2] for lang in langs]
        self.keys = np.unique(np.concatenate([keys for keys, _ in top])) if top else np.empty(0, np.int64)
        most = max_cells // max(1, len(langs))
        if len(self.keys) > most:
            seen = np.zeros(len(self.keys))
            for keys, counts in top:
                seen[np.searchsorted(self.keys, keys)] += counts
            self.keys = self.keys[np.sort(np.argsort(-seen, kind="stable")[:most])]
        self.logs = self.evaluate(self.keys)

    @staticmethod
    def _find(keys: np.ndarray, values: tuple[np.ndarray, ...], asked: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(asked)) for _ in values]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[at] == asked
        return [np.where(hit, v[at], 0.0) for v in values]

    def evaluate(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last unit of each gram under every language."""
        plain, out = grams.view(np.uint64), np.empty((len(grams), len(self.langs)), np.float32)
        for k, lang in enumerate(self.langs):
            p = np.full(len(grams), FLOOR)
            for order in range(1, ORDER + 1):
                suffix = plain & np.uint64(2 ** (16 * order) - 1)
                keys, counts, contexts, totals, kinds = self.tables[lang, order]
                (count,) = self._find(keys, (counts,), suffix.view(np.int64))
                total, kind = self._find(contexts, (totals, kinds), (suffix >> np.uint64(16)).view(np.int64))
                d = self.discounts[lang, order]
                seen = np.maximum(total, 1.0)
                p = np.where(total > 0, (np.maximum(count - d, 0) + d * kind * p) / seen, p)
            out[:, k] = np.log(np.maximum(p, 1e-30))
        return out

    def score(self, texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log probability by row and language, and the rows' numbers of units."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for gram, row, first, rows in unit_steps(texts, letters):
            if not len(gram):
                continue
            at = np.minimum(np.searchsorted(self.keys, gram), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == gram if len(self.keys) else np.zeros(len(gram), bool)
            for k in range(len(self.langs)):
                sums[first : first + rows, k] += np.bincount(row[hit], self.logs[at[hit], k], rows)
            if not hit.all():
                rare, back = np.unique(gram[~hit], return_inverse=True)
                logs = self.evaluate(rare)
                for k in range(len(self.langs)):
                    sums[first : first + rows, k] += np.bincount(row[~hit], logs[back, k], rows)
            sizes[first : first + rows] += np.bincount(row, minlength=rows)
        return sums / np.maximum(sizes, 1)[:, None], sizes


def train(labelled: DataFrame, max_cells: int = 20_000_000) -> Models:
    """Models from all rows of ``labelled`` (``lang``, ``text``) whose language is not null.

    Counts, continuation counts and discounts are Spark aggregations over every text. The
    driver gets all distinct grams and contexts with their counts, 16 and 24 bytes each;
    ``max_cells`` bounds only the log probabilities that are laid up for the frequent ones.
    """
    grams = materialize(gram_counts(labelled.filter("lang is not null and text is not null")), "lang-grams")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    tables, discounts = {}, {}
    counts = grams
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # in how many different grams one longer it stands
            suffix = F.col("gram").bitwiseAND(F.lit(2 ** (16 * order) - 1))
            counts = materialize(counts.groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")), "lang-grams")
        context = F.shiftrightunsigned("gram", 16)
        contexts = counts.groupBy("lang", context.alias("gram")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        few = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()
        whole = [df.toPandas() for df in (counts, contexts)]
        for row in few:
            discounts[row["lang"], order] = row["one"] / (row["one"] + 2 * row["two"]) if row["one"] and row["two"] else 0.5
        for lang in langs:
            a, b = (df[df["lang"] == lang].sort_values("gram") for df in whole)
            tables[lang, order] = (
                a["gram"].to_numpy(np.int64), a["n"].to_numpy(float), b["gram"].to_numpy(np.int64), b["n"].to_numpy(float), b["kinds"].to_numpy(float)
            )
    return Models(langs, tables, discounts, max_cells)


PREDICTION = "struct<lang:string,score:double,cross_entropy:double,units:long>"


def predicted(spark, models: Models, text: Column) -> Column:
    """Language, confidence, cross-entropy (nats a unit) and length of a text.

    The language is the one of the lowest length-normalised cross-entropy, ties to the
    first by name. The confidence is the share of its likelihood among all languages,
    taken at 30 units or the text's length if shorter. Null texts and texts without a
    letter are ``und`` with confidence 0 and no cross-entropy.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(models)

    @F.arrow_udf(PREDICTION)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, letters = shared.value, _letters()
        for texts in batches:
            means, sizes = known.score(texts, letters)
            blank = sizes == 0
            if not known.langs:
                best, share, entropy = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                blank[:] = True
            else:
                best = means.argmax(1)
                scaled = (means - means.max(1, keepdims=True)) * np.minimum(sizes, 30)[:, None]
                share, entropy = 1 / np.exp(scaled).sum(1), -means.max(1)
            names = ["und" if b else known.langs[i] for b, i in zip(blank, best)]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.where(blank, 0.0, share)), pa.array(entropy, mask=blank), pa.array(sizes)],
                ["lang", "score", "cross_entropy", "units"],
            )

    return run(text)


def rejection_levels(spark, labelled: DataFrame, models: Models, deviations: float = 8.0) -> dict[str, tuple[float, float]]:
    """Highest cross-entropy accepted by language: mean + ``deviations`` * deviation / sqrt(share of length).

    Calibrated on all labelled texts; see ``levels_of``.
    """
    said = labelled.select("lang", predicted(spark, models, F.col("text")).alias("p"))
    return levels_of(said, models.langs, deviations)


def levels_of(said: DataFrame, langs: list[str], deviations: float = 8.0) -> dict[str, tuple[float, float]]:
    """(mean, spread of a text of 100 units) by language from ``lang`` and the prediction ``p`` of labelled texts.

    Only texts predicted as they are labelled count. Deviations are from the language's own
    mean, so differences of length alone are none. A language without such a text gets the
    mean and spread of all; without any such text there are no levels.
    """
    x, s = F.col("p.cross_entropy"), F.sqrt(F.least(F.col("p.units"), F.lit(400)) / 100)  # deviations shrink with the root of the length: bring all to 100 units
    right = said.filter("p.lang = lang and p.cross_entropy is not null")
    means = {r["lang"]: r["m"] for r in right.groupBy("lang").agg(F.avg("p.cross_entropy").alias("m")).collect()}
    if not means:
        return {}
    mean = F.create_map(*[F.lit(v) for pair in sorted(means.items()) for v in pair])[F.col("lang")]
    sums = right.withColumn("_off", (x - mean) * s).groupBy("lang").agg(F.count("*").alias("n"), F.stddev_pop("_off").alias("d")).collect()
    levels = {r["lang"]: (means[r["lang"]], deviations * max(r["d"] or 0.0, 0.05)) for r in sums}
    n = sum(r["n"] for r in sums)
    pooled = sum(r["n"] * means[r["lang"]] for r in sums) / n, deviations * max((sum(r["n"] * (r["d"] or 0.0) ** 2 for r in sums) / n) ** 0.5, 0.05)
    return {lang: levels.get(lang, pooled) for lang in langs}


def rejected(prediction: Column, levels: dict[str, tuple[float, float]]) -> Column:
    """True for ``und`` and for texts whose cross-entropy lies beyond their language's level."""
    out = prediction["lang"] == "und"
    scale = F.sqrt(F.least(F.greatest(prediction["units"], F.lit(1)), F.lit(400)) / 100)
    for lang, (mean, spread) in sorted(levels.items()):
        out = out | ((prediction["lang"] == lang) & (prediction["cross_entropy"] > mean + spread / scale))
    return out
