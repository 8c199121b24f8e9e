"""URL verdicts: host and path rules, and a character language-model ratio for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import fresh, without
from passagework.operators.common import join_sized as _join_sized
from passagework.operators.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
#: Chance of a character that no model has seen.
FLOOR = 1.0 / 1024
#: Bytes that each of the ten joins of one filter may broadcast; beyond, they shuffle.
BROADCAST_BYTES = 16 << 20


def join_sized(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return _join_sized(big, side, on, how, max_bytes=BROADCAST_BYTES)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict; null where none fits.

    A rule is a host and a path prefix in one string, split at its first slash.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _grams(strings: DataFrame, order: int, *keep: str) -> DataFrame:
    """One row per character of ``s``: the character with its ``order - 1`` predecessors, as ``g``.

    A string is cut into characters once, so a long one costs in proportion to its length.
    """
    padded = F.split(F.concat(F.lit(START * (order - 1)), F.col("s"), F.lit(END)), "")
    cut = strings.select(*keep, padded.alias("_chars"))
    places = F.sequence(F.lit(0), F.size("_chars") - order)
    gram = F.concat(*[F.get("_chars", F.col("_at") + i) for i in range(order)])
    return cut.select(*keep, "_chars", F.explode(places).alias("_at")).select(*keep, gram.alias("g"))


def ratio_table(known: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """``log p(accepted) - log p(rejected)`` of every gram that ``asked`` holds.

    ``known`` has (``g``, ``a``, ``r``): counts of the longest grams in accepted and
    rejected strings. Shorter grams are sums over their suffixes. Each order is smoothed
    with the one below by its number of distinct continuations (Witten-Bell), and a
    context that a model has never seen leaves the shorter one's probability as it is.
    """
    out = asked.select("g").distinct()
    for side in "ar":
        out = out.withColumn(f"p{side}", F.lit(FLOOR))
    for n in range(1, order + 1):
        gram = F.substring("g", order - n + 1, n)
        counts = materialize(known.groupBy(gram.alias("gram")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr")), "url-grams")
        seen = [F.sum("ca").alias("na"), F.sum("cr").alias("nr"), F.count_if(F.col("ca") > 0).alias("ta"), F.count_if(F.col("cr") > 0).alias("tr")]
        out = join_sized(out.withColumn("gram", gram), counts, ["gram"], "left").drop("gram")
        if n == 1:  # one empty context: four numbers
            row = counts.agg(*seen).first()
            out = out.select("*", *[F.lit(float(row[c] or 0)).alias(c) for c in ("na", "nr", "ta", "tr")])
        else:
            contexts = materialize(counts.groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(*seen), "url-contexts")
            out = join_sized(out.withColumn("context", F.substring("g", order - n + 1, n - 1)), contexts, ["context"], "left").drop("context")
        smoothed = []
        for side in "ar":
            count, total, kinds = (F.coalesce(F.col(c + side), F.lit(0.0)) for c in "cnt")
            p = F.when(total > 0, (count + kinds * F.col(f"p{side}")) / (total + kinds)).otherwise(F.col(f"p{side}"))
            smoothed.append(p.alias(f"p{side}"))
        out = out.select("g", *smoothed)
    return out.select("g", (F.log("pa") - F.log("pr")).alias("ratio"))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", order: int = 4, calibrate: int = 5
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``llr`` to every page.

    Urls with a rule have its verdict. They are also what the method learns from: two
    character models of variable order, one of accepted and one of rejected strings (host
    and path). A url without a rule is scored by the difference of its log-likelihoods per
    character (``llr``) and allowed at or above a threshold. The threshold is set on the
    strings of one fold of ``calibrate`` that the models haven't seen: the point between
    the two means that lies equally many standard deviations from either. Without
    rejected (accepted) strings everything (nothing) is allowed; without both, everything.

    Null urls and urls without ``://`` have an empty host and path and are judged as the
    empty string. Equal urls are scored once and joined back; repeated rows stay. An empty
    table gives an empty table. Columns with one of the added names, in upper or lower case, are replaced. All
    steps are DataFrame operations; a url's characters become rows, summed by the
    string's digest, so that a url of a million characters is cut in one pass and never repeated.
    """
    s, sid = fresh(pages, "_s", "_sid")
    kept = without(pages, ("host", "path", "rule", "verdict", "llr"))
    host, path = fresh(pages, "_host", "_path")
    parts = pages.select(*kept, host_of(F.col(url)).alias(host), path_of(F.col(url)).alias(path))
    rule, said = rule_of(F.col(host), F.col(path), rules)
    judged = parts.select(*kept, F.col(host).alias("host"), F.col(path).alias("path"), rule.alias("rule"), said.alias("verdict"), F.concat(host, path).alias(s)).withColumn(sid, F.sha2(F.col(s).cast("binary"), 256))
    strings = materialize(
        judged.groupBy(F.col(sid).alias("sid"), F.col(s).alias("s"), "verdict").agg(F.count("*").alias("n"))
        .withColumn("fold", F.pmod(F.crc32(F.col("s").cast("binary")), F.lit(calibrate))), "url-strings",
    )
    learned = strings.filter("verdict is not null and fold <> 0")
    weight = {side: F.when(F.col("verdict") == word, F.col("n")).otherwise(0) for side, word in (("a", "allow"), ("r", "block"))}
    known = materialize(_grams(learned, order, "verdict", "n").groupBy("g").agg(*[F.sum(w).alias(c) for c, w in weight.items()]), "url-known")
    asked = strings.filter("verdict is null or fold = 0")
    grams = materialize(_grams(asked, order, "sid", "verdict").groupBy("sid", "verdict", "g").agg(F.count("*").alias("k")), "url-asked")
    ratios = materialize(ratio_table(known, grams, order), "url-ratios")
    scores = materialize(
        join_sized(grams, ratios, ["g"]).groupBy("sid", "verdict").agg((F.sum(F.col("ratio") * F.col("k")) / F.sum("k")).alias("llr")), "url-scores"
    )
    of = {r["verdict"]: r for r in scores.filter("verdict is not null").groupBy("verdict").agg(F.avg("llr").alias("m"), F.stddev_pop("llr").alias("d")).collect()}
    taught = {r["verdict"] for r in learned.select("verdict").distinct().collect()}
    if {"allow", "block"} <= set(of):
        up, down = of["allow"], of["block"]
        spread = up["d"] + down["d"]
        threshold = (up["m"] * down["d"] + down["m"] * up["d"]) / spread if spread > 0 else (up["m"] + down["m"]) / 2
    else:
        threshold = 0.0
    guess = F.when(F.col("llr") >= threshold, "allow").otherwise("block")
    if "block" not in taught:
        guess = F.lit("allow")
    elif "allow" not in taught:
        guess = F.lit("block")
    open_scores = scores.filter("verdict is null").select(F.col("sid").alias(sid), "llr")
    out = join_sized(judged.drop(s), open_scores, [sid], "left")
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("rule").isNull(), guess)).alias("verdict"), "llr")
