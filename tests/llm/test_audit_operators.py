"""Whitening, decontamination and filter audit against brute force; names that clash, very long texts."""

import itertools
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import decontaminate, filter_audit, mixing, near_dups, secrets, sharding, toxicity, urls, whitening

# --- whitening ---------------------------------------------------------------------------


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, N string").repartition(3)


def _by_row(frame):
    out = defaultdict(dict)
    for r in frame.collect():
        out[r["vec_id"]][r["component"]] = r
    return out


@pytest.mark.parametrize("size,spare", [(5, 24), (40, 4), (40, 24)])
def test_whitening_equals_eigenvectors(spark, size, spare):
    rng = np.random.default_rng(size + spare)
    x = (rng.standard_normal((400, size)) * np.linspace(3, 1, size)).astype(np.float32)
    rows = [(i, [float(v) for v in row], "x") for i, row in enumerate(x)]
    rows += [(500, None, "x"), (501, [1.0, None] + [0.0] * (size - 2), "x"), (502, [float("nan")] * size, "x"), (503, [float("inf")] + [0.0] * (size - 1), "x"), (504, [], "x")]
    got = whitening.whiten(_vectors(spark, rows), 8, whitening.floored(1024, 100_000), spare=spare)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    own = _by_row(got)
    y = np.floor(1024.0 * x.astype(float)) + 100_000
    far = y - y.mean(0)
    value, vector = np.linalg.eigh(far.T @ far / len(y))
    k = min(8, size)
    assert set(own) == set(range(400)) and all(set(c) == set(range(1, k + 1)) for c in own.values())
    total = y.sum(0).astype(int)
    for j in range(1, k + 1):
        want = far @ vector[:, -j] / math.sqrt(value[-j])
        have = np.array([own[i][j]["whitened"] for i in range(400)])
        assert np.abs(have - want * np.sign(want @ have)).max() < 1e-6
        assert own[0][j]["explained"] == pytest.approx(value[-j] / value.sum(), rel=1e-9)
    for i in (0, 7, 399):
        assert own[i][1]["deviation"] == sum((400 * int(v) - int(t)) ** 2 for v, t in zip(y[i], total))
    assert 0 <= own[0][1]["identity_error"] < 1e-9


def test_whitening_of_large_numbers_repeated_rows_and_null_ids(spark):
    rows = [(1, [1e12, 0.0], "x"), (1, [-1e12, 1.0], "x"), (None, [3e11, 2.0], "x"), (2, [5e11, 2.0], "x"), (3, [1.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec string")
    got = whitening.whiten(frame, 1).collect()
    assert sorted((r["vec_id"] or 0, r["n"]) for r in got) == [(0, 4), (1, 4), (1, 4), (2, 4)]
    total = [int(8e11), 5]
    want = {sum((4 * int(v) - t) ** 2 for v, t in zip(vec, total)) for _, vec, _ in rows[:4]}
    assert {int(r["deviation"]) for r in got} == want


def test_whitening_of_nothing_and_of_equal_rows(spark):
    empty = _vectors(spark, [(1, [1.0, 2.0], "x")]).limit(0)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(_vectors(spark, [(i, [1.5, 2.0, 3.0], "x") for i in range(9)]), 8, whitening.floored(1024, 100_000)).collect() == []
    flat = _by_row(whitening.whiten(_vectors(spark, [(i, [float(i), 2.0, 3.0], "x") for i in range(9)]), 8, whitening.floored(1024, 0)))
    assert all(set(c) == {1} for c in flat.values()) and flat[0][1]["explained"] == pytest.approx(1)


# --- decontamination ---------------------------------------------------------------------


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _plain_hits(docs, items, window):
    out = []
    for doc_id, text in docs:
        words, hit, named = _words(text), set(), set()
        for item_id, body in items:
            own = _words(body)
            n = min(window, len(own))
            for a in range(len(own) - n + 1) if own else ():
                for b in range(len(words) - n + 1):
                    if words[b : b + n] == own[a : a + n]:
                        hit.update(range(b, b + n))
                        if item_id is not None:
                            named.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(named), sorted(named), bool(hit)))
    return out


def _leaks(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "Cd", "e\u00e9", "\u00c9e", "x1", "y", "z", "\u65e5\u672c", "q"])
    body = lambda n: "".join(word() + rng.choice([" ", ", ", "-", "\n", "\x00"]) for _ in range(n))
    items = [(i, body(rng.choice([1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(14)] + [(3, body(12)), (None, body(14)), (90, None), (91, ""), (92, " -- "), (10, "x1 x1 x1 x1 x1 x1 x1 x1 x1 x1")]
    docs = [(i, body(rng.choice([0, 1, 2, 6, 30, 80])) + (rng.choice(items)[1] or "") + body(rng.choice([0, 3]))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "..."), (5, docs[5][1]), (5, "another " + items[7][1]), (None, items[3][1]), (73, "x1 " * 3000), (74, "\u00c9E e\u00c9 \u00e9E")]
    return docs, items


@pytest.mark.parametrize("window,shingle,block", [(10, 3, 32 << 20), (4, 2, 1500)])
def test_decontamination_equals_brute_force(spark, window, shingle, block):
    docs, items = _leaks(window)
    frame = spark.createDataFrame([(*d, 9, "w") for d in docs], "doc_id long, text string, N_HIT int, win string").repartition(4)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, digest string")
    out = decontaminate.decontaminate(frame, bench, window=window, shingle=shingle, block_bytes=block)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    assert out.columns == ["doc_id", "text", "win", "n_words", "n_hit", "n_items", "items", "contaminated"]
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in out.collect()]
    key = lambda r: (str(r[0]), r[1:3], r[4])
    assert sorted(got, key=key) == sorted(_plain_hits(docs, items, window), key=key)
    assert sum(r[5] for r in got) > 20


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []
    row = decontaminate.decontaminate(docs, items.limit(0)).first()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["items"], row["contaminated"]) == (3, 0, 0, [], False)
    row = decontaminate.decontaminate(docs, items).first()
    assert (row["n_hit"], row["items"], row["contaminated"]) == (2, ["1"], True)


# --- filter audit ------------------------------------------------------------------------


def _plain_audit(docs, labels):
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > firsts[t],
        }
        parts[source or ""].append((i, fails))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in rows) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows),
                    sum(r[0] in good for r in gone), sum(r[0] in bad for r in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_filter_audit_equals_playing_every_order(spark):
    rng = random.Random(12)
    pool = ["".join(rng.choice(["aa ", "Bb ", "c\td ", "# ", "XYZ ", "\u00e9 ", "w%d " % rng.randint(0, 99)]) for _ in range(rng.choice([0, 3, 20, 60, 90]))) for _ in range(40)]
    docs = [(i, rng.choice([*pool, None, ""]), rng.choice(["s", "s", "s", "t", "", None])) for i in range(150)]
    docs += [(None, pool[0], "s"), (None, pool[0], "s"), (7, docs[7][1], docs[7][2]), (7, "other", "t"), (900, "w " * 100_000, "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (5000, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, DOCS int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in filter_audit.audit_filters(frame, marks).collect()}
    assert got == _plain_audit(docs, labels)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.limit(0), labels).collect() == []
    assert filter_audit.audit_filters(docs, labels).count() == 600


def test_potential_is_the_games(spark):
    """Differences of potentials add up to what a set removes, for every set."""
    rng = random.Random(5)
    v = [0] + [rng.randint(0, 50) for _ in range(31)]
    p = spark.createDataFrame([(v,)], "v array<long>").select(filter_audit.potentials(F.col("v"), 5).alias("p")).first()["p"]
    for s in range(1, 32):
        assert sum(p[s] - p[s & ~(1 << i)] for i in range(5) if s >> i & 1) == math.factorial(5) * v[s]


# --- all operators: clashing names, very long texts ---------------------------------------


def test_added_names_in_upper_case_are_replaced(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "old", "old", "old")], "page_id long, url string, HOST string, Llr string, _S string")
    assert urls.filter_urls(pages, [("allow", "org/")]).first()["verdict"] == "allow"
    docs = spark.createDataFrame([(i, f"some words {i}", "s", 1, 2, 3, 4, 5) for i in range(3)], "doc_id long, text string, source string, SIZE int, Shard int, Kept int, Score int, _Set int")
    assert mixing.mix(docs).count() == 3 and "SIZE" not in mixing.mix(docs).columns
    assert sharding.shard_documents(docs).count() == 3
    assert near_dups.near_duplicates(docs).count() == 3
    model = toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, label int"))
    assert toxicity.score_documents(docs, model).columns[-2:] == ["score", "predicted"]


def test_secrets_of_a_million_characters_without_a_break():
    rng = random.Random(1)
    allowed = re.compile("|".join(f"(?:{p})" for p in (a.removeprefix("(?i)") for a in secrets.ALLOWED)))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    run = "".join(rng.choices(letters, k=1_000_000))
    start = time.time()
    found = secrets.spans_of(run, run.encode(), allowed)
    assert any(kind == 3 for _, kind, _ in found) and time.time() - start < 60


@pytest.mark.parametrize("run", ["a/xEXAMPLEy/b", "example", "exampleexample", "k=dummy_example-z", "no", "x/redactedredacted+example="])
def test_placeholders_equal_the_pattern(run):
    want = [m.span() for m in re.compile(r"[^/+_=-]*(?:" + secrets.PLACEHOLDER.pattern + r")[^/+_=-]*", re.I).finditer(run)]
    assert secrets.placeholders_of(run, 0, len(run)) == want


def test_urls_of_a_million_characters(spark):
    rows = [(1, "http://a.org/x"), (2, "http://b.net/y"), (3, "http://c.info/" + "ab" * 500_000)]
    start = time.time()
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "org/"), ("block", "net/")]).collect()}
    assert got[1] == "allow" and got[2] == "block" and got[3] in ("allow", "block") and time.time() - start < 120


def test_pipeline_stages_keep_columns_called_like_their_helpers(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "password = abcdef123456", "en", "s", "own"), (2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, _secrets string")
    got = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, docs, str(tmp_path)).collect()}
    assert got[1]["_secrets"] == "own" and "abcdef123456" not in got[1]["text"] and got[2]["text"] is None
    assert corpus_pipeline.secret_scan(spark, docs.limit(0), str(tmp_path)).count() == 0
