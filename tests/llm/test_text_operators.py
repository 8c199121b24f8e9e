"""BPE, language identification, secrets, toxicity and URL filter against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagework.llm import bpe, langid, secrets, toxicity, urls

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  \n\t ", "a", "plain words, here.", "tabs\t\tand\r\nlines \n\n end  ", "it's we'll I'D 'sx", "x<|endoftext|>y  <|endoftext|>",
    "ümlaut é́ 日本語　全角 １２３ ½ ²", "😀😀 zero​width", "\x1c\x1d sep\x85nel", "0123456789 3.14 -- ... !!", "plain words, here.", "long " * 30_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").repartition(3)


def test_bpe_equals_the_library_and_round_trips(spark, odd):
    own = Tokenizer.from_file(BPE)
    for words in (1, 200_000):  # nearly all words beyond the table, and none
        got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(odd, BPE, words=words), BPE).collect()}
        for i, text in enumerate(ODD):
            want = own.encode(text or "", add_special_tokens=False).ids
            assert got[i]["ids"] == want
            assert got[i]["decoded"] == own.decode(want, skip_special_tokens=False)


def test_bpe_empty_table_null_and_unknown_ids(spark, odd):
    assert bpe.encode(odd.limit(0), BPE).count() == 0
    ids = spark.createDataFrame([([15496, None, 99_999_999, 11],), (None,), ([],), ([447],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(ids, BPE).collect()] == ["Hello,", None, "", "�"]


def _texts(seed, syllables, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40))) for _ in range(n)]


LANGS = {"aa": ["the", "ing", "and", "wh"], "bb": ["que", "ción", "ado", "ll"], "cc": ["sch", "ung", "ein", "ü"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(lang, t) for lang, parts in LANGS.items() for t in _texts(lang, parts, 80)]
    return spark.createDataFrame([*rows, (None, "the"), ("aa", None)], "lang string, text string").repartition(4)


def test_language_held_out_and_edges(spark, labelled):
    models = langid.train(labelled)
    asked = [(lang, t) for lang, parts in LANGS.items() for t in _texts(lang + "held", parts, 30)]
    edges = [("und", None), ("und", ""), ("und", "12 -- 7!"), ("aa", "The WHING"), ("bb", "cióncióning " * 30_000), ("aa", "the")]
    df = spark.createDataFrame([*asked, *edges], "lang string, text string").withColumn("score", F.lit("clash"))
    rows = df.select("lang", langid.predicted(spark, models, F.col("text")).alias("p")).collect()
    assert all(r["p"]["lang"] == r["lang"] for r in rows)
    assert all(0 <= r["p"]["score"] <= 1 for r in rows)
    assert [r["p"]["score"] for r in rows if r["lang"] == "und"] == [0, 0, 0]


def test_language_counts_and_probabilities(spark, labelled):
    """Gram counts against a loop; each context's probabilities add up to one."""
    want = Counter()
    for row in labelled.filter("lang is not null and text is not null").collect():
        text = re.sub(r"[\W\d_]+", " ", row["text"].lower()).lstrip()
        padded = "\0\0\0" + text
        want.update((row["lang"], padded[i : i + 4]) for i in range(len(text)))
    got = {(r["lang"], r["gram"]): r["n"] for r in langid.gram_counts(labelled.filter("lang is not null and text is not null")).collect()}
    pack = lambda g: int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in g), "big")
    assert got == {(lang, pack(g)): n for (lang, g), n in want.items()}
    models = langid.train(labelled)
    units = np.arange(1, 65536, dtype=np.int64)
    for context in ("the", "zzz"):
        grams = (pack("\0" + context) << 16) | units
        assert np.exp(models.evaluate(grams).astype(float)).sum(0) == pytest.approx(1, abs=2e-3)


def test_language_rejection_keeps_ordinary_texts(spark, labelled):
    models = langid.train(labelled)
    levels = langid.rejection_levels(spark, labelled.filter("lang is not null and text is not null"), models)
    fine = [(True, t) for lang, parts in LANGS.items() for t in _texts(lang + "new", parts, 20)]
    rng = random.Random(5)
    noise = [(False, " ".join("".join(rng.choices("xqzjvkжщъ漢字", k=6)) for _ in range(40))) for _ in range(10)]
    df = spark.createDataFrame([*fine, *noise, (False, None), (False, "")], "keep boolean, text string")
    p = df.select("keep", langid.predicted(spark, models, F.col("text")).alias("p"))
    assert all(r["keep"] != r["gone"] for r in p.select("keep", langid.rejected(F.col("p"), levels).alias("gone")).collect())


def test_language_without_labels(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    models = langid.train(empty)
    df = spark.createDataFrame([("text",)], "text string")
    assert df.select(langid.predicted(spark, models, F.col("text")).alias("p")).first()["p"]["lang"] == "und"


SECRET_TEXTS = [
    None, "", "no secrets here", 'PassWord = "abcdefghij.kl" end', "token:short1 token=abcdefABCDEF123", "api_key=x apikey: 0123456789abcdef!",
    "AKIAABCDEFGHIJKLMN and AKIAABC", "deadbeefdeadbeef deadbeef", "secret=" + "0123456789abcdef" * 2, "to\u212aen=abcdefghijklm", "é token=ÄÖabcdefghijklm",
    "q7Zp3Xv9Lk2Wn8Rt5Yb1Hs4Df6Gj0Mc", "internationalization-of-things-and-more-words", "550e8400-e29b-41d4-a716-446655440000", "x=" + "Zq9" * 40,
    "a" * 200_000, "k8Jd2 " * 5 + "Tz4qW9xB7nM2vR5kL8pY3cF6hJ1d/+gS" + "\nPASSWORD:AAAAAAAAAAAA",
]


def _plain_spans(text):
    """Base spans by the contract's own wording; entropy by counting every window anew."""
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    ):
        out += [(m.start(), secrets.KINDS.index(kind), m.end()) for m in re.compile(pattern, re.A).finditer(text) if len(m[group]) >= least]
    taken = [(s, e) for s, _, e in out]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(s < m.end() and m.start() < e for s, e in taken) or any(re.fullmatch(p, m[0]) for p in secrets.ALLOWED):
            continue
        for _, members, window, bits in secrets.CLASSES:
            parts = ["".join(g) for g in re.findall("[" + re.escape("".join(sorted(members))) + "]+", m[0])]
            windows = (p[i : i + window] for p in parts if len(set(p)) > 1 for i in range(len(p) - window + 1))
            if any(
                0 < sum(c.isdigit() for c in w) < window and -sum(n / window * math.log2(n / window) for n in Counter(w).values()) >= bits - 1e-9 for w in windows
            ):
                out.append((m.start(), 3, m.end()))
                break
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_against_plain_scan_and_redaction(spark):
    df = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string").withColumn("secrets", F.lit(1)).repartition(3)
    found = secrets.find_secrets(df)
    rows = found.select("doc_id", "text", secrets.span_text(F.col("secrets")).alias("s"), secrets.redacted(F.col("text"), F.col("secrets")).alias("r")).collect()
    assert len(rows) == len(SECRET_TEXTS)
    assert any("entropy" in r["s"] for r in rows)
    for r in rows:
        assert r["s"] == _plain_spans(r["text"] or "")
        if r["text"] is None:
            assert r["r"] is None
            continue
        cut, at = "", 0
        for span in filter(None, r["s"].split(",")):
            _, start, end = span.split(":")
            if int(start) >= at:
                cut += r["text"][at : int(start)] + "[SECRET]"
            at = max(at, int(end))
        assert r["r"] == cut + r["text"][at:]


def test_secrets_empty_table(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "text string")).count() == 0


def _plain_kernel(a, b, marked=True):
    """Gap-weighted subsequences of three characters, by three loops; ``a`` without marks if not ``marked``."""
    def features(word, marked=True):
        s, out = f"\x02{word}\x03" if marked else word, defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    x, y = features(a, marked), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y) or 1)


def test_toxicity_kernel_against_loops():
    marks = ["idiot", "worthless", "aaaa", "ab", "überall"]
    words = ["idiot", "idiiot", "idixot", "worthles", "aaaaaa", "b", "überal", "zebra", "id" * 40]
    got = toxicity.Kernel(marks).values(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            k = _plain_kernel(w, m)
            want = math.exp((k - 1) / toxicity.SHARP) if k >= toxicity.LEAST else 0
            assert got[i, j] == pytest.approx(want, abs=1e-4)


def test_toxicity_held_out_and_inserted_characters(spark):
    rng = random.Random(3)
    clean = _texts("t", ["the", "ing", "an", "re", "wh", "st"], 400)
    rows = [(i, t + (" " + rng.choice(["grumwit", "snarlface", "blobhead"]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(900, 1), (None, 1), (5, None)], "doc_id long, label int")
    model = toxicity.train(docs, labels)
    more = [(1000, "the gru.mwit ing"), (1001, "so s n a r l f a c e an"), (1002, "the blobbhead ing"), (1003, "ing " * 50_000)]
    asked = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(asked, model).collect()}
    assert sum(got[i] == y for i, _, y in rows if i % 3 == 0) >= 0.97 * sum(1 for i, *_ in rows if i % 3 == 0)
    assert [got[i] for i in (900, 901, 1000, 1001, 1002, 1003)] == [0, 0, 1, 1, 1, 0]


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, label int"))
    row = toxicity.score_documents(docs, model).first()
    assert 0 <= row["score"] < 0.3 and row["predicted"] == 0
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


RULES = [("allow", "org/"), ("block", "bad.org/x"), ("block", "net/")]


def test_url_parts_rules_and_odd_urls(spark):
    cases = [
        ("http://A.B.Org/Path?q=1", "a.b.org", "/Path", "org/"), ("https://bad.org/xy#f", "bad.org", "/xy", "bad.org/x"),
        ("https://sub.bad.org/X", "sub.bad.org", "/X", "org/"), ("//org/", "", "", None), (None, "", "", None), ("", "", "", None),
        ("ftp://org", "org", "", None), ("x://borg/a", "borg", "/a", None), ("a://b://c/d", "b:", "//c/d", None), ("http://net/a\nb", "net", "/a\nb", "net/"),
        ("http://net/" + "z" * 5_000, "net", "/" + "z" * 5_000, "net/"), ("http://A.B.Org/Path?q=1", "a.b.org", "/Path", "org/"),
    ]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in urls.filter_urls(df, RULES).collect()}
    assert len(got) == len(cases)
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block")
        if rule:
            assert got[i]["verdict"] == {r: v for v, r in RULES}[rule]
    assert urls.filter_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_url_ratio_against_recursion(spark):
    """The table's log ratios against a recursive Witten-Bell model."""
    order, counts = 3, {"a": Counter(), "r": Counter()}
    for side, strings in (("a", ["good/abc", "good/abd"]), ("r", ["evil/xyz", "good/xyz"])):
        for s in strings:
            padded = "\x02\x02" + s + "\x03"
            counts[side].update(padded[i : i + order] for i in range(len(s) + 1))
    known = spark.createDataFrame([(g, counts["a"][g], counts["r"][g]) for g in counts["a"] | counts["r"]], "g string, a long, r long")
    asked = [*(counts["a"] | counts["r"]), "qqq", "goq", "xgo"]

    def p(side, gram):
        n = len(gram)
        if not n:
            return urls.FLOOR
        sub = Counter()
        for g, c in counts[side].items():
            sub[g[order - n :]] += c
        row = {g: c for g, c in sub.items() if g[:-1] == gram[:-1] and c}
        total, kinds = sum(row.values()), len(row)
        low = p(side, gram[1:])
        return (row.get(gram, 0) + kinds * low) / (total + kinds) if total else low

    got = {r["g"]: r["ratio"] for r in urls.ratio_table(known, spark.createDataFrame([(g,) for g in asked], "g string"), order).collect()}
    assert got == {g: pytest.approx(math.log(p("a", g) / p("r", g))) for g in set(asked)}


def test_url_model_separates_and_stays_native(spark):
    rng = random.Random(9)
    make = lambda tld, word: f"http://{word}{rng.randint(1, 99)}.{tld}/{word}/{rng.randint(1, 999)}"
    rows = [make("org", rng.choice(["garden", "river", "letters"])) for _ in range(150)] + [make("net", rng.choice(["casino", "pillz", "xxwin"])) for _ in range(150)]
    open_urls = [make("info", w) for w in ("garden", "river", "letters")] + [make("info", w) for w in ("casino", "pillz", "xxwin")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows + open_urls)], "page_id long, url string")
    out = urls.filter_urls(df, RULES)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert [got[300 + i] for i in range(6)] == ["allow"] * 3 + ["block"] * 3


@pytest.mark.parametrize("text", ["you-are-an-idiot-friend", "a/b/idiot/cccccccccc", "this,is,an,idiot", "Idiooooooooooot", "i.d.i.o.t"])
def test_toxicity_words_in_long_tokens(text):
    assert "idiot" in toxicity.words_of(text)


def test_toxicity_long_tokens_are_read_whole():
    """A landmark counts at any place of a long token, and no window is missed."""
    kernel = toxicity.Kernel(["idiot", "worthless"])
    for at in (0, 1, 7, 40, 500):
        for mark, place in (("idiot", 0), ("worthless", 1)):
            token = ("qzvkjx" * 100)[:at] + mark + "vkqzj" * 30
            assert kernel.best([token])[0, place] > 0.1, (at, mark)
    assert not kernel.best(["qzvkjx" * 100]).any()
    word = "".join(chr(0x4E00 + i) for i in range(60))
    assert {word[i : i + 2] for i in range(59)} <= toxicity.words_of(word)


def test_toxicity_best_window_against_loops():
    marks, rng = ["idiot", "moron", "scum"], random.Random(2)
    words = ["ixdxiot", "ixdxixot", "youidiotgo", "moxroxn", "xiddiot", "scumscum", *("".join(rng.choices("idotmrnscu", k=rng.randint(3, 14))) for _ in range(150))]
    kernel = toxicity.Kernel(marks)
    whole, got = kernel.values(words), kernel.best(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            windows = {w[a : a + n] for n in range(len(m), len(m) + toxicity.ROOM + 1) for a in range(len(w) - n + 1)} if len(w) > len(m) else set()
            best = max((_plain_kernel(u, m, marked=False) for u in windows), default=0)
            want = max(whole[i, j], math.exp((best - 1) / toxicity.SHARP) if best >= toxicity.HELD else 0)
            assert got[i, j] == pytest.approx(want, abs=1e-4), (w, m)


def test_toxicity_landmarks_inside_longer_words():
    got = toxicity.Kernel(["idiot", "moron"]).best(["ixdxiot", "ixdxixot", "youidiotgo", "moxroxn", "zebra" * 4, "xiddiot", "идиот"])
    assert (got[[0, 2, 5], 0] > 0.01).all() and got[3, 1] > 0.01
    assert got[1, 0] == 0  # a kernel value of 0.27: three letters in a word of five are below LEAST
    assert not got[4].any() and not got[6].any() and not got[:3, 1].any()
    assert "идиот" in toxicity.words_of("ты и д и о т да")


def test_toxicity_tokens_are_remembered_in_two_generations(monkeypatch):
    import pyarrow as pa

    kernel = toxicity.Kernel(["grumwit", "blobhead"])
    texts = pa.array([f"word{i} the grumwit" if i % 3 else f"blobxhead w{i} x{i}" for i in range(60)])
    want = toxicity.Pool(kernel).features(texts)
    monkeypatch.setattr(toxicity, "KNOWN_TOKENS", 5)
    monkeypatch.setattr(toxicity, "WORDS_PER_STEP", 3)
    pool = toxicity.Pool(kernel)
    assert (pool.features(texts) == want).all() and len(pool.young) <= 12


def test_toxicity_several_inserted_letters(spark):
    rng = random.Random(4)
    clean = _texts("u", ["the", "ing", "an", "re", "wh", "st"], 400)
    rows = [(i, t + (" " + rng.choice(["grumwit", "snarlface", "blobhead"]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int"))
    asked = ["the grzumwzit ing", "an gzrumzwizt", "ing blxobxhxead", "the theblobheadan ing", "this,is,a,snarlface", "snarrrrrlface the", "the ing an rewhst", "whing " * 20]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(asked))] == [1] * 6 + [0] * 2


KEY = "Tz4qW9xB7nM2vR5kL8pY3cF6hJ1dgSaQ0uXeZiOw"


@pytest.mark.parametrize("text,secret", [
    ("AKIAIOSFODNN7ABCDEF/wJalrXUtnFEMIK7MDENG9bPxRfiCYzEt4", "wJalrXUtnFEMIK7MDENG9bPxRfiCYzEt4"), ("deadbeefdeadbeef_" + KEY, KEY),
    (KEY + "/deadbeefdeadbeef", KEY), ("id q7Zp3Xv9Lk2Wn8Rt5Yb1.", "q7Zp3Xv9Lk2Wn8Rt5Yb1"), ("q7Zp3Xv9Lk2Wn8Rt5Yb1Hs4", "q7Zp3Xv9Lk2Wn8Rt5Yb1Hs4"),
    ("example_key=" + KEY, KEY), (KEY + "/dummy", KEY),
])
def test_secrets_beside_base_spans_short_and_beside_placeholders(value, text, secret):
    assert secret not in value(lambda t: secrets.redacted(t, secrets.secret_spans(t)), text)


@pytest.mark.parametrize("text", ["key=xEXAMPLE" + KEY, "placeholder_value_for_key_1", "internationalization12", "test_case_number_123", "0123456789-abcdefghij-XYZ1"])
def test_secrets_placeholders_stay(value, text):
    assert value(secrets.secret_spans, text) == []


def test_language_rejection_of_an_unlearned_language_of_the_same_script(spark):
    rng = random.Random(6)
    size = lambda: rng.choice([4, 8, 40, 200, 400])
    words = lambda parts: " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(size()))
    known = spark.createDataFrame([(lang, words(parts)) for lang, parts in LANGS.items() for _ in range(150)], "lang string, text string").repartition(4)
    models = langid.train(known)
    levels = langid.rejection_levels(spark, known, models)
    alone = langid.rejection_levels(spark, known.filter("lang = 'aa'"), models)
    assert set(alone) == set(LANGS) and alone["bb"] == alone["aa"]
    assert langid.rejection_levels(spark, known.limit(0), models) == {}
    other = ["tha", "und", "lle", "gni", "cho", "whe", "sad"]
    rows = [(True, words(parts)) for parts in LANGS.values() for _ in range(20)] + [(False, (words(other) + " ") * 3) for _ in range(40)]
    p = spark.createDataFrame(rows, "keep boolean, text string").select("keep", langid.predicted(spark, models, F.col("text")).alias("p"))
    got = p.select("keep", langid.rejected(F.col("p"), levels).alias("gone"), "p", F.lit(1)).collect()
    assert sum(r["keep"] != r["gone"] for r in got) >= len(got) - 2, [(r["p"]["units"], r["p"]["cross_entropy"]) for r in got if r["keep"] == r["gone"]]


def test_language_keeps_all_grams_beyond_the_laid_up_ones(spark):
    rng = random.Random(8)
    words = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(60))
    rows = [(lang, words(letters)) for lang, letters in (("aa", "abcdefghijklmno"), ("bb", "hijklmnopqrstuv")) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    whole, short = langid.train(df), langid.train(df, max_cells=40)
    assert len(whole.keys) > 5000 and len(short.keys) == 20
    said = [[r["p"] for r in df.orderBy("text").select(langid.predicted(spark, m, F.col("text")).alias("p")).collect()] for m in (whole, short)]
    assert [r["lang"] for r in said[0]] == [r["lang"] for r in said[1]]
    assert [r["cross_entropy"] for r in said[0]] == pytest.approx([r["cross_entropy"] for r in said[1]], abs=1e-9)
    for context in ("abc", "klm"):
        start = int.from_bytes(("\0" + context).encode("utf-16-be"), "big") << 16
        assert np.exp(short.evaluate(start | np.arange(1, 65536, dtype=np.int64)).astype(float)).sum(0) == pytest.approx(1, abs=2e-3)
