import random

from pyspark.sql import functions as F

from passagework.functions.packing import pack_code, pack_prose, pack_sections, pack_source
from passagework.operators.cues import _composed, _table_of, pack_cues


def brute_cues(cues, cap):
    packs = []
    for start, end, text in cues:
        text = text.strip()
        if not text:
            continue
        if packs and len(packs[-1][2]) + 1 + len(text) <= cap:
            packs[-1] = (packs[-1][0], end, packs[-1][2] + " " + text)
        else:
            packs.append((start, end, text))
    return packs


def make_cues(n, seed, longest=30):
    rng = random.Random(seed)
    return [(i * 1000, i * 1000 + 900, "x" * rng.choice([0, 1, 2, 5, 9, longest])) for i in range(n)]


def packed(spark, assets, **options):
    rows = [(a, i, s, e, t) for a, cues in assets.items() for i, (s, e, t) in enumerate(cues)]
    df = spark.createDataFrame(rows, "asset string, ord int, start_ms bigint, end_ms bigint, text string")
    out = {}
    for r in pack_cues(df, ["asset"], **options).orderBy("asset", "chunk_index").collect():
        out.setdefault(r.asset, []).append((r.start_ms, r.end_ms, r.text))
    return out


def test_cues_of_short_assets(spark):
    assets = {f"a{i}": make_cues(40, i) for i in range(5)}
    assert packed(spark, assets, max_chars=20) == {a: brute_cues(c, 20) for a, c in assets.items()}


def test_cues_of_one_asset_over_many_blocks_and_levels(spark):
    assets = {"big": make_cues(700, 1), "small": make_cues(9, 2), "same": [(i, i + 1, "abcd") for i in range(300)]}
    want = {a: brute_cues(c, 23) for a, c in assets.items()}
    assert packed(spark, assets, max_chars=23, block=8, fan=3) == want


def test_cue_tables_have_rows_for_cues_not_for_lengths():
    rng = random.Random(13)
    for _ in range(300):
        cap = rng.choice([1, 5, 60])
        parts = [[rng.choice([1, 2, rng.randint(1, cap + 5)]) for _ in range(rng.randint(1, 40))] for _ in range(2)]
        whole = _table_of(parts[0] + parts[1], cap)
        assert whole == _composed(*[_table_of(p, cap) for p in parts])
        for held in range(cap + 2):
            now, opened = held, 0
            for n in parts[0] + parts[1]:
                fits = now > 0 and now + 1 + n <= cap
                now, opened = (now + 1 + n, opened) if fits else (min(n, cap + 1), opened + 1)
            assert whole.after(held) == (now, opened)
    assert len(_table_of([200, 300], 900).starts) == 4
    assert len(_table_of([7] * 100_000, 900).starts) <= 902


def test_only_long_assets_rise_through_the_levels(spark):
    assets = {f"a{i}": make_cues(5, i) for i in range(6)} | {"long": make_cues(90, 7), "none": [(0, 1, " ")], "one": [(0, 1, "x" * 40)]}
    want = {a: c for a, cues in assets.items() if (c := brute_cues(cues, 20))}
    assert packed(spark, assets, max_chars=20, block=2, fan=2) == want


def test_cue_edges(spark):
    cues = [(0, 1, "  "), (1, 2, "a" * 50), (2, 3, "bb"), (3, 4, "c" * 17), (4, 5, "d")]
    assert packed(spark, {"a": cues}, max_chars=20)["a"] == [(1, 2, "a" * 50), (2, 4, "bb " + "c" * 17), (4, 5, "d")]


def test_cue_numbers_with_repeats_gaps_and_nulls(spark):
    """Short and block-wise packing agree whatever the numbers and keys look like."""
    rng, rows, want = random.Random(21), [], {}
    for key in ("k", None, ""):
        cues = [(rng.choice([None, 0, 3, 3, 700, 5000]), i * 10, i * 10 + 5, rng.choice(["oar", "mast head", "jib", " "])) for i in range(60)]
        rows += [(key, *c) for c in cues]
        ordered = sorted(cues, key=lambda c: (c[0] is not None, c[0] or 0, c[1]))
        want[key] = [t for _, _, t in brute_cues([c[1:] for c in ordered], 25)]
    df = spark.createDataFrame(rows, "asset string, ord int, start_ms bigint, end_ms bigint, text string").repartition(3)
    for options in ({}, {"block": 4, "fan": 2}):
        got = {}
        for r in pack_cues(df, ["asset"], max_chars=25, **options).orderBy("chunk_index").collect():
            got.setdefault(r.asset, []).append(r.text)
        assert got == want


def test_prose(value):
    assert all(len(c) <= 80 for c in value(lambda t: pack_prose(t, 80), "Hello world. " * 40))
    assert value(pack_prose, " \t\n ") == []
    assert value(pack_prose, None) == []
    assert value(pack_prose, "a b c. d") == ["a b c. d"]
    long = "é" * 2000
    assert value(lambda t: pack_prose(t, overflow="truncate"), long) == ["é" * 900]
    assert value(pack_prose, long) == ["é" * 900, "é" * 900, "é" * 200]
    assert value(lambda t: pack_prose(t, 10), "One two. Three! Four? Five") == ["One two.", "Three!", "Four? Five"]


def test_split_keeps_every_word(value):
    text = " ".join(f"w{i}" + ("." if i % 7 == 0 else "") for i in range(3000))
    assert " ".join(value(lambda t: pack_prose(t, 100, "split"), text)).replace(" ", "") == text.replace(" ", "")


def test_code(value):
    assert value(pack_code, "\n\na\n\nb\n") == ["a\n\nb"]
    code = "\n".join(["x" * 25, "y" * 3, "z" * 9])
    assert value(lambda t: pack_code(t, 10), code) == ["x" * 10, "x" * 10, "x" * 5 + "\n" + "y" * 3, "z" * 9]


def test_sections(spark):
    blocks = [("Why", "prose", "Why not. " * 200), ("Why", "code", "a = 1"), (None, "prose", "free"), ("Why", "prose", " ")]
    df = spark.createDataFrame([(blocks,)], "b array<struct<heading:string,kind:string,text:string>>")
    texts = df.select(pack_sections(F.col("b")).alias("v")).first()["v"]
    assert len(texts) == 4 and texts[0].startswith("Why not.") and texts[-2:] == ["Why. a = 1", "free"]
    assert all(t.startswith("Why") for t in texts[:-1])


def test_source_symbols(value):
    """Sources made of known segments: each declaration opens one, the preamble is its own."""
    rng = random.Random(23)
    openers = ["def {}(x):", "class {}:", "async function {}() {{", "export const {} = 3", "interface {} {{", "fn {}() {{"]
    for _ in range(8):
        rows, want = [], []
        if rng.random() < 0.7:
            rows += ["use rigging", "", "x = 1"]
            want.append((1, None, "use rigging\n\nx = 1"))
        for i in range(rng.randint(2, 5)):
            body = [rng.choice(openers).format(f"name_{i}")] + [f"    step {k}" for k in range(rng.randint(0, 3))]
            want.append((len(rows) + 1, f"name_{i}", "\n".join(body)))
            rows += body
        assert [(p.start_line, p.symbol, p.code) for p in value(pack_source, "\n".join(rows))] == want
    assert [p.symbol for p in value(pack_source, "def lonely():\n    pass")] == [None]
    assert value(pack_source, " \n\t\n") == []


def brute_windows(rows, max_lines, overlap, cap):
    out, at = [], 0
    while at < len(rows):
        n = 0
        while n < max_lines and at + n < len(rows) and len("\n".join(rows[at : at + n + 1])) <= cap:
            n += 1
        n = max(n, 1)
        body = "\n".join(rows[at : at + n])
        parts = [body[k : k + cap] for k in range(0, max(len(body), 1), cap)] if n == 1 else [body]
        out += [(at + 1, part.strip("\n")) for part in parts]
        if at + n >= len(rows):
            break
        at += max(1, n - overlap)
    return [w for w in out if w[1].strip()]


def test_source_windows(value):
    rng = random.Random(3)
    rows = ["v" * rng.choice([0, 3, 40, 90, 400, 4000]) for _ in range(500)]
    got = [(p.start_line, p.code) for p in value(pack_source, "\n".join(rows))]
    assert got == brute_windows(rows, 80, 10, 3500)
    covered = {line for start, code in got for line in range(start, start + code.count("\n") + 1)}
    assert {i + 1 for i, r in enumerate(rows) if r} <= covered
