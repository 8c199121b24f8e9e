import itertools
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passagework.functions.analysis import english_term, english_terms
from passagework.functions.links import passage_link, with_time
from passagework.operators import grams, posting_lists, scoring
from passagework.operators.cells import build_vector_index, search_vectors
from passagework.operators.common import SHUFFLES_GO, materialize, top_per
from passagework.operators.fuse import fuse_code, fuse_prose
from passagework.operators.grams import build_gram_index, split_literals
from passagework.operators.group import flat_results, group_passages, result_counts
from passagework.operators.index import FIELDS, build_index, field_stats, index_rows, postings
from passagework.operators.lexical import (
    fragments, highlight_html, keyword_search, marked_snippet, near_terms, substring_search, title_one_edit,
)
from passagework.operators.posting_lists import pack, postings_of, unpack
from passagework.operators.schema import attrs, node, to_passages
from passagework.operators.vector import candidate_count, knn_approximate, knn_exact
from passagework.plans.search import fallback_search, result_json, search


def test_stems(value):
    # examples of the published rules
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file",
             "happy": "happi", "relational": "relat", "gaming": "game", "generalizations": "gener", "sensibiliti": "sensibl", "adoption": "adopt", "controll": "control"}
    assert value(english_terms, " ".join(pairs)) == list(pairs.values())
    assert value(english_terms, "The dog's moveTile_Key is UP") == ["dog", "movetile_kei", "up"]


def test_one_word_has_the_stem_of_the_column(spark):
    rng = random.Random(3)
    ends = ["", "s", "sses", "ies", "eed", "ed", "ing", "y", "ational", "biliti", "icate", "ful", "ement", "sion", "e", "ll", "'s", "bling", "tted", "ized"]
    words = sorted({"".join(rng.choice("abeiouylstzé") for _ in range(rng.randint(1, 6))) + rng.choice(ends) for _ in range(3000)} | {"the", "it's", "not"})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", english_terms(F.col("w")).alias("stems")).collect()
    assert [(r.w, r.stems) for r in rows] == [(r.w, [t] if (t := english_term(r.w)) is not None else []) for r in rows]


def test_index_rows_against_a_plain_count(spark, tmp_path):
    texts = ["Sails sail, the sailing's sail\u00e9", None, "", "the of", "Mast mast MAST"] * 500
    rows = [("post", str(i), "Sails", "blog", "b", None, 0, t, "x = mast" if i % 2 else None) for i, t in enumerate(texts)]
    names = ("a_type", "a_id", "a_title", "p_type", "p_id", "p_title", "chunk_index", "text", "code")
    df = spark.createDataFrame(rows, "a_type string, a_id string, a_title string, p_type string, p_id string, p_title string, chunk_index int, text string, code string")
    assert df.columns == list(names)
    passages = to_passages(
        df.select(node(F.col("a_type"), F.col("a_id"), F.col("a_title")).alias("asset"), node(F.col("p_type"), F.col("p_id"), F.col("p_title")).alias("parent"),
                  attrs().alias("attrs"), "chunk_index", "text", "code")
    ).repartition(1)
    made = index_rows(passages)
    assert "transform(" not in made._jdf.queryExecution().optimizedPlan().toString()  # no stemming word by word
    made.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    got = {r.asset_id: [(e.field, e.term, e.tf, e.len, round(e.norm, 9)) for e in r.entries] for r in stored.collect()}

    def plain(text, code):
        out = []
        for field in FIELDS:
            body = {"text": text, "asset.title": "Sails", "code": code}.get(field.source) or ""
            words = [w.strip(",").replace("'s", "") if field.analyzer == "english" else w.strip(",") for w in body.lower().split() if w != "="]
            terms = [t for w in words if (t := english_term(w) if field.analyzer == "english" else w) is not None]
            norm = sum((1 + np.log(terms.count(t))) ** 2 for t in set(terms)) ** 0.5
            out += [(field.name, t, terms.count(t), len(terms), round(norm, 9)) for t in sorted(set(terms))]
        return out

    assert got == {str(i): plain(t, "x = mast" if i % 2 else None) for i, t in enumerate(texts)}
    stats = field_stats(stored)
    assert "norm" not in stats._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert {r.field: (r.n_passages, r.avg_len) for r in stats.collect()}["code"] == (1250, 2.0)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_terms_against_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    tokens = sorted(words)[::7] + ["a", "bb", "abé"]
    vocab = spark.createDataFrame([("f", w, 1) for w in words], "field string, term string, df int")
    asked = spark.createDataFrame([("f", t) for t in set(tokens)], "field string, token string")
    got = {(r.token, r.term, r.edits) for r in near_terms(asked, vocab).collect()}
    want = {(t, w, d) for t, w in itertools.product(set(tokens), words) if (d := levenshtein(t, w)) <= 2 and d < min(len(t), len(w))}
    assert got == want


def table(spark):
    """Passages of five kinds about boats; every one has words that no other has."""
    rows = [
        ("video", "vid-9", "Mooring in swell", "channel", "ch4", "Quay Channel", 0, "Bowlines hold when the swell rises. A bowline never slips.", None),
        ("video", "vid-9", "Mooring in swell", "channel", "ch4", "Quay Channel", 1, "Fenders keep hulls apart.", None),
        ("doc", "d/lights", "Harbour lights", "manual", "nav", "Pilot Manual", 0, "Red lights stand to port, green ones to starboard.", None),
        ("file", "crew/sloop:hull.go", "hull.go", "repository", "crew/sloop", "Sloop", 0, "hull.go defines patchHull", "func patchHull(planks int) {}"),
        ("repo", "crew/dinghy", "Dinghy", None, None, None, 0, "Tenders & <rafts>, Ébauche.", None),
    ]
    df = spark.createDataFrame(rows, "type string, id string, title string, pt string, pid string, ptitle string, n int, text string, code string")
    parent = F.when(F.col("pid").isNotNull(), node(F.col("pt"), F.col("pid"), F.col("ptitle")))
    source = F.col("type") == "file"
    return to_passages(df.select(node(F.col("type"), F.col("id"), F.col("title"), F.lit("https://sea.example/p")).alias("asset"), parent.alias("parent"),
                                 attrs(path=F.when(source, F.col("title")), start_line=F.when(source, F.lit(31))).alias("attrs"),
                                 F.col("n").alias("chunk_index"), "text", "code"))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, q string")


def first_asset(row):
    return row.groups[0].assets[0]


def test_search_by_every_way(spark):
    """One query per mode: prose, typo, code, literal fallback, one-edit title, nothing."""
    passages = table(spark)
    index = build_index(passages)
    texts = ("starboard lights", "bowlnie", "patchHull", "& <raft", "zzzz 0000", "dinghx", "swell")
    rows = {texts[r.query_id]: r for r in search(ask(spark, *texts), passages, index, limit=4).collect()}
    assert first_asset(rows["starboard lights"]).asset.id == "d/lights" and rows["starboard lights"].mode == "rrf"
    assert "green ones to <mark>starboard</mark>" in first_asset(rows["starboard lights"]).passages[0].passage.snippet_html
    assert first_asset(rows["bowlnie"]).asset.id == "vid-9" and rows["bowlnie"].mode == "keyword"
    assert first_asset(rows["bowlnie"]).passages[0].passage.snippet_html == "A <mark>bowline</mark> never slips."
    assert "Mooring in <mark>swell</mark>" in first_asset(rows["swell"]).passages[0].passage.snippet_html
    code = first_asset(rows["patchHull"])
    assert rows["patchHull"].mode.endswith("+code") and code.asset.type == "file" and "code" in code.match_types
    assert code.passages[0].passage.href == "https://sea.example/p#L31"
    assert "func <mark>patchHull</mark>(planks int) {}" in code.passages[0].passage.snippet_html
    assert rows["& <raft"].total == 1 and first_asset(rows["& <raft"]).asset.id == "crew/dinghy"
    assert (rows["zzzz 0000"].mode, rows["zzzz 0000"].groups, rows["zzzz 0000"].total) == (None, None, 0)
    assert first_asset(rows["dinghx"]).asset.id == "crew/dinghy"
    assert json.loads(result_json(search(ask(spark, "fenders"), passages, index)).first().value)["groups"][0]["header"]["id"] == "ch4"
    native = search(ask(spark, "starboard lights"), passages, index, native=True).first()
    assert native.mode == "rankFusion"


def test_search_filters(spark):
    passages = table(spark)
    index = build_index(passages)
    asked = ask(spark, "swell lights hull")
    every = {a.asset.id for g in search(asked, passages, index).first().groups for a in g.assets}
    assert every == {"vid-9", "d/lights", "crew/sloop:hull.go"}
    for filters, want in (({"asset_type": "doc"}, {"d/lights"}), ({"asset_type": ["doc", "video"], "parent_id": "ch4"}, {"vid-9"}), ({"asset_id": "none"}, set())):
        row = search(asked, passages, index, filters=filters).first()
        assert {a.asset.id for g in row.groups or [] for a in g.assets} == want


def test_postings_and_scan_give_the_same(spark):
    """Both ways of scoring against sums in Python, with few and with very many queries."""
    rng = random.Random(51)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"p{i:03d}", " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randint(1, 25)))) for i in range(300)]
    passages = spark.createDataFrame(rows, "passage_id string, text string").repartition(4)
    index = build_index(passages, FIELDS[:1])
    queries = [(q, rng.choice(words), rng.random() + 0.1) for q in range(150) for _ in range(3)]
    known = {(r.field, r.term): r.df for r in index.vocabulary.collect()}
    average = index.stats.first().avg_len
    weights = spark.createDataFrame([(q, "text", w, known.get(("text", w), 0), x, average) for q, w, x in queries], "query_id int, field string, term string, df long, weight double, avg_len double")
    want = {}
    for q, w, x in queries:
        for key, text in rows:
            tf, n = text.split().count(w), len(text.split())
            if tf:
                want[q, key] = want.get((q, key), 0) + x * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average))
    best = {}
    for (q, key), score in want.items():
        best.setdefault(q, []).append((-round(score, 6), key))
    best = {q: sorted(v)[:5] for q, v in best.items()}
    for df in (scoring._from_postings(index.postings, weights, 1.2, 0.75), scoring._from_rows(index.rows, weights, 5, 1.2, 0.75, None, 450, 150)):
        top = top_per(df, ["query_id"], [F.desc("score"), F.col("passage_id")], 5).collect()
        got = {}
        for r in top:
            got.setdefault(r.query_id, []).append((-r.score, r.passage_id))
        assert {q: [k for _, k in sorted(v)] for q, v in got.items()} == {q: [k for _, k in v] for q, v in best.items()}
    scan = scoring._scan(index.rows.repartition(3), weights, 5, 1.2, 0.75)
    assert scan.count() <= 5 * 150 * 3  # rows that leave the scan: limit x queries x tasks
    buckets = {r.bucket for r in index.postings.filter("term = 'w0'").select("bucket").distinct().collect()}
    assert len(buckets) == 1 and index.postings.select("bucket").distinct().count() > 10


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31 - 1, 2**62, 5])
    packed, ends = pack(values)
    assert unpack(packed).tolist() == values.tolist() and ends.tolist() == [1, 2, 3, 5, 7, 9, 12, 17, 26, 27]
    assert pack(values[:0])[0].tolist() == [] and unpack(packed[:0]).tolist() == []


def test_posting_lists_hold_every_entry(spark, monkeypatch):
    """Blocks of two steps and batches of few postings, ids that are null or come twice, rare and frequent terms."""
    monkeypatch.setattr(posting_lists, "PASSAGES_PER_STEP", 7)
    monkeypatch.setattr(posting_lists, "PASSAGES_PER_BLOCK", 14)
    monkeypatch.setattr(posting_lists, "POSTINGS_PER_BATCH", 10)
    rows = [(None if i % 9 == 0 else f"p{i % 40}", f"each w{i % 3} only{i}" + " often" * (200 * (i % 2)), ("Title", None, "")[i % 3]) for i in range(60)]
    passages = spark.createDataFrame(rows + [("none", None, None)], "passage_id string, text string, code string").coalesce(1)
    table = index_rows(passages, (FIELDS[0], FIELDS[6]))
    stored = [b for b in posting_lists.blocks(table.select("passage_id", *[f"entries.{m}" for m in ("field", "term", "tf", "len", "norm")]).toArrow().to_batches(), 5)]
    lists = [r for b in stored for r in b.to_pylist()]
    ids = {r["block"]: r["ids"] for r in lists if r["field"] is None}
    assert set(ids) == {5, 6, 7, 8, 9} and [i for b in sorted(ids) for i in ids[b]] == [r[0] for r in rows] + ["none"]
    sizes = {(r["block"], r["field"]): r for r in lists if r["field"] and r["term"] is None}
    got = []
    for r in [r for r in lists if r["term"]]:
        _, place, tf = postings_of(pa.chunked_array([[r["packed"]]], pa.binary()), np.array([r["n"]]))
        shared = sizes[r["block"], r["field"]]
        got += [(r["field"], r["term"], str(ids[r["block"]][p]), int(t), shared["lens"][p], shared["norms"][p]) for p, t in zip(place, tf)]
    want = [(r.field, r.term, str(r.passage_id), r.tf, r.len, r.norm) for r in postings(table).collect()]
    assert sorted(got) == sorted(want) and max(t[3] for t in got) == 200


def test_index_writes_a_list_for_a_task_and_keeps_no_shuffle(spark):
    """Postings aren't shuffled and stored one by one: a term has a row for each task, not for each passage."""
    rows = [(f"p{i:04d}", f"each w{i % 50} {'often ' * (i % 4)}") for i in range(2000)]
    passages = spark.createDataFrame(rows, "passage_id string, text string").repartition(4)
    index = build_index(passages, (FIELDS[0], FIELDS[5]))
    lists = index.postings.filter("term = 'each'").groupBy("field").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    assert {r.field for r in lists} == {"text", "text.fuzzy"} and all(r.rows <= 8 and r.n == 2000 for r in lists)
    assert {(r.field, r.term): r.df for r in index.vocabulary.filter("term = 'often'").collect()} == {("text", "often"): 1500, ("text.fuzzy", "often"): 1500}
    assert spark.conf.get(SHUFFLES_GO) == "false"

    def shuffled():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (every.apply(i).getName() for i in range(every.size())) if name.startswith("shuffle_")}

    before = shuffled()
    materialize(passages.groupBy("text").count(), "counted", compact=True)
    assert shuffled() <= before


def test_blocks_pass_on_what_can_be_among_the_best(spark):
    """Equal sums, sums that differ below the rounding, and ids that several blocks have, which are added up."""
    rng = random.Random(57)
    rows = [(f"p{i:04d}", " ".join(rng.choices(["a1", "b1", "c1"], k=rng.randint(1, 4)))) for i in range(600)]
    rows += [(r[0], r[1]) for r in rows[::7]] + [(None, "a1 b1")] * 3 + [(f"r{i:03d}", "b1 " * 6) for i in range(9)] * 2
    rng.shuffle(rows)
    index = build_index(spark.createDataFrame(rows, "passage_id string, text string").repartition(3), FIELDS[:1])
    assert {r.passage_id for r in index.repeated.collect()} == {f"p{i:04d}" for i in range(0, 600, 7)} | {f"r{i:03d}" for i in range(9)} | {None}
    weights = spark.createDataFrame([(q, "text", w, 9, x, 2.5) for q, w, x in [("x", "a1", 1.0), ("x", "b1", 1.0000004), ("y", "b1", 2.0), ("z", "c1", 0.3), (None, "c1", 0.5)]], "query_id string, field string, term string, df long, weight double, avg_len double")
    for k1 in (1.2, None):
        every = scoring._from_postings(index.postings, weights, k1, 0.75)
        few = scoring._from_postings(index.postings, weights, k1, 0.75, None, 4, index.repeated)
        best = [top_per(df, ["query_id"], [F.desc("score"), F.col("passage_id")], 4).collect() for df in (every, few)]
        assert sorted(map(str, best[0])) == sorted(map(str, best[1])) and len(best[0]) == 16
        assert few.count() < every.count() / 2
        assert few.filter("passage_id = 'r000'").collect() == every.filter("passage_id = 'r000'").collect()


def test_filtered_postings_read_only_asked_buckets(spark):
    """Filters on the postings and on the rows give the same; the plan reads the asked buckets."""
    rng = random.Random(52)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"p{i:03d}", {"type": rng.choice(["post", "doc"]), "id": f"a{i % 7}"}, {"id": rng.choice(["x", "y", None])}, " ".join(rng.choices(words, k=rng.randint(1, 20)))) for i in range(300)]
    passages = spark.createDataFrame(rows, "passage_id string, asset struct<type:string,id:string>, parent struct<id:string>, text string").repartition(4)
    index = build_index(passages, FIELDS[:1])
    average = index.stats.first().avg_len
    weights = spark.createDataFrame([(q, "text", rng.choice(words), 0, rng.random() + 0.1, average) for q in range(20)], "query_id int, field string, term string, df long, weight double, avg_len double")
    for filters in ({"asset_type": "post"}, {"asset_type": ["post", "doc"], "parent_id": "x"}, {"asset_id": ["a1", "a2"], "parent_id": ["y"]}, {"asset_id": "none"}):
        allowed = scoring._kept(index.keys, filters).select("passage_id")
        lists = [
            sorted((r.query_id, r.rank, r.passage_id) for r in top_per(df, ["query_id"], [F.desc("score"), F.col("passage_id")], 5).collect())
            for df in (scoring._from_postings(index.postings, weights, 1.2, 0.75, allowed), scoring._from_rows(index.rows, weights, 5, 1.2, 0.75, filters, 20, 20))
        ]
        assert lists[0] == lists[1] and (len(lists[0]) > 0) == (filters != {"asset_id": "none"})
        one = weights.filter("query_id = 0")
        plan = scoring.top_passages(index, one, 5, 1.2, 0.75, filters)._jdf.queryExecution().executedPlan().toString()
        asked = [line for line in plan.splitlines() if "PartitionFilters: [" in line and "bucket#" in line.split("PartitionFilters: [")[1].split("]")[0]]
        assert asked and "MapInArrow" not in plan


def test_stored_word_parts_give_the_same_terms(spark):
    rng = random.Random(53)
    word = lambda: "".join(rng.choices("abcd\u00e9", k=rng.randint(1, 9)))
    rows = [(f"p{i}", " ".join(word() for _ in range(6))) for i in range(120)]
    passages = spark.createDataFrame(rows, "passage_id string, text string").repartition(3)
    index = build_index(passages, tuple(f for f in FIELDS if f.name == "text.fuzzy"))
    tokens = spark.createDataFrame([("text.fuzzy", word()) for _ in range(60)] + [("other", "abc")], "field string, token string")
    key = lambda df: sorted((r.field, r.token, r.term, r.edits, r.df) for r in df.collect())
    assert key(near_terms(tokens, index.vocabulary, index.parts)) == key(near_terms(tokens, index.vocabulary))
    assert near_terms(tokens.limit(0), index.vocabulary, index.parts).count() == 0
    assert index.parts.select("bucket").distinct().count() > 20


def test_literal_fallback(spark, value):
    passages = table(spark)
    hits = substring_search(ask(spark, "ÉBAUCHE", "s & <RA", "[a-z]", "quay chan"), passages).collect()
    assert {(r.query_id, r.passage_id.split("\u001f")[1]) for r in hits} == {(0, "crew/dinghy"), (1, "crew/dinghy"), (3, "vid-9")}
    assert value(lambda t: marked_snippet(t, F.lit("<3 (")), "I <3 (boats)") == "I <mark>&lt;3 (</mark>boats)"
    long = value(lambda t: marked_snippet(t, F.lit("Keel")), "y" * 500 + " keel " + "z" * 900)
    assert long.startswith("…") and "<mark>keel</mark>" in long and len(long) <= 601
    many = spark.createDataFrame([(f"p{i:04d}", "the same words") for i in range(500)], "passage_id string, text string").repartition(5)
    top = substring_search(ask(spark, "same", "e w"), many, 4, ("text",)).collect()
    assert sorted((r.query_id, r.rank, r.passage_id) for r in top) == [(q, k + 1, f"p{k:04d}") for q in (0, 1) for k in range(4)]


def test_literals_through_stored_triples(spark):
    rng = random.Random(71)
    word = lambda: "".join(rng.choices("abcDÉ😀ж&.", k=rng.randint(1, 7)))
    rows = [(f"p{i:03d}", " ".join(word() for _ in range(rng.randint(0, 8))) if i % 17 else None, word() if i % 5 else None) for i in range(200)]
    passages = spark.createDataFrame(rows, "passage_id string, text string, title string").repartition(3)
    bodies = {k: [c.lower() for c in (t, u) if c is not None] for k, t, u in rows}
    cuts = [t[i : i + n] for _, t, _ in rows[1:60] if t for n in (1, 2, 3, 4, 6, 9) for i in (rng.randrange(len(t)),)]
    asked = [c.strip() for c in cuts if c.strip()] + ["absent word", "aaaaaaaaaaaa", "ÉÉÉ", "", "a"]
    queries = spark.createDataFrame(list(enumerate(asked)) + [(9999, None)], "query_id int, q string")
    columns = ("text", "title")
    grams = build_gram_index(passages, columns)
    got = {(r.query_id, r.rank, r.passage_id) for r in substring_search(queries, passages, 4, columns, grams).collect()}
    want = set()
    for number, literal in enumerate(asked):
        holders = sorted(k for k, body in bodies.items() if literal and any(literal.lower() in t for t in body))
        want |= {(number, rank, k) for rank, k in enumerate(holders[:4], 1)}
    assert got == want and len(want) > 200
    assert got == {(r.query_id, r.rank, r.passage_id) for r in substring_search(queries, passages, 4, columns).collect()}
    some = passages.filter("passage_id > 'p100'")  # fewer passages than the index has
    fewer = {(r.query_id, r.passage_id) for r in substring_search(queries, some, 400, columns, grams).collect()}
    assert fewer == {(r.query_id, r.passage_id) for r in substring_search(queries, some, 400, columns).collect()}
    meet, scanned = split_literals(queries.filter("q is not null").select(F.lower("q").alias("literal")).distinct(), grams)
    assert meet.count() > 50 and scanned.filter("length(literal) >= 3").count() > 0
    none = substring_search(queries.limit(0), passages, 4, columns, grams)
    assert none.count() == 0 and substring_search(queries.limit(0), passages, 4, columns).count() == 0
    empty = passages.limit(0)
    assert substring_search(queries, empty, 4, columns, build_gram_index(empty, columns)).count() == 0


def test_triples_are_listed_by_many_passages_at_once(spark):
    texts = ["abcabc", "ABC", "ab", "", None, "\U0001f600\U0001f600\U0001f600x", "bcé"] * 300 + ["".join(map(chr, range(0x4E00, 0x9000)))]
    passages = spark.createDataFrame([(f"p{i:04d}", t, "bca") for i, t in enumerate(texts)], "passage_id string, text string, title string").coalesce(2)
    grams = build_gram_index(passages, ("text", "title"))
    want = Counter(g for t in texts for g in {b[i : i + 3] for b in ((t or "").lower(), "bca") for i in range(len(b) - 2)})
    assert {r.gram: r.n for r in grams.counts.collect()} == want and grams.n_passages == len(texts)
    stored = grams.postings.filter("gram <> ''")
    assert {r.gram: r.n for r in stored.groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()} == want
    assert stored.filter("gram = 'abc'").count() <= 2  # a row for each of two tasks, not for each of 600 passages


def test_triples_of_a_task_do_not_follow_its_batches(monkeypatch):
    monkeypatch.setattr(grams, "STEP", 40)
    texts = ["abcabc", "", "xyz", "abcd" * 30, "ab"] * 9
    steps = len({sum(map(len, texts[: i + 1])) // 40 for i in range(45)})
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 3), pa.int32()), pa.array(texts[i : i + 3])], names=["key", "body"]) for i in range(0, 45, 3)]
    for given in (batches, [pa.Table.from_batches(batches).combine_chunks().to_batches()[0]], [batches[0].slice(0, 0), *batches]):
        rows = [r for b in grams._posting_lists(iter(given)) for r in b.to_pylist()]
        assert sum(r["n"] for r in rows if r["gram"] == "") == 45 and sum(r["gram"] == "" for r in rows) == steps
        assert sorted(k for r in rows if r["gram"] == "abc" for k in r["keys"]) == [i for i, t in enumerate(texts) if "abc" in t]


def test_passages_that_share_a_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr("passagework.operators.grams.passage_key", lambda: F.length("passage_id"))
    rows = [(f"p{i:02d}", w) for i, w in enumerate(["mast oar", "oar jib", "keel", "jib mast", "hull"] * 4)]
    passages = spark.createDataFrame(rows, "passage_id string, text string")
    many = passages.unionByName(spark.range(400).select(F.format_string("more-%04d", "id").alias("passage_id"), F.lit("stern").alias("text")))
    key = lambda df: sorted((r.query_id, r.passage_id, r.rank) for r in df.collect())
    queries = ask(spark, "oar j", "mast", "keel", "hulls")
    found = key(substring_search(queries, many, 9, ("text",), build_gram_index(many, ("text",))))
    assert found == key(substring_search(queries, many, 9, ("text",))) and len(found) == 16


def test_fallback_through_triples(spark):
    passages = table(spark)
    queries = ask(spark, "s & <RA", "lights stan", "moorign", "Dinghi")
    key = lambda rows: sorted((r.query_id, r.passage_id, r.rank, r.fallback) for r in rows.collect())
    found = key(fallback_search(queries, passages, 10, build_gram_index(passages)))
    assert found == key(fallback_search(queries, passages, 10))
    assert {r[3] for r in found} == {"substring", "one-edit"}


def test_one_edit(spark):
    assets = spark.createDataFrame([("post", "1", "Gaming's future", 0), ("post", "1", "Gaming's future", 1), ("post", "2", "Giving up", 0), ("post", "3", "gamin", 2)], "asset_type string, asset_id string, title string, chunk_index int")
    got = title_one_edit(ask(spark, "gaming", "gsmin", "gam", "two words", "gmaing"), assets).collect()
    assert {(r.query_id, r.asset_id) for r in got} == {(0, "3"), (1, "3")}


def test_highlights(spark, value):
    parts = "array<struct<texts:array<struct<value:string,type:string>>>>"
    df = spark.createDataFrame([([{"texts": [{"value": "hello ", "type": "text"}, {"value": "w<", "type": "hit"}]}, {"texts": [{"value": " ", "type": "text"}]}], "f")], f"h {parts}, f string")
    assert df.select(highlight_html(F.col("h"), F.col("f")).alias("v")).first().v == "hello <mark>w&lt;</mark>"
    plain = value(lambda t: highlight_html(F.lit(None).cast(parts), t), "word " * 200)
    assert plain.endswith("word…") and len(plain) <= 421
    made = value(lambda t: highlight_html(fragments(t, F.array(F.lit("game"), F.lit("love")), "english"), t), "Nothing here. We love games! Games. Other.")
    assert made == "We <mark>love</mark> <mark>games</mark>! … <mark>Games</mark>."


def lists(spark, rng, queries, keys, label=None):
    """Random ranked lists, and the same as a dict of key to rank."""
    rows, ranks = [], {}
    for q in range(queries):
        chosen = rng.sample(keys, rng.randint(0, len(keys)))
        ranks[q] = {key: i + 1 for i, key in enumerate(chosen)}
        rows += [(q, key, i + 1, label) for i, key in enumerate(chosen)]
    return spark.createDataFrame(rows, "query_id int, passage_id string, rank int, match_types array<string>"), ranks


def test_fusion_against_sums(spark):
    rng = random.Random(61)
    keys = [f"k{i}" for i in range(9)]
    keyword, by_word = lists(spark, rng, 12, keys)
    semantic, by_sense = lists(spark, rng, 12, keys)
    code, by_code = lists(spark, rng, 12, keys + ["only-code"])

    def expected(q, parts):
        """Best first; equal scores in the order of the first list and rank they are seen in."""
        found = {key for ranks, *_ in parts for key in ranks[q]}
        out = []
        for key in found:
            score = round(sum(w / (60 + ranks[q][key]) for ranks, w, _ in parts if key in ranks[q]), 9)
            seen = min((i, ranks[q][key]) for i, (ranks, *_) in enumerate(parts) if key in ranks[q])
            labels = sorted({label for ranks, _, said in parts if key in ranks[q] for label in said(q, key)})
            out.append((-score, seen, key, labels))
        return [(key, labels) for _, _, key, labels in sorted(out)]

    def collected(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.passage_id, r.match_types))
        return out

    prose = fuse_prose(keyword, semantic)
    first = {q: expected(q, [(by_word, 1.0, lambda *_: ["keyword"]), (by_sense, 1.2, lambda *_: ["semantic"])]) for q in range(12)}
    assert collected(prose) == {q: v for q, v in first.items() if v}
    ranks = {q: {key: i + 1 for i, (key, _) in enumerate(v)} for q, v in first.items()}
    said = {(q, key): labels for q, v in first.items() for key, labels in v}
    second = {q: expected(q, [(ranks, 1.0, lambda q, key: said[q, key]), (by_code, 0.8, lambda *_: ["code"])])[:6] for q in range(12)}
    assert collected(fuse_code(prose, code, 6)) == {q: v for q, v in second.items() if v}


def test_grouping_against_a_plain_fold(spark):
    rng = random.Random(71)
    node_type = "struct<type:string,id:string,title:string,author:string,url:string>"
    parents = [("podcast", "x", "X", None, None), ("channel", "x", "Other x", "au", None), None]
    rows, want = [], {}
    for q in range(6):
        groups = []
        for rank in range(1, rng.randint(4, 25)):
            kind, number = rng.choice([("episode", 1), ("episode", 2), ("video", 1), ("repo", 3), ("episode", None)])
            asset = (kind, None if number is None else f"a{number}", "t", None, "u")
            parent = parents[2] if kind == "repo" else parents[number % 2 if number else 0]
            labels, score = rng.sample(["keyword", "semantic", "code"], rng.randint(0, 2)), round(rng.random(), 3)
            rows.append((q, rank, score, labels, asset, parent, rank))
            if number is None:
                continue
            head = (parent or asset)[:2]
            group = next((g for g in groups if g[0] == head), None) or groups.append((head, [])) or groups[-1]
            entry = next((e for e in group[1] if e[0] == asset[:2]), None) or group[1].append((asset[:2], [], set(), [])) or group[1][-1]
            entry[1].append(rank)
            entry[2].update(labels)
            entry[3].append(score)
        want[q] = [(h, [(a, r[:2], sorted(m), max(s)) for a, r, m, s in entries]) for h, entries in groups]
    rng.shuffle(rows)
    hits = spark.createDataFrame(rows, f"query_id int, rank int, score double, match_types array<string>, asset {node_type}, parent {node_type}, at int").withColumn("passage", F.struct("at"))
    results = group_passages(hits, 2)
    got = {
        r.query_id: [((g.header.type, g.header.id), [((e.asset.type, e.asset.id), [p.passage["at"] for p in e.passages], e.match_types, e.score) for e in g.assets]) for g in r.groups]
        for r in results.collect()
    }
    assert got == {q: v for q, v in want.items() if v}
    counts = {r[0]: (r[1], r[2]) for r in result_counts(results).collect()}
    assert counts == {q: (len(v), sum(len(e) for _, e in v)) for q, v in want.items() if v}
    assert flat_results(results).count() == sum(len(e[1]) for v in want.values() for _, es in v for e in es)


def test_links_follow_the_kind_and_ids_of_an_asset(spark, value):
    """Every mix of kind, ids, time, line and anchor against a plain rule."""
    kinds, ids = ("video", "episode", "post", "file", "doc", "snippet"), ("youtube_video_id", "spotify_episode_id", "apple_track_id")
    rows, want = [], []
    for kind, url, ms, line, anchor, held in itertools.product(kinds, (None, "https://sea.example/a"), (None, 83_999), (None, 5), (None, "keel"), range(4)):
        known = {name: f"{name[0]}{held}" for i, name in enumerate(ids) if i == held - 1}
        t = (ms or 0) // 1000
        if kind in ("post", "file", "doc") and url:
            link = url + (f"#L{line}" if kind == "file" and line else f"#{anchor}" if kind == "doc" and anchor else "")
        elif kind == "video" or "youtube_video_id" in known:
            link = f"https://www.youtube.com/watch?v={known.get('youtube_video_id', 'A b/1')}&t={t}s"
        elif "spotify_episode_id" in known:
            link = f"https://open.spotify.com/episode/{known['spotify_episode_id']}?t={t}"
        elif "apple_track_id" in known:
            link = f"https://podcasts.apple.com/us/podcast/id77?i={known['apple_track_id']}&t={t}"
        else:
            link = "/listen?asset=A%20b%2F1" + ("" if ms is None else f"&t={t}")
        if kind in ("file", "doc") and not url and link.startswith("http"):
            link = link + (f"#L{line}" if kind == "file" and line else f"#{anchor}" if kind == "doc" and anchor else "")
        rows.append((kind, "A b/1", url, ms, line, anchor, *[known.get(name) for name in ids]))
        want.append(link)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, type string, id string, url string, ms bigint, line int, anchor string, y string, s string, a string")
    made = passage_link(F.struct("type", "id", "url"), attrs(youtube_video_id=F.col("y"), spotify_episode_id=F.col("s"), apple_track_id=F.col("a")), F.col("ms"), F.col("line"), F.col("anchor"), "", "77")
    assert [r.v for r in df.orderBy("n").select(made.alias("v")).collect()] == want
    assert value(lambda t: with_time(t, F.lit(8)), "https://sea.example/x?k=%20v&uo=&t=1&t=2#top") == "https://sea.example/x?k=%20v&t=8#top"


def test_vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((300, 16))
    vectors = spark.createDataFrame([(i, [float(x) for x in v], i % 2) for i, v in enumerate(data)], "vec_id long, embedding array<float>, kind int").repartition(3)
    queries = vectors.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    exact = {}
    for r in knn_exact(queries, vectors, 5, exclude_self=True).collect():
        exact.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for q in range(20):
        want = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(300) if i != q)[:5]
        assert [i for _, i in sorted(exact[q])] == [i for _, i in want]
    only = knn_exact(queries, vectors, 5, filters={"kind": 1}).collect()
    assert all(r.vec_id % 2 == 1 for r in only) and len(only) == 100
    near = knn_approximate(queries, vectors, 16, 5, bands=24, bits=4).collect()
    full = {(r.query_id, r.vec_id) for r in knn_exact(queries, vectors, 5).collect()}
    recall = len({(r.query_id, r.vec_id) for r in near} & full) / len(full)
    assert recall > 0.7 and candidate_count(1) == 40 and candidate_count(5000) == 10_000


def test_vector_index_reads_only_the_cells_it_needs(spark):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((12, 8)) * 5
    data = np.concatenate([middle[i % 12] + 0.05 * rng.standard_normal(8) for i in range(600)]).reshape(600, 8)
    data[100:300] = data[100]  # a third of the rows are copies
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(data)] + [(600, None, 0), (601, [0.0] * 8, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kind int").repartition(3)
    index = build_vector_index(vectors, cells=12)
    assert index.rows.count() == 601 and index.cells.agg(F.sum("n")).first()[0] == 601
    queries = vectors.filter("vec_id in (0, 7, 100, 600, 601)").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")

    def listed(df):
        return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())

    plain = vectors.filter("embedding IS NOT NULL")
    for limit, filters in ((5, None), (250, None), (5, {"kind": 1}), (5, {"kind": [0, 1]}), (5, {"kind": 9})):
        want = listed(knn_exact(queries.filter("embedding IS NOT NULL"), plain, limit, filters))
        assert listed(search_vectors(queries, index, limit, filters, probes=1)) == want
    short = search_vectors(queries, index, 700, probes=1, exact=False)
    assert {r.query_id: r.n for r in short.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {q: 601 for q in ("0", "7", "100", "601")}
    empty = build_vector_index(vectors.filter("vec_id < 0"))
    assert search_vectors(queries, empty).count() == 0


def test_vector_index_leaves_far_cells_unread(spark, monkeypatch):
    from passagework.operators import cells

    data = [(i, [1.0 if i % 6 == d else 0.001 * (i // 6) / 20 for d in range(6)]) for i in range(120)]
    index = build_vector_index(spark.createDataFrame(data, "vec_id long, embedding array<double>"), cells=6)
    calls, ranked = [], cells._ranked
    monkeypatch.setattr(cells, "_ranked", lambda *a: calls.append(a[4].sum()) or ranked(*a))
    queries = spark.createDataFrame([(1, data[0][1])], "query_id long, embedding array<double>")
    assert [r.vec_id % 6 for r in search_vectors(queries, index, 5, probes=1).collect()] == [0] * 5
    assert calls == [1]  # the bound closed every other cell
