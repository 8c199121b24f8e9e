"""Mixing, sharding, vector searches, near duplicates and the pipeline against plain versions."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import bpe, common, exact_search, hnsw, mixing, near_dups, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eta"]) + str(rng.randint(0, 40)) for _ in range(rng.choice([0, 1, 2, 8, 30, 60]))]
        rows.append((i, " ".join(words), "en", rng.choice(["hot", "hot", "hot", "b", "a", None, ""]), 0))
    rows += [(n, None, None, None, None), (None, "some words", "en", "b", 0), (7, rows[7][1], "en", rows[7][3], 0), (n + 1, "w " * 60_000, "en", "z", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), DOCS).repartition(5)


# --- mixing ------------------------------------------------------------------------------


def _plain_mix(rows, weights=(3, 1, 2), share=1.5, cap=2.0, offset=0.37):
    size = lambda t: len((t or "").split())  # noqa: E731  (the fixture has ASCII white space only)
    groups = defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        mark = hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()
        groups[source].append((size(text), mark, doc_id))
    order = sorted(groups, key=lambda s: (s is None, (s or "").encode()))
    totals = {s: sum(x[0] for x in groups[s]) for s in order}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = share * sum(totals.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > cap * totals[s]}
        if not full:
            target.update({s: weight[s] * level for s in free})
            break
        target.update({s: cap * totals[s] for s in full})
        left -= sum(cap * totals[s] for s in full)
        free -= full
    out = Counter()
    for s, members in groups.items():
        rate = target[s] / totals[s] if totals[s] else 0.0
        for place, (n, _, doc_id) in enumerate(sorted(members, key=lambda x: (x[0], x[1]))):
            out[doc_id, n, totals[s], round(target[s], 6), math.floor((place + 1) * rate + offset) - math.floor(place * rate + offset)] += 1
    return out


def test_mix_equals_plain_version_and_repeats(spark, docs):
    clash = docs.withColumn("size", F.lit("x")).withColumn("_source", F.lit(1)).withColumn("copies", F.lit(9))
    for df in (docs, clash):
        rows = mixing.mix(df).select("doc_id", "size", "source_size", "target", "copies", "source").collect()
        got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in rows)
        assert got == _plain_mix(_docs())
        assert all(0 <= r["copies"] <= 2 for r in rows)
        taken, largest = Counter(), Counter()
        for r in rows:
            taken[r["source"]] += r["copies"] * r["size"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        for r in rows:
            assert abs(taken[r["source"]] - r["target"]) <= 2 * largest[r["source"]]
    mixed = mixing.mix(docs)
    assert mixing.emitted(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, "b", 0)], DOCS)).collect()
    assert {(r["doc_id"], r["copies"], r["target"]) for r in rows} == {(1, 0, 0.0), (2, 0, 0.0)}


# --- sharding ----------------------------------------------------------------------------


@pytest.mark.parametrize("exact", [100_000, 20])
def test_shards(spark, docs, exact):
    rows = sharding.shard_documents(docs, shards=4, exact_groups=exact).collect()
    assert len(rows) == len(_docs())
    where, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        where[r["text"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if exact > 1000:  # every group through the heap: equal to the plain schedule
        groups = Counter()
        for r in rows:
            groups[r["text"]] += r["size"]
        heap = [(0, s) for s in range(4)]
        for size in sorted(groups.values(), reverse=True):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
        assert sorted(sizes.values()) == sorted(load for load, _ in heap)
    others = sorted(sizes.values())[:-1]  # the longest text has a shard to itself
    assert max(others) - min(others) <= (5 if exact > 1000 else 900)


def test_spread_is_longest_processing_time():
    rng = random.Random(2)
    for _ in range(200):
        loads, count, each = [float(rng.randint(0, 50)) for _ in range(5)], rng.randint(0, 40), float(rng.randint(1, 9))
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + each, s))
        taken = sharding._spread(loads, count, each)
        assert sum(taken) == count
        assert sorted(load + t * each for load, t in zip(loads, taken)) == pytest.approx(sorted(load for load, _ in heap))


def test_shards_of_nothing_and_fewer_groups_than_shards(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    rows = sharding.shard_documents(spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (2, "", None, None, 0)], DOCS)).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == [(1, 1), (2, 1), (2, 1)]


# --- vector searches ---------------------------------------------------------------------


def _vectors(n=400, d=12, seed=4):
    rng = np.random.default_rng(seed)
    grid = rng.normal(size=(n, d)).round(3)
    grid[50:180] = grid[10]  # a third of all rows is one vector
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(grid)]
    rows += [(1000, None), (None, rows[0][1]), (1001, [None] * d), (1002, [float("nan")] * d), (1003, [float("inf")] + [0.0] * (d - 1))]
    return rows + [(1004, []), (1005, [1.0]), (1006, [0.0] * d), rows[20]], grid


@pytest.fixture(scope="module")
def vectors(spark):
    rows, grid = _vectors()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, vec int, score int").repartition(6)
    return df, grid


@pytest.mark.parametrize("pivots, annulus, blocks", [(8, 16, 8192), (1, 4, 5), (400, 64, 8192)])
def test_exact_search_equals_brute_force(spark, vectors, pivots, annulus, blocks):
    df, grid = vectors
    whole = np.floor(256 * grid)
    whole = np.vstack([whole, np.zeros(grid.shape[1])])
    ids = [*range(len(grid)), 1006]
    want = set()
    for q in range(0, len(grid), 7):
        scores = sorted(((-int(whole[q] @ whole[k]), i) for k, i in enumerate(ids) if i != q))[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    found = exact_search.exact_top_k(
        df, (F.col("vec_id") % 7 == 0) & (F.col("vec_id") < 1000), 5, lambda x: F.floor(x * 256).cast("double"), pivots=pivots, annulus=annulus, block_rows=blocks
    )
    assert {tuple(r) for r in found.collect()} == want


def test_exact_search_of_large_numbers_is_exact():
    a = np.array([[2.0**40 + 1, 3.0]])
    assert exact_search.dots(a, a)[0, 0] == float((2**40 + 1) ** 2 + 9)


def test_graph_search_recall_and_scores(spark, vectors):
    df, grid = vectors
    unit = grid / np.linalg.norm(grid, axis=1)[:, None]
    found = hnsw.nearest(df, F.col("vec_id") % 3 == 0, 5, shard_rows=100, ef=48, m=8, ef_build=48).collect()
    hits = total = 0
    by_query = defaultdict(list)
    for r in found:
        by_query[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, len(grid), 3):
        cosines = unit @ unit[q]
        best = sorted((-round(c, 12), i) for i, c in enumerate(cosines) if i != q)[:5]
        got = sorted(by_query[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(g[2] == pytest.approx(cosines[g[1]], abs=1e-12) for g in got)
        hits += len({g[1] for g in got} & {i for _, i in best})
        total += 5
    assert hits >= 0.95 * total


def test_searches_with_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    two = one.union(spark.createDataFrame([(1, [2.0, 4.0])], "vec_id long, embedding array<float>"))
    for search in (exact_search.exact_top_k, hnsw.nearest):
        assert search(empty, F.lit(True)).count() == 0
        assert search(one, F.lit(True)).count() == 0
        assert search(two, F.lit(False)).count() == 0
        assert {(r[0], r[2]) for r in search(two, F.lit(True)).collect()} == {(0, 1), (1, 0)}


# --- near duplicates ---------------------------------------------------------------------


def _near_docs(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, next_id = [], 0
    base = [word() for _ in range(120)]
    for _ in range(60):  # a group that drifts: neighbours are linked, ends are not
        rows.append(" ".join(base))
        base[rng.randrange(len(base))] = word()
    heart = [word() for _ in range(150)]
    for _ in range(80):  # near copies of one text
        copy = list(heart)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    for _ in range(60):  # one passage, otherwise apart
        rows.append(" ".join(passage + [word() for _ in range(60)]))
    rows += ["same text here now"] * 40 + ["SAME text\there  now", "", None, " \n", "two words", "Two Words", "one", "one"]
    rows += ["x " * 50_000, "x " * 70_000]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None, "same text here now"), (3, rows[3])]


def _plain_groups(links, ids):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def _plain_components(rows, size, percent):
    def shingles(text):
        w = [x.decode() for x in (text or "").encode().lower().split()]
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size, percent, small", [(3, 85, 16), (5, 80, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, size, percent, small):
    monkeypatch.setattr(near_dups, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dups, "MINOR_ROWS", 4)
    monkeypatch.setattr(near_dups, "MEMBER_ROWS", 8)
    rows = _near_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_set", F.lit(1)).withColumn("kept", F.lit("x")).repartition(5)
    want = _plain_components(rows, size, percent)
    assert len(set(c for _, c in want.values())) < len(want) - 100
    got = near_dups.near_duplicates(df, shingle=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_missed_pairs_are_all_pairs_across_components(spark):
    """Without any confirmed link, every pair of a bucket that agrees enough must come back."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 60_000, 100).astype(np.uint16)
    signatures = []
    for i in range(40):
        s = base.copy()
        s[rng.choice(100, int(rng.integers(0, 60)), replace=False)] = rng.integers(60_000, 65_535)
        signatures.append(s)
    nodes = spark.createDataFrame([(i, 100 + i, bytearray(s.tobytes())) for i, s in enumerate(signatures)], "node long, n long, signature binary")
    first = lambda a, b: min((k for k in range(25) if (signatures[a][4 * k : 4 * k + 4] == signatures[b][4 * k : 4 * k + 4]).all()), default=None)
    rare = {i: i % 5 * 4 for i in range(40)}  # shingles of their own
    bands = {band: [i for i in range(40) if first(0, i) is not None or i == 0] for band in range(25)}
    rest = spark.createDataFrame([(7 + band, band, i, 100 + i, rare[i]) for band, ids in bands.items() for i in ids], "bucket long, band int, node long, n long, own long")
    labels = spark.createDataFrame([(i, 0) for i in range(10)], "id long, component long")
    tested = spark.createDataFrame([(0, i) for i in range(1, 40)], "a long, b long")

    def reachable(a, b):
        top = min(100 + a - rare[a], 100 + b - rare[b])
        return 100 * top >= 85 * (200 + a + b - top)

    pairs = {(a, b) for a in bands[0] for b in bands[0] if a < b and not (a < 10 and b < 10) and reachable(a, b)}
    close = {p for p in pairs if p[0] and (signatures[p[0]] == signatures[p[1]]).sum() >= 60}
    want = {p for p in close if first(*p) is not None}
    # node i has 100 + i shingles; nodes of one third have all of the smaller set in common
    sets = {i: sorted(range(1000 * (i % 3), 1000 * (i % 3) + 100 + i)) for i in range(40)}
    shingles = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    for limit in (2, 100):
        near_dups.SMALL_BUCKET, before = limit, near_dups.SMALL_BUCKET
        pairs_left, found = near_dups.missed_pairs(rest, shingles, labels, nodes, tested, 100, 4, 60, 85)
        got, links = ({(r["a"], r["b"]) for r in df.collect()} for df in (pairs_left, found))
        near_dups.SMALL_BUCKET = before
        if limit == 100:
            assert want <= got <= close and not links
        else:
            exact = {(a, b) for a, b in want if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
            joined = lambda some: _plain_groups(some | {(0, i) for i in range(10)}, range(40))
            assert not got and links <= exact and joined(links) == joined(exact)
            assert len(exact) > 5
    assert len(want) > 5
    star = {(r["a"], r["b"]) for r in near_dups.central_pairs(rest, labels, 85).collect()}
    assert star == {p for p in pairs if p[0] == 0}  # node 0 has no shingle of its own


def test_own_shingles(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "b c d e"), (3, "x"), (4, "p q r"), (4, "s t u")], "node long, text string")
    assert {tuple(r) for r in near_dups.own_shingles(near_dups.full_sets(texts, 3)).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_super_minhash_estimates_with_less_spread():
    rng = np.random.default_rng(3)
    errors, m = [], 64
    for _ in range(300):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = pool[:45], pool[15:]
        low = near_dups.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], [45, 45]), 2, m)
        assert np.isfinite(low).all()
        errors.append((low[0] == low[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.9 * 0.25 / m  # independent draws have 0.25 / m


def test_super_minhash_stops_early_without_change():
    hashes = np.random.default_rng(4).integers(0, 2**63, 500).astype(np.uint64)
    whole = near_dups.super_minhash(hashes, np.zeros(500, int), 1, 32)
    parts = [near_dups.super_minhash(hashes[i : i + 5], np.zeros(5, int), 1, 32) for i in range(0, 500, 5)]
    assert (whole == np.min(parts, axis=0)).all()


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    order = list(range(60))
    random.Random(8).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(links).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "and", "wh"], "de": ["sch", "ung", "ein", "ü"]}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 60)))
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(20)]
    secret = rows[30][1] + " password = hunter2hunter2hunter2"
    rows[30] = (30, secret, *rows[30][2:4], len(secret))
    rows += [(300, None, None, None, None), (301, "", "en", "src0", 0), (302, "1234 -- 5678", "en", "src0", 12)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}.parquet")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = docs
        if name != "tokens":
            assert docs.dtypes == before.dtypes
    assert {r["doc_id"] for r in seen["language"].collect()} == {r[0] for r in rows} - {300, 301, 302}
    assert {r["doc_id"] for r in seen["near_duplicates"].collect()} == set(range(160))
    clean = {r["doc_id"]: r for r in seen["secrets"].collect()}
    assert clean[30]["text"] == rows[30][1].split("password")[0] + "[SECRET]" and clean[30]["n_chars"] == len(clean[30]["text"])
    assert all(clean[i]["text"] == rows[i][1] for i in range(160) if i != 30)
    kept = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in clean.values()]
    want = Counter({k[0]: k[4] * n for k, n in _plain_mix(kept).items() if k[4]})
    assert Counter(r["doc_id"] for r in seen["mix"].collect()) == want
    final = seen["tokens"].collect()
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in final)
    texts = Counter((r["doc_id"], r["text"]) for r in seen["mix"].collect())
    decoded = bpe.decode(seen["tokens"], public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in decoded) == texts
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, ((r["doc_id"], tuple(r["ids"])) for r in again))) == sorted((r["doc_id"], tuple(r["ids"])) for r in final)


def test_most_frequent_rows_per_key(spark):
    rng = random.Random(17)
    rows = [(k, i, rng.choice([1, 1, 1, 2, 5, 40, 41, 900])) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, n long")
    for limit in (10, 100, 1000):
        kept = common.most_frequent(df, "n", limit, "k").collect()
        for k in "ab":
            own = sorted((r["n"] for r in kept if r["k"] == k), reverse=True)
            every = sorted((n for key, _, n in rows if key == k), reverse=True)
            assert len(own) <= limit and own == every[: len(own)]
            assert len(own) == len(every) if limit == 1000 else len(own) + sum(n == every[len(own)] or 40 <= n <= 41 for n in every) > limit
    assert common.most_frequent(df, "n", 1000).count() == 400
