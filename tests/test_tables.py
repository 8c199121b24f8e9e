import random
from datetime import datetime

from pyspark.sql import functions as F

from passagework.operators import enrich, state
from passagework.operators.clips import clip_pages, transcript_lines, write_transcripts
from passagework.operators.schema import (
    attrs, construction_errors, from_legacy, node, passage_filter, split_valid, to_passages, validation_errors,
)
from passagework.operators.upsert import read_snapshot, update_attrs, upsert_passages, write_snapshot
from passagework.plans.migrate import migrate


def passages(spark, rows):
    df = spark.createDataFrame(rows, "type string, id string, title string, ptype string, pid string, n int, text string, code string, sp string, done boolean")
    parent = F.when(F.col("pid").isNotNull(), node(F.col("ptype"), F.col("pid"), F.col("pid")))
    return to_passages(
        df.select(
            node(F.col("type"), F.col("id"), F.col("title")).alias("asset"), parent.alias("parent"), F.col("n").alias("chunk_index"),
            "text", "code", attrs(spotify_episode_id=F.col("sp")).alias("attrs"), F.col("done").alias("ingest_complete"),
        )
    )


def test_construction_and_validation(spark):
    df = passages(spark, [
        ("post", "a", "T", "blog", "b", 0, "x", None, "", None), ("post", "b", "T", None, None, 0, "x", None, None, None),
        ("repo", "c", "T", "blog", "b", 0, "x", None, None, None), ("song", "d", "", None, None, 0, "", None, None, None),
        ("post", "e", "T", "manual", "b", -1, "x" * 9000, "y" * 9000, None, None),
    ])
    errors = {r.id: r.e for r in df.select("asset.id", construction_errors().alias("e")).collect()}
    assert errors["a"] == [] and errors["b"] == ["parent required"] and errors["c"] == ["parent not allowed"]
    assert errors["d"] == ["unknown asset type", "asset id and title required", "text required"]
    assert errors["e"] == ["wrong parent type"]
    good, bad = split_valid(df, validation_errors())
    assert {r.asset.id: r.reject_reasons for r in bad.collect()} == {"d": ["asset.type", "asset.title", "text"], "e": ["chunk_index", "text", "code"]}
    assert good.filter("asset.id = 'a'").first().attrs.spotify_episode_id is None
    assert passage_filter(df, "post", "a", 0).count() == 1 and passage_filter(df, "post", "zz").count() == 0


def test_migration_is_idempotent(spark):
    old = spark.createDataFrame([("show", "The Show", "abc", "Hello", "sp1", "hi", 0, "kept")],
                                "podcast_id string, podcast_title string, episode_id string, episode_title string, spotify_episode_id string, text string, chunk_index int, mood string")
    once = from_legacy(old)
    row = once.first()
    assert (row.asset.type, row.asset.id, row.parent.type, row.parent.title, row.attrs.spotify_episode_id) == ("episode", "abc", "podcast", "The Show", "sp1")
    assert row.attrs_extra == {"mood": "kept"} and "podcast_id" not in once.columns
    assert from_legacy(once).collect() == once.collect()
    valid, rejected = migrate(old.unionByName(old.withColumn("text", F.lit(""))))
    assert (valid.count(), rejected.count()) == (1, 1)


def test_upsert_rules(spark):
    stored = passages(spark, [("post", "a", "T", "blog", "b", i, f"old{i}", "code", "sp", True) for i in range(4)] + [("post", "gone", "T", "blog", "b", 0, "stay", None, None, True)])
    new = passages(spark, [("post", "a", "T2", "blog", "b", 0, "new0", None, None, True), ("post", "a", "T2", "blog", "b", 1, "dup", None, None, True), ("post", "a", "T2", "blog", "b", 1, "new1", None, None, True)])
    out = {(r.asset.id, r.chunk_index): r for r in upsert_passages(stored, new, order=["text"]).collect()}
    assert set(out) == {("a", 0), ("a", 1), ("gone", 0)}
    assert out["a", 1].text == "new1" and out["a", 0].code == "code" and out["a", 0].attrs.spotify_episode_id is None
    merged = upsert_passages(stored, new, merge_attrs=True).filter("asset.id = 'a'").first()
    assert merged.attrs.spotify_episode_id == "sp"
    again = upsert_passages(upsert_passages(stored, new, order=["text"]), new, order=["text"])
    assert sorted(map(str, again.collect())) == sorted(map(str, out.values()))


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "table")
    assert read_snapshot(spark, root) is None
    rows = passages(spark, [("post", "a", "T", "blog", "b", i, "x", None, None, True) for i in range(3)])
    assert write_snapshot(rows, root) == 1
    assert write_snapshot(rows.limit(2), root) == 2
    assert read_snapshot(spark, root).count() == 2


def test_states(spark):
    rows = [("ok", i, "2026-06-03", True, None) for i in (0, 1)] + [("gap", i, "2026-06-03", True, None) for i in (0, 2)]
    rows += [("dup", i, "2026-06-03", True, 5) for i in (0, 0, 1)] + [("nodate", 0, None, True, None), ("half", 0, "2026-06-03", True, None), ("half", 1, "2026-06-03", False, None)]
    chunks = spark.createDataFrame(rows, "slug string, chunk_index int, lastmod string, complete boolean, start_ms bigint")
    catalog = spark.createDataFrame([(s, "2026-06-03") for s in ("ok", "gap", "dup", "nodate", "half", "new")] , "slug string, lastmod string")
    stored = state.stored_state(chunks, ["slug"])
    plan = state.ingest_plan(catalog, stored, ["slug"], state.post_state(F.col("lastmod")))
    assert {r.slug: r.state for r in plan.collect()} == {"ok": "complete", "gap": "partial", "dup": "partial", "nodate": "stale", "half": "stale", "new": "missing"}
    later = state.ingest_plan(catalog.withColumn("lastmod", F.lit("2026-06-04")), stored, ["slug"], state.post_state(F.col("lastmod")))
    assert {r.slug: r.state for r in later.collect()}["ok"] == "stale"
    videos = state.ingest_plan(catalog, stored, ["slug"], state.video_state())
    assert {r.slug: r.state for r in videos.collect()} == {"ok": "complete", "gap": "complete", "dup": "complete", "nodate": "complete", "half": "complete", "new": "missing"}
    episodes = state.ingest_plan(catalog, stored, ["slug"], state.episode_state())
    assert [r.slug for r in episodes.filter("state = 'complete'").collect()] == ["dup"]
    forced = state.ingest_plan(catalog, stored, ["slug"], state.post_state(F.col("lastmod"), force=True))
    assert forced.filter("state <> 'missing'").count() == 0


def test_newest_first(spark):
    rng = random.Random(31)
    rows = [(f"r{i:02d}", None if i % 6 == 0 else datetime(2000 + rng.randint(0, 3), 1 + i % 3, 5)) for i in range(30)]
    rng.shuffle(rows)
    got = [r.id for r in state.newest_first(spark.createDataFrame(rows, "id string, at timestamp"), "at", "id").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or datetime(1, 1, 1)).toordinal(), r[0]))]


def test_attribute_changes(spark):
    """Ids shared by two types, rows without attributes, several changes of one asset, null keys."""
    shape = "asset struct<type:string,id:string>, attrs struct<duration:string,anchor_id:string>, n int"
    rows = [(("episode", "7"), ("60", "a"), 0), (("video", "7"), ("60", "a"), 1), (("episode", "8"), None, 2), (("episode", "9"), None, 3), ((None, "7"), None, 4)]
    changes = spark.createDataFrame([("episode", "7", "90", 2), ("episode", "7", "10", 1), ("episode", "8", "5", 1), ("episode", "9", None, 1), (None, None, "1", 1)],
                                    "asset_type string, asset_id string, duration string, seq int")
    got = {r.n: r.attrs and tuple(r.attrs) for r in update_attrs(spark.createDataFrame(rows, shape), changes, ("duration",), order=["seq"]).collect()}
    assert got == {0: ("90", "a"), 1: ("60", "a"), 2: ("5", None), 3: None, 4: None}


def test_long_legacy_text_is_kept_and_refused(spark):
    old = spark.createDataFrame([("p", "e", "t", "y" * 9000), ("p", "f", "t", "y" * 8000)], "podcast_id string, episode_id string, episode_title string, text string").withColumn("chunk_index", F.lit(0))
    assert sorted(len(r.text) for r in from_legacy(old).collect()) == [8000, 9000]
    valid, rejected = migrate(old)
    assert [r.asset.id for r in valid.collect()] == ["f"]
    assert [(r.asset.id, r.reject_reasons, len(r.text)) for r in rejected.collect()] == [("e", ["text"], 9000)]


def test_title_matching(spark):
    assets = spark.createDataFrame([("1", "Big Data  Day"), ("2", "Intro to Big Data Day (live)"), ("3", "Day"), ("4", "Nothing"), ("5", "a")], "id string, title string")
    catalog = spark.createDataFrame([(1, "big data day"), (2, "Big Data Day"), (3, "The Day After"), (4, "intro")], "track int, name string")
    exact = {r.id: r.track for r in enrich.match_exact(assets, catalog, "title", "name", "track").collect()}
    assert exact == {"1": 2, "2": None, "3": None, "4": None, "5": None}
    loose = {r.id: r.track for r in enrich.match_contained(assets, catalog, "title", "name", "track").collect()}
    assert loose == {"1": 1, "2": 1, "3": 1, "4": None, "5": 1}


def test_titles_with_one_common_start_stay_linear(spark):
    """Hundreds of titles that begin alike meet by their rare ends, not by their start."""
    titles = spark.createDataFrame([(f"the long running harbour programme part {i:04d}",) for i in range(400)], "title_key string")
    assert enrich.contained_titles(titles, titles).count() == 400
    small = titles.select(F.col("title_key").alias("small"))
    pairs = enrich._inside(small, "small", titles.select(F.col("title_key").alias("large")), "large")
    joined = [line for line in pairs._jdf.queryExecution().toString().split("\n") if "Join" in line]
    assert joined and pairs.count() == 400
    mixed = spark.createDataFrame([("quay",), ("the quay wall",), ("wall",), ("zz",)], "title_key string")
    got = {tuple(r) for r in enrich.contained_titles(mixed, mixed).collect()}
    words = ["quay", "the quay wall", "wall", "zz"]
    assert got == {(a, b) for a in words for b in words if a in b or b in a}


def test_transcript_files(spark, tmp_path):
    """Two assets of one title, one of them long: lines come back in order from their own files."""
    assets = spark.createDataFrame([("a/1", "Same Title!", "2020-01-01", None), ("b2", "Same Title!", None, "u")], "asset_id string, title string, published string, url string")
    texts = spark.createDataFrame([("a/1", i, f"line {i}") for i in range(50)] + [("b2", 0, "only")], "asset_id string, chunk_index int, text string").repartition(4)
    write_transcripts(transcript_lines(assets, texts), str(tmp_path / "out"))
    found = {}
    for path in sorted((tmp_path / "out").glob("bucket=*/file=*/part-*")):
        found.setdefault(path.parent.name, []).extend(path.read_text().splitlines())
    assert found == {
        "file=Same-Title-a1": ["Episode: Same Title!", "Date: 2020-01-01", "URL: Unknown", "-" * 50, "", *[f"line {i}" for i in range(50)]],
        "file=Same-Title-b2": ["Episode: Same Title!", "Date: Unknown", "URL: u", "-" * 50, "", "only"],
    }


def test_clip_pages(spark):
    rows = [("p", 0, "h", "G", "A", 61000, "t"), ("p", 1, None, "A", "A", None, None), ("p", 2, "h", None, "A", 3661000, "u")]
    df = spark.createDataFrame(rows, "pack_id string, ord int, href string, group_title string, asset_title string, start_ms bigint, text string")
    pages = [r.text for r in clip_pages(df, 2).orderBy("page").collect()]
    assert "\n\n".join(pages) == "1.\nh\nG\nA\nAt 1:01\nt\n\n2.\nA\n\n3.\nh\nA\nAt 1:01:01\nu"


def test_migration_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    from passagework.plans import migrate as plan

    source, target = str(tmp_path / "old"), str(tmp_path / "new")
    rows = [(f"e{i}", f"Title {i}", "" if i % 10 == 3 else f"text {i}", i) for i in range(60)]
    columns = "episode_id string, episode_title string, text string, chunk_index int"
    spark.createDataFrame(rows, columns).repartition(6).write.parquet(source)
    valid, rejected, left = plan.migrate_in_steps(spark, source, target, files_per_step=2, at_most=0)
    assert (valid.count(), rejected.count(), left) == (0, 0, 3)
    valid, rejected, left = plan.migrate_in_steps(spark, source, target, files_per_step=2, at_most=1)
    first = valid.count() + rejected.count()
    assert left == 2 and 0 < first < 60

    # a run that breaks while it writes leaves rows without a commit
    parts = tmp_path / "new" / "rows" / "step=1"
    valid.write.parquet(str(parts))
    (parts / "_SUCCESS").unlink()
    spark.createDataFrame([("late", "Late", "late text", 0)], columns).coalesce(1).write.mode("append").parquet(source)
    read, made = [], plan.from_legacy
    monkeypatch.setattr(plan, "from_legacy", lambda df: read.append(len(df.inputFiles())) or made(df))
    valid, rejected, left = plan.migrate_in_steps(spark, source, target, files_per_step=2)
    assert left == 0 and [n for n in read if n] == [2, 2, 1]  # the finished step is not read again
    ids = [r.id for r in valid.unionByName(rejected.drop("reject_reasons")).select("asset.id").collect()]
    assert sorted(ids) == sorted([f"e{i}" for i in range(60)] + ["late"])
    assert {r.id for r in rejected.select("asset.id").collect()} == {f"e{i}" for i in range(60) if i % 10 == 3}


def test_sketches_merge_without_counting_twice(spark):
    rows = [("s", f"a{i % 40}", i, "x" if i % 40 < 10 else None) for i in range(400)] + [("t", "a1", 0, None)]
    made = spark.createDataFrame(rows, "parent string, asset string, chunk int, channel string").select(
        F.struct(F.lit("blog").alias("type"), F.col("parent").alias("id")).alias("parent"),
        F.struct(F.lit("post").alias("type"), F.col("asset").alias("id")).alias("asset"),
        F.concat_ws("/", "asset", "chunk").alias("passage_id"), F.struct("channel").alias("attrs"),
    )
    stored, change = made.filter("passage_id < 'a3'"), made.filter("passage_id > 'a2'")
    merged = state.merge_sketches(*[state.container_sketches(p, "channel") for p in (stored, change, change)])
    got = {r.parent_id: (r.n_chunks, r.n_assets, r.n_with_attr) for r in state.sketched_counts(merged).collect()}
    assert got["t"] == (1, 1, 0)
    assert abs(got["s"][0] - 400) <= 8 and got["s"][1:] == (40, 10)
    assert state.sketched_counts(state.container_sketches(made.limit(0))).count() == 0
