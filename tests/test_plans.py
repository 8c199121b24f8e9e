import random

from pyspark.sql import functions as F

from passagework.operators.schema import attrs
from passagework.plans.ingest import apply_ingest, doc_passages, post_passages, source_passages, timed_passages, untimed_passages
from passagework.sources import captions, pages, repo
from passagework.streaming.ingest import ingest_stream, read_table


def test_ingest_of_every_kind(spark):
    html = "<article><h2>Why</h2><p>Because of it.</p><pre>a()\nb()</pre></article><title>T</title>"
    articles = pages.articles(spark.createDataFrame([("https://w/company/blog/x/a", html)], "url string, html string"), "/company/blog/", "https://w")
    lastmods = spark.createDataFrame([("/company/blog/x/a", "2026-01-01")], "slug string, lastmod string")
    posts = post_passages(articles, lastmods, {"id": "blog", "title": "Blog"})
    assert [(r.text, r.attrs.channel, r.attrs.sitemap_lastmod) for r in posts.orderBy("chunk_index").collect()] == [("Why. Because of it.", "x", "2026-01-01"), ("Why. a()\nb()", "x", "2026-01-01")]

    docs = doc_passages(
        spark.createDataFrame([("https://w/docs/cli/a#x", "/docs/cli/a", "cli", "2026-01-01", "# Run\ntext\n```sh\nrun it\n```")], "url string, slug string, product string, lastmod string, markdown string"),
        {"cli": "The CLI"}, "https://w",
    )
    rows = docs.orderBy("chunk_index").collect()
    assert (rows[0].parent.title, rows[0].asset.url, rows[1].code, rows[1].text, rows[1].attrs.language) == ("The CLI", "https://w/docs/cli/a", "run it", "Run. run", "sh")

    files = repo.repo_files(spark.createDataFrame([("o/r", "README.md", bytearray(b"# Race"), 6), ("o/r", "a/b.py", bytearray(b"def collect(): pass"), 19)], "repo string, path string, content binary, length long"))
    source = source_passages(files, repo.readmes(files), "https://h", "c1")
    by_id = {r.asset.id: r for r in source.collect()}
    assert by_id["o/r:a/b.py"].asset.url == "https://h/o/r/blob/c1/a/b.py" and by_id["o/r:a/b.py"].parent.title == "Race"

    srt = "1\n00:00:01,000 --> 00:00:02,000\nHello.\n\n2\n00:00:02,000 --> 00:00:03,000\nBye."
    cues = captions.explode_cues(spark.createDataFrame([("v1", srt)], "asset_id string, value string"), captions.subtitle_cues(F.col("value")), "asset_id")
    assets = spark.createDataFrame([("v1", "Talk", "u", None, None, "long text here")], "asset_id string, title string, url string, audio_url string, published_at timestamp, transcript string").withColumn("attrs", attrs(youtube_video_id=F.col("asset_id")))
    video = timed_passages("video", assets, cues, {"id": "ch", "title": "Channel"}, "captions")
    row = video.first()
    assert (row.text, row.start_ms, row.end_ms, row.ingest_complete, row.parent.type) == ("Hello. Bye.", 1000, 3000, True, "channel")
    plain = untimed_passages(assets, {"id": "p", "title": "Pod"}, "text")
    assert plain.first().start_ms is None

    every = posts.unionByName(docs).unionByName(source).unionByName(video).unionByName(plain)
    bad = posts.withColumn("parent", F.lit(None).cast(posts.schema["parent"].dataType))
    table, rejected = apply_ingest(every.limit(0), every.unionByName(bad))
    assert table.count() == every.count() and rejected.count() == 2
    again, _ = apply_ingest(table, every)
    assert again.count() == table.count()


def test_stream_with_cap_and_replay(spark, tmp_path):
    """Assets split over batches and rows that come late: the table is that of one merge of all rows."""
    rng = random.Random(41)
    landed, root = tmp_path / "landed", str(tmp_path / "table")
    rows = [(f"a{rng.randint(0, 4)}", rng.randint(0, 9), rng.choice([None, f"v{i}"]), i) for i in range(120)]
    rows = [(*r, 7 if r[0] == "a1" else None) for r in rows]
    late = rows[::-1]  # newest first
    for i in range(0, 120, 20):
        spark.createDataFrame(late[i : i + 20], "asset_id string, chunk_index int, text string, seq int, n_chunks int").coalesce(1).write.mode("append").parquet(str(landed))
    schema = spark.read.parquet(str(landed)).schema
    want = {}
    for asset, chunk, text, seq, _ in rows:
        if not (asset == "a1" and chunk >= 7):
            old = want.get((asset, chunk), (None, None))
            want[asset, chunk] = (text if text is not None else old[0], seq)

    def run(name, buckets):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(landed))
        query = ingest_stream(source, root, str(tmp_path / name), ["asset_id"], order=["seq"], buckets=buckets, ends="n_chunks")
        query.awaitTermination()
        return query

    query = run("progress", 4)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    newest = {k: v[1] for k, v in want.items()}
    got = {(r.asset_id, r.chunk_index): (r.text, r.seq) for r in read_table(spark, root, schema).collect()}
    assert {k: v[1] for k, v in got.items()} == newest
    assert all(got[k][0] is not None or want[k][0] is None for k in want)
    run("replayed", 9)  # a lost progress folder replays every batch; the table keeps its buckets
    again = {(r.asset_id, r.chunk_index): (r.text, r.seq) for r in read_table(spark, root, schema).collect()}
    assert {k: v[1] for k, v in again.items()} == newest
    parts = [p for p in (tmp_path / "table").glob("batch=*/bucket=*")]
    assert len(parts) <= 2 * 4
