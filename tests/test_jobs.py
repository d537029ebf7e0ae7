from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from newsloom.operators import requests, store
from newsloom.operators.rollup import digest_heads, digest_parts, entry_blocks, write_digests
from newsloom.plans.analyze import analyze
from newsloom.plans.chain import check_stages, run, stages_of
from newsloom.plans.publish import publish
from newsloom.schemas import CAPTURES, ITEMS, RESPONSES, SOURCES
from newsloom.sources.digests import choose_digest, read_digest
from newsloom.streaming.ingest import ingest_captures, ingest_items, start_ingest

NOW = datetime(2026, 2, 6, 5, tzinfo=timezone.utc)
HEAD = "---\ntitle: {}\ndescription:\ndate: 2026-02-06\nscheduled: 2026-02-06\ntags:\n  - AI\nlayout: layouts/post.njk\n---\n"


def entry(title, url, when, summary, published="unknown"):
    return f"#### {title}\n- URL: {url}\n- Published: {published}\n- Collected: {when}+00:00\n- Summary:\n  {summary}\n"


def fill(spark, path, *rows):
    """rows: (url, title, collected, content, summary)"""
    df = spark.createDataFrame(rows, "url string, title string, at string, content string, summary string")
    at = F.col("at").cast("timestamp")
    number = F.regexp_extract("url", r"\d+$", 0).cast("bigint")
    store.append_news(
        df.select(
            "url", "title", F.lit(None).cast("string").alias("published_date"), F.lit(None).cast("timestamp").alias("published_ts"),
            at.alias("collected_at"), number.alias("ingest_seq"), "content", "summary",
            F.extract(F.lit("YEAROFWEEK"), at).cast("int").alias("iso_year"), F.weekofyear(at).alias("iso_week"),
        ),
        path,
    )


ROWS = [
    ("u2", "Two", "2026-02-06 01:00:00", "First. Second! Third? Fourth.", None),
    ("u1", "One", "2026-02-02 00:00:00", "text", "given"),
    ("u3", "Three", "2026-02-06 01:00:00.5", "no mark", ""),
    ("u4", "Before", "2026-02-01 23:59:59", "x", None),
    ("u5", "After", "2026-02-09 00:00:00", "x", None),
]


def test_digest_of_the_week(spark, tmp_path):
    path = str(tmp_path / "news")
    fill(spark, path, *ROWS)
    parts = analyze(spark, path, NOW, output=str(tmp_path / "out")).collect()
    want = HEAD.format("News Summary (2026-06)") + "\n".join(
        [
            entry("One", "u1", "2026-02-02T00:00:00", "given"),
            entry("Two", "u2", "2026-02-06T01:00:00", "First. Second! Third?"),
            entry("Three", "u3", "2026-02-06T01:00:00.500000", "no mark"),
        ]
    )
    assert [(p.iso_year, p.iso_week, p.part, p.markdown) for p in parts] == [(2026, 6, 0, want)]
    files = sorted((tmp_path / "out" / "file=news_2026_06.md").glob("part-*"))
    assert "".join(f.read_text() for f in files) == want
    summaries = {r.url: r.summary for r in store.read_news(spark, path).collect()}
    assert summaries == {"u1": "given", "u2": "First. Second! Third?", "u3": "no mark", "u4": None, "u5": None}


def test_rolling_window_without_summaries(spark, tmp_path):
    path = str(tmp_path / "news")
    fill(spark, path, *ROWS)
    (part,) = analyze(spark, path, NOW, days=6, skip_summaries=True).collect()
    assert part.markdown.startswith(HEAD.format("News Summary (last 6 days)") + "#### Before\n")
    assert (part.iso_year, part.iso_week) == (2026, 6)
    assert store.read_news(spark, path).where("summary <> 'given'").count() == 1


def test_digest_of_nothing_is_its_head(spark, tmp_path):
    (part,) = analyze(spark, str(tmp_path / "news"), NOW).collect()
    assert part.markdown == HEAD.format("News Summary (2026-06)")


def test_parts_joined_are_the_whole_digest(spark, tmp_path):
    path = str(tmp_path / "news")
    fill(spark, path, *((f"u{n}", f"T{n}", "2026-02-06 01:00:00", "c", "s") for n in range(25)))
    whole = analyze(spark, path, NOW).first().markdown
    parts = analyze(spark, path, NOW, part_entries=4, output=str(tmp_path / "out")).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(7))
    assert "\n".join(p.markdown for p in parts) == whole
    files = sorted((tmp_path / "out" / "file=news_2026_06.md").glob("part-*"))
    assert "".join(f.read_text() for f in files) == whole


def test_digests_of_all_weeks(spark, tmp_path):
    path = str(tmp_path / "news")
    fill(spark, path, *ROWS)
    news = store.read_news(spark, path)
    heads = digest_heads(news.select("iso_year", "iso_week").distinct(), F.lit("2026-02-06"))
    parts = digest_parts(entry_blocks(news), heads)
    assert sorted((p.iso_week, p.markdown.count("####")) for p in parts.collect()) == [(5, 1), (6, 3), (7, 1)]
    write_digests(parts, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("file=news_2026_*.md"))) == 3


def test_failed_and_empty_responses_leave_rows_pending(spark, tmp_path):
    path = str(tmp_path / "news")
    fill(spark, path, *ROWS)
    asked = requests.summary_requests(store.read_news(spark, path)).collect()
    assert sorted(r.key for r in asked) == ["u2", "u3", "u4", "u5"]
    by_key = {r.key: r.request_id for r in asked}
    responses = spark.createDataFrame([(by_key["u2"], " \nAnswer ", None), (by_key["u3"], "x", "timeout")], RESPONSES)
    part = analyze(spark, path, NOW, responses=responses).first()
    assert "  Answer\n" in part.markdown
    assert {r.url: r.summary for r in store.read_news(spark, path).collect()}["u3"] == ""


def test_requests(spark):
    captured = spark.createDataFrame([("u", "x" * 30_000), ("v", None)], "url string, body string")
    rows = {r.key: r.input for r in requests.inspection_requests(captured).collect()}
    assert rows == {"u": "Captured from u:\n\n" + "x" * 20_000, "v": "Captured from v:\n\n"}
    assert requests.inspection_requests(captured, head=None).where("key = 'u'").first().input.count("x") == 30_000
    parts = spark.createDataFrame([(2026, 6, 0, "digest")], "iso_year int, iso_week int, part int, markdown string")
    assert requests.post_requests(parts, "Use ##.").first().instructions.endswith("\n\nKeep to this layout:\nUse ##.")
    assert requests.post_requests(parts).first().instructions == requests.POST_INSTRUCTIONS


def test_any_summarizer_can_be_given(spark):
    rows = spark.createDataFrame([("u1", "text", None), ("u2", "text", "done"), ("u3", "", None)], "url string, content string, summary string")
    got = requests.summarize(rows, lambda content: F.upper(content)).orderBy("url").collect()
    assert [r.summary for r in got] == ["TEXT", "done", None]


def test_post(spark, tmp_path):
    parts = spark.createDataFrame([(2026, 6, 0, "digest")], "iso_year int, iso_week int, part int, markdown string")
    request = requests.post_requests(parts).first().request_id
    draft = "---\ntitle: model\n---\n\n# Week in AI\n\n## Highlights\n- x"
    responses = spark.createDataFrame([(request, draft, None)], RESPONSES)
    post = publish(spark, parts, responses, NOW, output=str(tmp_path / "out")).first()
    assert post.title == "Week in AI"
    want = HEAD.format("Week in AI") + "## Highlights\n- x\n\n---\n\n- [AI news summary — 2026-06](../weekly_news/news_2026_06)\n"
    assert post.markdown == want
    files = sorted((tmp_path / "out" / "file=blog_2026_06.md").glob("part-*"))
    assert "".join(f.read_text() for f in files) == want


@pytest.mark.parametrize("parts", [1, 3])
def test_a_digest_in_parts_becomes_one_post(spark, tmp_path, parts):
    rows = [(2026, week, part, f"digest {part}") for week in (6, 7) for part in range(parts)]
    digests = spark.createDataFrame(rows, "iso_year int, iso_week int, part int, markdown string")
    asked = requests.post_requests(digests).orderBy("key").collect()
    # Week 7 lacks the answer for its last part.
    answers = spark.createDataFrame([(r.request_id, f"# Title {r.input}\n\nText of {r.input}", None) for r in asked[:-1]], RESPONSES)
    posts = publish(spark, digests, answers, NOW, output=str(tmp_path / "out")).orderBy("part").collect()
    assert [(r.iso_week, r.part, r.title) for r in posts] == [(6, n, None if n else "Title digest 0") for n in range(parts)]
    files = sorted((tmp_path / "out" / "file=blog_2026_06.md").glob("part-*"))
    body = "\n\n".join(f"Text of digest {n}" for n in range(parts))
    want = HEAD.format("Title digest 0") + body + "\n\n---\n\n- [AI news summary — 2026-06](../weekly_news/news_2026_06)\n"
    assert "".join(f.read_text() for f in files) == want
    assert not (tmp_path / "out" / "file=blog_2026_07.md").exists()


def test_digest_files_are_read_whole(spark, tmp_path):
    path = tmp_path / "old_digest.md"
    path.write_text("# a\n\nb\n")
    (row,) = read_digest(spark, str(path)).collect()
    assert (row.part, row.markdown) == (0, "# a\n\nb\n")
    assert choose_digest(None, None, "c") == "c"
    assert choose_digest(None, "b", "c") == "b"
    assert choose_digest("a", "b", "c") == "a"


def test_stage_lists():
    check_stages(["collector", "analyzer", "blogger"])
    with pytest.raises(ValueError):
        check_stages(["collector", "blogger"])
    with pytest.raises(ValueError):
        check_stages(["collector", "publisher"])
    assert stages_of("pipeline") == ["collector", "analyzer", "blogger"]
    assert stages_of(" analyzer, blogger,") == ["analyzer", "blogger"]


def sources_and_captures(spark):
    api = {"items_path": "$", "url_field": "url", "title_field": "title", "content_field": "body"}
    sources = spark.createDataFrame([(1, "p", "https://p.org/api", "api", {"api": api})], SOURCES)
    body = '[{"url":"https://p.org/1","title":"One","body":"Text one."},{"url":"https://p.org/2","title":"One","body":"again"},{"url":"https://p.org/3","title":"Three","body":""}]'
    return sources, spark.createDataFrame([("https://p.org/api", NOW, True, False, body)], CAPTURES)


def test_chain(spark, tmp_path):
    sources, captures = sources_and_captures(spark)
    news = str(tmp_path / "news")
    collected = run(spark, ["collector", "analyzer"], NOW, news, {"collector": {"sources": sources, "captures": captures}})
    assert sorted(r.outcome for r in collected["outcomes"].collect()) == ["duplicate", "inserted", "no_content"]
    digest = collected["digest"]
    assert "#### One\n- URL: https://p.org/1\n" in digest.first().markdown
    request = requests.post_requests(digest).first().request_id
    responses = spark.createDataFrame([(request, "# Post", None)], RESPONSES)
    inputs = {"collector": {"sources": sources, "captures": captures}, "blogger": {"responses": responses}}
    everything = run(spark, stages_of("pipeline"), NOW, news, inputs)
    assert {r.outcome for r in everything["outcomes"].collect()} == {"duplicate", "no_content"}
    assert everything["posts"].first().title == "Post"


def test_sections_know_of_each_other(spark):
    rows = [(2026, 6, 0, "---\nx: #### no\n---\n#### A\n- 1\n\n#### B\n- 2\n"), (2026, 6, 1, "#### C\n- 3\n"), (2026, 6, 2, "bare"), (2026, 7, 0, "#### D\n")]
    parts = spark.createDataFrame(rows, "iso_year int, iso_week int, part int, markdown string")
    asked = {r.key: r.instructions for r in requests.post_requests(parts, instructions="Go.").collect()}
    outline = "The sections begin and end with:\n1. A … B\n2. C … C\n3.  … "
    whole = "Go.\n\nThe digest comes in 3 sections. This is section {}. Write this section of the post only. {} {} " + outline
    assert asked == {
        "2026-06/0": whole.format(1, "Begin the post with its title.", "Do not close the post: it goes on."),
        "2026-06/1": whole.format(2, "Write no title: the post has begun.", "Do not close the post: it goes on."),
        "2026-06/2": whole.format(3, "Write no title: the post has begun.", "End the post."),
        "2026-07/0": "Go.",
    }


def test_blogger_alone_takes_a_file(spark, tmp_path):
    path = tmp_path / "news_2020_01.md"
    path.write_text("old digest")
    parts = spark.createDataFrame([(2026, 6, 0, "old digest")], "iso_year int, iso_week int, part int, markdown string")
    request = requests.post_requests(parts).first().request_id
    responses = spark.createDataFrame([(request, "text", None)], RESPONSES)
    posts = run(spark, ["blogger"], NOW, "unused", {"blogger": {"responses": responses}}, digest_path=str(path))["posts"]
    assert "- [AI news summary — 2026-06](../weekly_news/news_2020_01)\n" in posts.first().markdown
    # Without a path it is the file of the current week, from the setting or the usual folder.
    inputs = {"blogger": {"responses": responses}}
    with pytest.raises(AnalysisException, match="output/news_summaries/.*news_2026_06.md"):
        run(spark, ["blogger"], NOW, "unused", inputs)
    (tmp_path / "news_2026_06.md").write_text("old digest")
    assert run(spark, ["blogger"], NOW, "unused", inputs, digest_folder=str(tmp_path))["posts"].first().title is not None
    assert "news_2020_01" in run(spark, ["blogger"], NOW, "unused", inputs, digest_setting=str(path))["posts"].first().markdown


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    news = str(tmp_path / "news")
    batch = ingest_items(news, lambda batch_id: NOW)
    rows = spark.createDataFrame([(1, 0, "u1", "t1", None, "c"), (1, 1, "u2", "t1", None, "c"), (1, 2, "u3", "t3", None, "c")], ITEMS)
    batch(rows, 0)
    batch(rows, 0)
    assert sorted(r.url for r in store.read_news(spark, news).collect()) == ["u1", "u3"]


def test_captures_arrive_in_files(spark, tmp_path):
    sources, captures = sources_and_captures(spark)
    arriving, news = str(tmp_path / "arriving"), str(tmp_path / "news")
    captures.write.parquet(arriving)
    for attempt in range(2):
        stream = spark.readStream.schema(CAPTURES).parquet(arriving)
        query = start_ingest(stream, ingest_captures(sources, str(tmp_path / "log"), news, lambda batch_id: NOW, limit=5), str(tmp_path / f"state{attempt}"))
        query.awaitTermination()
        assert query.exception() is None
    assert [r.url for r in store.read_news(spark, news).collect()] == ["https://p.org/1"]
    assert Path(news).is_dir()


def test_articles_may_arrive_after_their_listing(spark, tmp_path):
    page = {"list_selector": "li a", "title_selector": "h1", "content_selector": "article"}
    sources = spark.createDataFrame([(1, None, "https://h.org/", "html", {"html": page}), (2, None, "https://f.org/feed", "rss", None)], SOURCES)
    read = "<h1>{0}</h1><article>Text of {0}</article>"
    feed = "<rss><channel><item><title>F</title><link>https://f.org/1</link><description>feed text</description></item></channel></rss>"
    batches = [
        [("https://h.org/", '<li><a href="/a">A</a><li><a href="/b">B</a>'), ("https://f.org/feed", feed)],
        [("https://h.org/a", read.format("A")), ("https://f.org/1", read.format("F"))],
        [("https://h.org/b", read.format("B")), ("https://h.org/a", read.format("A"))],
    ]
    news, arriving = str(tmp_path / "news"), str(tmp_path / "arriving")
    found = []
    for bodies in batches:
        # One stream with one checkpoint, started again for each batch.
        rows = [(url, NOW, True, False, body) for url, body in bodies]
        spark.createDataFrame(rows, CAPTURES).write.mode("append").parquet(arriving)
        take = ingest_captures(sources, str(tmp_path / "log"), news, lambda batch_id: NOW)
        query = start_ingest(spark.readStream.schema(CAPTURES).parquet(arriving), take, str(tmp_path / "state"))
        query.awaitTermination()
        assert query.exception() is None
        found.append(sorted((r.url, r.content) for r in store.read_news(spark, news).collect()))
    of_feed = ("https://f.org/1", "feed text")
    assert found[0] == [of_feed]
    assert found[1] == [of_feed, ("https://h.org/a", "Text of A")]
    assert found[2] == [*found[1], ("https://h.org/b", "Text of B")]
