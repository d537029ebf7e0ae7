"""Whole jobs: collect, analyze, publish, all of them in a chain, and incremental ingest."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.inputs import ALL_FETCHED, SQL, captures, kept_in_order, keyed_documents, news, ntz, registry, table, with_tables
from catalog.operators import WEEK_SQL
from newsloom.functions.binding import once
from newsloom.functions.urls import normalize_url
from newsloom.operators import caps, dedup, rollup, store
from newsloom.operators.requests import post_requests
from newsloom.plans.analyze import analyze
from newsloom.plans.chain import run, stages_of
from newsloom.plans.collect import collect, collect_and_report
from newsloom.plans.publish import label_now, publish
from newsloom.schemas import CAPTURES, ITEMS
from newsloom.session import cut_lineage, scratch_path
from newsloom.sources.digests import read_digest
from newsloom.streaming.ingest import ingest_captures, ingest_items, start_ingest

NOW = datetime(2026, 2, 10, tzinfo=timezone.utc)
MID_JANUARY = datetime(2024, 1, 3, 5, tzinfo=timezone.utc)
LAYOUT = {"tags": ("x",), "layout": "post"}


def q_flagship(spark, sf):
    """Pages to a weekly digest count: articles read, capped per host, duplicates dropped."""
    from newsloom.functions.html import read_article

    article = read_article(F.col("html"), F.lit("h1"), F.lit(None).cast("string"), F.lit("article"), F.lit(False))
    read = table(spark, sf, "pages").select("page_id", "url", once(article).alias("a")).select(
        F.col("page_id").alias("ingest_seq"), normalize_url(F.col("url")).alias("url"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "a.title", "a.content",
    )
    good = read.where((F.col("title") != "") & (F.col("content") != ""))
    capped = cut_lineage(caps.first_per_group(good, 5, ["host"], ["ingest_seq"]))
    kept = dedup.keep_first(capped.select("ingest_seq", "url", "title", "host"), "ingest_seq")
    moment = F.timestamp_seconds(F.lit(1704067200) + F.col("ingest_seq") * 3600)
    weekly = kept.groupBy(F.extract(F.lit("YEAROFWEEK"), moment).cast("int").alias("iso_year"), F.weekofyear(moment).alias("iso_week"))
    return weekly.agg(F.count("*").alias("items"), F.count_distinct("host").alias("hosts"), F.min("ingest_seq").alias("first"))


def q_collect(spark, sf):
    path = scratch_path(spark, "news")
    outcomes = collect(spark, registry(spark, sf), captures(spark, sf), path, NOW, limit=3)
    return outcomes.select("source_id", "pos", "url", "title", "outcome")


def q_collect_again(spark, sf):
    """A second run over the same captures adds nothing."""
    path = scratch_path(spark, "news")
    sources, captured = registry(spark, sf), captures(spark, sf)
    collect(spark, sources, captured, path, NOW, limit=3)
    again = collect(spark, sources, captured, path, NOW, limit=3)
    return again.groupBy("outcome").agg(F.count("*").alias("n"))


def q_analyze(spark, sf):
    path = scratch_path(spark, "news")
    store.append_news(news(spark, sf), path)
    parts = analyze(spark, path, MID_JANUARY, part_entries=400, **LAYOUT)
    return parts.select("iso_year", "iso_week", "part", F.length("markdown").alias("n"), F.md5("markdown").alias("markdown_md5"))


def q_analyze_days(spark, sf):
    """A rolling window, without new summaries; what the table holds is left as it is."""
    path = scratch_path(spark, "news")
    store.append_news(news(spark, sf), path)
    parts = analyze(spark, path, datetime(2024, 1, 8, 5, tzinfo=timezone.utc), days=3, skip_summaries=True, **LAYOUT)
    return parts.select("iso_year", "iso_week", "part", F.md5("markdown").alias("markdown_md5"))


def q_publish(spark, sf):
    return _published(spark, sf).select("iso_year", "iso_week", "part", "title", F.md5("markdown").alias("markdown_md5"))


def _published(spark, sf, output=None):
    """Posts of real digests in several parts, all answered."""
    rows = news(spark, sf)
    heads = rollup.digest_heads(rows.select("iso_year", "iso_week").distinct(), F.lit("2026-02-10"), **LAYOUT)
    parts = cut_lineage(rollup.digest_parts(rollup.entry_blocks(rows), heads, part_entries=100))
    return publish(spark, parts, _answers(parts), NOW, output=output, **LAYOUT)


def q_post_files(spark, sf):
    """Every file of posts, as its lines in alphabetical order, with its numbers of titles and of links back."""
    path = scratch_path(spark, "posts")
    _published(spark, sf, path)
    lines, line = spark.read.text(path), F.col("value")
    return lines.groupBy("file").agg(
        F.count_if(line.startswith("title: ")).alias("titles"), F.count_if(line.startswith("- [AI news summary")).alias("links"),
        F.md5(F.array_join(F.array_sort(F.collect_list("value")), "\n")).alias("lines_md5"),
    )


def q_silent_sources(spark, sf):
    """Sources that gave no item: some were never fetched, some payloads hold no list where they should, some lists lead nowhere."""
    number = F.col("source_id") % 10
    api = F.col("howto.api").withField("items_path", F.when(number == 3, "data.none").otherwise(F.col("howto.api.items_path")))
    howto = F.col("howto").withField("api", F.when(F.col("howto.api").isNotNull(), api))
    url = F.when(number == 0, F.concat("url", F.lit("/gone"))).otherwise(F.col("url"))
    sources = registry(spark, sf).withColumn("howto", howto).withColumn("url", url)
    return collect_and_report(spark, sources, captures(spark, sf), scratch_path(spark, "news"), NOW, limit=3)[1]


def q_chain(spark, sf):
    """Collector and analyzer, and with the answers to their digest all three; the digest that the blogger takes is the one handed on."""
    path = scratch_path(spark, "news")
    inputs = {
        "collector": {"sources": registry(spark, sf), "captures": captures(spark, sf), "limit": 3},
        "analyzer": {"skip_summaries": True, **LAYOUT},
    }
    digest = run(spark, stages_of("collector,analyzer"), NOW, path, inputs)["digest"]
    posts = run(spark, stages_of("pipeline"), NOW, path, inputs | {"blogger": {"responses": _answers(digest), **LAYOUT}})["posts"]
    parts = digest.select("iso_year", "iso_week", "part", F.lit("digest").alias("kind"), F.md5("markdown").alias("markdown_md5"))
    return parts.unionAll(posts.select("iso_year", "iso_week", "part", F.lit("post"), F.md5("markdown")))


def _answers(parts):
    """An answer to the request of each part."""
    answer = F.concat(F.lit("# Post of "), F.col("key"), F.lit("\n\nText "), F.md5("input"), F.lit("."))
    return post_requests(parts).select("request_id", answer.alias("output"), F.lit(None).cast("string").alias("error"))


def q_blogger_alone(spark, sf):
    """The blogger on the file of the current week, on that of the setting, and on that of the argument."""
    rows = news(spark, sf).where("iso_week = 1")
    folders, posts = {}, []
    for day, case in ((10, "current"), (11, "setting"), (12, "argument")):
        heads = rollup.digest_heads(rows.select("iso_year", "iso_week").distinct(), F.lit(f"2026-02-{day}"), **LAYOUT)
        folders[case] = scratch_path(spark, case)
        rollup.write_digests(rollup.digest_parts(rollup.entry_blocks(rows), heads), folders[case])
    file = {case: f"{folder}/news_2024_01.md" for case, folder in folders.items()}
    cases = {"current": {}, "setting": {"digest_setting": file["setting"]}, "argument": {"digest_path": file["argument"], "digest_setting": file["setting"]}}
    for case, paths in cases.items():
        answers = _answers(label_now(read_digest(spark, file[case]), MID_JANUARY))
        inputs = {"blogger": {"responses": answers, **LAYOUT}}
        made = run(spark, ["blogger"], MID_JANUARY, "unused", inputs, digest_folder=folders["current"], **paths)["posts"]
        posts.append(made.select(F.lit(case).alias("kind"), "iso_year", "iso_week", F.md5("markdown").alias("markdown_md5")))
    return reduce(DataFrame.unionAll, posts)


def q_incremental_ingest(spark, sf):
    """Documents that arrive in three batches of files, the first of them twice."""
    path, arriving = scratch_path(spark, "news"), scratch_path(spark, "arriving")
    docs = keyed_documents(spark, sf).select(
        F.expr("int(seq div 400)").alias("source_id"), F.expr("int(seq % 400)").alias("pos"), "url", "title",
        F.lit(None).cast("string").alias("published_date"), F.lit("text").alias("content"),
    )
    for batch in (0, 1, 2):
        docs.where(F.least(F.col("source_id"), F.lit(2)) == batch).write.parquet(f"{arriving}/{batch}")
    clock = lambda batch_id: NOW
    for number, batch in enumerate((0, 0, 1, 2)):
        stream = spark.readStream.schema(ITEMS).parquet(f"{arriving}/{batch}")
        query = start_ingest(stream, ingest_items(path, clock), scratch_path(spark, f"stream-{number}"))
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return store.read_news(spark, path).select("url", "title", "ingest_seq", ntz("collected_at").alias("collected_at"))


def q_incremental_captures(spark, sf):
    """What sources gave arrives first, articles later, in one stream that is stopped and started again."""
    path, arriving, log, state = (scratch_path(spark, name) for name in ("news", "arriving", "log", "stream"))
    sources, everything = registry(spark, sf), captures(spark, sf).captures()
    take = ingest_captures(sources, log, path, lambda batch_id: NOW, limit=3)
    for how in ("left_semi", "left_anti"):
        everything.join(sources.select("url").distinct(), "url", how).select(*everything.columns).write.mode("append").parquet(arriving)
        query = start_ingest(spark.readStream.schema(CAPTURES).parquet(arriving), take, state)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return store.read_news(spark, path).select("url", "title")


COLLECT_SQL = kept_in_order(
    "SELECT row_number() OVER (ORDER BY source_id, pos) AS n, * FROM fetched WHERE content <> ''",
    ",".join(SQL[name] for name in ALL_FETCHED),
)
SENTENCES = r"regexp_replace(regexp_extract(content, '(?s)^((?:[^.!?。！？]*[.!?。！？]+){1,3}|.*)', 1), '^\s+|\s+$', '', 'g')"
SUMMED = f"CASE WHEN coalesce(summary, '') = '' AND content <> '' THEN {SENTENCES} ELSE summary END"


def window_digest(start: str, end: str, size: int, title: str, week: int, date: str, summary: str = "summary", source: str = "news") -> str:
    """Digest parts of a window, labelled with one week."""
    body = WEEK_SQL.format(size=size).replace("FROM news)", "FROM chosen)")
    body = body.replace("'title: News Summary (' || printf('%04d-%02d', iso_year, iso_week) || ')'", f"'title: {title}'").replace("2026-02-10", date)
    year = date[:4]
    return f""",
chosen AS (SELECT * REPLACE ({summary} AS summary, {year} AS iso_year, {week} AS iso_week) FROM {source}
  WHERE collected_at >= TIMESTAMP '{start}' AND collected_at < TIMESTAMP '{end}'),{body}
"""

#: Sections of posts: the first one has the front matter, the last one the link.
SECTIONS_SQL = "," + WEEK_SQL.format(size=100) + """,
sections AS (SELECT *, CASE WHEN part = 0 THEN concat_ws(chr(10), '---', 'title: ' || title, 'description:', 'date: 2026-02-10', 'scheduled: 2026-02-10',
    'tags:', '  - x', 'layout: post', '---', '') ELSE '' END || 'Text ' || md5(markdown) || '.'
  || CASE WHEN part = last THEN concat_ws(chr(10), '', '', '---', '', '- [AI news summary — ' || week || '](../weekly_news/news_' || replace(week, '-', '_') || ')', '') ELSE '' END AS section
  FROM (SELECT *, max(part) OVER (PARTITION BY iso_year, iso_week) AS last, printf('%04d-%02d', iso_year, iso_week) AS week,
    CASE WHEN part = 0 THEN 'Post of ' || printf('%04d-%02d/%d', iso_year, iso_week, part) END AS title FROM digests))
"""

QUERIES = {
    "flagship": (
        q_flagship,
        kept_in_order(
            """SELECT *, row_number() OVER (ORDER BY page_id) AS n FROM (SELECT * FROM (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, rtrim(regexp_extract(url, '^[^?#]*'), '/') AS url,
    regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages)
  WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 5)"""
        )
        + """
SELECT isoyear(moment)::INTEGER AS iso_year, weekofyear(moment)::INTEGER AS iso_week, count(*) AS items, count(DISTINCT host) AS hosts, min(page_id) AS first
FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id::BIGINT) AS moment FROM batch JOIN kept USING (n)) GROUP BY ALL""",
    ),
    "collect": (
        q_collect,
        COLLECT_SQL
        + """
SELECT f.source_id, f.pos, f.url, f.title, CASE WHEN f.content = '' THEN 'no_content' WHEN k.n IS NOT NULL THEN 'inserted' ELSE 'duplicate' END AS outcome
FROM fetched f LEFT JOIN (SELECT source_id, pos, n FROM batch JOIN kept USING (n)) k ON k.source_id = f.source_id AND k.pos = f.pos""",
    ),
    "collect_again": (
        q_collect_again,
        with_tables(
            "links", "articles", "feed_items", "fetched_feeds", "fetched_pages", "fetched_rendered", "fetched_apis", "fetched",
            then="""SELECT CASE WHEN content = '' THEN 'no_content' ELSE 'duplicate' END AS outcome, count(*) AS n
FROM fetched GROUP BY ALL""",
        ),
    ),
    "analyze": (
        q_analyze,
        with_tables(
            "news",
            then=window_digest("2024-01-01 00:00:00", "2024-01-08 00:00:00", 400, "News Summary (2024-01)", 1, "2024-01-03", SUMMED)
            + "SELECT iso_year, iso_week, part, length(markdown)::INTEGER AS n, md5(markdown) AS markdown_md5 FROM digests",
        ),
    ),
    "analyze_days": (
        q_analyze_days,
        with_tables(
            "news",
            then=window_digest("2024-01-06 00:00:00", "2024-01-09 00:00:00", 5000, "News Summary (last 3 days)", 2, "2024-01-08")
            + "SELECT iso_year, iso_week, part, md5(markdown) AS markdown_md5 FROM digests",
        ),
    ),
    "publish": (
        q_publish,
        with_tables("news", then=SECTIONS_SQL + "SELECT iso_year, iso_week, part, title, md5(section) AS markdown_md5 FROM sections"),
    ),
    "post_files": (
        q_post_files,
        with_tables(
            "news",
            then=SECTIONS_SQL
            + """
SELECT file, count(*) FILTER (starts_with(line, 'title: ')) AS titles, count(*) FILTER (starts_with(line, '- [AI news summary')) AS links,
  md5(string_agg(line, chr(10) ORDER BY line)) AS lines_md5
FROM (SELECT file, unnest(string_split(markdown, chr(10))) AS line FROM (
  SELECT 'blog_' || replace(week, '-', '_') || '.md' AS file, string_agg(rtrim(section, chr(10)), chr(10) || chr(10) ORDER BY part) AS markdown FROM sections GROUP BY week))
GROUP BY file""",
        ),
    ),
    "chain": (
        q_chain,
        COLLECT_SQL
        + """,
inserted AS (SELECT url, title, published_date, TIMESTAMP '2026-02-10 00:00:00' AS collected_at, source_id * 4294967296 + pos AS ingest_seq,
  NULL::VARCHAR AS summary, 2026 AS iso_year, 7 AS iso_week FROM batch JOIN kept USING (n))"""
        + window_digest("2026-02-09 00:00:00", "2026-02-16 00:00:00", 5000, "News Summary (2026-07)", 7, "2026-02-10", source="inserted")
        + """,
posts AS (SELECT iso_year, iso_week, part, concat_ws(chr(10), '---', 'title: Post of 2026-07/0', 'description:', 'date: 2026-02-10', 'scheduled: 2026-02-10',
    'tags:', '  - x', 'layout: post', '---', '') || 'Text ' || md5(markdown) || '.'
  || concat_ws(chr(10), '', '', '---', '', '- [AI news summary — 2026-07](../weekly_news/news_2026_07)', '') AS markdown FROM digests)
SELECT iso_year, iso_week, part, 'digest' AS kind, md5(markdown) AS markdown_md5 FROM digests
UNION ALL SELECT iso_year, iso_week, part, 'post', md5(markdown) FROM posts""",
    ),
    "blogger_alone": (
        q_blogger_alone,
        with_tables("news", then="," + WEEK_SQL.format(size=5000) + """,
cases(kind, day) AS (VALUES ('current', 10), ('setting', 11), ('argument', 12)),
texts AS (SELECT kind, md5(replace(markdown, '2026-02-10', '2026-02-' || day)) AS digest_md5 FROM cases JOIN digests ON iso_year = 2024 AND iso_week = 1 AND part = 0)
SELECT kind, 2024 AS iso_year, 1 AS iso_week, md5(concat_ws(chr(10), '---', 'title: Post of 2024-01/0', 'description:', 'date: 2024-01-03', 'scheduled: 2024-01-03',
    'tags:', '  - x', 'layout: post', '---', '') || 'Text ' || digest_md5 || '.'
  || concat_ws(chr(10), '', '', '---', '', '- [AI news summary — 2024-01](../weekly_news/news_2024_01)', '')) AS markdown_md5
FROM texts"""),
    ),
    "silent_sources": (
        q_silent_sources,
        with_tables(
            *ALL_FETCHED,
            then="""SELECT page_id::INTEGER AS source_id,
  CASE WHEN page_id % 10 = 0 THEN url || '/gone' WHEN page_id % 5 = 0 THEN url ELSE 'source ' || page_id END AS name,
  ['rss', 'html', 'js', 'api'][page_id % 4 + 1] AS type,
  CASE WHEN page_id % 10 = 0 THEN 'no_capture' WHEN page_id % 4 = 3 AND page_id % 10 = 3 THEN 'unreadable' ELSE 'no_items' END AS reason
FROM pages WHERE page_id % 10 = 0 OR page_id % 4 = 3 AND page_id % 10 = 3 OR page_id NOT IN (SELECT source_id FROM fetched)""",
        ),
    ),
    "incremental_captures": (
        q_incremental_captures,
        # Feeds and payloads have texts of their own; listings wait for their articles.
        kept_in_order(
            "SELECT row_number() OVER (ORDER BY source_id % 4 IN (1, 2), source_id, pos) AS n, * FROM fetched WHERE content <> ''",
            ",".join(SQL[name] for name in ALL_FETCHED),
        )
        + """
SELECT url, title FROM batch JOIN kept USING (n)""",
    ),
    "incremental_ingest": (
        q_incremental_ingest,
        kept_in_order("SELECT *, row_number() OVER (ORDER BY seq) AS n FROM keyed", SQL["keyed"])
        + """
SELECT url, title, (seq // 400) * 4294967296 + seq % 400 AS ingest_seq, TIMESTAMP '2026-02-10 00:00:00' AS collected_at
FROM batch JOIN kept USING (n)""",
    ),
}
