"""Sources: registry, feeds, listings, payloads, and the articles behind their links."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    ALL_FETCHED, article_captures, captures, feed_bodies, nav_links, now, payload_bodies, registry, source_captures,
    table, with_tables,
)
from newsloom.functions.html import select_links
from newsloom.operators.caps import sample_item
from newsloom.operators.filters import is_not_source
from newsloom.operators.merge import fill_content, with_body
from newsloom.sources import apis, articles, dispatch, feeds
from newsloom.sources.registry import parse_registry, run_errors, validate

LIMIT = 3
LOOKBACK = 30
ITEMS = ["source_id", "pos", "url", "title", "published_date", "content"]


def q_read_registry(spark, sf):
    sources = registry(spark, sf).drop("source_id")
    named = F.named_struct(F.lit("collector"), F.named_struct(F.lit("sources"), F.array(F.struct(*sources.columns))))
    texts = sources.select(F.to_json(named).alias("value"))
    read = parse_registry(texts)
    return read.select(
        "source_id", "name", "url", "type", F.col("howto.rss.item_limit").alias("item_limit"),
        F.coalesce("howto.html.list_selector", "howto.js.list_selector").alias("list_selector"),
        F.col("howto.api.items_path").alias("items_path"),
    )


def q_fetch_feeds(spark, sf):
    return dispatch.fetch(registry(spark, sf), captures(spark, sf), now(), LOOKBACK, LIMIT, ("rss",))


def q_fetch_pages(spark, sf):
    return dispatch.fetch(registry(spark, sf), captures(spark, sf), now(), LOOKBACK, LIMIT, ("html",)).select(*ITEMS)


def q_fetch_rendered(spark, sf):
    return dispatch.fetch(registry(spark, sf), captures(spark, sf), now(), LOOKBACK, LIMIT, ("js",)).select(*ITEMS)


def q_fetch_apis(spark, sf):
    return dispatch.fetch(registry(spark, sf), captures(spark, sf), now(), LOOKBACK, LIMIT, ("api",))


def q_fetch_all(spark, sf):
    return dispatch.fetch(registry(spark, sf), captures(spark, sf), now(), LOOKBACK, LIMIT)


def _listed(spark, sf, kind):
    return dispatch.list_urls(registry(spark, sf), captures(spark, sf), now(), LOOKBACK, LIMIT, (kind,)).drop("name")


def q_list_feed_urls(spark, sf):
    return _listed(spark, sf, "rss")


def q_list_page_urls(spark, sf):
    return _listed(spark, sf, "html")


def q_list_rendered_urls(spark, sf):
    return _listed(spark, sf, "js")


def q_list_api_urls(spark, sf):
    """The url field is not configured but guessed from the first item."""
    howto = F.col("howto").withField("api", F.col("howto.api").withField("url_field", F.lit(None).cast("string")))
    captured = source_captures(spark, sf).withColumn("body", F.replace("body", F.lit("[7,"), F.lit("[")))
    return dispatch.list_urls(registry(spark, sf).withColumn("howto", howto), captured, now(), LOOKBACK, LIMIT, ("api",)).drop("name")


def q_list_all_urls(spark, sf):
    return dispatch.list_urls(registry(spark, sf), captures(spark, sf), now(), LOOKBACK, LIMIT)


def q_feed_entries(spark, sf):
    bodies = feed_bodies(spark, sf).select("page_id", F.posexplode(feeds.feed_entries(F.col("body"))).alias("pos", "e"))
    return bodies.select("page_id", "pos", "e.title", "e.link", "e.published", "e.html")


def q_unreadable_feeds(spark, sf):
    cut = F.when(F.col("source_id") % 8 == 0, F.substring("body", 1, 120)).otherwise(F.col("body"))
    opened = dispatch.open_sources(registry(spark, sf), captures(spark, sf), "rss")
    return feeds.unreadable_feeds(opened.withColumn("body", cut))


def q_unreadable_payloads(spark, sf):
    path = F.when(F.col("source_id") % 8 == 3, "data.none").otherwise("data.items")
    howto = F.col("howto").withField("api", F.col("howto.api").withField("items_path", path))
    return apis.unreadable_payloads(dispatch.open_sources(registry(spark, sf), captures(spark, sf), "api").withColumn("howto", howto))


def q_select_links(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(select_links(F.col("html"), F.lit("nav li > a[href]"))).alias("l"))
    return links.select("page_id", "l.pos", "l.href", "l.text", F.size("l.classes").alias("n_classes"))


def q_select_mixed(spark, sf):
    links = select_links(F.col("html"), F.when(F.col("page_id") % 2 == 0, "main a").otherwise("div.ad, article > h1"))
    return table(spark, sf, "pages").select("page_id", F.size(links).alias("n"))


def q_article_texts(spark, sf):
    return articles.full_texts(nav_links(spark, sf), article_captures(spark, sf, False))


def _articles(spark, sf, rendered, date_selector):
    links = nav_links(spark, sf).select(
        F.col("page_id").alias("source_id"), "pos", "url", F.lit(rendered).alias("rendered"), F.lit("h1").alias("title_selector"),
        F.lit(date_selector).cast("string").alias("date_selector"), F.lit("article").alias("content_selector"),
    )
    read = articles.read_articles(links, article_captures(spark, sf, rendered))
    return articles.article_items(links, read).select(*ITEMS)


def q_articles(spark, sf):
    return _articles(spark, sf, False, "b")


def q_rendered_articles(spark, sf):
    return _articles(spark, sf, True, None)


def q_fill_content(spark, sf):
    """Two documents share each url."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.expr("concat('u', doc_id div 2)").alias("url"), F.md5("text").alias("content")
    )
    text = F.when(F.col("quality") == 1, F.concat(F.lit("full "), F.col("doc_id").cast("string"))).otherwise("")
    texts = table(spark, sf, "labels").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), text.alias("text"))
    return fill_content(docs, texts, ["id"])


def q_items_of_sources(spark, sf):
    items = nav_links(spark, sf).select(F.col("page_id").cast("int").alias("source_id"), "pos", "url")
    joined = items.join(registry(spark, sf).select("source_id", "name", "type", F.col("url").alias("source_url")), "source_id")
    return joined.where(is_not_source(F.col("url"), F.col("source_url"))).select("source_id", "pos", "name", "type", "url")


def q_links_with_capture(spark, sf):
    links = nav_links(spark, sf).select("page_id", "pos", "url", F.lit(False).alias("rendered"))
    return with_body(links, article_captures(spark, sf, False)).select("page_id", "pos", "url", F.md5("body").alias("body_md5"))


def q_newest_capture(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.lit(False).alias("rendered"))
    tries = pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"))
    log = tries.select(
        "url", F.timestamp_seconds(F.lit(1770000000) + F.col("n") * 3600).alias("fetched_at"),
        ((F.col("page_id") + F.col("n")) % 3 != 0).alias("ok"), F.lit(False).alias("rendered"), F.format_string("try %d", "n").alias("body"),
    )
    return with_body(pages, log).select("page_id", "body")


def q_sample_items(spark, sf):
    links = nav_links(spark, sf).select(F.col("page_id").alias("source_id"), "pos", "url", "txt")
    return sample_item(links, ["source_id"])


def q_object_items(spark, sf):
    from newsloom.functions.payloads import as_list, get_path, is_object, member, value_text

    lists = payload_bodies(spark, sf).select("page_id", as_list(get_path(F.try_parse_json("body"), F.lit("data.items"))).alias("list"))
    items = lists.select("page_id", F.posexplode("list").alias("pos", "item")).where(is_object(F.col("item")))
    return items.select("page_id", "pos", value_text(member(F.col("item"), F.lit("body"))).alias("body"))


def q_validate_registry(spark, sf):
    sources = _faulty_registry(spark, sf)
    return validate(sources).select("source_id", F.array_join("violations", ",").alias("violations"), "valid")


def q_run_errors(spark, sf):
    return _faulty_registry(spark, sf).select("source_id", run_errors().alias("error"))


def _faulty_registry(spark, sf):
    form = F.col("source_id") % 20
    none = F.lit(None).cast("string")
    html = F.col("howto.html")
    howto = (
        F.col("howto")
        .withField("html", F.when(form == 1, html.withField("list_selector", none)).otherwise(html.withField("date_selector", F.lit("time"))))
        .withField("api", F.when(form == 3, F.lit(None)).otherwise(F.col("howto.api")))
    )
    return registry(spark, sf).select(
        "source_id",
        F.when(form == 4, none).otherwise(F.col("name")).alias("name"),
        "url",
        F.when(form == 8, F.lit("ftp")).otherwise(F.col("type")).alias("type"),
        F.when(form == 12, F.lit(None)).otherwise(howto).alias("howto"),
    )


FETCHED = {
    name: with_tables(*ALL_FETCHED[: ALL_FETCHED.index(source) + 1], then=f"SELECT * FROM {source}")
    for name, source in {
        "fetch_feeds": "fetched_feeds", "fetch_pages": "fetched_pages", "fetch_rendered": "fetched_rendered",
        "fetch_apis": "fetched_apis", "fetch_all": "fetched",
    }.items()
}

LISTED = """
listed AS (
  SELECT source_id, pos, url FROM (
    SELECT page_id::INTEGER AS source_id, pos, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM feed_items
    WHERE NOT back AND (published_ts IS NULL OR published_ts >= TIMESTAMP '2026-01-11 00:00:00')) WHERE n <= 3
  UNION ALL
  SELECT page_id::INTEGER, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM links WHERE page_id % 4 IN (1, 2))
  WHERE n <= 3
  UNION ALL
  SELECT page_id::INTEGER, (pos + 1)::INTEGER, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM links WHERE page_id % 4 = 3)
  WHERE n <= 3)"""


def listed(kind: int, columns: str = "*") -> str:
    return with_tables("links", "feed_items", then=f", {LISTED} SELECT {columns} FROM listed WHERE source_id % 4 = {kind}")


REGISTRY_SQL = """SELECT page_id::INTEGER AS source_id, CASE WHEN page_id % 5 <> 0 THEN 'source ' || page_id ELSE '' END AS name, url,
  list_extract(['rss', 'html', 'js', 'api'], (page_id % 4 + 1)::INTEGER) AS type FROM pages"""

QUERIES = {
    "read_registry": (
        q_read_registry,
        f"""SELECT (row_number() OVER (ORDER BY url, name) - 1)::INTEGER AS source_id, name, url, type, CASE WHEN type = 'rss' THEN 50 END AS item_limit,
  CASE WHEN type IN ('html', 'js') THEN 'nav a' END AS list_selector, CASE WHEN type = 'api' THEN 'data.items' END AS items_path
FROM ({REGISTRY_SQL})""",
    ),
    "fetch_feeds": (q_fetch_feeds, FETCHED["fetch_feeds"]),
    "fetch_pages": (q_fetch_pages, FETCHED["fetch_pages"]),
    "fetch_rendered": (q_fetch_rendered, FETCHED["fetch_rendered"]),
    "fetch_apis": (q_fetch_apis, FETCHED["fetch_apis"]),
    "fetch_all": (q_fetch_all, FETCHED["fetch_all"]),
    "list_feed_urls": (q_list_feed_urls, listed(0)),
    "list_page_urls": (q_list_page_urls, listed(1)),
    "list_rendered_urls": (q_list_rendered_urls, listed(2)),
    "list_api_urls": (q_list_api_urls, listed(3, "source_id, pos - 1 AS pos, url")),
    "list_all_urls": (
        q_list_all_urls,
        with_tables(
            "links", "feed_items",
            then=f""", {LISTED} SELECT l.source_id, coalesce(nullif(r.name, ''), r.url) AS name, l.pos, l.url
FROM listed l JOIN ({REGISTRY_SQL}) r ON r.source_id = l.source_id""",
        ),
    ),
    "feed_entries": (
        q_feed_entries,
        with_tables(
            "links",
            then="""SELECT l.page_id, pos, CASE WHEN pos = 2 THEN '' ELSE txt END AS title,
  CASE WHEN l.page_id % 3 = 0 AND pos = 1 THEN page_url ELSE url END AS link,
  list_extract(['Fri, 06 Feb 2026 10:00:00 GMT', '06 Feb 2026 10:00 +0100', 'Fri, 6 Feb 2026 10:00:00 EST', 'Thu, 01 Jan 2026 10:00:00 -0000',
    '2026-02-06T00:00:00Z', 'junk', 'Sun, 11 Jan 2026 00:00:00 +0000'], ((l.page_id + pos) % 7 + 1)::INTEGER) AS published,
  '<p>Feed text of <b>' || txt || '</b></p>' AS html FROM links l""",
        ),
    ),
    "unreadable_feeds": (q_unreadable_feeds, "SELECT page_id::INTEGER AS source_id, url FROM pages WHERE page_id % 8 = 0"),
    "unreadable_payloads": (q_unreadable_payloads, "SELECT page_id::INTEGER AS source_id, url FROM pages WHERE page_id % 8 = 3"),
    "select_links": (
        q_select_links,
        with_tables("links", then="SELECT page_id, pos, href, txt AS text, 0 AS n_classes FROM links"),
    ),
    "select_mixed": (q_select_mixed, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 2 END AS n FROM pages"),
    "article_texts": (q_article_texts, with_tables("links", "articles", then="SELECT url, plain_text AS text FROM articles WHERE ok")),
    "read_articles": (
        q_articles,
        with_tables(
            "links", "articles",
            then="""SELECT l.page_id AS source_id, l.pos, l.url, l.txt AS title, l.txt AS published_date, a.plain_text AS content
FROM links l JOIN articles a ON a.url = l.url WHERE a.ok AND a.has_h1""",
        ),
    ),
    "read_rendered_articles": (
        q_rendered_articles,
        with_tables(
            "links", "articles",
            then="""SELECT l.page_id AS source_id, l.pos, l.url, l.txt AS title, NULL::VARCHAR AS published_date, a.drawn_text AS content
FROM links l JOIN articles a ON a.url = l.url WHERE a.ok AND a.has_h1""",
        ),
    ),
    "fill_content": (
        q_fill_content,
        """SELECT d.doc_id AS id, 'u' || (d.doc_id // 2) AS url, CASE WHEN l.quality = 1 THEN 'full ' || l.doc_id ELSE md5(d.text) END AS content
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id // 2""",
    ),
    "items_of_sources": (
        q_items_of_sources,
        with_tables(
            "links",
            then=f"""SELECT r.source_id, l.pos, r.name, r.type, l.url FROM links l JOIN ({REGISTRY_SQL}) r ON r.source_id = l.page_id
WHERE rtrim(regexp_extract(r.url, '^[^?#]*'), '/') <> l.url""",
        ),
    ),
    "links_with_capture": (
        q_links_with_capture,
        with_tables(
            "links", "articles",
            then="""SELECT l.page_id, l.pos, l.url, md5('<html><head><title>' || l.txt || '</title></head><body>'
  || CASE WHEN a.has_h1 THEN '<h1>' || l.txt || '</h1>' ELSE '' END || CASE WHEN length(l.txt) % 4 <> 0 THEN '<article>' ELSE '<div>' END
  || '<p>About <b>' || l.txt || '</b></p><p>at ' || l.site || '</p>'
  || CASE WHEN length(l.txt) % 4 <> 0 THEN '</article>' ELSE '</div>' END || '</body></html>') AS body_md5
FROM links l JOIN articles a ON a.url = l.url WHERE a.ok""",
        ),
    ),
    "newest_capture": (
        q_newest_capture,
        "SELECT page_id, 'try ' || max(n) AS body FROM pages, range(5) AS t(n) WHERE (page_id + n) % 3 <> 0 GROUP BY page_id",
    ),
    "sample_items": (
        q_sample_items,
        with_tables("links", then="SELECT page_id AS source_id, pos, url, txt FROM links WHERE pos = 0"),
    ),
    "object_items": (
        q_object_items,
        with_tables(
            "links", then="SELECT page_id, (pos + 1)::INTEGER AS pos, CASE WHEN pos <> 4 THEN 'Body of ' || txt END AS body FROM links"
        ),
    ),
    "validate_registry": (
        q_validate_registry,
        f"""SELECT source_id, violations, violations = '' AS valid FROM (
  SELECT source_id, CASE source_id % 20 WHEN 4 THEN 'name' WHEN 8 THEN 'type' WHEN 12 THEN 'howto' WHEN 3 THEN 'howto.api'
    WHEN 1 THEN 'howto.html.list_selector,howto.html.date_selector' ELSE CASE WHEN type = 'js' THEN 'howto.js.date_selector' ELSE '' END END AS violations
  FROM ({REGISTRY_SQL}))""",
    ),
    "run_errors": (
        q_run_errors,
        f"""SELECT source_id, CASE source_id % 20 WHEN 8 THEN 'ftp is none of the types rss, html, js, api' WHEN 1 THEN 'html needs howto.html.list_selector'
  WHEN 3 THEN 'api needs howto.api.url_field and howto.api.title_field' END AS error FROM ({REGISTRY_SQL})""",
    ),
}
