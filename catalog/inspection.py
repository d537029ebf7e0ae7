"""Profiling of unknown sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import ANCHOR, feed_bodies, now, payload_bodies, table, with_tables
from newsloom.operators import profiling


def classed_pages(spark, sf):
    """Pages whose anchors have classes, by their first letter. Every tenth page has no anchors."""
    classed = F.regexp_replace("html", '<a href="(/(.)[^"]*)">', '<a class="nav c$2" href="$1">')
    bare = F.regexp_replace("html", "</?a( [^>]*)?>", "")
    return table(spark, sf, "pages").select("page_id", "url", F.when(F.col("page_id") % 10 == 0, bare).otherwise(classed).alias("body"))


def q_selector_counts(spark, sf):
    profiles = profiling.page_profiles(classed_pages(spark, sf), "page_id")
    links = profiles.select("page_id", F.explode("links").alias("l")).select("page_id", "l.*")
    doubled = links.unionByName(links.withColumn("pos", F.col("pos") + 100))
    return profiling.selector_counts(doubled, "page_id")


def q_united_selectors(spark, sf):
    """Targets of the selectors of whole sites, from sketches kept for each page."""
    profiles = profiling.page_profiles(classed_pages(spark, sf), "page_id")
    links = profiles.select("page_id", F.explode("links").alias("l")).select("page_id", "l.*")
    sketches = profiling.selector_sketches(links, "page_id")
    site = F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("site")
    of_pages = sketches.join(table(spark, sf, "pages").select("page_id", site), "page_id")
    return profiling.united_counts(of_pages, "site").select("site", "selector", "targets", "first_pos")


def q_best_selector(spark, sf):
    profiles = profiling.page_profiles(classed_pages(spark, sf), "page_id")
    links = profiles.select("page_id", F.explode("links").alias("l")).select("page_id", "l.*")
    return profiling.best_selector(profiling.selector_counts(links, "page_id"), "page_id").select("page_id", "selector")


def q_list_selectors(spark, sf):
    return profiling.list_selectors(profiling.page_profiles(classed_pages(spark, sf), "page_id"), "page_id")


def marked_pages(spark, sf):
    """Pages that differ in what marks their date, heading and content."""
    page = F.col("page_id")
    mark = (
        F.when(page % 4 == 0, "<span class='x published'>1</span><time>2</time>")
        .when(page % 4 == 1, '<i class="timestamp"></i><span class="published x">1</span>')
        .when(page % 4 == 2, "<b class=date>1</b>")
        .otherwise("")
    )
    body = F.replace("body", F.lit("<footer>"), F.concat(mark, F.lit("<footer>")))
    body = F.when(page % 3 == 0, F.replace(body, F.lit("article>"), F.lit("main>"))).when(page % 3 == 1, F.replace(body, F.lit("article>"), F.lit("section>"))).otherwise(body)
    body = F.when(page % 5 == 0, F.replace(body, F.lit("h1>"), F.lit("h2>"))).otherwise(body)
    return classed_pages(spark, sf).withColumn("body", body)


def q_page_marks(spark, sf):
    profiles = profiling.page_profiles(marked_pages(spark, sf), "page_id")
    return profiles.select("page_id", F.array_join("marks", " ").alias("marks"), F.size("links").alias("n_links"))


def q_page_selectors(spark, sf):
    return profiling.page_selectors(profiling.page_profiles(marked_pages(spark, sf), "page_id"), "page_id")


def raw_pages(spark, sf):
    """What a plain fetch gave: nothing for every seventh page, and for odd pages a text without their selectors."""
    letters = F.regexp_extract_all("html", F.lit('<a href="/(.)'), F.lit(1))
    told = F.array_join(F.transform(letters, lambda c: F.concat(F.lit("a.nav.c"), c)), " ")
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a[href] "), told)).otherwise("<div id=app></div>")
    return table(spark, sf, "pages").where("page_id % 7 <> 0").select("url", body.alias("body"))


def q_page_proposals(spark, sf):
    return profiling.page_proposals(marked_pages(spark, sf).select("url", "body"), raw_pages(spark, sf))


def payload_forms(spark, sf):
    page = F.col("page_id").cast("string")
    plain = F.replace("body", F.lit("[7,"), F.lit("["))
    whole = F.regexp_extract("body", r"\[7,(.*)\]", 1)
    body = (
        F.when(F.col("page_id") % 6 == 0, plain)
        .when(F.col("page_id") % 6 == 1, F.concat(F.lit("["), whole, F.lit("]")))
        .when(F.col("page_id") % 6 == 2, F.concat(F.lit('{"z":{"results":[]},"a":{"n":'), page, F.lit(',"b":{"posts":[{"permalink":1,"headline":2}]}}}')))
        .when(F.col("page_id") % 6 == 3, F.lit('{"news":[{"x":1}],"items":[{"url":"u","title":"t","publishedAt":1,"text":""}]}'))
        .when(F.col("page_id") % 6 == 4, F.lit('{"b":{"data":[{"url":1,"name":2}]},"a":{"items":[{"url":1}]}}'))
        .otherwise(F.concat(F.lit('{"x":[{"url":1}],"items":[3],"k":'), page, F.lit("}")))
    )
    return payload_bodies(spark, sf).select("page_id", "url", body.alias("body"))


def q_item_lists(spark, sf):
    return profiling.item_lists(payload_forms(spark, sf), "page_id").select("page_id", "items_path")


def q_api_proposals(spark, sf):
    return profiling.api_proposals(payload_forms(spark, sf))


def q_feed_proposals(spark, sf):
    feeds = feed_bodies(spark, sf).where("page_id % 2 = 0").select("url", "body")
    others = table(spark, sf, "pages").where("page_id % 2 = 1").select("url", F.col("html").alias("body"))
    return profiling.feed_proposals(feeds.unionByName(others))


def q_propose(spark, sf):
    page = F.col("page_id")
    feeds = feed_bodies(spark, sf).where(page % 5 == 0).select("url", "body")
    payloads = payload_forms(spark, sf).where(page % 5 == 1).select("url", "body")
    plain = raw_pages(spark, sf).join(table(spark, sf, "pages").where(page % 5 > 1).select("url"), "url", "left_semi")
    raw = feeds.unionByName(payloads).unionByName(plain)
    drawn = marked_pages(spark, sf).select("url", "body")
    captures = raw.withColumn("rendered", F.lit(False)).unionByName(drawn.withColumn("rendered", F.lit(True)))
    captures = captures.withColumns({"ok": F.lit(True), "fetched_at": now()})
    found = profiling.propose(table(spark, sf, "pages").select("url"), captures)
    return found.select(
        "name", "url", "type", "howto.rss.item_limit", "howto.api.items_path",
        F.coalesce("howto.html.list_selector", "howto.js.list_selector").alias("list_selector"), "howto.js.wait_ms",
    )


ANCHORS = f"regexp_extract_all(html, '{ANCHOR}', 1)"
COUNTS = """
counts AS (
  SELECT page_id, 'a.nav.c' || substr(txt, 1, 1) AS selector, count(DISTINCT href) AS targets, min(pos)::INTEGER AS first_pos
  FROM links WHERE page_id % 10 <> 0 AND length(txt) >= 10 GROUP BY ALL),
best AS (SELECT page_id, selector FROM counts QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY targets DESC, first_pos) = 1),
chosen AS (
  SELECT p.page_id, p.url, CASE WHEN p.page_id % 10 <> 0 THEN coalesce(b.selector, 'a[href]') END AS list_selector
  FROM pages p LEFT JOIN best b ON b.page_id = p.page_id),
selectors AS (
  SELECT page_id, url, list_selector, CASE WHEN page_id % 5 = 0 THEN 'title' ELSE 'h1' END AS title_selector,
    CASE page_id % 4 WHEN 0 THEN 'time' WHEN 1 THEN '.published' WHEN 2 THEN '.date' ELSE 'time' END AS date_selector,
    CASE page_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'body' ELSE 'article' END AS content_selector
  FROM chosen WHERE list_selector IS NOT NULL),
proposals AS (
  SELECT *, CASE WHEN page_id % 7 <> 0 AND page_id % 2 = 0 THEN 'html' ELSE 'js' END AS type FROM selectors),
payloads AS (
  SELECT page_id, url, list_extract(['data.items', '$', 'a.b.posts', 'items', 'b.data', NULL], (page_id % 6 + 1)::INTEGER) AS items_path,
    list_extract(['url', 'url', 'permalink', 'url', 'url', NULL], (page_id % 6 + 1)::INTEGER) AS url_field,
    list_extract(['title', 'title', 'headline', 'title', 'name', NULL], (page_id % 6 + 1)::INTEGER) AS title_field,
    list_extract(['date', 'date', NULL, 'publishedAt', NULL, NULL], (page_id % 6 + 1)::INTEGER) AS date_field,
    list_extract(['body', 'body', NULL, 'text', NULL, NULL], (page_id % 6 + 1)::INTEGER) AS content_field FROM pages)"""


def over_links(statement: str) -> str:
    return with_tables("links", then=f",{COUNTS}\n{statement}")


QUERIES = {
    "selector_counts": (q_selector_counts, over_links("SELECT * FROM counts")),
    "united_selectors": (
        q_united_selectors,
        over_links(
            """SELECT site, 'a.nav.c' || substr(txt, 1, 1) AS selector, count(DISTINCT href) AS targets, min(pos)::INTEGER AS first_pos
FROM links WHERE page_id % 10 <> 0 AND length(txt) >= 10 GROUP BY ALL"""
        ),
    ),
    "best_selector": (q_best_selector, over_links("SELECT * FROM best")),
    "list_selectors": (q_list_selectors, over_links("SELECT page_id, list_selector FROM chosen")),
    "page_marks": (
        q_page_marks,
        """SELECT page_id, concat_ws(' ', CASE WHEN page_id % 5 <> 0 THEN 'h1' END, CASE WHEN page_id % 4 = 0 THEN 'time' END,
  CASE WHEN page_id % 4 = 2 THEN '.date' END, CASE WHEN page_id % 4 < 2 THEN '.published' END, CASE WHEN page_id % 4 = 1 THEN '.timestamp' END,
  CASE WHEN page_id % 3 = 2 THEN 'article' END, CASE WHEN page_id % 3 = 0 THEN 'main' END) AS marks,
  CASE WHEN page_id % 10 = 0 THEN 0 ELSE len(regexp_extract_all(html, '<a href="')) END::INTEGER AS n_links FROM pages""",
    ),
    "page_selectors": (
        q_page_selectors,
        over_links("SELECT page_id, list_selector, title_selector, date_selector, content_selector FROM selectors"),
    ),
    "page_proposals": (
        q_page_proposals,
        over_links("SELECT url, list_selector, title_selector, date_selector, content_selector, type FROM proposals"),
    ),
    "item_lists": (q_item_lists, over_links("SELECT page_id, items_path FROM payloads WHERE items_path IS NOT NULL")),
    "api_proposals": (
        q_api_proposals,
        over_links("SELECT url, items_path, url_field, title_field, date_field, content_field FROM payloads WHERE items_path IS NOT NULL"),
    ),
    "feed_proposals": (q_feed_proposals, "SELECT url, 50 AS item_limit, 'published' AS date_field FROM pages WHERE page_id % 2 = 0"),
    "propose": (
        q_propose,
        over_links(
            """SELECT trim(replace(replace(p.url, 'https://', ''), 'http://', ''), '/') AS name, p.url, p.type, p.item_limit, p.items_path,
  p.list_selector, p.wait_ms FROM (
  SELECT url, 'rss' AS type, 50 AS item_limit, NULL AS items_path, NULL AS list_selector, NULL::INTEGER AS wait_ms FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT url, 'api', NULL, items_path, NULL, NULL FROM payloads WHERE page_id % 5 = 1 AND items_path IS NOT NULL
  UNION ALL SELECT url, type, NULL, NULL, list_selector, CASE WHEN type = 'js' THEN 1000 END FROM proposals WHERE page_id % 5 > 1
  UNION ALL SELECT url, 'js', NULL, NULL, list_selector, 1000 FROM proposals
    WHERE page_id % 5 = 1 AND page_id % 6 = 5) p"""
        ),
    ),
}
