"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import nav_links, news, ntz, table, utc, with_tables
from newsloom.functions import payloads, text, times, urls
from newsloom.functions.html import html_text, read_article
from newsloom.operators.profiling import item_fields
from newsloom.sources.feeds import entry_html

WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Normal form of a URL that has scheme and host.
NORMAL = (
    "CASE WHEN regexp_extract({0}, '^[^:]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN lower(regexp_extract({0}, '^[^:]+://[^/?#]*')) || '/'"
    " ELSE lower(regexp_extract({0}, '^[^:]+://[^/?#]*'))"
    " || regexp_replace(regexp_extract({0}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/$', '') END"
)


def normalized(column: str) -> str:
    return NORMAL.format(column)


def plain_text(html: str) -> str:
    """Text of markup, for the markup and entities that occur in the pages."""
    bare = rf"regexp_replace({html}, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g')"
    for entity, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        bare = f"regexp_replace({bare}, '&{entity};?', '{sign}', 'g')"
    return f"trim(regexp_replace({bare}, '{WS}+', ' ', 'g'))"


def q_normalize_url(spark, sf):
    messy = F.concat(F.upper(F.substring("url", 1, 12)), F.expr("substring(url, 13)"), F.lit("#x"))
    return table(spark, sf, "pages").select(
        "page_id", urls.normalize_url(F.col("url")).alias("normalized"), urls.normalize_url(messy).alias("from_messy")
    )


def q_same_url(spark, sf):
    host = urls.normalize_url(F.regexp_extract("url", "^https?://[^/]+", 0))
    return table(spark, sf, "pages").select(
        "page_id",
        urls.is_same_url(F.concat("url", F.lit("#x")), urls.normalize_url(F.col("url"))).alias("same"),
        urls.is_same_url(F.col("url"), host).alias("same_as_site"),
    )


def q_join_url(spark, sf):
    def joined(prefix):
        return urls.join_url(F.col("page_url"), F.concat(F.lit(prefix), F.col("txt")))

    return nav_links(spark, sf).select(
        "page_id", "pos", "url", joined("./").alias("beside"), joined("../").alias("above"),
        joined("?q=").alias("asked"), joined("//other.example.org/").alias("elsewhere"), joined("mailto:").alias("foreign"),
    )


def q_collapse(spark, sf):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit(" \n"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.collapse(padded)).alias("collapsed"), F.md5(text.strip(padded)).alias("stripped"),
        F.length(text.collapse(padded)).alias("n"),
    )


def q_html_text(spark, sf):
    whole = html_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", whole.alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


def q_read_article(spark, sf):
    article = read_article(F.col("html"), F.lit("h1"), F.lit("div.ad"), F.lit("article"), F.lit(False))
    read = table(spark, sf, "pages").select("page_id", article.alias("a"))
    return read.select("page_id", "a.title", "a.date_text", F.length("a.content").alias("n"), F.md5("a.content").alias("content_md5"))


def q_entry_html(spark, sf):
    form = F.col("doc_id") % 3
    content = F.when(form == 0, F.array("text")).when(form == 1, F.array(F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.md5(entry_html(content, F.col("lang"))).alias("html_md5"))


def q_entry_dates(spark, sf):
    ts = utc("ts")
    form = F.col("event_id") % 7
    date = (
        F.when(form == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(form == 1, F.date_format(ts, "d MMM yyyy HH:mm '+0130'"))
        .when(form == 2, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss 'EST'"))
        .when(form == 3, F.date_format(ts, "d MMM yy HH:mm:ss '-0000'"))
        .when(form == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 5, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"))
    )
    second = F.when(F.col("event_id") % 2 == 0, "Fri, 06 Feb 2026 10:00:00 GMT")
    parsed = times.first_mail_date(date, second)
    return table(spark, sf, "events").select("event_id", ntz(parsed).alias("published"), times.iso_text(parsed).alias("published_text"))


def q_iso_weeks(spark, sf):
    ts = utc("ts")
    year, week = times.iso_year(ts), times.iso_week(ts)
    return table(spark, sf, "events").select(
        "event_id", year.alias("iso_year"), week.alias("iso_week"), text.week_label(year, week).alias("label"),
        ntz(times.week_start(ts)).alias("week_start"), ntz(times.week_end(ts)).alias("week_end"),
        ntz(times.rolling_start(ts, 3)).alias("rolling_start"), ntz(times.rolling_end(ts)).alias("rolling_end"),
        times.iso_text(ts).alias("text"),
    )


def q_payload_paths(spark, sf):
    body = F.concat(F.lit('{"a":{"list":['), F.col("props"), F.lit(',{"k":'), F.col("event_id").cast("string"), F.lit("}]}}"))
    forms = ("a.list.0.k", "a.list.-1.k", "a.list.7.k", "a.k", "a.list.x")
    path = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 5 + 1).cast("int"))
    found = payloads.get_path(F.try_parse_json(body), path)
    whole = payloads.get_path(F.try_parse_json("props"), F.lit("$"))
    return table(spark, sf, "events").select(
        "event_id", payloads.value_text(found).alias("found"), payloads.value_text(payloads.member(whole, F.lit("k"))).alias("k")
    )


def q_payload_values(spark, sf):
    values = ('"v "', "0", "true", "null", "[]", '{"k":1}', '""', "12")
    body = F.concat(F.lit('{"v":'), F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 8 + 1).cast("int")), F.lit("}"))
    value = payloads.member(F.try_parse_json(body), F.lit("v"))
    return table(spark, sf, "events").select(
        "event_id", payloads.value_text(value).alias("value"), payloads.has_value(value).alias("filled"),
        payloads.is_object(value).alias("is_object"),
    )


def q_pick_fields(spark, sf):
    bodies = ('{"link":1,"href":2,"name":"n","date":3}', '{"url":1,"title":"t","text":""}', '{"x":1}', '{"permalink":1,"headline":2,"createdAt":3,"summary":4,"body_html":5}')
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", item_fields(F.try_parse_json(body)).alias("f")).select("event_id", "f.*")


def q_site_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.site_name(F.col("url")).alias("name"))


def q_digest_entries(spark, sf):
    rows = news(spark, sf)
    block = text.digest_block(F.col("title"), F.col("url"), F.col("published_date"), times.iso_text(F.col("collected_at")), F.col("summary"))
    return rows.select("ingest_seq", block.alias("block"))


def q_front_matter(spark, sf):
    head = text.front_matter(F.concat(F.lit("Title "), F.col("lang"), F.col("doc_id").cast("string")), F.lit("2026-02-10"), ["x", "y"], "post")
    return table(spark, sf, "documents").select("doc_id", head.alias("head"))


def q_file_stem(spark, sf):
    path = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", text.file_stem(path).alias("stem"))


QUERIES = {
    "normalize_url": (
        q_normalize_url,
        f"SELECT page_id, {normalized('url')} AS normalized, {normalized('url')} AS from_messy FROM pages",
    ),
    "same_url": (
        q_same_url,
        "SELECT page_id, TRUE AS same, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) IN ('', '/') AS same_as_site FROM pages",
    ),
    "join_url": (
        q_join_url,
        with_tables(
            "links",
            then="""SELECT page_id, pos, url, site || folder || txt AS beside,
  site || regexp_replace(folder, '[^/]+/$', '') || txt AS above, site || path || '?q=' || txt AS asked,
  regexp_extract(page_url, '^https?:') || '//other.example.org/' || txt AS elsewhere, 'mailto:' || txt AS "foreign"
FROM (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder
      FROM (SELECT *, regexp_extract(page_url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM links))""",
        ),
    ),
    "collapse_text": (
        q_collapse,
        f"""SELECT doc_id, md5(t) AS collapsed, md5(s) AS stripped, length(t)::INTEGER AS n FROM (
  SELECT doc_id, trim(regexp_replace(padded, '{WS}+', ' ', 'g')) AS t, regexp_replace(padded, '^{WS}+|{WS}+$', '', 'g') AS s
  FROM (SELECT doc_id, chr(160) || chr(9) || text || chr(8195) || chr(10) AS padded FROM documents))""",
    ),
    "html_text": (
        q_html_text,
        f"SELECT page_id, length(t)::INTEGER AS n, md5(t) AS text_md5 FROM (SELECT page_id, {plain_text('html')} AS t FROM pages)",
    ),
    "read_article": (
        q_read_article,
        rf"""SELECT page_id, title, date_text, length(t)::INTEGER AS n, md5(t) AS content_md5 FROM (
  SELECT page_id, {plain_text("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
    {plain_text("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS date_text,
    {plain_text("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS t FROM pages)""",
    ),
    "entry_html": (q_entry_html, "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 AND text <> '' THEN text ELSE lang END) AS html_md5 FROM documents"),
    "entry_dates": (
        q_entry_dates,
        """SELECT event_id, published, strftime(published, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_text FROM (
  SELECT event_id, CASE event_id % 7 WHEN 0 THEN s WHEN 1 THEN date_trunc('minute', ts) - INTERVAL 90 MINUTE WHEN 2 THEN s + INTERVAL 5 HOUR
    WHEN 3 THEN s WHEN 5 THEN s ELSE CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2026-02-06 10:00:00' END END AS published
  FROM (SELECT event_id, ts, date_trunc('second', ts) AS s FROM events))""",
    ),
    "iso_weeks": (
        q_iso_weeks,
        """SELECT event_id, isoyear(ts)::INTEGER AS iso_year, weekofyear(ts)::INTEGER AS iso_week,
  printf('%04d-%02d', isoyear(ts), weekofyear(ts)) AS label,
  date_trunc('week', ts)::TIMESTAMP AS week_start, date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY AS week_end,
  date_trunc('day', ts)::TIMESTAMP - INTERVAL 2 DAY AS rolling_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS rolling_end,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS text
FROM events""",
    ),
    "payload_paths": (
        q_payload_paths,
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN k WHEN 1 THEN event_id::VARCHAR END AS found, k
FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""",
    ),
    "payload_values": (
        q_payload_values,
        """SELECT event_id, v AS value, event_id % 8 IN (0, 2, 5, 7) AS filled, event_id % 8 = 5 AS is_object
FROM events JOIN (VALUES (0, 'v '), (1, '0'), (2, 'True'), (3, NULL), (4, '[]'), (5, '{"k":1}'), (6, ''), (7, '12')) AS f(form, v)
  ON form = event_id % 8""",
    ),
    "pick_fields": (
        q_pick_fields,
        """SELECT event_id, url_field, title_field, date_field, content_field
FROM events JOIN (VALUES (0, 'link', 'name', 'date', NULL), (1, 'url', 'title', NULL, 'text'), (2, NULL, NULL, NULL, NULL),
  (3, 'permalink', 'headline', 'createdAt', 'body_html')) AS f(form, url_field, title_field, date_field, content_field)
  ON form = event_id % 4""",
    ),
    "site_name": (
        q_site_name,
        "SELECT page_id, trim(replace(replace(url, 'https://', ''), 'http://', ''), '/') AS name FROM pages",
    ),
    "digest_entries": (
        q_digest_entries,
        with_tables(
            "news",
            then="""SELECT ingest_seq, '#### ' || title || chr(10) || '- URL: ' || url || chr(10) || '- Published: ' || coalesce(published_date, 'unknown')
  || chr(10) || '- Collected: ' || strftime(collected_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || '- Summary:' || chr(10) || '  '
  || coalesce(summary, '') || chr(10) AS block FROM news""",
        ),
    ),
    "front_matter": (
        q_front_matter,
        """SELECT doc_id, concat_ws(chr(10), '---', 'title: Title ' || lang || doc_id, 'description:', 'date: 2026-02-10', 'scheduled: 2026-02-10',
  'tags:', '  - x', '  - y', 'layout: post', '---', '') AS head FROM documents""",
    ),
    "file_stem": (
        q_file_stem,
        "SELECT page_id, regexp_extract(regexp_extract(url, '^https?://([^?#]*)', 1), '([^/]+?)(\\.[^./]+)?/*$', 1) AS stem FROM pages",
    ),
}
