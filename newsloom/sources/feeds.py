"""RSS, RDF and Atom feeds."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let, once
from newsloom.functions.html import html_text
from newsloom.functions.text import is_filled, strip
from newsloom.functions.times import first_mail_date, iso_text
from newsloom.operators.caps import first_per_group
from newsloom.operators.filters import has_link_and_title, is_not_source, recent_enough
from newsloom.sources.articles import with_full_text

# Element names of feed formats.
RSS_ITEM = (
    "title string, link array<string>, guid struct<_VALUE: string, _isPermaLink: string>, pubDate string,"
    " `dc:date` string, `dcterms:created` string, `content:encoded` array<string>, description string"
)
ATOM_ENTRY = (
    "title string, link array<struct<_href: string, _rel: string>>, published string, updated string, created string,"
    " content array<string>, summary string"
)
FEED = f"channel struct<item: array<struct<{RSS_ITEM}>>>, item array<struct<{RSS_ITEM}>>, entry array<struct<{ATOM_ENTRY}>>"
ENTRY = "array<struct<title: string, link: string, published: string, updated: string, created: string, html: string>>"


def entry_html(content: Column, summary: Column) -> Column:
    """The full content of an entry where the feed gives it, else its summary."""
    return F.coalesce(F.nullif(F.get(content, F.lit(0)), F.lit("")), summary)


def _rss_entry(item: Column) -> Column:
    permalink = F.when(F.coalesce(item["guid"]["_isPermaLink"], F.lit("true")) != "false", item["guid"]["_VALUE"])
    return F.struct(
        item["title"].alias("title"),
        F.coalesce(F.get(item["link"], F.lit(0)), permalink).alias("link"),
        item["pubDate"].alias("published"),
        item["dc:date"].alias("updated"),
        item["dcterms:created"].alias("created"),
        entry_html(item["content:encoded"], item["description"]).alias("html"),
    )


def _atom_entry(entry: Column) -> Column:
    pages = F.filter(entry["link"], lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate")
    return F.struct(
        entry["title"].alias("title"),
        F.try_element_at(pages, F.lit(-1))["_href"].alias("link"),
        entry["published"].alias("published"),
        entry["updated"].alias("updated"),
        entry["created"].alias("created"),
        entry_html(entry["content"], entry["summary"]).alias("html"),
    )


# References that every XML text may hold, and any other sign of one.
KNOWN_REFERENCE = r"(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);"
NAMED = {name: chr(code) for name, code in name2codepoint.items() if name not in ("amp", "lt", "gt", "quot")}


def well_formed(body: Column) -> Column:
    """``body`` with HTML's named characters in place of their names and ``&amp;`` for a bare ampersand, outside CDATA sections."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def mend(after: Column, place: Column) -> Column:
        name = F.regexp_extract(after, "^([A-Za-z][A-Za-z0-9]*);", 1)
        known = (place == 0) | after.rlike(f"^{KNOWN_REFERENCE}")
        shown = let(F.try_element_at(names, name), lambda c: F.when(c.isNotNull(), F.concat(c, F.regexp_replace(after, "^[^;]*;", ""))))
        sign = F.when(place == 0, F.lit("")).otherwise(F.lit("&"))
        return F.when(known, F.concat(sign, after)).otherwise(F.coalesce(shown, F.concat(F.lit("&amp;"), after)))

    def section(text: Column) -> Column:
        mended = F.array_join(F.transform(F.split(text, "&"), mend), "")
        return F.when(text.startswith("<![CDATA["), text).otherwise(mended)

    sections = F.split(body, r"(?=<!\[CDATA\[)|(?<=\]\]>)")
    return F.when(body.rlike(f"&(?!{KNOWN_REFERENCE})"), F.array_join(F.transform(sections, section), "")).otherwise(body)


def feed_entries(body: Column) -> Column:
    """Entries of a feed text in feed order; none when the text is no feed, or far from well formed."""
    none = F.array().cast(ENTRY)

    def entries(feed: Column) -> Column:
        parts = (
            F.transform(feed["channel"]["item"], _rss_entry),
            F.transform(feed["item"], _rss_entry),
            F.transform(feed["entry"], _atom_entry),
        )
        return F.concat(*(F.coalesce(part, none) for part in parts))

    return let(F.from_xml(well_formed(body), FEED), entries)


def entries_of(opened: DataFrame, now: Column, lookback_days: int) -> DataFrame:
    """Entries of opened feeds that are recent enough and lead elsewhere, in feed order."""
    feeds = opened.where(F.col("type") == "rss")
    listed = feeds.select("source_id", F.col("url").alias("source_url"), F.posexplode(feed_entries(F.col("body"))).alias("pos", "e"))
    dated = listed.select(
        "source_id",
        "source_url",
        "pos",
        F.col("e.link").alias("url"),
        strip(F.coalesce("e.title", F.lit(""))).alias("title"),
        once(first_mail_date(F.col("e.published"), F.col("e.updated"), F.col("e.created"))).alias("published_ts"),
        F.col("e.html").alias("html"),
    )
    return dated.where(
        recent_enough(F.col("published_ts"), now, lookback_days)
        & is_filled(F.col("url"))
        & is_not_source(F.col("url"), F.col("source_url"))
    ).drop("source_url")


def feed_urls(opened: DataFrame, now: Column, lookback_days: int, limit: int) -> DataFrame:
    """Urls that feeds offer; entries without a title count."""
    entries = entries_of(opened, now, lookback_days).select("source_id", "pos", "url")
    return first_per_group(entries, limit, ["source_id"], ["pos"])


def titled_entries(opened: DataFrame, now: Column, lookback_days: int, limit: int) -> DataFrame:
    """Entries with a title, capped. The cap counts entries, whether or not their article can be read; so it comes
    before articles are."""
    titled = entries_of(opened, now, lookback_days).where(has_link_and_title(F.col("url"), F.col("title")))
    return first_per_group(titled, limit, ["source_id"], ["pos"])


def feed_items(entries: DataFrame, articles: DataFrame, hot: dict[int, int] | None = None) -> DataFrame:
    """Items of feed entries. The article behind a link replaces the text of the feed where it was captured."""
    joined = with_full_text(entries, articles, hot)
    # Feed text is only parsed where it is needed.
    own = html_text(F.when(~is_filled(F.col("full_text")), F.col("html")))
    return joined.select(
        "source_id",
        "pos",
        "url",
        "title",
        iso_text(F.col("published_ts")).alias("published_date"),
        F.when(is_filled(F.col("full_text")), F.col("full_text")).otherwise(F.coalesce(own, F.lit(""))).alias("content"),
    )


def unreadable_feeds(opened: DataFrame) -> DataFrame:
    """Feeds whose capture gives no entry at all."""
    feeds = opened.where(F.col("type") == "rss")
    return feeds.where(F.size(feed_entries(F.col("body"))) == 0).select("source_id", "url")
