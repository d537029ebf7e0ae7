"""Every source by its type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.merge import with_body
from newsloom.operators.skew import hot_keys
from newsloom.session import staged
from newsloom.sources.apis import payload_items, payload_urls, undecided_payloads
from newsloom.sources.articles import WANTED, article_items, article_key, read_articles, wanted_texts
from newsloom.sources.capture_log import CaptureLog
from newsloom.sources.feeds import feed_items, feed_urls, titled_entries
from newsloom.sources.listings import first_links, full_listings, links_of, page_urls
from newsloom.sources.registry import NAMED_FAULTS, NEEDED_TO_LIST, TYPES, check_sources, source_name

# Limits of a run.
LOOKBACK_DAYS = 30
MAX_ITEMS = 50


def open_sources(sources: DataFrame, captures: DataFrame | CaptureLog, *kinds: str) -> DataFrame:
    """Sources (of some types, or all) with the body that was captured for them, in one pass over the captures.
    A ``js`` source is read from its rendered capture, any other from its plain one."""
    chosen = sources.where(F.col("type").isin(*(kinds or TYPES)))
    rendered = F.col("type") == "js"
    return with_body(chosen.select("source_id", "url", "type", "howto", rendered.alias("rendered")), captures, ["source_id"])


def fetch(
    sources: DataFrame,
    captures: DataFrame | CaptureLog,
    now: Column,
    lookback_days: int = LOOKBACK_DAYS,
    limit: int = MAX_ITEMS,
    kinds: tuple[str, ...] = TYPES,
) -> DataFrame:
    """Items of all sources of the given types; ``(source_id, pos)`` is their order. A lookback applies to feeds only.

    The captures are read twice: for the sources, and for the articles that all of them lead to.
    """
    check_sources(sources)
    return fetch_opened(staged(open_sources(sources, captures, *kinds), "opened"), captures, now, lookback_days, limit, kinds)


def fetch_opened(
    opened: DataFrame,
    captures: DataFrame | CaptureLog,
    now: Column,
    lookback_days: int = LOOKBACK_DAYS,
    limit: int = MAX_ITEMS,
    kinds: tuple[str, ...] = TYPES,
) -> DataFrame:
    """The same for sources with their bodies."""
    branches: list[DataFrame] = []
    wanted: list[DataFrame] = []
    if "rss" in kinds:
        entries = staged(titled_entries(opened, now, lookback_days, limit), "entries")
        wanted.append(wanted_texts(entries.select("url")))
    offered = [links_of(opened, "html")] if "html" in kinds else []
    offered += [first_links(links_of(opened, "js"), limit)] if "js" in kinds else []
    if offered:
        # Rendered listings are told by the kind of capture that their articles are read from.
        links = staged(reduce(DataFrame.unionByName, offered), "links")
        wanted.append(links)
    if wanted:
        pages = reduce(DataFrame.unionByName, (part.select(*WANTED) for part in wanted))
        articles = staged(read_articles(pages, captures), "articles")
        hot = hot_keys(pages.select(article_key()), ["article_key"])
    if "rss" in kinds:
        branches.append(feed_items(entries, articles, hot))
    if "html" in kinds:
        branches.append(full_listings(links.where(~F.col("rendered")), articles, limit, hot))
    if "js" in kinds:
        branches.append(article_items(links.where("rendered"), articles, hot))
    if "api" in kinds:
        branches.append(payload_items(opened, limit))
    return reduce(DataFrame.unionByName, branches)


def list_urls(
    sources: DataFrame,
    captures: DataFrame | CaptureLog,
    now: Column,
    lookback_days: int = LOOKBACK_DAYS,
    limit: int = MAX_ITEMS,
    kinds: tuple[str, ...] = TYPES,
) -> DataFrame:
    """What every source of the given types offers: (source_id, name, pos, url), sorted by source and position.

    Payloads need no configured url field; those whose first item has no field of a usual name either are an error."""
    check_sources(sources, NEEDED_TO_LIST)
    opened = staged(open_sources(sources, captures, *kinds), "opened")
    undecided = undecided_payloads(opened).orderBy("source_id").limit(NAMED_FAULTS).collect() if "api" in kinds else []
    if undecided:
        raise ValueError("; ".join(f"source {row.source_id}: no howto.api.url_field, and none to be found" for row in undecided))
    listings = {
        "rss": lambda: feed_urls(opened, now, lookback_days, limit),
        "html": lambda: page_urls(opened, "html", limit),
        "js": lambda: page_urls(opened, "js", limit),
        "api": lambda: payload_urls(opened, limit),
    }
    offered = reduce(DataFrame.unionByName, (listings[kind]() for kind in kinds))
    names = sources.select("source_id", source_name(F.col("name"), F.col("url")).alias("name"))
    return offered.join(names, "source_id").select("source_id", "name", "pos", "url").orderBy("source_id", "pos")
