"""JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.payloads import as_list, get_path, has_value, is_object, keys_of, member, pick_field, value_text
from newsloom.functions.text import strip
from newsloom.operators.caps import first_per_group
from newsloom.operators.filters import is_not_source

# Names that hold the url of an item, in order of preference.
URL_FIELDS = ("canonical_url", "url", "link", "href", "permalink")


def _lists(opened: DataFrame) -> DataFrame:
    """The item list of every opened payload, null where its path leads to none."""
    howto = F.col("howto.api")
    fields = ("items_path", "url_field", "title_field", "date_field", "content_field")
    apis = opened.where(F.col("type") == "api").select("source_id", "url", "body", *(howto[name].alias(name) for name in fields))
    return apis.withColumn("list", as_list(get_path(F.try_parse_json("body"), F.col("items_path")))).drop("body")


def _items(lists: DataFrame) -> DataFrame:
    """Object items in payload order."""
    others = [c for c in lists.columns if c not in ("list", "url")]
    listed = lists.select(*others, F.col("url").alias("source_url"), F.posexplode("list").alias("pos", "item"))
    return listed.where(is_object(F.col("item")))


def _present(value) -> object:
    return F.nullif(value, F.lit(""))


def payload_items(opened: DataFrame, limit: int) -> DataFrame:
    """Items of payloads, by the field names of their source."""
    fields = {name: _present(F.col(f"{name}_field")) for name in ("url", "title", "date", "content")}
    valued = _items(_lists(opened)).select(
        "source_id", "source_url", "pos", *(member(F.col("item"), field).alias(name) for name, field in fields.items())
    )
    told = valued.where(has_value(F.col("url")) & has_value(F.col("title")))
    texts = told.select(
        "source_id",
        "source_url",
        "pos",
        value_text(F.col("url")).alias("url"),
        strip(value_text(F.col("title"))).alias("title"),
        value_text(F.col("date")).alias("published_date"),
        F.coalesce(strip(value_text(F.col("content"))), F.lit("")).alias("content"),
    )
    items = texts.where(is_not_source(F.col("url"), F.col("source_url"))).drop("source_url")
    return first_per_group(items, limit, ["source_id"], ["pos"])


def payload_urls(opened: DataFrame, limit: int) -> DataFrame:
    """Urls that payloads offer. A source that names no url field gets it from its first item."""
    valued = _items(_with_url_field(opened)).select("source_id", "source_url", "pos", member(F.col("item"), F.col("url_field")).alias("url"))
    urls = valued.where(has_value(F.col("url"))).withColumn("url", value_text(F.col("url")))
    offered = urls.where(is_not_source(F.col("url"), F.col("source_url"))).drop("source_url")
    return first_per_group(offered, limit, ["source_id"], ["pos"])


def _with_url_field(opened: DataFrame) -> DataFrame:
    guess = pick_field(keys_of(F.get("list", F.lit(0))), URL_FIELDS)
    return _lists(opened).withColumn("url_field", F.coalesce(_present(F.col("url_field")), guess))


def undecided_payloads(opened: DataFrame) -> DataFrame:
    """Payloads with a list, for which neither their source nor their first item tells which field holds the url."""
    return _with_url_field(opened).where("list is not null and url_field is null").select("source_id", "url")


def unreadable_payloads(opened: DataFrame) -> DataFrame:
    """Payloads whose path leads to no list."""
    return _lists(opened).where(F.col("list").isNull()).select("source_id", "url")
