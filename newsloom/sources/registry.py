"""The registry of sources, and its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.html import bad_selector
from newsloom.functions.text import is_filled
from newsloom.operators.skew import rank_all
from newsloom.schemas import SOURCES

# What each type of source has to state, in a proposal and at run time.
REQUIRED = {
    "rss": ("item_limit", "date_field"),
    "html": ("list_selector", "title_selector", "date_selector", "content_selector"),
    "js": ("list_selector", "title_selector", "date_selector", "content_selector",
           "wait_for", "wait_ms", "strategy", "notes"),
    "api": ("items_path", "url_field", "title_field"),
}
NEEDED_TO_RUN = {"html": ("list_selector",), "js": ("list_selector",), "api": ("url_field", "title_field")}
# A listing needs no titles, and finds out by itself which field holds the url.
NEEDED_TO_LIST = {kind: NEEDED_TO_RUN[kind] for kind in ("html", "js")}
#: Faulty sources that an error names.
NAMED_FAULTS = 10
TYPES = tuple(REQUIRED)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry file: ``{"collector": {"sources": [...]}}``. No sources when the list is missing."""
    wrapped = f"collector struct<sources: array<struct<{SOURCES}>>>"
    return unpack_registry(spark.read.schema(wrapped).option("multiLine", True).json(path))


def parse_registry(texts: DataFrame) -> DataFrame:
    """Registry texts (column ``value``), one registry per row."""
    wrapped = f"collector struct<sources: array<struct<{SOURCES}>>>"
    return unpack_registry(texts.select(F.from_json("value", wrapped).alias("r")).select("r.collector"))


def unpack_registry(registry: DataFrame) -> DataFrame:
    """Sources of all registries. Those without an id get numbers above all ids that are given, by their place, then by url
    and name; so a single registry without ids numbers its sources from 0 by place, and no number is given twice."""
    listed = registry.select(F.posexplode("collector.sources").alias("place", "s")).select("place", "s.*")
    given = listed.where(F.col("source_id").isNotNull())
    above = given.agg(F.max("source_id")).first()[0]
    rest = listed.where(F.col("source_id").isNull()).withColumn("_all", F.lit(0))
    ranked = rank_all(rest, ["_all"], ["place", "url", "name"], "_rank")
    numbered = ranked.withColumn("source_id", (F.col("_rank") + (0 if above is None else max(above + 1, 0)) - 1).cast("int"))
    columns = ["source_id", "name", "url", "type", "howto"]
    return given.select(*columns).unionByName(numbered.select(*columns))


def source_name(name: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), url)


def violations() -> Column:
    """What a proposed source lacks: missing fields by name, and ``type`` for one outside the closed set."""
    rules = [F.when(F.col(field).isNull(), F.lit(field)) for field in ("name", "url", "type", "howto")]
    rules.append(F.when(~F.col("type").isin(*TYPES), F.lit("type")))
    for kind, fields in REQUIRED.items():
        section = f"howto.{kind}"
        this = F.col("type") == kind
        rules.append(F.when(this & F.col("howto").isNotNull() & F.col(section).isNull(), F.lit(section)))
        for field in fields:
            gap = this & F.col(section).isNotNull() & F.col(f"{section}.{field}").isNull()
            rules.append(F.when(gap, F.lit(f"{section}.{field}")))
    return F.array_compact(F.array(*rules))


def validate(sources: DataFrame) -> DataFrame:
    return sources.withColumn("violations", violations()).withColumn("valid", F.size("violations") == 0)


def run_errors(needed: dict[str, tuple[str, ...]] = NEEDED_TO_RUN) -> Column:
    """What keeps a source from being collected, as one text; null when nothing does."""
    known = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    error = F.when(~known, F.concat(F.coalesce("type", F.lit("none")), F.lit(" is none of the types "), F.lit(", ".join(TYPES))))
    for kind, fields in needed.items():
        lacks = reduce(lambda a, b: a | b, (~is_filled(F.col(f"howto.{kind}.{field}")) for field in fields))
        names = " and ".join(f"howto.{kind}.{field}" for field in fields)
        error = error.when((F.col("type") == kind) & lacks, F.lit(f"{kind} needs {names}"))
    return error


def selectors() -> Column:
    """The selectors that a source is read with."""
    fields = ("list_selector", "title_selector", "date_selector", "content_selector")
    named = [F.when(F.col("type") == kind, F.col(f"howto.{kind}.{field}")) for kind in ("html", "js") for field in fields]
    return F.array_compact(F.array(*named))


def check_sources(sources: DataFrame, needed: dict[str, tuple[str, ...]] = NEEDED_TO_RUN) -> None:
    """Fail before a run on sources that cannot be collected, the first few being named: settings that are missing, selectors that
    are not supported, and ids that several sources have."""
    bad = sources.select("source_id", run_errors(needed).alias("error"), bad_selector(selectors()).alias("bad"))
    error = F.coalesce("error", F.concat(F.lit("unsupported selector "), F.col("bad")))
    of_ids = bad.groupBy("source_id").agg(F.count("*").alias("n"), F.min(error).alias("error"))
    twice = F.when(F.col("n") > 1, F.concat(F.lit("an id of "), F.col("n").cast("string"), F.lit(" sources")))
    faults = of_ids.select("source_id", F.coalesce("error", twice).alias("error")).where("error is not null")
    first = faults.orderBy("source_id").limit(NAMED_FAULTS).collect()
    if first:
        total = len(first) if len(first) < NAMED_FAULTS else faults.count()
        more = f"; {total - len(first)} more" if total > len(first) else ""
        raise ValueError("; ".join(f"source {row.source_id}: {row.error}" for row in first) + more)
