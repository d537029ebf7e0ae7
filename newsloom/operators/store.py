"""The curated news table: Parquet files, partitioned by the ISO week of collection, in versions.

A write puts its files into a folder of its own and is there when a new version names that folder: a reader sees all of it or nothing. A write that
was prepared on an older version than the newest is refused. Beside the rows of a commit lie the hashes of their keys, and summaries that
come later, which are laid over the rows when these are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import times
from newsloom.operators.commits import Manifest, commit, latest
from newsloom.operators.dedup import KEYS, drop_stored, first_kept
from newsloom.operators.filters import has_content
from newsloom.schemas import NEWS
from newsloom.session import cut_lineage, cut_lineage_measured, staged

WEEK = ("iso_year", "iso_week")
OUTCOMES = ("inserted", "duplicate", "no_content")
#: Folders that the hashes of a commit are dealt into; a batch reads those that its own hashes fall into.
KEY_SLOTS = 16
HASHES = "kind int, hash bigint, iso_year int, iso_week int, slot int"
LAID_OVER = "url string, summary string, version int, of_part string, iso_year int, iso_week int"


@dataclass(frozen=True)
class News:
    """A version of the table under ``path``."""

    spark: SparkSession
    path: str
    manifest: Manifest

    @staticmethod
    def now(spark: SparkSession, path: str) -> News:
        return News(spark, path.rstrip("/"), latest(spark, path))

    def _read(self, kind: str, folders: tuple[str, ...], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{kind}/part={name}" for name in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def rows(self) -> DataFrame:
        """Rows as they were added, with the commit that added them as ``part``."""
        return self._read("rows", self.manifest.rows, f"{NEWS}, part string")

    def summaries(self) -> DataFrame:
        """The newest summary of each row that got one later."""
        laid = self._read("summaries", self.manifest.summaries, LAID_OVER)
        keys = [F.col("of_part").alias("part"), *WEEK, "url"]
        return laid.groupBy(*keys).agg(F.max_by("summary", "version").alias("_summary"))

    def read(self) -> DataFrame:
        """Rows with the summaries that came later."""
        rows = self.rows()
        if self.manifest.summaries:
            rows = rows.join(self.summaries(), ["part", *WEEK, "url"], "left").withColumn("summary", F.coalesce("_summary", "summary"))
        return rows.select(*self.spark.createDataFrame([], NEWS).columns)

    def sharing_keys(self, items: DataFrame) -> DataFrame:
        """Rows (url, title) among which are all that share a key with an item.

        The hashes of the items meet those of the store, of which only the slots of the items' hashes are read; urls and titles are read of the
        weeks that a hash was found in. So a batch of new items reads neither.
        """
        asked, (slots,) = cut_lineage_measured(_hashes(items).drop(*WEEK).distinct(), F.collect_set("slot"))
        stored = self._read("keys", self.manifest.keys, HASHES).where(F.col("slot").isin(slots or []))
        weeks = stored.join(asked, ["slot", "kind", "hash"], "left_semi").select(*WEEK).distinct().collect()
        found = [week_key(row.iso_year, row.iso_week) for row in weeks]
        return self.rows().where(week_number(F.col("iso_year"), F.col("iso_week")).isin(found)).select(*KEYS)

    def _commit(self, manifest: Manifest) -> None:
        commit(self.spark, self.path, manifest)


def _hashes(rows: DataFrame) -> DataFrame:
    """The hash of each key of each row, with its slot (and the week of the row, if it has one)."""
    weeks = [F.col(name) if name in rows.columns else F.lit(None).cast("int").alias(name) for name in WEEK]
    pairs = F.array(*(F.struct(F.lit(i).alias("kind"), F.xxhash64(key).alias("hash")) for i, key in enumerate(KEYS)))
    found = rows.select(F.explode(pairs).alias("k"), *weeks).select("k.*", *WEEK)
    return found.withColumn("slot", F.pmod(F.shiftright("hash", 40), F.lit(KEY_SLOTS)).cast("int"))


def create_news(spark: SparkSession, path: str) -> None:
    """Make an empty news table unless there is one. A table without a version is empty, so this only makes its folder."""
    spark.createDataFrame([], NEWS).write.mode("ignore").parquet(f"{path.rstrip('/')}/rows")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    return News.now(spark, path).read()


def item_seq(source_id: Column, pos: Column) -> Column:
    """Order of items in a run as one BIGINT: by source, then by place in its listing."""
    return F.shiftleft(source_id.cast("bigint"), 32).bitwiseOR(pos.cast("bigint"))


def ingest(items: DataFrame, stored: DataFrame | News, **tuning: int) -> DataFrame:
    """Items with their ``outcome``: ``inserted``, ``duplicate`` or ``no_content``; ``ingest_seq`` is their order.

    Empty items go first, then those the store has, then duplicates within the batch. The order matters: an item
    that is turned away stands in nobody's way. An item that comes several times, or several items of one place of a source, are one item and duplicates of
    it; the one with the least hash counts, so that it is the same one whenever the batch is run. Keys alone move through these steps.
    """
    numbered = items.withColumns({"ingest_seq": item_seq(F.col("source_id"), F.col("pos")), "_row": F.monotonically_increasing_id()})
    numbered = staged(numbered, "items")
    one = F.struct(F.xxhash64("url", "title", "published_date", "content").alias("hash"), "_row", *KEYS)
    filled = numbered.where(has_content(F.col("content"))).groupBy("ingest_seq").agg(F.min(one).alias("one"))
    filled = cut_lineage(filled.select("ingest_seq", "one._row", *(f"one.{key}" for key in KEYS)))
    new = drop_stored(filled, stored.sharing_keys(filled) if isinstance(stored, News) else stored, ["ingest_seq"])
    kept = first_kept(new, "ingest_seq", **tuning)
    rows = filled.join(kept, "ingest_seq").select("_row", F.lit(True).alias("_kept"))
    outcome = (
        F.when(~has_content(F.col("content")), "no_content").when(F.col("_kept"), "inserted").otherwise("duplicate")
    )
    return numbered.join(rows, "_row", "left").withColumn("outcome", outcome).drop("_kept", "_row")


def as_news(outcomes: DataFrame, now: Column) -> DataFrame:
    """News rows of the inserted items."""
    return outcomes.where(F.col("outcome") == "inserted").select(
        "url",
        "title",
        "published_date",
        times.any_date(F.col("published_date")).alias("published_ts"),
        now.cast("timestamp").alias("collected_at"),
        "ingest_seq",
        "content",
        F.lit(None).cast("string").alias("summary"),
        times.iso_year(now).alias("iso_year"),
        times.iso_week(now).alias("iso_week"),
    )


def append_news(news: DataFrame, path: str, expected: News | None = None, batch: tuple[str, int] | None = None) -> None:
    """Add news rows as one commit, made on the version ``expected`` (the newest one, if none is given) for a ``batch`` (stream, number).

    Tasks write their own rows, so a week that takes the whole batch is written by all of them.
    """
    table = expected or News.now(news.sparkSession, path)
    part = uuid.uuid4().hex
    news.write.partitionBy(*WEEK).parquet(f"{table.path}/rows/part={part}")
    added = table._read("rows", (part,), f"{NEWS}, part string")
    _hashes(added).write.partitionBy("slot").parquet(f"{table.path}/keys/part={part}")
    old = table.manifest
    table._commit(old.next(rows=(*old.rows, part), keys=(*old.keys, part), batches=old.with_batch(batch)))


def week_number(year: Column, week: Column) -> Column:
    return year * 100 + week


def collected_between(news: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows collected in ``[start, end)``. The week predicate prunes partitions, which Spark does not derive itself."""
    last = end - F.expr("INTERVAL 1 MICROSECOND")
    weeks = week_number(F.col("iso_year"), F.col("iso_week")).between(
        week_number(times.iso_year(start), times.iso_week(start)), week_number(times.iso_year(last), times.iso_week(last))
    )
    return news.where(weeks & times.in_window(F.col("collected_at"), start, end))


def news_between(news: DataFrame, start: Column, end: Column) -> DataFrame:
    """The same in collection order."""
    return collected_between(news, start, end).orderBy("collected_at", "ingest_seq")


def update_summaries(
    spark: SparkSession, path: str, summaries: DataFrame, window: tuple[Column, Column] | None = None
) -> None:
    """Lay summaries (url, summary; unique by url) over the rows they belong to. No row is written again.

    Where all summaries belong to a collection window, only its weeks are searched.
    """
    table = News.now(spark, path)
    rows = table.rows()
    searched = collected_between(rows, *window) if window else rows
    old, part = table.manifest, uuid.uuid4().hex
    laid = searched.select("url", "part", *WEEK).join(summaries.where(F.col("summary").isNotNull()).select("url", "summary"), "url")
    laid = laid.select("url", "summary", F.lit(old.version + 1).alias("version"), F.col("part").alias("of_part"), *WEEK)
    laid.write.partitionBy(*WEEK).parquet(f"{table.path}/summaries/part={part}")
    table._commit(old.next(summaries=(*old.summaries, part)))


def compact(spark: SparkSession, path: str) -> None:
    """Write the rows of all commits that summaries were laid over again, with these, as one commit. Keys stay where they are."""
    table = News.now(spark, path)
    old, part = table.manifest, uuid.uuid4().hex
    if not old.summaries:
        return
    touched = [row.part for row in table.summaries().select("part").distinct().collect()]
    merged = News(spark, table.path, replace(old, rows=tuple(name for name in old.rows if name in touched))).read()
    merged.write.partitionBy(*WEEK).parquet(f"{table.path}/rows/part={part}")
    table._commit(old.next(rows=(*(name for name in old.rows if name not in touched), part), summaries=()))


def week_key(year: int, week: int) -> int:
    return year * 100 + week


def instant(moment: datetime | Column) -> Column:
    """A point in time as a column."""
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")
