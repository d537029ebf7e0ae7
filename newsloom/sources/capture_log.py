"""The log of captures: bodies stay where they were written, a narrow index says which one is wanted."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import CAPTURES
from newsloom.session import cut_lineage_measured

PAGE = ("url", "rendered")
COLUMNS = ("url", "fetched_at", "ok", "rendered", "body")
#: Two tables: bodies, by day of fetch and in buckets of a key of their own; and the newest capture of each page in each batch, in buckets of the url.
LOG = f"{CAPTURES}, batch string, capture_key string, day date"
INDEX = "url string, rendered boolean, fetched_at timestamp, body_hash bigint, capture_key string, day date"


def newest_first() -> Column:
    """What orders captures of a page: time, then the least hash of the body. The least of it is the newest capture."""
    return F.struct((-F.unix_micros("fetched_at")).alias("age"), "body_hash", "capture_key", "day")


class CaptureLog:
    """Captures under ``path``, to be used in place of a frame of captures.

    A capture is moved once, when it is added, to the bucket of its key. The key is a hash of the capture and of the batch that added it, so that
    buckets are even however often one url is captured. To read bodies, wanted pages are looked up in the index, and the rows that want them go to
    the buckets of the keys found: no body moves. Only the days of those keys are read.

    The index is written last, and only what it names is read: a batch that failed half way leaves nothing that counts, and one that is
    added again is a capture more of the same time, which changes nothing. The number of buckets is fixed when the log is made.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        settings = f"{self.path}/settings"
        spark.range(1).select(F.lit(wanted).alias("buckets")).coalesce(1).write.mode("ignore").json(settings)
        self.buckets = spark.read.schema("buckets int").json(settings).first().buckets
        self._log = self._table("log", LOG, "day", "capture_key")
        self._index = self._table("index", INDEX, None, "url")

    def _table(self, name: str, schema: str, part: str | None, key: str) -> str:
        """The name of a bucketed table over a folder; a catalog that has not seen it yet learns of what is there."""
        folder = f"{self.path}/{name}"
        table = f"capture_{name}_{hashlib.md5(folder.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(table):
            parts = f"PARTITIONED BY ({part})" if part else ""
            self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet {parts} CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
            if part:
                # Makes the folder if there is none, and no file in it.
                self.spark.createDataFrame([], schema).write.mode("append").partitionBy(part).parquet(folder)
                self.spark.catalog.recoverPartitions(table)
        return table

    def append(self, captures: DataFrame) -> None:
        """Add captures (``CAPTURES``); equal rows of a batch are kept once."""
        batch = uuid.uuid4().hex
        key = F.md5(F.to_json(F.struct(F.lit(batch), *PAGE, "fetched_at", "ok", F.md5("body"))))
        day = F.coalesce(F.col("fetched_at").cast("date"), F.lit("1970-01-01").cast("date"))
        keyed = captures.select(*COLUMNS, F.lit(batch).alias("batch"), key.alias("capture_key"), day.alias("day"))
        seen = Observation()
        once = keyed.repartition(self.buckets, "capture_key").dropDuplicates(["capture_key"])
        once.observe(seen, F.collect_set("day").alias("days")).write.insertInto(self._log)
        self.spark.catalog.refreshTable(self._log)
        # What was written is read, not the source again: it may give other rows the second time.
        added = self.spark.table(self._log).where(F.col("ok") & (F.col("batch") == batch) & F.col("day").isin(seen.get["days"] or []))
        newest = added.withColumn("body_hash", F.xxhash64("body")).groupBy(*PAGE).agg(F.min(newest_first()).alias("n"))
        found = newest.select(*PAGE, F.timestamp_micros(-F.col("n.age")).alias("fetched_at"), "n.body_hash", "n.capture_key", "n.day")
        found.repartition(self.buckets, "url").write.insertInto(self._index)
        self.spark.catalog.refreshTable(self._index)

    def captures(self) -> DataFrame:
        """All captures that the log has, copies included."""
        return self.spark.table(self._log).select(*COLUMNS)

    def newest(self, pages: DataFrame) -> DataFrame:
        """(url, rendered, capture_key, day) of those pages that have a successful capture."""
        index = self.spark.table(self._index).join(pages.select(*PAGE).distinct(), list(PAGE), "left_semi")
        return index.groupBy(*PAGE).agg(F.min(newest_first()).alias("n")).select(*PAGE, "n.capture_key", "n.day")

    def with_body(self, rows: DataFrame) -> DataFrame:
        """Rows (url, rendered, …) that have a successful capture, with its body."""
        keyed, (days,) = cut_lineage_measured(rows.join(self.newest(rows), list(PAGE)), F.collect_set("day"))
        log = self.spark.table(self._log).where(F.col("day").isin(days or [])).select("capture_key", "body")
        return log.join(keyed.drop("day").hint("shuffle_hash"), "capture_key").select(*rows.columns, "body")
