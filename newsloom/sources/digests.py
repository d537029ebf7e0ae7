"""Digest texts as input of posts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Fixed value: where digests are looked for when nothing names one.
DIGEST_FOLDER = "output/news_summaries"


def current_digest(folder: str, now: datetime) -> str:
    """The digest file of the ISO week of ``now``."""
    year, week, _ = (now.astimezone(timezone.utc) if now.tzinfo else now).isocalendar()
    return f"{folder.rstrip('/')}/news_{year:04d}_{week:02d}.md"


def choose_digest(argument: str | None, configured: str | None, current: str) -> str:
    """The path given, else the configured one, else that of the current week."""
    return argument or configured or current


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """A digest file, or the files of a written digest: (path, part, markdown), whole texts in order.

    A digest that was written as a dataset lies beside the name of its file, in a folder of that name.
    """
    folder, name = path.rstrip("/").rsplit("/", 1) if "/" in path.rstrip("/") else (".", path)
    # Written digests are folders ``file=<name>``; one of the two is there.
    places = spark.read.text(f"{folder}/{{{name},file={name}}}", wholetext=True)
    files = places.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("markdown"))
    # One row per file of one digest, which is what bounds this window.
    part = F.row_number().over(Window.partitionBy("path").orderBy("file")) - 1
    return files.withColumn("path", F.lit(path)).select("path", part.alias("part"), "markdown")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """All written digests of a folder: (file, part, markdown)."""
    files = spark.read.schema("value string, file string").text(folder, wholetext=True)
    part = F.row_number().over(Window.partitionBy("file").orderBy("_path")) - 1
    return files.select("file", F.col("value").alias("markdown"), F.col("_metadata.file_path").alias("_path")).select("file", part.alias("part"), "markdown")
