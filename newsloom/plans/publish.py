"""Publish job: digests and model drafts in, posts out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text, times
from newsloom.functions.binding import let
from newsloom.operators.requests import post_requests, responses_by_key
from newsloom.operators.rollup import write_digests
from newsloom.operators.store import instant


def make_post(
    draft: Column, year: Column, week: Column, stem: Column, run_date: Column,
    default_title: str = text.DEFAULT_TITLE, tags: Sequence[str] = text.DEFAULT_TAGS, layout: str = text.DEFAULT_LAYOUT,
    first: Column | None = None, last: Column | None = None,
) -> Column:
    """A draft becomes ``struct<title, markdown>``: cleaned, titled, with front matter and a link to its digest.

    Where a post has several drafts, only the ``first`` one gives title and front matter, and the link follows the ``last`` one."""
    opens, ends = (F.lit(True) if place is None else place for place in (first, last))

    def post(bare: Column) -> Column:
        return let(F.when(opens, text.heading_title(bare, default_title)), lambda title: F.struct(
            title.alias("title"),
            F.concat(
                F.coalesce(text.front_matter(title, run_date, tags, layout), F.lit("")),
                text.drop_heading(bare),
                F.when(ends, text.back_link(year, week, stem)).otherwise(""),
            ).alias("markdown"),
        ))

    return let(text.drop_front_matter(draft), post)


def digest_stem(year: Column, week: Column) -> Column:
    return F.format_string("news_%04d_%02d", year, week)


def posts_of(drafts: DataFrame, run_date: Column, **layout) -> DataFrame:
    """Posts of drafts (iso_year, iso_week, part, stem, draft), one of each draft; with a ``last_part``, parts are sections of one post."""
    year, week = F.col("iso_year"), F.col("iso_week")
    if "last_part" in drafts.columns:
        layout |= {"first": F.col("part") == 0, "last": F.col("part") == F.col("last_part")}
    made = make_post(F.col("draft"), year, week, F.col("stem"), run_date, **layout)
    return drafts.select("iso_year", "iso_week", "part", made.alias("p")).select("iso_year", "iso_week", "part", "p.*")


def label_now(parts: DataFrame, now: datetime) -> DataFrame:
    """Digest texts that were read from files, labelled with the current week: posts always are."""
    moment = instant(now)
    return parts.withColumns({"iso_year": times.iso_year(moment), "iso_week": times.iso_week(moment)})


def publish(
    spark: SparkSession,
    parts: DataFrame,
    responses: DataFrame,
    now: datetime,
    rules: str | None = None,
    output: str | None = None,
    **layout,
) -> DataFrame:
    """Posts of digest parts (iso_year, iso_week, part, markdown; optionally path): one post for each digest, in as many sections.

    A digest of usual size is one part and its post one section. The first section has the title and the front matter, the last one the link
    to the digest. A digest waits until all its parts are answered.
    """
    stem = text.file_stem(F.col("path")) if "path" in parts.columns else digest_stem(F.col("iso_year"), F.col("iso_week"))
    key = F.format_string("%04d-%02d/%d", "iso_year", "iso_week", "part")
    drafts = responses_by_key(post_requests(parts, rules), responses).withColumnRenamed("output", "draft")
    named = parts.select("iso_year", "iso_week", "part", stem.alias("stem"), key.alias("key"))
    told, digest = named.join(drafts, "key", "left").drop("key"), ["iso_year", "iso_week", "stem"]
    whole = told.groupBy(*digest).agg(F.max("part").alias("last_part"), F.every(F.col("draft").isNotNull()).alias("whole"))
    answered = told.join(whole.where("whole").drop("whole"), digest)
    posts = posts_of(answered, F.date_format(instant(now), "yyyy-MM-dd"), **layout)
    if output:
        write_digests(posts, output, prefix="blog")
    return posts
