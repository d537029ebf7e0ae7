"""Weekly digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, times
from newsloom.operators.skew import rank_all

#: Entries in one part of a digest. A digest up to this size is one text.
PART_ENTRIES = 5_000
WEEK = ("iso_year", "iso_week")


def entry_blocks(news: DataFrame) -> DataFrame:
    """One digest entry per news row, with its sort keys."""
    block = text.digest_block(
        F.col("title"), F.col("url"), F.col("published_date"), times.iso_text(F.col("collected_at")), F.col("summary")
    )
    return news.select(*WEEK, "collected_at", "ingest_seq", block.alias("block"))


def digest_parts(
    blocks: DataFrame, heads: DataFrame, by: Sequence[str] = WEEK, part_entries: int = PART_ENTRIES
) -> DataFrame:
    """Text of each digest in parts of at most ``part_entries`` entries: ``(*by, part, markdown)``.

    Parts joined by a line end, in order, are the whole digest. ``heads`` has one row per digest with its front
    matter; a digest without entries is that alone. A digest may hold any share of all news, so its entries are
    numbered without gathering them, and only the entries of one part meet in one row.
    """
    ranked = rank_all(blocks, by, ["collected_at", "ingest_seq"], "_rank")
    part = F.floor((F.col("_rank") - 1) / part_entries).cast("int").alias("part")
    pairs = F.array_sort(F.collect_list(F.struct("_rank", "block")))
    body = F.array_join(F.transform(pairs, lambda pair: pair.block), "\n").alias("_body")
    bodies = ranked.groupBy(*by, part).agg(body)
    first = heads.withColumn("part", F.lit(0))
    return bodies.join(first, [*by, "part"], "full").select(
        *by, "part", F.concat(F.coalesce("head", F.lit("")), F.coalesce("_body", F.lit(""))).alias("markdown")
    )


def digest_heads(weeks: DataFrame, run_date: Column, days: int | None = None, **layout) -> DataFrame:
    """Front matter for each ``(iso_year, iso_week)``."""
    title = text.digest_title(F.col("iso_year"), F.col("iso_week"), days)
    return weeks.select(*WEEK, text.front_matter(title, run_date, **layout).alias("head"))


def digest_lines(parts: DataFrame, by: Sequence[str] = WEEK) -> DataFrame:
    """Digest parts as rows for a text sink, which ends each row with a line end."""
    later = F.when(F.col("part") > 0, "\n").otherwise("")
    value = F.concat(later, F.regexp_replace("markdown", r"\n\z", ""))
    return parts.select(*by, "part", value.alias("value"))


def write_digests(parts: DataFrame, root: str, prefix: str = "news") -> None:
    """Write every digest as a text dataset ``{prefix}_{year}_{week}.md`` under ``root``.

    The files of one digest, in order, are its text; a digest of usual size is one file.
    """
    name = F.format_string(f"{prefix}_%04d_%02d.md", "iso_year", "iso_week")
    lines = digest_lines(parts).withColumn("file", name)
    lines.orderBy("file", "part").select("file", "value").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("file").text(root)


def tally(outcomes: DataFrame) -> DataFrame:
    """Inserted, duplicate and empty items of each source."""
    counts = [F.count_if(F.col("outcome") == name).alias(name) for name in ("inserted", "duplicate", "no_content")]
    return outcomes.groupBy("source_id").agg(*counts)
