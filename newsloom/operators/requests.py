"""Requests to a model as tables, and merging of its responses. Calling the model is not part of a job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import strip
from newsloom.operators.filters import awaits_summary

#: Characters of a payload that an inspection request shows, unless told otherwise.
HEAD_CHARACTERS = 20_000

SUMMARY_INSTRUCTIONS = (
    "Write a summary of this news article in Chinese: two to five sentences, neutral, only facts that the text states."
)
POST_INSTRUCTIONS = (
    "From this news digest write a weekly post as Markdown, in clear and professional Chinese: a bulleted section of"
    " highlights, then a section that comments briefly on each item."
)
INSPECTION_INSTRUCTIONS = (
    "Decide whether this source is of type rss, html, js or api, and answer with one registry entry only:"
    " name, url, type and howto, the howto holding the section of that type alone."
    " rss: item_limit, date_field. html: list_selector, title_selector, date_selector, content_selector."
    " js: the same, with wait_for, wait_ms, strategy and notes."
    " api: items_path, url_field, title_field, date_field, content_field."
)


def _request(kind: str, key: Column, instructions: Column, text: Column) -> list[Column]:
    return [
        F.sha2(F.concat_ws("|", F.lit(kind), key), 256).alias("request_id"),
        F.lit(kind).alias("kind"),
        key.alias("key"),
        instructions.alias("instructions"),
        text.alias("input"),
    ]


def summary_requests(news: DataFrame, instructions: str = SUMMARY_INSTRUCTIONS) -> DataFrame:
    """One request for each news row that lacks a summary and has content."""
    pending = news.where(awaits_summary(F.col("summary"), F.col("content")))
    return pending.select(*_request("summarize", F.col("url"), F.lit(instructions), F.col("content")))


def outlines(parts: DataFrame) -> DataFrame:
    """For digests of several parts: (iso_year, iso_week, sections, outline), the titles that each part begins and ends with, a line for each part."""
    titles = F.regexp_extract_all("markdown", F.lit("(?:^|\n)#### ([^\n]*)"), F.lit(1))
    ends = parts.select("iso_year", "iso_week", "part", F.get(titles, F.lit(0)).alias("first"), F.try_element_at(titles, F.lit(-1)).alias("last"))
    line = F.concat((F.col("part") + 1).cast("string"), F.lit(". "), F.coalesce("first", F.lit("")), F.lit(" … "), F.coalesce("last", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("part", line.alias("line"))))
    outline = F.array_join(F.transform(lines, lambda pair: pair["line"]), "\n")
    return ends.groupBy("iso_year", "iso_week").agg(F.count("*").alias("sections"), outline.alias("outline")).where("sections > 1")


def section_instructions(told: Column, part: Column, sections: Column, outline: Column) -> Column:
    """What a model is told of a digest in several sections: which one it writes, and what the others are about."""
    opening = F.when(part == 0, "Begin the post with its title.").otherwise("Write no title: the post has begun.")
    closing = F.when(part == sections - 1, "End the post.").otherwise("Do not close the post: it goes on.")
    return F.concat(
        told, F.lit("\n\nThe digest comes in "), sections.cast("string"), F.lit(" sections. This is section "), (part + 1).cast("string"),
        F.lit(". Write this section of the post only. "), opening, F.lit(" "), closing, F.lit(" The sections begin and end with:\n"), outline,
    )


def post_requests(parts: DataFrame, rules: str | None = None, instructions: str = POST_INSTRUCTIONS) -> DataFrame:
    """One request for each digest part, with formatting rules if there are any.

    A digest of usual size is one part and its answer the post. Answers for a larger one are the sections of its post, in order: each request names
    its section and shows the outline of all, so that the first answer opens the post, the last one closes it and none repeats another.
    """
    told = F.lit(f"{instructions}\n\nKeep to this layout:\n{rules}" if rules else instructions)
    key = F.format_string("%04d-%02d/%d", "iso_year", "iso_week", "part")
    known = parts.join(outlines(parts), ["iso_year", "iso_week"], "left")
    of_section = section_instructions(told, F.col("part"), F.col("sections"), F.col("outline"))
    return known.select(*_request("post", key, F.when(F.col("sections").isNull(), told).otherwise(of_section), F.col("markdown")))


def inspection_requests(
    captures: DataFrame, instructions: str = INSPECTION_INSTRUCTIONS, head: int | None = HEAD_CHARACTERS
) -> DataFrame:
    """One request for each captured unknown source, showing the head of what was captured, or all of it without a ``head``."""
    shown = F.concat(F.lit("Captured from "), F.col("url"), F.lit(":\n\n"), content_head(F.col("body"), head))
    return captures.select(*_request("inspect", F.col("url"), F.lit(instructions), shown))


def content_head(body: Column, head: int | None = HEAD_CHARACTERS) -> Column:
    return F.coalesce(body if head is None else F.substring(body, 1, head), F.lit(""))


def responses_by_key(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Stripped outputs by request key (key, output). Failed requests give no row and stay pending."""
    answered = responses.where(F.col("error").isNull()).groupBy("request_id").agg(F.max("output").alias("output"))
    output = strip(F.coalesce("output", F.lit(""))).alias("output")
    return requests.select("request_id", "key").join(answered, "request_id").select("key", output)


def first_sentences(text: Column, count: int = 3) -> Column:
    """The opening sentences of a text: a summary without a model."""
    # Sentence marks of Western and Chinese text.
    return strip(F.regexp_extract(text, rf"(?s)^((?:[^.!?。！？]*[.!?。！？]+){{1,{count}}}|.*)", 1))


def summarize(news: DataFrame, summarizer: Callable[[Column], Column] = first_sentences) -> DataFrame:
    """Fill missing summaries with any expression over the content: a built-in one, or a pandas or Arrow UDF."""
    pending = awaits_summary(F.col("summary"), F.col("content"))
    made = F.coalesce(strip(summarizer(F.when(pending, F.col("content")))), F.lit(""))
    return news.withColumn("summary", F.when(pending, made).otherwise(F.col("summary")))
