"""Text clean-up and Markdown rendering as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let

# The characters that count as whitespace when titles, dates and bodies are collapsed or stripped.
WHITESPACE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# The line ends, beside \n, that separate lines of a Markdown draft.
OTHER_LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"

# Wording and layout of a digest and a post.
UNKNOWN = "unknown"
DEFAULT_TITLE = "Weekly AI News"
DEFAULT_TAGS = ("AI",)
DEFAULT_LAYOUT = "layouts/post.njk"


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+", "")


def or_default(text: Column, default: str = UNKNOWN) -> Column:
    """``default`` where the text is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def is_filled(text: Column) -> Column:
    """Neither null nor empty; never null itself."""
    return F.coalesce(text, F.lit("")) != ""


def week_label(year: Column, week: Column) -> Column:
    return F.format_string("%04d-%02d", year, week)


def file_stem(path: Column) -> Column:
    """Last part of a path without its extension."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def lines_of(text: Column) -> Column:
    """Lines of a text; a final line end starts no further line."""
    unified = F.regexp_replace(text, OTHER_LINE_ENDS, "\n")
    return F.when(unified == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(unified, r"\n\z", ""), "\n")
    )


def digest_block(title: Column, url: Column, published: Column, collected: Column, summary: Column) -> Column:
    """One digest entry. Ends in a line end, so that entries joined by a line end are set apart by a blank line."""
    return F.concat(
        F.lit("#### "), title,
        F.lit("\n- URL: "), url,
        F.lit("\n- Published: "), or_default(published),
        F.lit("\n- Collected: "), collected,
        F.lit("\n- Summary:\n  "), F.coalesce(summary, F.lit("")),
        F.lit("\n"),
    )


def front_matter(
    title: Column, run_date: Column, tags: Sequence[str] = DEFAULT_TAGS, layout: str = DEFAULT_LAYOUT
) -> Column:
    tag_lines = "".join(f"\n  - {tag}" for tag in tags)
    return F.concat(
        F.lit("---\ntitle: "), title,
        F.lit("\ndescription:\ndate: "), run_date,
        F.lit("\nscheduled: "), run_date,
        F.lit(f"\ntags:{tag_lines}\nlayout: {layout}\n---\n"),
    )


def digest_title(year: Column, week: Column, days: int | None = None) -> Column:
    if days is not None:
        return F.lit(f"News Summary (last {days} days)")
    return F.concat(F.lit("News Summary ("), week_label(year, week), F.lit(")"))


# Draft clean-up: what a model returned becomes the body of a post.


def _from_line(lines: Column, number: Column) -> Column:
    """Text from a line (counted from 1) on, without leading blanks."""
    return lstrip(F.array_join(F.slice(lines, number.cast("int"), F.greatest(F.size(lines), F.lit(1))), "\n"))


def drop_front_matter(draft: Column) -> Column:
    """Remove a leading front matter section, if it is closed by a line that holds nothing but ``---``."""

    def without(lines: Column) -> Column:
        closing = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), strip), "---")
        opened = F.get(lines, F.lit(0)).startswith("---")
        return let(closing, lambda at: F.when(opened & (at > 0), _from_line(lines, at + 2)).otherwise(draft))

    return let(lines_of(lstrip(draft)), without)


def heading_title(body: Column, default: str = DEFAULT_TITLE) -> Column:
    """Text of the level-one heading that opens the body, else ``default``."""

    def title(opening: Column) -> Column:
        heading = or_default(strip(F.substring(opening, 3, 2**31 - 1)), default)
        return F.when(opening.startswith("# "), heading).otherwise(F.lit(default))

    return let(F.get(F.filter(lines_of(body), lambda line: strip(line) != ""), F.lit(0)), title)


def drop_heading(body: Column) -> Column:
    """Remove a level-one heading from the very first line, with one blank line after it."""

    def without(lines: Column) -> Column:
        start = F.when(strip(F.get(lines, F.lit(1))) == "", F.lit(3)).otherwise(F.lit(2))
        return F.when(F.get(lines, F.lit(0)).startswith("# "), _from_line(lines, start)).otherwise(body)

    return let(lines_of(body), without)


def back_link(year: Column, week: Column, stem: Column) -> Column:
    return F.concat(
        F.lit("\n\n---\n\n- [AI news summary — "), week_label(year, week), F.lit("](../weekly_news/"), stem, F.lit(")\n")
    )
