"""Repeated runs of lines: prefix doubling over the sequences of line ids, in DataFrame operations only.

All documents' lines, in order of document and line, are one long sequence of ids in which no run crosses a document's end. Prefix doubling names the
run of 2^k lines at each place from the names of its two halves; the places with one name are an interval of the suffix array whose longest
common prefix has at least 2^k lines. An interval is named by its earliest place, so a name also says whether a run has an
earlier copy. Only places in an interval with another place go on, so each level is no larger than the one before.

A run is worth deleting when it has ``min_words`` words. At each place the shortest such run is fixed by the lines themselves; two overlapping
runs of 2^k lines, whose names are known, give its interval. What follows such a run is compared line by line, as far as it is too short to be
a run of its own. So all maximal repeated runs are found whole, and the number of levels depends on ``min_words``, not on the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.llm.common import key_of, staged

#: Words that a repeated run has at least.
MIN_WORDS = 50
#: What separates words, as a class of characters.
BLANK = "\\x20\\x09-\\x0D"


def lines_of(docs: DataFrame) -> DataFrame:
    """The lines with a word: key of the document (a, b), doc_id, number of the line, place among the lines with a word (at), id (x, y), words."""
    text = docs["text"].cast("string")
    a, b = key_of(docs["doc_id"], text)
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("line"), F.regexp_replace(line, f"^[{BLANK}]+|[{BLANK}]+$", "").alias("text")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), a.alias("a"), b.alias("b"), F.filter(lines, lambda x: x["text"] != "").alias("lines"))
    rows = rows.select("doc_id", "a", "b", F.posexplode("lines").alias("at", "l"))
    line = F.col("l.text")
    return rows.select(
        "doc_id", "a", "b", "at", F.col("l.line").alias("line"),
        F.xxhash64(line).alias("x"), F.xxhash64(F.lit("second"), line).alias("y"), F.size(F.split(line, f"[{BLANK}]+")).alias("words"),
    )


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose ``by`` others have too. The counts are made in parts before the shuffle."""
    return rows.join(rows.groupBy(*by).count().where("count > 1").select(*by), by)


def run_starts(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines that occur more than once, with the lines from there on that do too.

    ``ahead`` holds lines from this one on, without a gap; ``need`` says how many of them have ``min_words`` words, and is null where
    too few follow. After these, ``ahead`` goes on as long as the lines after the first have fewer words than that.
    """
    rows = repeated(staged(lines_of(docs), "lines"), ["x", "y"]).repartition("a", "b").dropDuplicates(["a", "b", "at"])
    rows = rows.withColumn("segment", F.col("at") - F.row_number().over(Window.partitionBy("a", "b").orderBy("at")))
    segment = Window.partitionBy("a", "b", "segment").orderBy("at")
    rows = rows.withColumn("total", F.sum("words").over(segment))
    ahead = F.collect_list(F.struct("line", "x", "y", "total")).over(segment.rowsBetween(0, min_words - 1))
    rows = rows.withColumn("ahead", ahead)
    fewer = F.size(F.filter("ahead", lambda v: v["total"] < F.col("total") - F.col("words") + min_words))
    rows = rows.withColumn("need", F.when(fewer < F.size("ahead"), fewer + 1))
    tail = F.size(F.filter("ahead", lambda v: v["total"] < F.col("total") + min_words))
    ahead = F.when(F.col("need").isNotNull(), F.slice("ahead", F.lit(1), F.greatest("need", tail)))
    return rows.select("doc_id", "a", "b", "at", "x", "y", "need", ahead.alias("ahead"))


def doubled(names: DataFrame, width: int) -> DataFrame:
    """Names of runs of twice ``width`` lines from the names of their halves, where several places have them."""
    later = Window.partitionBy("a", "b").orderBy("at").rangeBetween(width, width)
    pairs = names.withColumn("half", F.first(F.struct("x", "y")).over(later)).where("half is not null")
    both = ["x", "y", "half.x", "half.y"]
    pairs = pairs.select("a", "b", "at", "need", F.xxhash64(*both).alias("x"), F.xxhash64(F.lit("second"), *both).alias("y"))
    return repeated(pairs, ["x", "y"])


def classes(starts: DataFrame) -> DataFrame:
    """The places from which a run of ``need`` lines has a copy elsewhere, each with the run's name (x, y)."""
    names = starts.select("a", "b", "at", "need", "x", "y")
    top, width, found = starts.agg(F.max("need")).first()[0] or 0, 1, []
    while width <= top:
        own = names.where(F.col("need").between(width, 2 * width - 1)).withColumn("other", F.col("at") + F.col("need") - width)
        ends = names.select("a", "b", F.col("at").alias("other"), F.col("x").alias("end_x"), F.col("y").alias("end_y"))
        both = ["need", "x", "y", "end_x", "end_y"]
        own = own.join(ends, ["a", "b", "other"])
        found.append(own.select("a", "b", "at", F.xxhash64(*both).alias("x"), F.xxhash64(F.lit("second"), *both).alias("y")))
        if 2 * width <= top:
            names = staged(doubled(names, width), "line-runs")
        width *= 2
    if not found:
        return names.select("a", "b", "at", "x", "y").limit(0)
    return repeated(reduce(DataFrame.unionByName, found), ["x", "y"])


def later_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, a, b, at, x, y) that are not the earliest of their name (x, y)."""
    here = F.struct("doc_id", "a", "b", "at")
    first = rows.groupBy("x", "y").agg(F.min(here).alias("first"))
    return rows.join(first, ["x", "y"]).where(here > F.col("first")).drop("first")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines of ``docs`` (doc_id, text) that are in a repeated run and not in its first copy: key of the document (a, b), ``removed`` numbers.

    A run is of consecutive lines with a word, compared without white space around them; it has ``min_words`` words or more in all and
    equals a run that begins earlier, in the same document or another. Documents are in order of doc_id, nulls first, then of their key.
    """
    starts = staged(run_starts(docs, min_words), "line-starts")
    members = staged(classes(starts).join(starts.select("doc_id", "a", "b", "at", "need", "ahead"), ["a", "b", "at"]), "line-classes")
    # How much longer the common prefix with an earlier place is: one name for each length of what follows.
    sizes = members.withColumn("more", F.explode(F.expr("sequence(1, size(ahead) - need)"))).where("size(ahead) > need")
    parts = F.slice("ahead", F.col("need") + 1, F.col("more"))
    both = ["x", "y", "more", "next.x", "next.y"]
    longer = sizes.withColumn("next", parts).select(
        "doc_id", "a", "b", "at", "more", F.xxhash64(*both).alias("x"), F.xxhash64(F.lit("second"), *both).alias("y")
    )
    longest = later_copies(repeated(longer, ["x", "y"])).groupBy("a", "b", "at").agg(F.max("more").alias("more"))
    copies = later_copies(members).join(longest, ["a", "b", "at"], "left")
    gone = F.slice("ahead", F.lit(1), F.col("need") + F.coalesce("more", F.lit(0)))
    lines = copies.select("a", "b", F.explode(gone["line"]).alias("line"))
    return lines.groupBy("a", "b").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text``, and ``n_lines`` and ``n_removed`` of each document.

    All other columns stay as they are; columns of ``docs`` named like the two new ones are replaced. A null text stays null and has no lines. A text without
    repeated runs stays as it is, to the character. Rows with the same doc_id and text are one document and get the same result. An empty table gives none.
    """
    removed = repeated_lines(docs, min_words)
    a, b = key_of(docs["doc_id"], docs["text"].cast("string"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    packed = docs.select(F.struct(*kept).alias("row"), a.alias("a"), b.alias("b"))
    joined = packed.join(removed, ["a", "b"], "left")
    lines = F.split(F.col("row.text").cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    rest = let(lines, lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(rest)
    out = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept]
    n_lines = F.coalesce(F.when(F.col("row.text").isNotNull(), F.size(lines)), F.lit(0))
    return joined.select(*out, n_lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))
