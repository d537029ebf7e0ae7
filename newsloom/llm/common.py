"""What several operators of this subpackage share: keys of rows, batches of texts, tallies of frequent terms."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import scratch_path

#: Characters of text that a task codes at a time. A longer text is a step of its own.
STEP_CHARACTERS = 4_000_000
#: Characters of text in one tally of terms.
TALLY_CHARACTERS = 16_000_000
#: Terms that one tally hands on at most, most frequent first.
TALLY_KEPT = 65_536


def text_or_empty(docs: DataFrame) -> Column:
    """The text, a null being an empty one."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def key_of(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that name a document. Rows with the same doc_id and text are the same document."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit("second"), doc_id, text)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there: lineage ends, columns can be pruned."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(sizes: Iterable[int], most: int = STEP_CHARACTERS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that hold about ``most`` characters in all."""
    start = at = total = 0
    for at, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, at
            start, total = at, 0
    if at > start:
        yield start, at


def text_steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_CHARACTERS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text each."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for start, end in steps((size or 0 for size in sizes), most):
        yield batch.slice(start, end - start)


def frequent_terms(texts: DataFrame, terms: Callable[[pa.Array], pa.Array], limit: int) -> pa.Table:
    """At most ``limit`` of the most frequent terms of all rows of the one column ``texts``: (term, n).

    ``terms`` gives the terms of an array of texts. Every task tallies its whole texts and hands on its frequent terms, so that neither a tally nor
    what is shuffled grows with the number of rare terms. The counts of terms that are frequent nowhere are not complete: the result
    serves to choose what is worth keeping at hand, never as a statistic. It is the only thing brought to the driver;
    the least count is chosen so that no more than ``limit`` rows reach it.
    """
    column = texts.columns[0]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, column, TALLY_CHARACTERS):
                counts = pc.value_counts(terms(part.column(column)))
                counts = counts.filter(pc.greater(counts.field("counts"), 1))
                order = pc.select_k_unstable(counts.field("counts"), TALLY_KEPT, sort_keys=[("", "descending")])
                kept = counts.take(order)
                term = kept.field("values")
                yield pa.RecordBatch.from_arrays([term.cast(pa.string()), kept.field("counts")], names=["term", "n"])

    counted = texts.mapInArrow(tally, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return most_frequent(staged(counted, "frequent-terms"), limit)


def most_frequent(counted: DataFrame, limit: int) -> pa.Table:
    """At most ``limit`` rows of ``counted`` (…, n) with the greatest n: all from some n on."""
    grade = F.floor(F.log2("n") * 8).cast("int")
    least, total = math.inf, 0
    for row in sorted(counted.groupBy(grade.alias("grade")).count().collect(), key=lambda row: -row["grade"]):
        total += row["count"]
        if total > limit:
            break
        least = row["grade"]
    return counted.where(grade >= (2**30 if least == math.inf else least)).toArrow()
