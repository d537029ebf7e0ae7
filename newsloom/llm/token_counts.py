"""Token counts without token ids: each distinct pre-token is counted once, and the counts are joined to the documents.

Pre-tokens are the units of ``units.py``. The most frequent ones, a bounded number, are counted first and broadcast; every document
sums them where it is read. Its other pre-tokens become rows (row, pre-token, frequency), which meet by pre-token: there each
distinct one is counted once, and the products are summed by document. No pre-token left for that shuffle is frequent, so no
task gets a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import frequent_terms, text_or_empty, text_steps
from newsloom.llm.units import LibraryCoder, cut, spaced_units, totals

#: Pre-tokens whose counts are broadcast at most.
FREQUENT = 400_000


def count_tokens(docs: DataFrame, tokenizer: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of ``docs`` (doc_id, text), other columns being ignored.

    The counts are those of the tokenizers library for the file ``tokenizer``, without added special tokens; the special token's own text counts as
    that token, which is the library's default. A null text counts as an empty one: no bytes, no tokens. Every row gives one row,
    repeated rows and rows with a null doc_id too. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = f.read()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    table = frequent_terms(rows.select("text"), spaced_units, frequent)
    library = spark.sparkContext.broadcast(file)

    terms = spark.createDataFrame(table.select(["term"])) if table.num_rows else None
    counts: dict[str, int] = {}
    if terms is not None:
        counted = terms.repartition(spark.sparkContext.defaultParallelism, "term").mapInArrow(pieces(library), "term string, pieces int").toArrow()
        counts = dict(zip(counted["term"].to_pylist(), counted["pieces"].to_pylist(), strict=True))
    known = spark.sparkContext.broadcast(counts)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, near = LibraryCoder(library.value), known.value
        row = TaskContext.get().partitionId() << 40

        def frame(*columns: object) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, kind) if not isinstance(c, pa.Array) else c for c, kind in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["row", "term", "n", "doc_id", "n_bytes"])

        for batch in batches:
            for part in text_steps(batch):
                numbers, sizes, spaced, lone = cut(part.column("text"))
                # Pieces of each distinct pre-token, -1 where it has to meet the others like it.
                each = np.array([near.get(unit, -1) for unit in spaced.to_pylist()], np.int64)
                each = np.append(each, coder(spaced[:0], lone)[1])
                rows = row + np.arange(len(sizes), dtype=np.int64)
                row += len(sizes)
                pieces_of = each[numbers]
                some = totals(np.maximum(pieces_of, 0), sizes)
                nothing = [None] * len(sizes)
                yield frame(rows, nothing, some, part.column("doc_id"), pc.binary_length(part.column("text")).cast(pa.int64()))
                far = pieces_of < 0
                pairs, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[far] << 32 | numbers[far], return_counts=True)
                terms = spaced.take(pa.array(pairs & 0xFFFFFFFF))
                nothing = [None] * len(pairs)
                yield frame(rows[pairs >> 32], terms, n.astype(np.int64), nothing, nothing)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last, last_pieces = LibraryCoder(library.value), None, 0
        for batch in batches:
            given = batch.column("term").to_pylist()
            new = [t for t in dict.fromkeys(given) if t is not None and t != last]
            lengths = dict(zip(new, coder(pa.array(new, pa.string()))[1].tolist(), strict=True))
            if last is not None:
                lengths[last] = last_pieces
            lengths[None] = 1
            each = np.array([lengths[t] for t in given], np.int64)
            if given and given[-1] is not None:
                last, last_pieces = given[-1], lengths[given[-1]]
            n = pa.array(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64) * each)
            yield pa.RecordBatch.from_arrays([batch.column("row"), n, batch.column("doc_id"), batch.column("n_bytes")], names=["row", "n", "doc_id", "n_bytes"])

    split_rows = rows.mapInArrow(split, "row long, term string, n long, doc_id long, n_bytes long")
    # Rows of documents have no term; their own number deals them out.
    met = split_rows.repartition(F.coalesce("term", F.col("row").cast("string"))).sortWithinPartitions("term")
    counted = met.mapInArrow(meet, "row long, n long, doc_id long, n_bytes long")
    summed = counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return summed.drop("row")


def pieces(library):
    """A function that counts the pieces of each distinct pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = LibraryCoder(library.value)
        for batch in batches:
            lengths = coder(batch.column("term"))[1]
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(lengths.astype(np.int32))], names=["term", "pieces"])

    return count
