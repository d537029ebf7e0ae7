"""Ranked lexical search of items in documents, by pipelined term partitioning.

One scan of the documents makes posting lists: documents are taken in ranges of at most ``RANGE_DOCS`` neighbours, and a list has the places in a range that
hold a term of any item, with their counts. The sums that weights need (documents, terms, documents of each term) come from the same scan.

Terms belong to ``OWNERS`` owners, by falling weight: the first has the rarest, the last the most frequent ones. A bundle is a block of items over one
range with an accumulator for each document found so far. It passes from owner to owner; at each stage it meets that owner's posting lists of its range in a cogroup, which add
their integer contributions. Since the owners to come can add no more than the greatest contribution of each of their terms in the range, an
accumulator that cannot reach the 20th best of its own bundle any more is dropped: twenty documents of the range would still rank before it. So the long lists
of frequent words make few accumulators, and the result is the same as with all of them. After the last stage each bundle gives its best 20, and a
window with a group limit takes the best of those.

A group of a cogroup is one block of items over one range, whatever a term's frequency: a term that every document holds has one list for each range. Items are
taken in blocks whose terms number at most ``BLOCK_TERMS``, which is the only thing that is brought to the driver or given to every task (term, weight); documents are scanned once for
each such block.

Defined results: a null text has no terms, such a document or item is in no row, and neither is an item whose terms no document holds. Rows of documents that come several times
are documents of their own, each with a rank; equal scores rank by doc_id, null last, and then by place. Rows of items with the same item_id are one item with the terms of all. Empty
tables give no row. Columns besides the named ones are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import staged, text_or_empty, text_steps

#: Documents of a range at most.
RANGE_DOCS = 8_192
#: Characters of a range from which on it takes no further document.
RANGE_CHARACTERS = 32_000_000
#: Stages.
OWNERS = 4
#: Terms of the items that are searched for in one scan.
BLOCK_TERMS = 200_000
#: Items of a bundle.
BUNDLE_ITEMS = 256
#: Documents of each item that are returned.
TOP = 20

#: A-Z lower-cased, every other ASCII character that is no letter or digit a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

POSTINGS = "range long, term int, docs array<int>, tfs array<int>, best array<long>, ids array<long>"
BUNDLE = "range long, bundle int, item int, docs array<int>, scores array<long>"
#: Stands for the range itself among its terms, and among the items of a bundle.
RANGE = -1


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(FOLD).split()


class Range:
    """Documents that are taken together, and the posting lists that they give."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes, number: dict[bytes, int]) -> None:
        words = terms_of(text)
        found = Counter(filter(None, map(number.get, words)))
        self.found.append((np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.int32, len(found))))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.size += len(text)

    def full(self) -> bool:
        return len(self.ids) >= RANGE_DOCS or self.size >= RANGE_CHARACTERS

    def rows(self, name: int) -> pa.RecordBatch:
        """A row for each term, and one for the range: the lengths of its documents, and by term the greatest count and the least length."""
        terms, counts = (np.concatenate(x) for x in zip(*self.found))
        places = np.repeat(np.arange(len(self.found), dtype=np.int32), [len(x) for x, _ in self.found])
        order = np.argsort(terms, kind="stable")
        terms, counts, places = terms[order], counts[order], places[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
        lengths = np.array(self.lengths, np.int32)
        best = np.zeros(0, np.int64)
        if len(starts):
            best = np.stack([terms[starts], np.maximum.reduceat(counts, starts), np.minimum.reduceat(lengths[places], starts)], axis=1).ravel().astype(np.int64)
        lists = len(starts)
        values = {
            "range": [name] * (lists + 1), "term": [*terms[starts].tolist(), RANGE],
            "docs": [*np.split(places, starts)[1:], []], "tfs": [*np.split(counts, starts)[1:], lengths],
            "best": [None] * lists + [best], "ids": [None] * lists + [self.ids],
        }
        return pa.RecordBatch.from_pydict(values, pa.schema(_ARROW))


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_ARROW = [("range", pa.int64()), ("term", pa.int32()), ("docs", _INTS), ("tfs", _INTS), ("best", _LONGS), ("ids", _LONGS)]
_BUNDLE = [("range", pa.int64()), ("bundle", pa.int32()), ("item", pa.int32()), ("docs", _INTS), ("scores", _LONGS)]


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Posting lists of the terms of ``vocabulary``, by range. Ranges are named by partition and order in it."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, name, current = known.value, TaskContext.get().partitionId() << 32, Range()
        for batch in batches:
            for part in text_steps(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary())):
                    current.add(doc_id, text.as_py(), number)
                    if current.full():
                        yield current.rows(name)
                        name, current = name + 1, Range()
        if current.ids:
            yield current.rows(name)

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return texts.mapInArrow(task, POSTINGS)


@dataclass(frozen=True)
class Totals:
    """Documents with a term, and terms of all documents."""

    documents: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def factors(self, tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds to documents."""
        if 25 * int(lengths.max(initial=0)) * self.documents < 2**63:
            share = 25 * lengths * self.documents // self.terms
        else:
            share = np.array([25 * n * self.documents // self.terms for n in lengths.tolist()], np.int64)
        return 1_000_000_000 * tfs // (1000 * tfs + 12 * (100 - 25 + share))


#: A term of an item: its number, its weight times how often the item has it, its owner.
Wanted = tuple[int, int, int]


def _owner(owner: int, bundles: list[dict[int, list[Wanted]]], totals: Totals, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What one owner does with a bundle: its lists add to the accumulators of each item."""

    def add(bundle: pa.Table, lists: pa.Table) -> pa.Table:
        states = zip(bundle.column("item").to_pylist(), bundle.column("docs"), bundle.column("scores"))
        rows = {item: (docs.values.to_numpy().astype(np.int64), scores.values.to_numpy()) for item, docs, scores in states}
        name, number = bundle.column("range")[0], bundle.column("bundle")[0]
        lengths, bounds = rows[RANGE]
        found = {}
        for term, docs, tfs in zip(lists.column("term").to_pylist(), lists.column("docs"), lists.column("tfs")):
            places = docs.values.to_numpy()
            found[term] = places, totals.factors(tfs.values.to_numpy().astype(np.int64), lengths[places])
        triples = bounds.reshape(-1, 3)
        most = dict(zip(triples[:, 0].tolist(), totals.factors(triples[:, 1], triples[:, 2]).tolist()))
        items, out_docs, out_scores = [RANGE], [lengths], [bounds]
        total = np.zeros(len(lengths), np.int64)
        for item, wanted in bundles[number.as_py()].items():
            total[:] = 0
            if item in rows:
                total[rows[item][0]] = rows[item][1]
            for term, weight, by in wanted:
                if by == owner and term in found:
                    places, factors = found[term]
                    total[places] += weight * factors
            places = np.flatnonzero(total)
            scores = total[places]
            if len(places) > top:
                to_come = sum(weight * most.get(term, 0) for term, weight, by in wanted if by > owner)
                kept = scores + to_come >= np.partition(scores, len(scores) - top)[len(scores) - top]
                places, scores = places[kept], scores[kept]
            if len(places):
                items.append(item)
                out_docs.append(places)
                out_scores.append(scores)
        columns = [pa.array([name.as_py()] * len(items)), pa.array([number.as_py()] * len(items)), pa.array(items), pa.array(out_docs, _INTS), pa.array(out_scores, _LONGS)]
        return pa.table([column.cast(kind) for column, (_, kind) in zip(columns, _BUNDLE)], pa.schema(_BUNDLE))

    return add


def _selection(top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best documents of a range for each item, by id."""

    def select(bundles: pa.Table, ids: pa.Table) -> pa.Table:
        rows = []
        named = ids.column("ids")[0].as_py() if bundles.num_rows else []
        for item, docs, scores in zip(*(bundles.column(x).to_pylist() for x in ("item", "docs", "scores"))):
            order = sorted((-score, named[place] is None, named[place] or 0, place) for score, place in zip(scores, docs))
            rows += [(item, named[place], -score, place) for score, _, _, place in order[:top]]
        kinds = [("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("place", pa.int32())]
        columns = list(zip(*rows)) or [[]] * 4
        arrays = [pa.array(column, kind) for column, (_, kind) in zip(columns, kinds)]
        name = ids.column("range")[0].as_py() if ids.num_rows else None
        return pa.table([*arrays, pa.array([name] * len(rows), pa.int64())], pa.schema([*kinds, ("range", pa.int64())]))

    return select


def _terms_of_items(items: DataFrame) -> DataFrame:
    """(item_id, term, n): how often an item has a term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary())):
                found = Counter(terms_of(text.as_py()))
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(found), pa.int64()), "term": pa.array(found, pa.binary()), "n": pa.array(found.values(), pa.int64())})

    texts = items.select(items["item_id"].cast("long").alias("item_id"), text_or_empty(items).alias("text"))
    return texts.mapInArrow(task, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def _search_block(docs: DataFrame, rows: list, top: int, owners: int) -> DataFrame | None:
    """The best documents of a block of items, of which ``rows`` are the terms."""
    spark = docs.sparkSession
    numbers = {term: i for i, term in enumerate(dict.fromkeys(bytes(row.term) for row in rows), 1)}
    lists = staged(postings(docs, numbers), "postings")
    ranges, by_term = lists.where(F.col("term") == RANGE), lists.where(F.col("term") != RANGE)
    sums = ranges.select(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, n: a + n).alias("terms"), F.size(F.filter("tfs", lambda n: n > 0)).alias("docs"))
    found = sums.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    if not found.terms:
        return None
    totals = Totals(found.docs, found.terms)
    frequent = {row.term: row.df for row in by_term.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}
    # Owners hold about as many postings each, the first the rarest terms.
    by_owner, passed, share = {}, 0, max(1, sum(frequent.values()) / owners)
    for term, df in sorted(frequent.items(), key=lambda x: (x[1], x[0])):
        by_owner[term] = min(owners - 1, int(passed / share))
        passed += df
    item_ids = sorted({row.item_id for row in rows}, key=lambda x: (x is None, x or 0))
    place = {item_id: i for i, item_id in enumerate(item_ids)}
    bundles: list[dict[int, list[Wanted]]] = [{} for _ in range(-(-len(item_ids) // BUNDLE_ITEMS))]
    dealt = set()
    for row in rows:
        term, item = numbers[bytes(row.term)], place[row.item_id]
        weight = totals.weight(frequent[term]) if term in frequent else 0
        if weight:
            bundles[item // BUNDLE_ITEMS].setdefault(item, []).append((term, weight * row.n, by_owner[term]))
            dealt.add((term, by_owner[term], item // BUNDLE_ITEMS))
    if not dealt:
        return None
    owned = by_term.select(F.col("range").alias("range"), "term", "docs", "tfs").join(spark.createDataFrame(sorted(dealt), "term int, owner int, bundle int"), "term")
    state = ranges.select("range", F.explode(F.sequence(F.lit(0), F.lit(len(bundles) - 1))).alias("bundle"), F.lit(RANGE).alias("item"), F.col("tfs").alias("docs"), F.col("best").alias("scores"))
    keys = ("range", "bundle")
    for owner in range(owners):
        right = owned.where(F.col("owner") == owner).select(*keys, "term", "docs", "tfs")
        state = state.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_owner(owner, bundles, totals, top), BUNDLE)
    scored = state.where(F.col("item") != RANGE).select("range", "item", "docs", "scores")
    best = scored.groupBy("range").cogroup(ranges.select(F.col("range").alias("range"), "ids").groupBy("range")).applyInArrow(_selection(top), "item int, doc_id long, score long, place int, range long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "range", "place")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(item_ids)), "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS) -> DataFrame:
    """The best documents (doc_id, text) of every item (item_id, text): item_id, rank, doc_id, score."""
    terms = staged(_terms_of_items(items), "item-terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    found = (_search_block(docs, terms.where(block == i).orderBy("item_id", "term").collect(), top, owners) for i in range(blocks))
    return reduce(DataFrame.unionAll, filter(None, found), docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long"))
