"""Passages of benchmark items in documents, found with SimHash fingerprints, in DataFrame operations only.

Every run of five words that a document shares with an item says where the item's passage would begin in it: windows are as long as the items and
lie at such places, so they are aligned with what they may be copies of. Windows of the same words are one. A window's fingerprint has 128 bits, the
majority of the bits of its shingles' hashes, weighted by how often each occurs.

Fingerprints are compared by a multi-index: in eight blocks of 16 bits, two fingerprints that differ in no more than 31 bits differ in no more than
3 in some block. All 697 values near each block of the items are listed, and windows are looked up by the values of their blocks, so every pair within the radius is a
candidate. What is within the radius is then verified by the weighted Jaccard similarity of the shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.llm.common import key_of, staged

#: Words of a shingle.
SHINGLE = 5
#: The least similarity of a passage and an item.
SIMILARITY = 0.8
#: Bits in which fingerprints differ at most: blocks of 16 bits, and how many may differ in the nearest block.
BLOCKS, BLOCK_BITS, NEAR_BITS = 8, 16, 3
RADIUS = BLOCKS * (NEAR_BITS + 1) - 1
#: Shingles of items that are broadcast at a time (24 bytes each). Items beyond it are another block of queries.
BROADCAST_SHINGLES = 500_000


def words_of(text: Column) -> Column:
    """Hashes of the words, in lower case, without white space."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of five words, in order; none in a text of fewer words."""

    def runs(words: Column) -> Column:
        first = F.slice(words, F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(0)))
        return F.transform(first, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, SHINGLE))))

    return let(words, runs)


def fingerprint(shingles: Column) -> Column:
    """64 bits: those that more than half of the shingles' hashes have."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda n, s: n + F.call_function("getbit", s, b).cast("int"))
        return F.when(ones * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda bits, b: bits.bitwiseOR(bit(b)))


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """``rows`` (shingles) with two longs of a fingerprint."""
    second = F.transform("shingles", lambda s: F.xxhash64(F.lit("second"), s))
    return rows.withColumn("f0", fingerprint(F.col("shingles"))).withColumn("f1", let(second, fingerprint))


def blocks() -> Column:
    """The fingerprint's blocks: number and value."""
    return F.array(*(
        F.struct(F.lit(k).alias("block"), F.shiftright(f"f{k * BLOCK_BITS // 64}", k * BLOCK_BITS % 64).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).alias("value"))
        for k in range(BLOCKS)
    ))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id and shingles of the items that have five words; equal items stay apart, repeated rows do not."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), shingles_of(words_of(benchmark["text"].cast("string"))).alias("shingles"))
    return rows.where("size(shingles) > 0").distinct()


def windows_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows that share a shingle with an item at the item's place for it: key of the document (a, b), doc_id, start (in words), shingles."""
    seeds = items.select(F.size("shingles").alias("size"), F.posexplode("shingles").alias("offset", "s")).distinct()
    parts = -(-seeds.count() // BROADCAST_SHINGLES)
    text = docs["text"].cast("string")
    a, b = key_of(docs["doc_id"], text)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), a.alias("a"), b.alias("b"), shingles_of(words_of(text)).alias("all"))
    rows = rows.select("*", F.posexplode("all").alias("at", "s"))
    found = []
    for part in range(parts):
        own = seeds.where(F.pmod(F.xxhash64("s"), F.lit(parts)) == part)
        start = F.greatest(F.col("at") - F.col("offset"), F.lit(0))
        end = F.least(F.col("at") - F.col("offset") + F.col("size"), F.size("all"))
        joined = rows.join(F.broadcast(own), "s")
        found.append(joined.select("a", "b", "doc_id", start.alias("start"), F.slice("all", start + 1, end - start).alias("shingles")))
    if not found:
        return rows.select("a", "b", "doc_id", F.col("at").alias("start"), F.col("all").alias("shingles")).limit(0)
    return reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b", "start", "shingles"])


def similarity(x: Column, y: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, the weight of a shingle being how often it occurs."""

    def count(values: Column, v: Column) -> Column:
        return F.size(F.filter(values, lambda w: w == v))

    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, v: n + F.least(count(x, v), count(y, v)))
    return let(shared, lambda n: n / (F.size(x) + F.size(y) - n))


def candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """All pairs of a window and an item whose fingerprints differ in no more than ``RADIUS`` bits: (x, y) of the window, item_id."""
    masks = F.filter(F.sequence(F.lit(0), F.lit(2**BLOCK_BITS - 1)), lambda m: F.bit_count(m) <= NEAR_BITS)
    near = items.select("item_id", F.col("f0").alias("g0"), F.col("f1").alias("g1"), F.explode(blocks()).alias("k"))
    near = near.select("item_id", "g0", "g1", "k.block", F.explode(F.transform(masks, lambda m: m.cast("long").bitwiseXOR(F.col("k.value")))).alias("value"))
    probes = windows.select("x", "y", "f0", "f1", F.explode(blocks()).alias("k")).select("x", "y", "f0", "f1", "k.block", "k.value")
    differ = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
    # The listed values are many times the items, which Spark's estimate does not see: never broadcast them.
    return probes.join(near.hint("merge"), ["block", "value"]).where(differ <= RADIUS).select("x", "y", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that are copies of items of ``benchmark`` (item_id, text): key of the document (a, b), doc_id, item_id, similarity, start.

    One row for each document and item, with the best passage and where it starts, in words; of equally good ones the first. Words are compared in lower case. Items and documents of fewer than five
    words, null and empty texts have no passages. Rows with the same doc_id and text are one document. Either table may be empty.
    """
    items = with_fingerprint(items_of(benchmark))
    content = [F.xxhash64("shingles").alias("x"), F.xxhash64(F.lit("second"), "shingles").alias("y")]
    windows = staged(windows_of(docs, items.select("shingles")).select("*", *content), "passages")
    distinct = windows.groupBy("x", "y").agg(F.first("shingles").alias("shingles"))
    distinct = staged(with_fingerprint(distinct), "passage-fingerprints")
    pairs = candidates(distinct, items).join(distinct.select("x", "y", "shingles"), ["x", "y"])
    pairs = pairs.join(items.select("item_id", F.col("shingles").alias("own")), "item_id")
    links = pairs.select("x", "y", "item_id", similarity(F.col("shingles"), F.col("own")).alias("similarity")).where(F.col("similarity") >= least)
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("best")
    found = windows.select("a", "b", "doc_id", "start", "x", "y").join(links, ["x", "y"]).groupBy("a", "b", "doc_id", "item_id").agg(best)
    return found.select("a", "b", "doc_id", "item_id", "best.similarity", "best.start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without a passage of ``benchmark``, all columns as they are."""
    a, b = key_of(docs["doc_id"], docs["text"].cast("string"))
    found = leaks(docs, benchmark, least).select("a", "b").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), a.alias("a"), b.alias("b"))
    return packed.join(found, ["a", "b"], "left_anti").select("row.*")
