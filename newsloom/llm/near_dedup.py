"""Near-duplicate documents: ProbMinHash signatures of weighted shingles, banding, verification and connected components.

A document's shingles are its runs of five words in lower case, weighted by how often they occur. Each shingle sends arrivals of a Poisson process whose rate
is its weight; every arrival goes to a random register, and a register keeps the shingle of its first arrival. Two documents agree in a register with the
probability Jaccard similarity of their weights. Arrivals after the time at which all registers are filled change nothing: only those before a time at which that is
very likely are made, and later ones for the few documents that need them.

Documents with the same words are one node. Nodes that agree in a band of registers share a bucket. In each bucket, all members are verified
against one of them, the one that most others are like. Verified links make components. Members of one bucket that are still in different components
are verified against further hubs, and at last against each other, so that no link within a bucket is lost and a group of copies costs in proportion to its size.
Pairs are left out that cannot be links: those too far apart by the triangle inequality from their distances to the first hub, and those whose sketches
agree in too few registers, and in large buckets those with too many shingles of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import key_of, staged, text_steps

#: Words of a shingle, and the least similarity of near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands, registers of a band, and registers of a signature. A register is in one band, so bands are independent: pairs with a similarity of 0.8 share none in two of
#: 10,000 cases, (1 - 0.8^6)^28; those of 0.5 share one in one of three, of 0.3 in one of 50.
BANDS, ROWS = 28, 6
REGISTERS = BANDS * ROWS
#: Registers of a sketch, seven bits of each, seven in a long; in how many of them pairs worth verifying agree. Of 0.8, three of a million pairs do not.
SKETCHED, AGREE = 63, 36
#: Nodes whose keys are broadcast at most, to pick their texts (24 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Pairs left to verify for each node, above which another hub is tried first, and rounds of hubs at most.
PAIRS_FOR_EACH, HUB_ROUNDS = 8, 2
#: Members of a part of a bucket, about, when all of its pairs are left.
PART = 128
#: Characters of text that get their signatures at a time.
STEP = 2_000_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, neither included."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def hash_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all documents, and how many words each has."""
    index: dict[bytes, int] = {}
    numbers = [np.array([index.setdefault(word, len(index)) for word in words], np.int64) for words in docs]
    hashes = np.array([int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") for word in index], np.uint64)
    flat = np.concatenate([np.zeros(0, np.int64), *numbers])
    return hashes[flat] if len(flat) else np.zeros(0, np.uint64), np.array([len(n) for n in numbers], np.int64)


def shingles_of(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all documents: number of the document, hash, weight. A document of fewer than five words has one, of all its words."""
    words, sizes = hash_words(docs)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(len(words)) - (ends - sizes)[doc]
    whole = at + SHINGLE <= np.maximum(sizes[doc], SHINGLE)
    starts = np.flatnonzero(whole & ((at + SHINGLE <= sizes[doc]) | (at == 0)))
    rolled = np.zeros(len(starts), np.uint64)
    for k in range(SHINGLE):
        there = np.minimum(starts + k, len(words) - 1) if len(words) else starts
        inside = at[starts] + k < sizes[doc[starts]]
        rolled = mixed(rolled * GOLDEN + np.where(inside, words[there], np.uint64(k)) + np.uint64(1))
    return weighed(doc[starts], rolled)


def weighed(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a document and a hash, in order, and how often each occurs."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc))).astype(np.float64)


def signatures(docs: int, doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingles in the registers of each document; zeros for a document without shingles."""
    out = np.zeros((docs, registers), np.uint64)
    total = np.bincount(doc, weights, docs)
    has = total > 0
    # All arrivals of a document come at this rate; so long a time rarely leaves a register empty.
    expected = registers * (np.log(registers) + 4)
    until = np.where(has, expected / np.maximum(total, 1e-300), 0.0)
    best = np.full(docs * registers, np.inf)
    # An element's k-th arrival is the sum of k exponential times; its next one is made from its number alone.
    live = np.arange(len(doc))
    time, k = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
    parked: list[np.ndarray] = []
    while len(live):
        while len(live):
            k[live] += np.uint64(1)
            random = mixed(hashes[live] + k[live] * GOLDEN)
            time[live] -= np.log(uniform(random)) / weights[live]
            early = time[live] < until[doc[live]]
            parked.append(live[~early])
            live, random = live[early], random[early]
            place = doc[live] * registers + (mixed(random) % np.uint64(registers)).astype(np.int64)
            fill(best, out, place, time[live], hashes[live])
        empty = np.isinf(best.reshape(docs, registers)).any(1) & has
        if not empty.any():
            break
        # Rarely: a longer time for the documents that have an empty register, going on where they stopped.
        until = np.where(empty, until * 2, until)
        waiting = np.concatenate(parked)
        again = empty[doc[waiting]]
        late = waiting[again]
        parked = [waiting[~again]]
        now = time[late] < until[doc[late]]
        parked.append(late[~now])
        live = late[now]
        random = mixed(hashes[live] + k[live] * GOLDEN)
        place = doc[live] * registers + (mixed(random) % np.uint64(registers)).astype(np.int64)
        fill(best, out, place, time[live], hashes[live])
    return out


def fill(best: np.ndarray, out: np.ndarray, place: np.ndarray, time: np.ndarray, hashes: np.ndarray) -> None:
    """Let arrivals into their registers if they come before what these hold."""
    order = np.lexsort((hashes, time, place))
    place, time, hashes = place[order], time[order], hashes[order]
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    place, time, hashes = place[first], time[first], hashes[first]
    earlier = time < best[place]
    best[place[earlier]] = time[earlier]
    out.reshape(-1)[place[earlier]] = hashes[earlier]


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A hash of each band's registers, signed."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS)).copy()
    for row in range(ROWS):
        out = mixed(out * GOLDEN + signature[:, row::ROWS])
    return out.view(np.int64)


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """Seven bits of each register, in the bytes of longs whose first byte is free."""
    bits = (mixed(signature[:, :SKETCHED]) & np.uint64(0x7F)).reshape(len(signature), -1, 7)
    return (bits << (np.arange(7, dtype=np.uint64) * np.uint64(8))).sum(2, dtype=np.uint64).view(np.int64)


def agreement(x: str, y: str) -> Column:
    """In how many registers two sketches agree: bytes that differ carry into their first bit."""
    most, first = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)
    differ = [F.bit_count((F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k))) + most).bitwiseAND(first)) for k in range(SKETCHED // 7)]
    return F.lit(SKETCHED) - reduce(Column.__add__, differ)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two sets of hashes, in order, with weights."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    at = np.searchsorted(y[0], x[0])
    both = (at < len(y[0])) & (y[0][np.minimum(at, len(y[0]) - 1)] == x[0])
    p, q = x[1][both], y[1][at[both]]
    if not len(p):
        return 0.0
    # For a shared element d: the sum over all e of max(x_e / x_d, y_e / y_d). Sorted by x / y, those from d on take the first.
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    only_x, only_y = x[1].sum() - p.sum(), y[1].sum() - q.sum()
    from_here = np.cumsum(p[::-1])[::-1] + only_x
    before = np.cumsum(q) - q + only_y
    return float((1.0 / (from_here / p + before / q)).sum())


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a, b), node (a digest of the words; null without words), bands and sketch of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, most=STEP):
                words = [words_of(text) for text in part.column("text").to_pylist()]
                nodes = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]
                signature = signatures(len(words), *shingles_of(words))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (bands_of(signature), sketch_of(signature))]
                columns = [part.column("doc_id"), part.column("a"), part.column("b"), pa.array(nodes, pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "node", "bands", "sketch"])

    return keyed(docs).mapInArrow(rows, "doc_id long, a long, b long, node binary, bands array<long>, sketch array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a, b) and text, null being empty."""
    text = docs["text"].cast("string")
    a, b = key_of(docs["doc_id"], text)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), a.alias("a"), b.alias("b"), F.coalesce(text, F.lit("")).alias("text"))


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (u, v) of nodes with the similarity of their texts."""
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text_u", STEP):
                known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
                for side in ("u", "v"):
                    new = dict(zip(part.column(side).to_pylist(), part.column(f"text_{side}").to_pylist(), strict=True))
                    new = {node: text for node, text in new.items() if node not in known}
                    doc, hashes, weights = shingles_of([words_of(text) for text in new.values()])
                    ends = np.searchsorted(doc, np.arange(len(new) + 1))
                    known |= {node: (hashes[a:b], weights[a:b]) for node, a, b in zip(new, ends[:-1], ends[1:], strict=True)}
                us, vs = part.column("u").to_pylist(), part.column("v").to_pylist()
                found = pa.array([similarity(known[u], known[v]) for u, v in zip(us, vs, strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), found], names=["u", "v", "similarity"])

    return both.select("u", "v", "text_u", "text_v").mapInArrow(check, "u binary, v binary, similarity double")


def links_in_groups(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (g, u, v) with a similarity of ``least`` or more. Groups are of few nodes with many pairs: a text goes to each group that it is in once, not to each pair."""
    nodes = pairs.groupBy(F.col("g").alias("g")).agg(F.array_union(F.collect_set("u"), F.collect_set("v")).alias("nodes"))
    members = nodes.select("g", F.explode("nodes").alias("node")).join(texts, "node")

    def check(asked: pa.Table, own: pa.Table) -> pa.Table:
        nodes = own.column("node").to_pylist()
        doc, hashes, weights = shingles_of([words_of(text) for text in own.column("text").to_pylist()])
        ends = np.searchsorted(doc, np.arange(len(nodes) + 1))
        known = {node: (hashes[a:b], weights[a:b]) for node, a, b in zip(nodes, ends[:-1], ends[1:], strict=True)}
        us, vs = asked.column("u").to_pylist(), asked.column("v").to_pylist()
        linked = [(u, v) for u, v in zip(us, vs, strict=True) if similarity(known[u], known[v]) >= least]
        return pa.table([pa.array([pair[side] for pair in linked], pa.binary()) for side in (0, 1)], names=["u", "v"])

    return pairs.groupBy("g").cogroup(members.groupBy("g")).applyInArrow(check, "u binary, v binary")


def shingle_counts(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, n_distinct, n_all, n_shared) of ``nodes``: how many distinct shingles a text has, all of them, and how many distinct ones another of the nodes has too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, most=STEP):
                doc, hashes, weights = shingles_of([words_of(text) for text in part.column("text").to_pylist()])
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
                counts = [np.diff(ends), np.bincount(doc, weights, part.num_rows).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column("node"), lists, *map(pa.array, counts)], names=["node", "hashes", "n_distinct", "n_all"])

    hashed = texts.join(nodes, "node", "left_semi").mapInArrow(rows, "node binary, hashes array<long>, n_distinct long, n_all long")
    hashed = staged(hashed, "shingles")
    shared = hashed.select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    alone = shared.groupBy("node").agg(F.lit(0).cast("long").alias("n_distinct"), F.lit(0).cast("long").alias("n_all"), F.count("*").alias("n_alone"))
    sums = hashed.select("node", "n_distinct", "n_all", F.lit(0).cast("long").alias("n_alone")).unionByName(alone).groupBy("node")
    sums = sums.agg(*(F.sum(name).alias(name) for name in ("n_distinct", "n_all", "n_alone")))
    return sums.select("node", "n_distinct", "n_all", (F.col("n_distinct") - F.col("n_alone")).alias("n_shared"))


def may_share(least: float) -> Column:
    """Whether two texts x and y may be similar by their ``shingle_counts``; true where these are not known.

    Both have at most the lesser ``n_shared`` as common shingles, and every other one has at least a weight of one; so at most the parts c and d of their weights are common.
    Of all such weights the similarity is at most 1 / (1/c + 1/d - 1): each element of it is at most 1 / (1/x + (1 - d)/y), which is concave and of degree one.
    """
    both = F.least("x.n_shared", "y.n_shared")
    c, d = (1 - (F.col(f"{side}.n_distinct") - both) / F.col(f"{side}.n_all") for side in "xy")
    return F.coalesce(c * d >= (least - 1e-9) * (c + d - c * d), F.lit(True))


def pairs_apart(current: DataFrame, near: Column, texts: DataFrame, least: float) -> DataFrame:
    """(g, u, v): all pairs of members of a bucket that are in different components and may be links, each once.

    A bucket is cut into parts of about ``PART`` members by a hash, and a group is of the pairs between two of its parts. A pair that shares several buckets is of the largest one, so
    that what is alike stays together: a row has all its buckets by falling size, and the join makes a pair only in the first one that both have.
    Members of buckets of more than one part are counted by ``shingle_counts``, which leaves out the pairs that have too few shingles in common with anyone.
    """
    sizes = current.groupBy("band").agg(F.count("*").alias("n"))
    dealt = current.join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART)))
    own = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "band")).over(Window.partitionBy("node")))["band"]
    dealt = staged(dealt.select("node", "band", "component", "sketch", "far", "n", "part", own.alias("own")), "dealt")
    known = staged(shingle_counts(dealt.where(F.col("n") > PART).select("node").distinct(), texts), "shingle-counts")
    # What has too few shingles in common with all others is in no pair.
    shares = F.col("n_distinct") - F.col("n_shared") <= (1 - least + 1e-9) * F.col("n_all")
    dealt = dealt.where(F.col("n") > PART).join(known.where(shares), "node").unionByName(dealt.where(F.col("n") <= PART), allowMissingColumns=True)
    x, y = dealt.alias("x"), dealt.alias("y")
    here = F.get(F.array_intersect("x.own", "y.own"), F.lit(0)) == F.col("x.band")
    apart = x.join(y, F.expr("x.band = y.band and x.component < y.component") & near & may_share(least) & (agreement("x.sketch", "y.sketch") >= AGREE) & here)
    group = F.xxhash64("x.band", F.least("x.part", "y.part"), F.greatest("x.part", "y.part"))
    apart = apart.select(group.alias("g"), F.greatest("x.node", "y.node").alias("u"), F.least("x.node", "y.node").alias("v"))
    # A large bucket is split on both sides of the join, into many small tasks.
    context = current.sparkSession.sparkContext
    return apart.coalesce(max(int(current.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect the same nodes as ``edges`` do: in each batch every node hangs below the least one that the batch connects it to."""

    def hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above: dict[bytes, bytes] = {}

            def top(node: bytes, above: dict[bytes, bytes] = above) -> bytes:
                while (up := above.get(node)) is not None:
                    above[node] = node = above.get(up, up)
                return node

            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                u, v = top(u), top(v)
                if u != v:
                    above[max(u, v)] = min(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in (list(above), list(map(top, list(above))))], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(hung, "u binary, v binary")


def stars(links: DataFrame) -> DataFrame:
    """(u, v): every node of ``links`` (u, v) but the least of its component, and that least node. By large and small stars in turns.

    Batches of links are contracted where they lie, so a node begins with at most one parent for each batch; no turn makes more rows than it gets. It is over when a
    turn changes nothing: then no parent has a parent, and every node has one.
    """
    edges = staged(contracted(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")), "links")
    mark = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    before, now = None, edges.agg(*mark).first()
    by_node = Window.partitionBy("u").orderBy("v")
    while now[0] and now != before:
        # Every edge goes on to the least parent of its own.
        parents = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = edges.join(parents, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # Each node keeps its least parent, and the others hang below that.
        small = large.select("u", "v", F.first("v").over(by_node).alias("m"), F.lag("v").over(by_node).alias("last"))
        small = small.where("last is null or v != last").select(F.when(F.col("last").isNull(), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = staged(small, "links")
        before, now = now, edges.agg(*mark).first()
    return edges


def hubs(members: DataFrame, passed: DataFrame | None) -> DataFrame:
    """The next hub of each bucket: (band, rank, hub, of), of being its component.

    Hubs go by popularity, which is how many members their buckets have in all: what many are copies of is in more and larger buckets
    than its copies. ``passed`` has the hubs before, whose ranks come first.
    """
    rank = F.struct((-F.col("popularity")).alias("popularity"), "node")
    if passed is not None:
        members = members.join(passed.select("band", "rank"), "band").where(rank > F.col("rank"))
    least = F.min(F.struct(rank.alias("rank"), F.col("component").alias("of"), F.col("sketch").alias("hub_sketch"))).alias("h")
    return members.groupBy("band").agg(least).select("band", "h.rank", F.col("h.rank.node").alias("hub"), "h.of", "h.hub_sketch")


def to_hubs(members: DataFrame, found: DataFrame, agree: int) -> DataFrame:
    """Pairs of a member (u) and a hub (v) of its bucket that are in different components and may be similar."""
    pairs = members.join(found, "band").where((F.col("component") != F.col("of")) & (agreement("sketch", "hub_sketch") >= agree))
    return pairs.select(F.col("node").alias("u"), F.col("hub").alias("v")).repartition("u").distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, key (a, b), class_id, class_size and is_first of every row of ``docs`` (doc_id, text), other columns being ignored.

    Rows are in one class if a chain of links leads from one to the other; a link is between texts with the same words or a similarity of ``least`` or more. ``class_id`` is the least doc_id of the class,
    and ``is_first`` says whether the row has it; of rows with the same doc_id the one with the least key is first. Rows with a null doc_id come last. A text
    without words, null or empty, is alike to no other: it is a class of its own. Rows with the same doc_id and text are one
    document and get the same result. An empty table gives none.
    """
    spark = docs.sparkSession
    rows = staged(signed(docs), "signatures")
    own = rows.where("node is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "a", "b")
    nodes = own.select("node", "bands", "sketch").dropDuplicates(["node"])
    bands = nodes.select("node", F.posexplode("bands").alias("number", "value"))
    bands = bands.select("node", F.xxhash64("number", "value").alias("band"))
    crowded = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = bands.join(crowded, "band").withColumn("popularity", F.sum("size").over(Window.partitionBy("node")))
    members = staged(members.join(nodes.select("node", "sketch"), "node").select("node", "band", "size", "popularity", "sketch"), "buckets")

    keys = own.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("a", "b")).alias("k")).select("node", "k.a", "k.b")
    keys = staged(keys, "bucket-nodes")
    count = keys.count()
    texts = keyed(docs).join(F.broadcast(keys) if count <= BROADCAST_NODES else keys, ["a", "b"]).select("node", "text")
    texts = staged(texts.dropDuplicates(["node"]), "bucket-texts")

    # A node without a row is the least of its component, or has no link.
    links, node_of, own_of = None, F.col("u").alias("node"), F.col("v").alias("component")
    current, turn, passed = members.withColumn("component", F.col("node")), 0, None
    while count:
        if turn:
            current = staged(members.drop("component").join(links.select(node_of, own_of), "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
            size = current.groupBy("band", "component").count().groupBy("band").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
            size = staged(size.select("band", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("left")).where("left > 0"), "split")
            left = size.agg(F.sum("left")).first()[0] or 0
            if not left:
                break
            # A bucket of one component stays so: only the others go on.
            members = current = staged(current.join(size, "band", "left_semi"), "split-buckets")
            if left <= PAIRS_FOR_EACH * count or turn > HUB_ROUNDS:
                # One less the similarity is a metric: texts whose distances from a hub differ by more are no link.
                near = F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= 1 - least + 1e-9, F.lit(True))
                pairs = staged(pairs_apart(current, near, texts, least), "pairs-apart")
                links = stars(links.unionByName(staged(links_in_groups(pairs, texts, least), "verified")))
                break
        passed = staged(hubs(current, passed), "hubs")
        # All members are compared with the first hub, for their distances from it; with later ones if they may be similar.
        found = staged(compared(to_hubs(current, passed, AGREE if turn else 0), texts), "compared")
        new = found.where(F.col("similarity") >= least).select("u", "v")
        links = stars(links.unionByName(new) if turn else new)
        if not turn:
            far = found.select(F.col("u").alias("node"), F.col("v").alias("hub"), (1 - F.col("similarity")).alias("far"))
            members = members.join(passed.select("band", "hub"), "band").join(far, ["node", "hub"], "left")
            members = staged(members.withColumn("far", F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.col("far"))).drop("hub"), "buckets")
            # The one pair of a bucket of two has been compared.
            members = members.where("size > 2")
        turn += 1
    out = rows.select("doc_id", "a", "b", "node")
    if links is not None:
        out = out.join(links.select(node_of, own_of), "node", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("binary"))
    # A text without words has a component of its own, made from its key.
    alone = F.concat(F.lit(b"-"), F.unhex(F.hex("a")), F.unhex(F.hex("b")))
    out = staged(out.withColumn("component", F.coalesce("component", "node", alone)).drop("node"), "components")
    sums = out.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("class_size"))
    joined = out.join(sums, "component")
    return joined.select("doc_id", "a", "b", F.col("first.doc_id").alias("class_id"), "class_size", (place == F.col("first")).alias("is_first"))


def dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The first document of each class, all columns as they are; of rows that are the same document, one stays."""
    a, b = key_of(docs["doc_id"], docs["text"].cast("string"))
    kept = classes(docs, least).where("is_first").select("a", "b").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), a.alias("a"), b.alias("b"))
    return packed.join(kept, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("row.*")
