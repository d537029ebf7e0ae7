"""Byte-level BPE: ranked merges of the bytes of words, all words of a run side by side, and decoding by joined pieces.

A piece is named by its rank: each pair of pieces that make a piece, as one number with its rank, lies in one of two places that its remainders name. The words of a run are one
array of pieces, beside the rank of each piece and the next. A turn merges in every word all pairs of that word's least rank, from left to right; words without a pair that has a rank leave.
That is the same as one merge at a time: a piece is reached by merges of lower rank only, so a merge never makes a pair of a lower rank, and a word that is a piece becomes it.

Documents are cut into units on which merging works independently (``units.py``), and units into words. The words of the frequent units of all texts, a
bounded number, are encoded once and broadcast. Other words are encoded once for each run of documents, where the ids are put together. So no text is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import math
from array import array
from collections.abc import Callable, Collection, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.common import frequent_terms, text_or_empty, text_steps
from newsloom.llm.units import Numbers, cut, gather, spaced_units, totals

#: Units whose words are broadcast at most, and characters of text in a run of documents.
FREQUENT, STEP = 40_000, 4_000_000
#: Bits of a piece's name.
NAME = 17
#: A pair without a rank.
NONE = 2**31 - 1


def read_ranks(path: str | None = None) -> list[bytes]:
    """Pieces by rank, from a file of base64 pieces and ranks."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, f)}
    return [ranks[rank] for rank in range(len(ranks))]


def pairs_of(pieces: list[bytes]) -> dict[int, int]:
    """The ranks of all pairs of pieces that make a piece; a piece is named by its rank, so a pair of pieces is one number."""
    names = {piece: rank for rank, piece in enumerate(pieces)}
    found = {}
    for piece, rank in names.items():
        for cut in range(1, len(piece)):
            left, right = names.get(piece[:cut]), names.get(piece[cut:])
            if left is not None and right is not None:
                found[left << NAME | right] = rank
    return found


def laid_out(ranks: dict[int, int], places: tuple[int, int]) -> list[int] | None:
    """Every pair, with its rank, in one of the two places that the remainders of its number name (cuckoo hashing); none if that fails."""
    one, two = places
    table = [0] * (one + two)
    for key, rank in ranks.items():
        entry, at = key << NAME | rank, key % one
        for _ in range(200):
            entry, table[at] = table[at], entry
            if not entry:
                break
            key = entry >> NAME
            at = one + key % two if at < one else key % one
        else:
            return None
    return table


def next_prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


class Merges:
    """The merges of a rank file: names of single bytes, and the ranks of pairs, each in one of two places."""

    def __init__(self, pieces: list[bytes]) -> None:
        if len(pieces) >= 1 << NAME:
            raise ValueError(f"a rank file has at most {1 << NAME} pieces")
        names = {piece: rank for rank, piece in enumerate(pieces)}
        ranks, size = pairs_of(pieces), 64
        while True:
            size = max(size, len(ranks)) * 5 // 4
            self.places = next_prime(size), next_prime(size + size // 50)
            table = laid_out(ranks, self.places)
            if table is not None:
                break
        self.bytes, self.pairs = np.array([names[bytes([byte])] for byte in range(256)], np.int64), np.array(table, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of pieces."""
        key = left << NAME | right
        here, there = self.pairs[key % self.places[0]], self.pairs[key % self.places[1] + self.places[0]]
        found = np.where(here >> NAME == key, here, there)
        return np.where(found >> NAME == key, found & ((1 << NAME) - 1), NONE)

    def __call__(self, words: Collection[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has. All words are folded side by side, each by its own least rank."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        number = np.flatnonzero(lengths)
        sizes, done, of = lengths[number], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pieces = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        # The rank of each piece and the one after it; the last piece of a word has none after it.
        ranks = np.full(len(pieces), NONE)
        ranks[:-1] = self.ranks(pieces[:-1], pieces[1:])
        ranks[np.cumsum(sizes) - 1] = NONE
        while len(sizes):
            least = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            going = least < NONE
            if not going.all():
                # Words that are done leave.
                stay = np.repeat(going, sizes)
                done.append(pieces[~stay])
                of.append(np.repeat(number[~going], sizes[~going]))
                pieces, ranks, number, sizes, least = pieces[stay], ranks[stay], number[going], sizes[going], least[going]
                if not len(sizes):
                    break
            word = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(ranks == least[word])
            at = at[every_other(at)]
            pieces[at], ranks[at] = least[word[at]], ranks[at + 1]
            stay = np.ones(len(pieces), bool)
            stay[at + 1] = False
            sizes -= np.bincount(word[at], minlength=len(sizes))
            pieces, ranks, at = pieces[stay], ranks[stay], at - np.arange(len(at))
            # Only pairs with a new piece have another rank.
            last = np.cumsum(sizes) - 1
            inner = np.ones(len(pieces), bool)
            inner[last] = False
            changed = np.concatenate([at, at[at > 0] - 1])
            changed = changed[inner[changed]]
            ranks[changed] = self.ranks(pieces[changed], pieces[changed + 1])
            ranks[last] = NONE
        lengths = np.bincount(of := np.concatenate(of), minlength=len(words))
        return np.concatenate(done)[np.argsort(of, kind="stable")].astype(np.uint32), lengths


def every_other(places: np.ndarray) -> np.ndarray:
    """Which of ``places`` count: of pairs that overlap the left one goes first, so in a run of neighbours every other one."""
    begins = np.append(True, np.diff(places) > 1)[: len(places)]
    number = np.arange(len(places))
    return (number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0


def encode_words(words: DataFrame, pieces: list[bytes], *keys: str) -> DataFrame:
    """The ids of ``words`` (word: bytes), beside the columns ``keys``."""
    merges = words.sparkSession.sparkContext.broadcast(Merges(pieces))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = merges.value(batch.column("word").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), lists], names=[*keys, "ids"])

    kept = words.select(*keys, "word")
    kinds = [f"{key} {kept.schema[key].dataType.simpleString()}" for key in keys]
    return kept.mapInArrow(rows, ", ".join([*kinds, "ids array<int>"]))


class WordIds:
    """Ids of words known by number; all of them one after the other."""

    def __init__(self, ids: pa.ListArray | pa.ChunkedArray) -> None:
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        offsets = ids.offsets.to_numpy().astype(np.int64)
        self.flat = ids.values.to_numpy(zero_copy_only=False).astype(np.uint32)
        self.starts, self.lengths = offsets[:-1], np.diff(offsets)


def encode(
    docs: DataFrame, ranks: str | None = None, pattern: str | None = None, frequent: int = FREQUENT,
    finish: tuple[Callable[[list, list[np.ndarray]], pa.RecordBatch], str] | None = None,
) -> DataFrame:
    """doc_id and ids (little-endian u32 in a binary) of every row of ``docs`` (doc_id, text), other columns being ignored.

    Each match of ``pattern`` is encoded by itself with the ranks in the file ``ranks``; there are no special tokens. A null text counts as empty: no ids. Every row gives one
    row, repeated ones and those with a null doc_id too; an empty table gives none. ``finish`` makes other columns of doc_ids and ids where these are
    put together, and names them. A single word of any length is encoded; the
    time for one word grows with its length times its number of different merges.
    """
    spark = docs.sparkSession
    pieces = read_ranks(ranks)
    make, columns = finish or (as_binary, "doc_id long, ids binary")
    pattern = pattern or public_tokenizers.PATTERN
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))

    # The words of the frequent units and their ids: bounded by ``frequent``.
    units = frequent_terms(rows.select("text"), spaced_units, frequent)["term"].to_pylist()
    matches = matcher(pattern)
    number = Numbers()
    for unit in units:
        for word in matches(" " + unit):
            number[word]
    words = spark.createDataFrame(pa.table({"at": pa.array(range(len(number)), pa.int64()), "word": pa.array(list(number), pa.binary())}))
    spread = words.repartition(max(1, spark.sparkContext.defaultParallelism), "at")
    found = encode_words(spread.select("at", "word"), pieces, "at").toArrow().sort_by("at")
    known = WordIds(found["ids"])
    near_words = spark.sparkContext.broadcast(list(number))
    near_ids = spark.sparkContext.broadcast((known.flat, known.starts, known.lengths))
    merges = spark.sparkContext.broadcast(Merges(pieces))
    del units, words, spread, found, known, number
    pa.default_memory_pool().release_unused()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of runs of documents: words that are not frequent are encoded once for each run."""
        near, find = {word: at for at, word in enumerate(near_words.value)}, matcher(pattern)
        flat, starts, lengths = near_ids.value
        for batch in batches:
            for part in text_steps(batch, most=STEP):
                numbers, sizes, spaced, lone = cut(part.column("text"))
                new, unit_words, unit_sizes = Numbers(), array("q"), array("q")
                for space, some in ((" ", spaced.to_pylist()), ("", lone)):
                    for unit in some:
                        own = find(space + unit)
                        unit_sizes.append(len(own))
                        for word in own:
                            at = near.get(word)
                            unit_words.append(len(near) + new[word] if at is None else at)
                own_flat, own_lengths = merges.value(new)
                word_lengths = np.append(lengths, own_lengths)
                word_starts = np.append(starts, np.cumsum(own_lengths) - own_lengths + len(flat))
                words = np.frombuffer(unit_words, np.int64)
                of_units = gather(np.append(flat, own_flat), word_starts[words], word_lengths[words])
                unit_lengths = totals(word_lengths[words], np.frombuffer(unit_sizes, np.int64))
                unit_starts = np.cumsum(unit_lengths) - unit_lengths
                each = unit_lengths[numbers]
                ids = gather(of_units, unit_starts[numbers], each).astype("<u4")
                ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(sizes))]
                yield make(part.column("doc_id").to_pylist(), [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])

    return rows.mapInArrow(rows_of, columns)


def as_binary(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())], names=["doc_id", "ids"])


def matcher(pattern: str) -> Callable[[str], list[bytes]]:
    """A function that gives the matches of ``pattern`` as bytes."""
    import regex

    find = regex.compile(pattern).findall
    return lambda text: [match.encode() for match in find(text)]


def decode(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    """The bytes of ids: their pieces one after the other."""
    return b"".join(map(pieces.__getitem__, ids.tolist()))


def digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, and checksums of the ids as text and of the bytes they decode to, for every row of ``docs``, as ``encode`` says."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def digest(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        of_ids = [hashlib.sha256(" ".join(map(str, i.tolist())).encode()).hexdigest() for i in ids]
        of_text = [hashlib.sha256(decode(i, pieces.value)).hexdigest() for i in ids]
        columns = [pa.array(doc_ids, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, ranks, pattern, frequent, (digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
