"""Repetition coverage of documents: characters inside repeated n-grams and repeated lines.

For several lengths n, every run of n words gets a rolling hash, made from the hashes of length n - 1; a run whose hash occurs more than once in
its document is repeated, and all its characters are covered, each once. The share of covered characters is held against a
limit for each length. Lines are covered when an earlier line of the document is equal. A heading, which is all that is repeated of a document's
lines, and short, does not count among the n-grams unless it covers much of the document; it always counts among the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.common import text_or_empty, text_steps

#: The most that may be covered, by length of the n-gram, as a share of the characters in words.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Words of a heading at most, and the most that all its occurrences may cover.
HEADING, HEADING_LIMIT = 20, 1 / 3
#: The most that may be covered by repeated lines.
LINE_LIMIT = 0.30
#: The base rules.
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: An odd multiplier of the rolling hash, modulo 2^64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Characters of text measured at a time.
STEP = 2_000_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "line_share double, ngram_share double"
)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers for small ones."""
    x = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def spread(starts: np.ndarray, n: int) -> np.ndarray:
    """Places that a run of ``n`` from any of the marked places covers."""
    marks = np.zeros(len(starts) + n, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + n, -1)
    return np.cumsum(marks)[: len(starts)] > 0


def heading_words(raw: bytes, twice: set[bytes], n_words: int) -> np.ndarray:
    """Which words of a text are in its heading; ``twice`` has the repeated lines."""
    out = np.zeros(n_words, bool)
    sizes = {line: len(line.split()) for line in twice}
    if 0 < sum(sizes.values()) <= HEADING:
        at = 0
        for line in raw.split(b"\n"):
            size = sizes.get(line, 0)
            out[at : at + size] = True
            at += size or len(line.split())
    return out


def measure(texts: list[str], limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> dict[str, np.ndarray]:
    """The measures of every text, all texts at once."""
    index: dict[bytes, int] = {}
    sizes, numbers, lines_again, lines_chars, symbols, heading = [], [], [], [], [], []
    for text in texts:
        raw = text.encode()
        words = raw.split()  # at the bytes 09-0D and 20
        sizes.append(len(words))
        numbers.append(np.array([index.setdefault(word, len(index)) for word in words], np.int64))
        seen: set[bytes] = set()
        twice: set[bytes] = set()
        again = covered = 0
        for line in raw.split(b"\n"):
            if line in seen:
                own = line.split()
                if own:
                    twice.add(line)
                    again += 1
                    covered += sum(len(word.decode()) for word in own)
            else:
                seen.add(line)
        lines_again.append(again)
        lines_chars.append(covered)
        symbols.append(len(SYMBOLS.findall(text)))
        heading.append(heading_words(raw, twice, len(words)))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    word = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    chars = np.array([len(w.decode()) for w in index], np.int64)[word] if len(word) else np.zeros(0, np.int64)

    def by_doc(values: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values))
        return sums[ends] - sums[starts]

    left = (ends[doc] - np.arange(len(word))) if len(word) else np.zeros(0, np.int64)  # words from here to the document's end
    # Windows of three words, exactly: pairs and then triples are numbered, never hashed.
    pair = np.zeros(len(word), np.int64)
    if len(word) > 2:
        pair[:-1] = np.unique(word[:-1] * np.int64(len(index)) + word[1:], return_inverse=True)[1]
        triple = np.zeros(len(word), np.int64)
        triple[:-2] = np.unique(pair[:-2] * np.int64(len(index)) + word[2:], return_inverse=True)[1]
        whole = left >= 3
        found = np.zeros(len(word), bool)
        found[whole] = repeated(doc[whole] * np.int64(len(word)) + triple[whole])
        repeat_words = by_doc(spread(found, 3))
    else:
        repeat_words = np.zeros(len(texts), np.int64)
    word_chars = by_doc(chars)
    in_heading = np.concatenate(heading) if heading else np.zeros(0, bool)
    passes = by_doc(chars * in_heading) <= HEADING_LIMIT * word_chars
    counting = np.where(in_heading & passes[doc], 0, chars)
    share = np.zeros(len(texts))
    failed = np.zeros(len(texts), bool)
    hashed = mixed(word.astype(np.uint64))
    rolling = hashed + mixed(doc.astype(np.uint64) + np.uint64(1 << 40)) if len(word) else hashed
    for n in range(2, max(limits) + 1):
        if n > len(word):
            break
        # The hash of n words from here: that of n - 1 words, times the factor, and the next word.
        rolling = rolling[:-1] * FACTOR + hashed[n - 1 :]
        if n not in limits:
            continue
        whole = left[: len(rolling)] >= n
        found = np.zeros(len(word), bool)
        found[: len(rolling)][whole] = repeated(rolling[whole])
        covered = by_doc(spread(found, n) * counting) / np.maximum(word_chars, 1)
        share = np.maximum(share, covered / limits[n])
        failed |= covered > limits[n]
    line_share = np.array(lines_chars) / np.maximum(word_chars, 1)
    n_words = np.array(sizes, np.int64)
    base_failed = (n_words < MIN_WORDS) | (repeat_words > MAX_REPEATED * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines_again, np.int64),
        "n_repeat_words": repeat_words.astype(np.int64),
        "base_failed": base_failed,
        "kept": ~(base_failed | failed | (line_share > line_limit)),
        "line_share": line_share,
        "ngram_share": share,
    }


def judge(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The measures and verdict of every row of ``docs`` (doc_id, text), other columns being ignored.

    ``ngram_share`` is the largest share of characters in repeated n-grams outside a heading, as a multiple of its length's limit; ``line_share`` is the
    share in repeated lines, headings too. A null or empty text has no words: it fails the base rule and is not kept. Every row gives one row, repeated rows and null doc_ids
    too; an empty table gives none. Texts of any length are measured whole.
    """
    limits = limits or NGRAM_LIMITS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, most=STEP):
                found = measure(part.column("text").to_pylist(), limits, line_limit)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return texts.mapInArrow(rows, SCHEMA)
