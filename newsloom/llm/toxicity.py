"""Toxicity of documents: a learned lexicon met by Levenshtein automata, and scores of the context of each match.

The lexicon is learned from labelled rows: terms whose contexts are found in toxic documents far more often than chance allows. A
context is a term with the words before and after it at its first place in a document; each distinct one counts once, so that neither copies of a document nor
a document that repeats a word say more than one document.
The lexicon is a trie. Words are run through the automaton that accepts what is within an edit distance of any term: its states are sets of trie nodes and
errors so far, built when first met, so a word costs one lookup for each letter and most words end after a few. Words that clean documents have are never
taken for misspelled terms.

A logistic model weighs the matches of a document, those that are quoted apart from the others; a misspelled match counts somewhat less. A match is quoted when marks enclose it
or a word of mention stands close before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import staged, text_or_empty, text_steps

#: Labelled rows of each label that are learned from at most, the first by a hash of doc_id.
SAMPLE_ROWS = 10_000
#: Terms of the lexicon at most, by evidence.
TERMS = 2_000
#: How far evidence has to go beyond what the best of all words has by chance.
MARGIN = 1.5
#: Contexts of a term at least, and its length.
CONTEXTS, SHORTEST = 4, 4
#: Edits allowed in a term by its length: one from five letters on, two from nine.
EDITS = ((9, 2), (5, 1))
#: Words before and after a match that are its context.
WINDOW = 6
WORD = re.compile(r"[^\W\d_]+")
#: Marks that open and close a quotation, and words of mention.
QUOTES = re.compile(r"[\"“”„«»‘’]")
MENTION = frozenset("said says saying called calls word words term quote quoted quotes wrote written".split())
#: Characters of text scored at a time.
STEP = 4_000_000
#: What a misspelled match counts.
MISSPELLED = 0.8
#: What the weights are before any row is seen: the bias, matches, quoted matches. Learning pulls them from there.
PRIOR = np.array([-3.0, 5.0, 1.0])


class Lexicon:
    """The automaton of all words within their edit distance of a term."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.final = [0]
        self.reach = [0]
        for term in sorted(set(terms)):
            edits = next((n for length, n in EDITS if len(term) >= length), 0)
            path = [0]
            for letter in term:
                child = self.children[path[-1]].get(letter)
                if child is None:
                    child = self.children[path[-1]][letter] = len(self.children)
                    self.children.append({})
                    self.final.append(-1)
                    self.reach.append(0)
                path.append(child)
            self.final[path[-1]] = edits
            for node in path:
                self.reach[node] = max(self.reach[node], edits)
        self.final[0] = -1
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.sets: list[frozenset] = []
        self.start = self.state({(0, 0)})

    def state(self, items: set[tuple[int, int]]) -> int:
        """The number of a state: (node, errors), with letters of terms left out of the word where edits allow it. -1 if none is left."""
        best: dict[int, int] = {}
        todo = sorted(items, key=lambda item: item[1])
        while todo:
            node, errors = todo.pop(0)
            if errors > self.reach[node] or best.get(node, 99) <= errors:
                continue
            best[node] = errors
            todo += [(child, errors + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if not key:
            return -1
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.moves)
            self.moves.append({})
            self.sets.append(key)
            self.accepts.append(min((errors for node, errors in key if errors <= self.final[node]), default=-1))
        return number

    def move(self, state: int, letter: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, errors in self.sets[state]:
            items.add((node, errors + 1))  # a letter too many
            for own, child in self.children[node].items():
                items.add((child, errors + (own != letter)))
        number = self.moves[state][letter] = self.state(items)
        return number

    def distance(self, word: str) -> int:
        """The fewest edits to a term that allows as many; -1 if there is none."""
        state = self.start
        for letter in word:
            following = self.moves[state].get(letter)
            state = self.move(state, letter) if following is None else following
            if state < 0:
                return -1
        return self.accepts[state]


def contexts(text: str) -> list[tuple[str, str, str]]:
    """Each word at its first place, between its neighbours."""
    words = ["", *WORD.findall(text.lower()), ""]
    triples = zip(words[-3::-1], words[-2:0:-1], words[:1:-1], strict=True)  # from the end, so that the first place stays
    return [(before, word, after) for word, (before, after) in {word: (before, after) for before, word, after in triples}.items() if len(word) >= SHORTEST]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks enclose a match within its context, or a word of mention stands before it."""
    before = " ".join(text[max(0, start - 200) : start].split(" ")[-WINDOW - 1 :])
    after = " ".join(text[end : end + 200].split(" ")[: WINDOW + 1])
    enclosed = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) is not None
    return enclosed or any(word in MENTION for word in WORD.findall(before.lower())[-WINDOW:])


class Matcher:
    """The matches of a lexicon in texts, each distinct word being run through the automaton once."""

    def __init__(self, terms: Iterable[str], known: Iterable[str]) -> None:
        self.lexicon, self.known, self.distances = Lexicon(terms), frozenset(known), {}

    def distance(self, word: str) -> int:
        found = self.distances.get(word)
        if found is None:
            if len(self.distances) > 300_000:
                self.distances.clear()
            found = self.lexicon.distance(word)
            found = self.distances[word] = -1 if found > 0 and word in self.known else found
        return found

    def features(self, text: str) -> tuple[float, float]:
        """What the matches count that are not quoted, and those that are."""
        lower, out = text.lower(), [0.0, 0.0]
        words = WORD.findall(lower)
        if any(self.distance(word) >= 0 for word in set(words)):
            for match in WORD.finditer(lower):
                distance = self.distance(match[0])
                if distance >= 0:
                    out[quoted(lower, match.start(), match.end())] += MISSPELLED if distance else 1.0
        return out[0], out[1]


def learned_terms(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, words: int) -> list[str]:
    """Terms of ``counts`` (word, toxic and clean contexts) that are toxic more often than chance allows for any of ``words`` words."""
    if not toxic or not clean:
        return []
    share, found = toxic / (toxic + clean), []
    for word, t, c in counts:
        p = t / (t + c)
        evidence = t * np.log(p / share) + (c * np.log((1 - p) / (1 - share)) if c else 0.0)
        if t >= CONTEXTS and p > 0.5 and evidence > MARGIN * np.log(words):
            found.append((-evidence, word))
    return [word for _, word in sorted(found)[:TERMS]]


def fitted(x: list, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Weights of a logistic model, by Newton's method in steps of bounded size; ``pull`` holds them at ``PRIOR``."""
    x, w = inputs(x), PRIOR.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull * np.eye(len(w)), x.T @ (y - p) - pull * (w - PRIOR))
        w = w + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def inputs(x: list) -> np.ndarray:
    """What the model weighs: one, and the features up to a few matches."""
    x = np.asarray(x, float).reshape(-1, 2)
    return np.column_stack([np.ones(len(x)), np.minimum(x, 3)])


def in_training(doc_id: Column) -> Column:
    """Whether labels of a row may be learned from. A null doc_id has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Terms, clean words that are close to a term, and weights of the features.

    At most ``SAMPLE_ROWS`` labelled rows of each label are read; contexts are counted where the texts are, and the driver gets one
    row for each word that has enough toxic contexts.
    """
    spark = docs.sparkSession
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    rows = rows.where("doc_id is not null and toxic in (0, 1)").where(in_training(F.col("doc_id"))).distinct()
    chosen = [
        row
        for label in (0, 1)
        for row in rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()
    ]
    if not chosen:
        return [], [], PRIOR
    sample = spark.createDataFrame(chosen, "doc_id long, toxic int")  # bounded, so its broadcast is
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, most=STEP):
                seen: list[set] = [set(), set()]
                for label, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist(), strict=True):
                    seen[label].update(contexts(text))
                for label in (0, 1):
                    names = ["before", "word", "after"]
                    columns = list(zip(*seen[label], strict=True)) or [(), (), ()]
                    arrays = [pa.array(c, pa.string()) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(seen[label]), pa.int32()), *arrays], names=["toxic", *names])

    triples = texts.select("toxic", "text").mapInArrow(count, "toxic int, before string, word string, after string").distinct()
    counts = triples.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    counts = staged(counts, "term-contexts")
    sums = counts.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first()
    often = counts.where((F.col("toxic") >= CONTEXTS) & (F.col("toxic") > F.col("clean"))).collect()
    terms = learned_terms(often, *(n or 0 for n in sums))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            yield batch.filter(pa.array([lexicon.distance(word) > 0 for word in batch.column("word").to_pylist()], pa.bool_()))

    known = [row["word"] for row in counts.where("clean > 0").select("word").mapInArrow(near, "word string").collect()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, known)
        for batch in batches:
            found = [matcher.features(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "features"])

    measured = texts.select("toxic", "text").mapInArrow(measure, "toxic int, features array<double>").toArrow()
    return terms, known, fitted(measured["features"].to_pylist(), measured["toxic"].to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic); other columns are ignored.

    ``held_out`` rows, and those with a null doc_id, are never learned from. A null or empty text has no match and gets the score of that. Labels that are
    null or neither 0 nor 1, and labels of unknown documents, are ignored; without any label nothing is toxic. Every row gives one row, repeated ones too; an empty table
    gives none.
    """
    terms, known, weights = learn(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, known)
        for batch in batches:
            for part in text_steps(batch, most=STEP):
                x = inputs([matcher.features(text) for text in part.column("text").to_pylist()])
                scores = 1 / (1 + np.exp(-x @ weights))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores)], names=["doc_id", "held_out", "score"])

    doc_id = docs["doc_id"].cast("long")
    held_out = F.coalesce(~in_training(doc_id), F.lit(True))
    rows = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), text_or_empty(docs).alias("text"))
    scored = rows.mapInArrow(judge, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    terms, known, weights = learn(docs, labels)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(terms, known)
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-inputs([matcher.features(text or "") for text in texts]) @ weights)))

    text = docs["text"].cast("string")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.explode(F.array(scores(text))).alias("score"))
    return packed.where(F.col("score") < 0.5).select("row.*")
