"""Scores of texts by a causal self-attention model over subword ids, beside those of add-one word frequencies.

Words are counted over all training documents by a grouped aggregation. The counts give the base score, and, as every word's ids are
known, the frequency of each subword id. Ids are put into classes: the most frequent ones have a class each, the others share classes of about equal weight. Attention gives
the probability of the next id's class from the ids before it, and an id has its share of its class. A word's probability is that of its ids and of a new word
after them, given that a word begins; the model mixes it with the word's own frequency, so that a text's score is a proper probability.

The model is one layer of masked self-attention, trained in numpy: every task trains a copy on the windows of its training documents, copies are averaged by
a grouped aggregation, and the next round starts from the average. The rounds share out the windows, so that together they are one pass over every id of
every training document. It starts as the frequencies of the classes. Training and scoring lay overlapping windows over the ids of a document; attention and loss are computed for a batch of windows at once, and each
id is scored once, in the window in which it has the most ids before it.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import most_frequent, staged, steps, text_or_empty, text_steps
from newsloom.llm.units import gather, totals

#: Words whose counts and ids are broadcast at most.
FREQUENT = 250_000
#: Width of the model, ids of a window, ids that a window scores, classes, and input ids that have a vector of their own.
WIDTH, WINDOW, STRIDE, CLASSES, INPUTS = 16, 32, 24, 128, 4096
#: Rounds that share out the windows to train on; windows of a step.
ROUNDS, TRAIN_BATCH = 2, 128
RATE = 0.02
#: The part of attention in the mixture.
ATTENTION = 0.3
#: Windows scored at a time, ids laid out in windows at a time, and characters of text (or bytes of ids) coded and scored at a time.
SCORE_BATCH, IDS, CODED = 64, 500_000, 4_000_000
#: Words of a task whose ids are kept for the texts after them at most, or whose counts are summed before they are handed on.
KEPT = 200_000
#: Words that are coded in one string, unless it has white space of Unicode within a word.
TOGETHER, WITHIN = 5_000, re.compile(r"[^\S ]")


def normal(text: str) -> list[bytes]:
    """The words: runs without white space of ASCII, with A-Z in lower case."""
    return text.encode().lower().split()


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learned from. A null doc_id has no remainder: it is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


class WordIds:
    """Subword ids of words, each as it is after a space. Those of up to ``KEPT`` words are kept."""

    def __init__(self, pieces: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=pieces, special_tokens={}).encode_ordinary
        #: Whether no match of the pattern goes beyond a word, and which pieces begin one.
        self.apart, self.begins = pattern == public_tokenizers.PATTERN, beginnings(pieces)
        self.forget()

    def forget(self) -> None:
        self.place, self.flat, self.lengths = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __call__(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, which differ, one after the other, and how many each has."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        if len(self.place) > KEPT:
            self.forget()
        places = pc.index_in(words, value_set=self.place).fill_null(-1).to_numpy().astype(np.int64)
        new = places < 0
        places[new] = len(self.place) + np.arange(np.count_nonzero(new))
        fresh = words.filter(pa.array(new))
        flat, lengths = self.ids(fresh)
        self.place = pa.concat_arrays([self.place, fresh])
        self.flat, self.lengths = np.append(self.flat, flat), np.append(self.lengths, lengths)
        starts, own = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[places], self.lengths[places].astype(np.int64)
        return gather(self.flat, starts, own).astype(np.int64), own

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are not kept."""
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        ends = np.append(np.arange(0, len(words), TOGETHER), len(words)).astype(np.int32)
        for at, joined in zip(ends, pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), b" ").to_pylist(), strict=False):
            text = " " + joined.decode()
            if self.apart and not WITHIN.search(text):
                run = np.array(self.encode(text), np.int32)
                # A space stands only before a word, so its piece begins the word.
                flat.append(run)
                lengths.append(np.diff(np.append(np.flatnonzero(self.begins[run]), len(run))).astype(np.int32))
            else:
                each = [self.encode(" " + word.decode()) for word in words[at : at + TOGETHER].to_pylist()]
                flat += [np.array(ids, np.int32) for ids in each]
                lengths.append(np.array([len(ids) for ids in each], np.int32))
        return np.concatenate(flat), np.concatenate(lengths)


def read_pieces(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def beginnings(pieces: dict[bytes, int]) -> np.ndarray:
    """Which ids begin a word, those of pieces with a space. The end, the id after the last, does not."""
    begins = np.zeros(len(pieces) + 1, bool)
    begins[[i for piece, i in pieces.items() if piece[:1] == b" "]] = True
    return begins


class Coded:
    """Texts as subword ids: distinct words, the word at each place, ids of all texts one after the other, each with its end."""

    def __init__(self, texts: list[str] | pa.Array, code: WordIds, end: int) -> None:
        # Arrow's lower case and white space are those of ASCII. Before and after white space at the ends of a text it gives an empty word.
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))
        sizes, words = cut.value_lengths().to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        flat, empty = words.indices.to_numpy(), pc.index(words.dictionary, "").as_py()
        self.words = words.dictionary.cast(pa.binary())
        if empty >= 0:
            self.words = pa.concat_arrays([self.words[:empty], self.words[empty + 1 :]])
            there = flat != empty
            sizes, flat = totals(there, sizes), flat[there]
            flat -= flat > empty
        self.sizes, self.flat = sizes, flat
        of_words, lengths = code(self.words)
        starts, own = (np.cumsum(lengths) - lengths)[flat], lengths[flat]
        per_doc = totals(own, sizes)
        self.ids, self.per_doc = np.insert(gather(of_words, starts, own), np.cumsum(per_doc), end), per_doc + 1

    def counts(self, counted: np.ndarray) -> pa.Table:
        """word and n over the texts that are ``counted``."""
        n = np.bincount(self.flat[np.repeat(counted, self.sizes)], minlength=len(self.words))
        seen = np.flatnonzero(n)
        return pa.table({"word": self.words.take(pa.array(seen)), "n": n[seen]})


class Words:
    """The words that runs of ids stand for. A word begins with a piece that begins with a space; its ids give its bytes."""

    def __init__(self, pieces: dict[bytes, int]) -> None:
        self.end = len(pieces)
        self.marks = beginnings(pieces)
        self.marks[self.end] = True
        of = [b""] * (self.end + 1)
        for piece, i in pieces.items():
            of[i] = piece.removeprefix(b" ")
        self.pieces = pa.array(of, pa.binary())

    def __call__(self, ids: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words and pieces (the end is empty), the number among them of each word and end in ``ids``, and how many ids that has.

        A word of one id has the id as its number; the others come after all pieces.
        """
        starts = np.flatnonzero(self.marks[ids])
        lengths = np.diff(np.append(starts, len(ids)))
        number, several = ids[starts].astype(np.int64), np.flatnonzero(lengths > 1)
        own = self.pieces.take(pa.array(gather(ids, starts[several], lengths[several])))
        offsets = np.append(0, np.cumsum(lengths[several])).astype(np.int32)
        found = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), own), b"").dictionary_encode()
        number[several] = found.indices.to_numpy() + (self.end + 1)
        return pa.concat_arrays([self.pieces, found.dictionary]), number, lengths


def packed(end: int) -> type:
    """The kind of number that ids are staged as."""
    return np.uint16 if end < 2**16 else np.uint32


def code_texts(docs: DataFrame, pieces: object, pattern: str) -> DataFrame:
    """doc_id, held_out and ids of every row of ``docs``: the text's ids and its end as little-endian numbers. Between them are rows of
    word and n, which sum up to the counts over the training documents; their ids are null."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, counts = WordIds(pieces.value, pattern), len(pieces.value), []
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "ids": pa.binary(), "word": pa.binary(), "n": pa.int64()}

        def frame(columns: dict[str, pa.Array]) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(size, kind)) for name, kind in kinds.items()], names=list(kinds))

        def counted() -> pa.RecordBatch:
            table = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            counts.clear()
            return frame({"word": table["word"].combine_chunks(), "n": table["n_sum"].combine_chunks()})

        for batch in batches:
            for part in text_steps(batch, most=CODED):
                coded = Coded(part.column("text"), words, end)
                ids = coded.ids.astype(packed(end))
                offsets = (np.append(0, np.cumsum(coded.per_doc)) * ids.itemsize).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield frame({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "ids": column})
                counts.append(coded.counts(~part.column("held_out").to_numpy(zero_copy_only=False)))
                if sum(map(len, counts)) > 2 * KEPT:
                    yield counted()
        if counts:
            yield counted()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), text_or_empty(docs).alias("text"))
    return rows.mapInArrow(code, "doc_id long, held_out boolean, ids binary, word binary, n long")


def unpacked(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    kind = np.dtype(packed(end))
    ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return ids.astype(np.int32), np.diff(offsets).astype(np.int64) // kind.itemsize


def count_ids(training: DataFrame, end: int) -> np.ndarray:
    """How often each id is in the texts of ``training`` (ids), the end last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(end + 1, np.int64)
        for batch in batches:
            for part in text_steps(batch, "ids", CODED):
                sums += np.bincount(unpacked(part.column("ids"), end)[0], minlength=end + 1)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["id", "n"])

    found = training.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(end + 1, np.int64)
    sums[found["id"].to_numpy()] = found["n"].to_numpy()
    return sums


def classed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each id, the log of its share of the class, and the share of each class, from counts of ids."""
    smooth = counts + 1.0
    order = np.argsort(-smooth, kind="stable")
    own = CLASSES * 3 // 4
    of = np.zeros(len(counts), np.int64)
    of[order[:own]] = np.arange(own)
    rest = order[own:]
    before = np.cumsum(smooth[rest]) - smooth[rest]
    of[rest] = own + np.minimum(before * (CLASSES - own) / max(smooth[rest].sum(), 1.0), CLASSES - own - 1).astype(np.int64)
    weight = np.bincount(of, smooth, CLASSES)
    return of, np.log(smooth / weight[of]), np.maximum(weight, 1e-9) / weight.sum()


class Model:
    """Parameters of the attention model, all in one vector."""

    def __init__(self, shares: np.ndarray) -> None:
        d = WIDTH
        self.shapes = {"embed": (INPUTS, d), "place": (WINDOW, WINDOW), "query": (d, d), "key": (d, d), "value": (d, d), "out": (d, CLASSES), "bias": (CLASSES,)}
        random = np.random.default_rng(7)
        first = {name: random.normal(0, 0.3, shape) for name, shape in self.shapes.items()}
        first |= {"place": np.zeros((WINDOW, WINDOW)), "out": random.normal(0, 0.01, (d, CLASSES)), "bias": np.log(shares)}
        self.vector = np.concatenate([first[name].ravel() for name in self.shapes]).astype(np.float32)

    def parts(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = math.prod(shape)
            out[name] = vector[at : at + size].reshape(shape)
            at += size
        return out


#: What a place sees: itself and the ids before it. Scores and logits are held within limits in which exponentials are safe.
SEEN, LIMIT = np.tri(WINDOW, dtype=np.float32), 60.0
#: Exponentials are powers of two, which numpy has faster.
BITS = 1 / math.log(2)
#: Windows whose attention, rows whose classes and parameters whose steps are computed at a time: what the cache holds.
SOME_WINDOWS, SOME_ROWS, SOME_PARAMETERS = 64, 384, 16_384


class Ready:
    """What all windows need of the parameters: scores and logits count in bits, the bias is the last row of ``out``."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.embed, self.mix, self.value = p["embed"], p["query"] @ p["key"].T, p["value"]
        self.asks = self.mix * BITS
        self.place = p["place"] * BITS
        #: The factor of what a place sees, 0 for what it does not.
        self.factor = np.exp2(np.clip(self.place, -LIMIT * BITS, LIMIT * BITS)) * SEEN
        self.head = {"out": np.vstack([p["out"], p["bias"]]) * BITS}
        self.from_out, self.from_mix, self.from_value = (np.ascontiguousarray(part.T) for part in (p["out"], self.mix, self.value))
        self.ones = np.ones(CLASSES, p["out"].dtype)


def safe(sums: np.ndarray) -> bool:
    """Whether sums of exponentials show that none of them was too large, and that those too small do not matter."""
    return not len(sums) or bool(1e-18 < sums.min() and sums.max() < 1e18)


def forward(p: dict[str, np.ndarray], ids: np.ndarray, first: int, ready: "Ready | None" = None) -> dict[str, np.ndarray]:
    """What attention makes of each id from ``first`` on, for a batch of windows, and what the gradient needs."""
    ready = ready or Ready(p)
    x = ready.embed.take(ids, 0)
    across = np.ones((len(ids), WIDTH + 1, WINDOW), x.dtype)
    across[:, :WIDTH] = x.transpose(0, 2, 1)
    own = x[:, first:].reshape(-1, WIDTH)
    asks = (own @ ready.asks).reshape(len(ids), -1, WIDTH)

    seen = asks @ across[:, :WIDTH]
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp2(seen, out=seen)
        seen *= ready.factor[first:]
        sums = seen.reshape(-1, WINDOW) @ np.ones(WINDOW, x.dtype)
    if not safe(sums):
        seen = np.clip(asks @ across[:, :WIDTH] + ready.place[first:], -LIMIT * BITS, LIMIT * BITS)
        np.exp2(seen, out=seen)
        seen *= SEEN[first:]
        sums = seen.reshape(-1, WINDOW) @ np.ones(WINDOW, x.dtype)
    scale = (1 / sums)[:, None]
    read = (seen @ x).reshape(-1, WIDTH)
    read *= scale
    full = np.ones((len(own), WIDTH + 1), x.dtype)
    np.add(read @ ready.value, own, out=full[:, :WIDTH])
    return {"x": x, "across": across, "own": own, "asks": asks, "seen": seen, "scale": scale, "read": read, "full": full, "hidden": full[:, :WIDTH]}


def logits_of(p: dict[str, np.ndarray], hidden: np.ndarray) -> np.ndarray:
    """Logits of the classes; where there is no bias, it is the last row of ``out``."""
    logits = hidden @ p["out"]
    if "bias" in p:
        logits += p["bias"]
    return logits


def log_shares(ready: Ready, hidden: np.ndarray, target: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logs of the probabilities of each target class and of an id that begins a word. ``begins`` has the sums' weights: ones, and the share of each class that begins one."""
    spots = np.arange(0, len(hidden) * CLASSES, CLASSES) + target

    def found(limit: float) -> tuple[np.ndarray, np.ndarray]:
        chosen, sums = np.empty(len(hidden), hidden.dtype), np.empty((len(hidden), 2), hidden.dtype)
        for at in range(0, len(hidden), SOME_ROWS):
            rows = slice(at, at + SOME_ROWS)
            logits = logits_of(ready.head, hidden[rows])
            if limit < math.inf:
                np.clip(logits, -limit, limit, out=logits)
            chosen[rows] = logits.ravel()[spots[rows] - at * CLASSES]
            sums[rows] = np.exp2(logits, out=logits) @ begins
        return chosen, sums

    with np.errstate(over="ignore", invalid="ignore"):
        chosen, sums = found(math.inf)
    if not safe(sums[:, 0]):
        chosen, sums = found(LIMIT * BITS)
    sums += np.float32(1e-30)
    np.log2(sums, out=sums)
    return (chosen - sums[:, 0]) / BITS, (sums[:, 1] - sums[:, 0]) / BITS


def add_gradient(ready: Ready, ids: np.ndarray, target: np.ndarray, part: np.ndarray, first: int, out: dict[str, np.ndarray], d_x: np.ndarray) -> None:
    """Adds the gradient of some windows to ``out`` and puts that of their input vectors into ``d_x``. No place before ``first`` has a weight."""
    f = forward({}, ids, first, ready)
    part, target = part[:, first:].ravel(), target[:, first:].ravel()
    # Places without a weight have no loss, so they need no logits.
    use = np.flatnonzero(part)
    hidden, weight = f["full"].take(use, 0), part[use]
    spots = np.arange(0, len(use) * CLASSES, CLASSES) + target[use]
    d_hidden = np.zeros_like(f["own"])
    found = d_hidden if len(use) == len(d_hidden) else np.empty_like(d_hidden[: len(use)])
    for at in range(0, len(use), SOME_ROWS):
        rows = slice(at, at + SOME_ROWS)
        share = logits_of(ready.head, hidden[rows])
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp2(share, out=share)
            sums = share @ ready.ones
        if not safe(sums):
            share = logits_of(ready.head, hidden[rows])
            share -= share.max(1, keepdims=True)
            np.exp2(share, out=share)
            sums = share @ ready.ones
        np.subtract.at(share.reshape(-1), spots[rows] - at * CLASSES, sums)
        own = (weight[rows] / sums)[:, None]
        out["out"] += (hidden[rows] * own).T @ share
        np.multiply(share @ ready.from_out, own, out=found[rows])
    if found is not d_hidden:
        d_hidden[use] = found
    d_own = d_hidden @ ready.from_value
    d_own *= f["scale"]
    d_read = np.empty((len(d_hidden), WIDTH + 1), d_hidden.dtype)
    d_read[:, :WIDTH] = d_own
    # Of the attention's own part in each place, this is the sum over what the place sees.
    d_read[:, WIDTH] = (d_own * f["read"]) @ -np.ones(WIDTH, d_read.dtype)
    d_read = d_read.reshape(len(ids), -1, WIDTH + 1)
    d_seen = d_read @ f["across"]
    d_seen *= f["seen"]
    d_asks = (d_seen @ f["x"]).reshape(-1, WIDTH)
    out["place"][first:] += (np.ones(len(ids), d_seen.dtype) @ d_seen.reshape(len(ids), -1)).reshape(-1, WINDOW)
    out["value"] += f["read"].T @ d_hidden
    out["mix"] += f["own"].T @ d_asks
    np.matmul(f["seen"].transpose(0, 2, 1), d_own.reshape(f["asks"].shape), out=d_x)
    f["asks"] *= 1 / BITS
    d_x += d_seen.transpose(0, 2, 1) @ f["asks"]
    d_hidden += d_asks @ ready.from_mix
    d_x[:, first:] += d_hidden.reshape(len(ids), -1, WIDTH)


def gradient(p: dict[str, np.ndarray], ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean loss of the targets (classes) that have a weight."""
    ready = Ready(p)
    # Most windows have no weight before their stride; those that have stand last.
    early = weight[:, : WINDOW - STRIDE].any(1)
    order, late = np.argsort(early, kind="stable"), len(early) - np.count_nonzero(early)
    ids, target, part = ids[order], target[order], weight[order] / max(weight.sum(), 1.0)
    kind = p["embed"].dtype
    sums = {"out": np.zeros((WIDTH + 1, CLASSES), kind), "place": np.zeros((WINDOW, WINDOW), kind), "value": np.zeros((WIDTH, WIDTH), kind), "mix": np.zeros((WIDTH, WIDTH), kind)}
    d_x = np.empty((*ids.shape, WIDTH), kind)
    for start, end, first in ((0, late, WINDOW - STRIDE), (late, len(ids), 0)):
        for at in range(start, end, SOME_WINDOWS):
            some = slice(at, min(at + SOME_WINDOWS, end))
            add_gradient(ready, ids[some], target[some], part[some], first, sums, d_x[some])
    out = {"place": sums["place"], "value": sums["value"], "out": sums["out"][:WIDTH], "bias": sums["out"][WIDTH]}
    out |= {"query": sums["mix"] @ p["key"], "key": sums["mix"].T @ p["query"]}
    order = np.argsort(ids.astype(np.uint16).ravel(), kind="stable")
    own = ids.ravel()[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    embed = np.zeros_like(p["embed"])
    # Two neighbours are summed as one complex number, which halves the sums.
    pairs = d_x.reshape(-1, WIDTH).take(order, 0).view(np.result_type(kind, np.complex64))
    embed[own[first]] = np.add.reduceat(pairs, first, axis=0).view(kind)
    out["embed"] = embed
    return out


class Training:
    """A copy of the parameters in one pass over windows, by Adam."""

    def __init__(self, model: Model, start: np.ndarray) -> None:
        self.model, self.vector, self.step, self.windows = model, start.copy(), 0, 0
        self.m, self.v = np.zeros_like(start), np.zeros_like(start)

    def learn(self, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        for at in range(0, len(ids), TRAIN_BATCH):
            part = slice(at, at + TRAIN_BATCH)
            found = gradient(self.model.parts(self.vector), ids[part], target[part], weight[part])
            g = np.concatenate([found[name].ravel() for name in self.model.shapes]).astype(np.float32, copy=False)
            self.step += 1
            # Sums without the factors 0.1 and 0.01, which go into the rate.
            shrink = math.sqrt(0.01 / (1 - 0.99**self.step))
            rate = RATE / math.sqrt(1 + self.step / 50) * 0.1 / (1 - 0.9**self.step) / shrink
            for some in range(0, len(g), SOME_PARAMETERS):
                m, v, own, vector = (x[some : some + SOME_PARAMETERS] for x in (self.m, self.v, g, self.vector))
                m *= 0.9
                m += own
                v *= 0.99
                own *= own
                v += own
                np.sqrt(v, out=own)
                own += 1e-6 / shrink
                np.divide(m, own, out=own)
                own *= rate
                vector -= own
        self.windows += len(ids)


def windows(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over documents, the ids of all one after the other: places of what each window reads, of what it predicts, and which predictions count.

    What is read at a place predicts the id after it; the first id is predicted from the end before the document. A document's last window is laid so
    that it ends with the document; places before the document's start read as the end.
    """
    return laid(*spans(sizes))


def spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window over documents: the size and the start of its document, and from where to where it predicts, counted from that start."""
    counts = np.where(sizes <= WINDOW, 1, -(-(sizes - WINDOW) // STRIDE) + 1)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts, own = np.repeat(np.cumsum(sizes) - sizes, counts), np.repeat(sizes, counts)
    # The first window also scores what is before its stride.
    first = np.where(number == 0, 0, np.minimum(WINDOW + (number - 1) * STRIDE, own))
    return own, starts, first, np.minimum(WINDOW + number * STRIDE, np.maximum(own, 1))


def laid(sizes: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of which ``spans`` gives the places."""
    begin = np.where(first == 0, 0, last - WINDOW)
    at = np.arange(WINDOW)
    counts_for = (at >= (first - begin)[:, None]) & (at < (np.minimum(last, sizes) - begin)[:, None])
    read = (starts + begin - 1)[:, None] + at
    predicted = np.where(counts_for, read + 1, 0)
    read[(at < (1 - begin)[:, None]) | (at > (sizes - begin)[:, None])] = -1
    return read, predicted, counts_for


class Coding:
    """What turns a word's ids into the model's input and target classes. The end has the id after the last piece."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray) -> None:
        self.end = len(counts) - 1
        self.target, self.within, self.shares = classed(counts)
        #: The share of each class that begins a word or ends the text.
        self.begins = np.bincount(self.target, np.exp(self.within) * begins, CLASSES).astype(np.float32)
        own = np.argsort(-counts, kind="stable")[: INPUTS - CLASSES]
        self.input = INPUTS - CLASSES + self.target
        self.input[own] = np.arange(len(own))


def training_windows(ids: np.ndarray, sizes: np.ndarray, coding: Coding, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input ids, target classes and weights of the windows of a round, mixed. What a window predicts gives its round, so that every id is predicted once in all."""
    places = spans(sizes)
    own_sizes, starts, first, last = places
    sums = np.append(0, np.cumsum(ids, dtype=np.int64))
    own = np.flatnonzero((sums[starts + np.minimum(last, own_sizes)] - sums[starts + first]) % ROUNDS == turn)
    order = np.random.default_rng(len(own)).permutation(own)
    read, predicted, counts_for = laid(*(of[order] for of in places))
    return coding.input[np.where(read >= 0, ids[read], coding.end)], coding.target[ids[predicted]], counts_for.astype(np.float32)


def train(training: DataFrame, coding: Coding) -> np.ndarray:
    """The model's parameters, averaged over the tasks' copies in every round. Learned from the texts of ``training`` (ids)."""
    model = Model(coding.shares)
    vector = model.vector

    def learn(start: object, turn: int):
        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            copy = Training(model, start.value)
            for batch in batches:
                for part in text_steps(batch, "ids", CODED):
                    ids, sizes = unpacked(part.column("ids"), coding.end)
                    ends = np.cumsum(sizes)
                    for first, last in steps(sizes.tolist(), IDS):
                        copy.learn(*training_windows(ids[ends[first] - sizes[first] : ends[last - 1]], sizes[first:last], coding, turn))
            if not copy.windows:
                return
            found = copy.vector
            n = np.full(len(found), float(copy.windows))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(n), pa.array(found.astype(float) * n)], names=["at", "n", "x"])

        return fit

    for turn in range(ROUNDS):
        copies = training.mapInArrow(learn(training.sparkSession.sparkContext.broadcast(vector), turn), "at long, n double, x double")
        mean = copies.groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        if mean.num_rows:
            vector = np.zeros_like(vector)
            vector[mean["at"].to_numpy()] = mean["x"].to_numpy()
    return vector


def model_logs(ids: np.ndarray, sizes: np.ndarray, coding: Coding, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For the ids of all documents one after the other: the logs of their probabilities, and of one that begins a word in their place."""
    each, new = coding.within[ids], np.zeros(len(ids))
    ends = np.cumsum(sizes)
    for start, end in steps(sizes.tolist(), IDS):
        own = slice(ends[start] - sizes[start], ends[end - 1])
        of_documents(ids[own], sizes[start:end], coding, p, each[own], new[own])
    return each, new


def of_documents(ids: np.ndarray, sizes: np.ndarray, coding: Coding, p: dict[str, np.ndarray], each: np.ndarray, new: np.ndarray) -> None:
    """Adds the logs of the classes to ``each`` and puts those of a beginning into ``new``."""
    read, predicted, counts_for = windows(ids, sizes)
    inputs = coding.input[np.where(read >= 0, ids[read], coding.end)]
    ready, sums_of = Ready(p), np.column_stack([np.ones(CLASSES, np.float32), coding.begins])
    begins = counts_for[:, 0]  # the first window of a document scores from its start on
    for kind, first in ((begins, 0), (~begins, WINDOW - STRIDE)):
        places = np.flatnonzero(kind)
        for at in range(0, len(places), SCORE_BATCH):
            part = places[at : at + SCORE_BATCH]
            where = predicted[part, first:].ravel()
            hidden, use = forward(p, inputs[part], first, ready)["full"], np.flatnonzero(counts_for[part, first:])
            where = where[use]
            found, new[where] = log_shares(ready, hidden.take(use, 0), coding.target[ids[where]], sums_of)
            each[where] += found


def word_logs(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, sizes: np.ndarray, coding: Coding, p: dict[str, np.ndarray]) -> np.ndarray:
    """The log of the probability by attention of each word of ``lengths`` ids, and of the ends, which are marked."""
    each, new = model_logs(ids, sizes, coding, p)
    first = np.cumsum(lengths) - lengths
    out = totals(each, lengths) - new[first]
    out[~ends] += new[first[np.flatnonzero(~ends) + 1]]
    return np.minimum(out, 0.0)


def score(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text), other columns being ignored.

    Learned from the rows that are not ``held_out``. Tokens are the words, white space being that of ASCII, and one end; subword ids are those of each word
    after a space by the file ``ranks``. A null or empty text has only the end. Every row gives one row, repeated rows and null doc_ids too; an empty
    table gives none. Without any training row all counts are zero.
    """
    spark = docs.sparkSession
    pattern = pattern or public_tokenizers.PATTERN
    table = read_pieces(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces, end = spark.sparkContext.broadcast(table), len(table)
    found = staged(code_texts(docs, pieces, pattern), "coded-texts")
    counts = staged(found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    coded = found.where("ids is not null").select("doc_id", "held_out", "ids")
    training = coded.where(~coded["held_out"]).select("ids")
    sums = count_ids(training, end)
    ends = int(sums[end])
    words, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = (words or 0) + ends
    base = math.log10(total + distinct + (ends > 0) + 1)
    begins = beginnings(table)
    begins[end] = True
    coding = Coding(sums, begins)
    vector = train(training, coding)
    known = most_frequent(counts, frequent)
    shared = spark.sparkContext.broadcast((known["word"].combine_chunks(), known["n"].to_numpy(), vector))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n_of, parameters = shared.value
        words, p = Words(pieces.value), Model(coding.shares).parts(parameters)
        n_of = np.append(n_of, 0)
        row = TaskContext.get().partitionId() << 40

        def frame(*columns: object) -> pa.RecordBatch:
            fields = ["row", "word", "log", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
            kinds = [pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=fields)

        for batch in batches:
            for part in text_steps(batch, "ids", CODED):
                ids, per_doc = unpacked(part.column("ids"), end)
                own, number, lengths = words(ids)
                place = pc.index_in(own, value_set=names).fill_null(-1).to_numpy()
                # Counts of words and ends; words that are not at hand are left to the join.
                c, far = n_of[place], place < 0
                c[end], far[end] = ends, False
                own_log, there, is_end = np.log10(c + 1) - base, far[number], number == end
                sizes = np.diff(np.flatnonzero(is_end), prepend=-1)
                logs = word_logs(ids, lengths, is_end, per_doc, coding, p)
                mixed = np.log10(ATTENTION * np.exp(logs) + (1 - ATTENTION) * (10.0**own_log)[number])
                rows = row + np.arange(len(sizes), dtype=np.int64)
                row += len(sizes)
                nothing = [None] * len(sizes)
                sums_of = [totals(np.where(there, 0, x), sizes) for x in ((c > 0)[number], own_log[number], mixed)]
                yield frame(rows, nothing, nothing, part.column("doc_id"), part.column("held_out"), sizes, sums_of[0].astype(np.int64), *sums_of[1:])
                # Other words meet their counts, each occurrence with its own probability.
                rest = own.take(pa.array(number[there]))
                nothing = [None] * len(rest)
                yield frame(np.repeat(rows, sizes)[there], rest, logs[there], *[nothing] * 6)

    fields = "row long, word binary, log double, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    weighed = coded.mapInArrow(weigh, fields)
    # Rows of documents have no word; a key that is no word deals them out.
    key = F.coalesce("word", F.concat(F.lit(b" "), F.col("row").cast("string").cast("binary")))
    joined = weighed.withColumn("key", key).join(counts.select(F.col("word").alias("key"), F.col("n").alias("c")).hint("merge"), "key", "left")
    is_word, c = F.col("word").isNotNull(), F.coalesce("c", F.lit(0))
    own_log = F.log10(c + 1) - F.lit(base)
    mixed = F.log10(ATTENTION * F.exp("log") + (1 - ATTENTION) * F.pow(F.lit(10.0), own_log))
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_word, (c > 0).cast("long")).otherwise(F.col("n_known"))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.sum(F.when(is_word, own_log).otherwise(F.col("base_score"))).alias("base_score"),
        F.sum(F.when(is_word, mixed).otherwise(F.col("score"))).alias("score"),
    )
    return out.drop("row")
