"""Texts cut into units on which byte-level BPE works independently, and their ids, coded once for each distinct unit.

The pre-tokenizer's pattern never matches across the point between a character that is no white space and a space after it. A text cut at
all such points gives units that can be coded alone: the first one, and others that begin with one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with white space before a space; they are cut one by one.
ODD = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
SPACE_AFTER_WORD = re.compile(r"(?<=\S) ")
#: Units in which line breaks, if any, stand alone between other characters than white space.
PLAIN = re.compile(r"\S+(?:\n\S+)*")
#: Units of a word and its marks, which are two matches of the pre-tokenizer's pattern.
WORD = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
#: Units that the library is given in one string.
STRING_UNITS = 5_000



def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, list[str]]:
    """The units of all texts in order, by number; how many units each text has; and the distinct units by number.

    First come those that begin with a space, given without it, then the others, given as they are.
    """
    odd = np.asarray(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False), bool)
    parts = pc.split_pattern(texts, " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    numbers, spaced, sizes = coded.indices.to_numpy().astype(np.int32), coded.dictionary, np.diff(offsets)
    lone, number = np.unique(numbers[offsets[:-1]], return_inverse=True)
    alone = spaced.take(pa.array(lone)).to_pylist()
    if not odd.any():
        numbers[offsets[:-1]] = number + len(spaced)
    else:
        known, others = {unit: at for at, unit in enumerate(spaced.to_pylist())}, {unit: at for at, unit in enumerate(alone)}
        pieces = np.split(numbers, offsets[1:-1])
        for at in np.flatnonzero(odd):
            own = SPACE_AFTER_WORD.split(texts[int(at)].as_py())
            pieces[at] = np.array([0, *(known.setdefault(unit, len(known)) for unit in own[1:])], np.int32)
            number[at] = others.setdefault(own[0], len(others))
            sizes[at] = len(own)
        numbers, spaced, alone = np.concatenate(pieces), pa.array(list(known), pa.string()), list(others)
        numbers[np.cumsum(sizes) - sizes] = number + len(spaced)
    # Units that only odd texts or first places had are dropped.
    used = np.bincount(numbers, minlength=len(spaced) + len(alone)) > 0
    numbers = (np.cumsum(used, dtype=np.int32) - 1)[numbers]
    return numbers, sizes, spaced.filter(pa.array(used[: len(spaced)])), list(compress(alone, used[len(spaced) :]))


def spaced_units(texts: pa.Array) -> pa.Array:
    """All units that begin with a space, without it."""
    numbers, _, spaced, _ = cut(texts)
    return pa.DictionaryArray.from_arrays(pa.array(numbers[numbers < len(spaced)]), spaced)


def plain(unit: str) -> bool:
    """Whether many such units can be coded in one string."""
    return PLAIN.fullmatch(unit) is not None and "<|" not in unit


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of neighbouring values, ``sizes`` at a time."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(sizes))])


class LibraryCoder:
    """Ids of units by the tokenizers library, many plain units in one call."""

    def __init__(self, file: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True
        self.line_break = vocabulary["Ċ"]
        self.model = self.tokenizer.model
        # The pre-tokenizer's characters for the bytes of letters beyond ASCII: those of Latin-1, but for bytes that are no letters there.
        shown = {b: chr(b) if 0xA1 <= b <= 0xFF and b != 0xAD else chr(0x100 + 33 + at) for at, b in enumerate([*range(0x7F, 0xA1), 0xAD])}
        self.letters = {c: "".join(shown.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        # One at a time: the library's results take far more memory than the ids.
        return [np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32) for text in texts]

    def __call__(self, spaced: pa.Array, lone: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, as ``cut`` gives them, one after the other, and how many each has."""
        # Words and marks are coded once, however they stand together; every unit is two runs of ids.
        found = pc.extract_regex(spaced, WORD)
        easy = np.asarray(found.is_valid().to_numpy(zero_copy_only=False), bool)
        found = found.drop_null()
        words, marks = found.field("word").dictionary_encode(), found.field("marks").dictionary_encode()
        rest = spaced.filter(pa.array(~easy)).to_pylist()
        parts = [self.words(words.dictionary.to_pylist()), self.others([], marks.dictionary.to_pylist()), self.others(rest, lone)]
        flat = np.concatenate([ids for ids, _ in parts])
        lengths = np.concatenate([sizes for _, sizes in parts])
        starts = np.cumsum(lengths) - lengths
        runs = np.zeros((len(spaced) + len(lone), 2), np.int64)
        easy = np.append(easy, np.zeros(len(lone), bool))
        runs[easy, 0], runs[easy, 1] = words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary)
        # A unit of another kind is one run; its second one is the empty run that is put at the end.
        runs[~easy, 0] = len(words.dictionary) + len(marks.dictionary) + np.arange(len(rest) + len(lone))
        runs[~easy, 1] = len(lengths)
        starts, lengths = np.append(starts, 0)[runs], np.append(lengths, 0)[runs]
        return gather(flat, starts.ravel(), lengths.ravel()), lengths.sum(1)

    def words(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters after a space."""
        ids: list[int] = []
        lengths = []
        for word in words:
            tokens = self.model.tokenize("Ġ" + (word if word.isascii() else word.translate(self.letters)))
            ids += [token.id for token in tokens]
            lengths.append(len(tokens))
        return np.array(ids, np.uint32), np.array(lengths, np.int64)

    def others(self, spaced: Sequence[str], lone: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for units of any kind."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for units, after_space in ((spaced, True), (lone, False)):
            for start in range(0, len(units), STRING_UNITS):
                ids, sizes = self.some(units[start : start + STRING_UNITS], after_space)
                flat.append(ids)
                lengths.append(sizes)
        return np.concatenate(flat), np.concatenate(lengths)

    def some(self, units: Sequence[str], after_space: bool) -> tuple[np.ndarray, np.ndarray]:
        simple = np.fromiter(map(plain, units), bool, len(units))
        lengths = np.zeros(len(units), np.int64)
        own, run, others = list(compress(units, simple)), np.zeros(0, np.uint32), []
        if own and after_space:
            run = self.encode([" " + " ".join(own)])[0]
            # A space stands only before a unit, so its token begins the unit.
            lengths[simple] = np.diff(np.append(np.flatnonzero(self.begins[run]), len(run)))
        elif own:
            # Line breaks stand alone, so each is a token: one after each unit, others within.
            run = self.encode(["\n".join(own)])[0]
            within = np.array([text.count("\n") for text in own])
            ends = np.append(np.flatnonzero(run == self.line_break), len(run))[np.cumsum(within + 1) - 1]
            run = np.delete(run, ends[:-1])
            lengths[simple] = np.diff(np.append(-1, ends)) - 1
        if not simple.all():
            others = self.encode((" " if after_space else "") + unit for unit in compress(units, ~simple))
            lengths[~simple] = [len(ids) for ids in others]
        out = np.zeros(int(lengths.sum()), np.uint32)
        in_run = np.repeat(simple, lengths)
        out[in_run] = run
        out[~in_run] = np.concatenate([np.zeros(0, np.uint32), *others])
        return out, lengths

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. Each distinct unit is coded once."""
        numbers, sizes, spaced, lone = cut(texts)
        flat, lengths = self(spaced, lone)
        starts = np.cumsum(lengths) - lengths
        return gather(flat, starts[numbers], lengths[numbers]), totals(lengths[numbers], sizes)


class Numbers(dict):
    """Numbers keys in the order in which they are met."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number
