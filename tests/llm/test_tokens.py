"""Token operators against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from newsloom.llm import byte_bpe, token_counts, token_files
from tokenizers import Tokenizer

ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b \n c\t d   e  f <|endoftext|> g<|endoftext|>"), (None, "x y"),
    (5, "a" * 500 + " " + "ab" * 300 + " " + "\n" * 70 + " z"), (6, "😀😀 日本語テキスト don't I'll  "), (7, "hi\x1c there\x1f  ok\x85 z"),
    (8, "élan, naïve; straße. the the\nThe end.\n"), (8, "élan, naïve; straße. the the\nThe end.\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "clash") for d, t in ODD], "doc_id long, text string, row string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_are_the_librarys(docs, library):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, frequent=3).collect())
    assert got == sorted((d or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in ODD)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_files_give_back_what_was_written(docs, library, spark):
    got = token_files.round_trip(docs).collect()
    start = 0
    for row, (doc_id, text) in zip(sorted(got, key=lambda r: r.start), sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens, np.frombuffer(row.ids, "<u4").tolist()) == (doc_id, start, len(ids), ids)
        start += len(ids)
    assert token_files.round_trip(docs.limit(0)).count() == 0


def test_packing_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 3, np.uint32)
    assert token_files.unpack(*token_files.pack(values), len(values)).tolist() == values.tolist()


def test_bpe_is_that_of_the_rank_file(docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.digests(docs, frequent=3).collect()

    def sha(data):
        return hashlib.sha256(data).hexdigest()

    want = []
    for d, t in ODD:
        ids = own.encode_ordinary(t or "")
        want.append((d or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert byte_bpe.encode(docs.limit(0)).count() == 0


def test_every_piece_is_reached_by_merges():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(own._core_bpe.encode_single_piece(piece) == [rank] for piece, rank in ranks.items())
    assert zlib.crc32(b"") == 0


def test_every_piece_is_what_its_bytes_are_merged_to():
    pieces = byte_bpe.read_ranks()
    pairs = byte_bpe.pairs_of(pieces)
    names = {piece: rank for rank, piece in enumerate(pieces)}
    for rank, piece in enumerate(pieces):
        word = [names[bytes([byte])] for byte in piece]
        while len(word) > 1:
            least, at = min((pairs.get(a << byte_bpe.NAME | b, byte_bpe.NONE), i) for i, (a, b) in enumerate(zip(word, word[1:])))
            assert least < byte_bpe.NONE
            word[at : at + 2] = [least]
        assert word == [rank]


def test_every_pair_lies_in_one_of_its_places():
    pieces = byte_bpe.read_ranks()[:2_000]
    pairs = byte_bpe.pairs_of(pieces)
    size = byte_bpe.next_prime(len(pairs) * 5 // 4), byte_bpe.next_prime(len(pairs) * 4 // 3)
    table = byte_bpe.laid_out(pairs, size)
    for key, rank in pairs.items():
        assert key << byte_bpe.NAME | rank in (table[key % size[0]], table[size[0] + key % size[1]])
    assert sum(map(bool, table)) == len(pairs) and byte_bpe.laid_out(pairs, (7, 11)) is None


def test_words_are_folded_and_swept_alike(spark):
    rnd = np.random.default_rng(5)
    words = [bytes(rnd.choice(list(b"abcdeth e\xc3\xa9"), rnd.integers(0, 90)).tolist()) for _ in range(400)]
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks={p: i for i, p in enumerate(byte_bpe.read_ranks())}, special_tokens={})
    frame = spark.createDataFrame([(i, bytearray(word)) for i, word in enumerate(words)], "at long, word binary")
    got = {r["at"]: r["ids"] for r in byte_bpe.encode_words(frame, byte_bpe.read_ranks(), "at").collect()}
    assert got == {i: own._core_bpe.encode_single_piece(word) if word else [] for i, word in enumerate(words)}


def test_plans_do_not_show_the_ranks(docs):
    plan = byte_bpe.digests(docs, frequent=3)._jdf.queryExecution().toString()
    assert len(plan) < 200_000


def test_words_of_any_kind_are_folded_side_by_side():
    rnd = np.random.default_rng(8)
    words = [bytes(rnd.choice(list(b"abcdeth e\xc3\xa9\xff"), rnd.integers(0, 60)).tolist()) for _ in range(3_000)]
    words += [b"", b"a" * 5_001, b"ab" * 3_000, b"aab" * 2_000, "\u65e5\u672c".encode() * 500, bytes(range(256)) * 4, b""]
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks={p: i for i, p in enumerate(byte_bpe.read_ranks())}, special_tokens={})
    merges = byte_bpe.Merges(byte_bpe.read_ranks())
    ids, lengths = merges(words)
    got = [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == [own._core_bpe.encode_single_piece(word) if word else [] for word in words]
    for none in ([], [b""], [b"", b""]):
        ids, lengths = merges(none)
        assert len(ids) == 0 and lengths.tolist() == [0] * len(none)


def test_merges_are_no_interpreted_fold(docs):
    plan = byte_bpe.digests(docs, frequent=3)._jdf.queryExecution().toString()
    assert "lambdafunction" not in plan
