"""The pipeline on a small table, each stage against a loop over what the one before it kept."""

import hashlib
from collections import Counter

import corpus_pipeline
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from newsloom.llm import byte_bpe, near_dedup, toxicity
from test_duplicates import removed

LINE_WORDS = 50


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The labelled documents of the test data, with copies, near copies, passages of items, runs of lines, empty texts and clashing columns planted."""
    path, given = tmp_path_factory.mktemp("tables"), "/root/testdata/sf0.01"
    bench, labels = pd.read_parquet(f"{given}/benchmark.parquet"), pd.read_parquet(f"{given}/labels.parquet")
    docs = pd.read_parquet(f"{given}/documents.parquet")
    docs = docs[docs.doc_id.isin(labels.doc_id) & (docs.text.str.len() < 6_000)]
    texts = docs.text.tolist()
    long = next(t for t in texts if 200 < len(t.split()) < 400)
    words = long.split()
    run = "\n".join(" ".join(words[i : i + 10]) for i in range(0, 100, 10))
    item = bench.text[0]
    extra = [
        long, long, " ".join([*words[:-1], "other"]), "before\n" + run + "\nafter it", "else\n" + run + "\nand more", run, None, "", " \n ",
        "It began so. " + item + " And so it went on.", item.upper(), " ".join(item.split()[: len(item.split()) // 2]),
    ]
    more = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(extra)), "text": extra, "lang": "en", "source": "planted", "n_chars": [len(t or "") for t in extra]})
    docs = pd.concat([docs, more.astype({"doc_id": "int64", "n_chars": "int64"})]).assign(score=1.0, node="clash")
    for name, table in (("documents", docs), ("benchmark", bench), ("labels", labels)):
        spark.createDataFrame(table).repartition(5).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def collected(df):
    return {row.doc_id: row.text for row in df.collect()}


def without_lines(docs):
    gone, kept = removed([(d, t) for d, t in docs.items()], LINE_WORDS), {}
    for doc_id, text in docs.items():
        lines = gone.get(doc_id, set())
        left = text if not lines else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in lines)
        if not lines or left.strip():
            kept[doc_id] = left
    return kept


def firsts(docs):
    """The least doc_id of each group of documents that links join."""
    ids = sorted(docs)
    sets = {d: near_dedup.shingles_of([near_dedup.words_of(docs[d] or "")])[1:] for d in ids}
    group = {d: d for d in ids}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for i, d in enumerate(ids):
        for e in ids[:i]:
            same = near_dedup.words_of(docs[d] or "") == near_dedup.words_of(docs[e] or "") != []
            if same or near_dedup.similarity(sets[d], sets[e]) >= 0.8:
                a, b = find(d), find(e)
                group[max(a, b)] = min(a, b)
    return {d: docs[d] for d in ids if find(d) == d}


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def holds(text, item):
    """Some passage of the text, as long as the item, is like it."""
    words, wanted = (text or "").lower().split(), item.lower().split()
    own = shingles(wanted)
    places = [i for i in range(len(words) - 4) if tuple(words[i : i + 5]) in own]
    for start in {max(0, at - back) for at in places for back in range(len(wanted))}:
        window = shingles(words[start : start + len(wanted)])
        if window and sum((window & own).values()) >= 0.8 * sum((window | own).values()):
            return True
    return False


def test_stages_agree_with_loops(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [row.text for row in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns

    toxic = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    want = {d: t for d, t in collected(docs).items() if d not in toxic}
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:4], (lambda kept: kept, without_lines, firsts, lambda kept: {d: t for d, t in kept.items() if not any(holds(t, i) for i in items)})):
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        before, want = len(want), expected(want)
        assert docs.columns == columns and collected(docs) == want, name
        assert name == "toxicity" and toxic or len(want) < before, name
    # Where lines went, the length of the text was counted anew.
    assert docs.where("source = 'planted' AND text IS NOT NULL AND n_chars <> length(text)").count() == 0

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(byte_bpe.read_ranks())}, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    ids = {d: own.encode_ordinary(t or "") for d, t in want.items()}
    result = corpus_pipeline.run(spark, folder).collect()
    assert len(result) == len(want)
    for row in result:
        own_ids = ids[row.doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(own_ids), sha(" ".join(map(str, own_ids)).encode()))
        assert row.decoded_sha256 == sha((want[row.doc_id] or "").encode())


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
