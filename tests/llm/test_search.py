"""Ranked search and whitening against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from newsloom.llm import ranked_search, whitening

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, top):
    counted = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, all_terms = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    df = Counter(term for _, t in counted for term in set(t))
    out = set()
    for item_id in {i for i, _ in items}:
        wanted = Counter(t for i, text in items if i == item_id for t in terms(text))
        scores = []
        for doc_id, t in counted:
            tf, m = Counter(t), 100 - 25 + (25 * len(t) * n_docs) // max(1, all_terms)
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w, k in wanted.items() if tf[w])
            if score:
                scores.append((-score, doc_id))
        out |= {(item_id, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:top], 1)}
    return out


def corpus():
    rnd = random.Random(11)
    words = [f"W{i}" for i in range(300)] + ["é", "日本", "x-y", "Zoë"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([0, 3, 20, 80])))) for i in range(600)]
    docs += [(600 + i, docs[5 * i][1]) for i in range(60)] + [(900, None), (901, ""), (902, "., \n"), (903, "w1 " * 20_000), (904, "İ É K w7")]
    items = [(i, " ".join(rnd.choices(words, weights, k=12))) for i in range(30)]
    items += [(100, None), (101, "unheardof"), (102, "w1 W1 w1"), (103, "é İ"), (102, "w299 é"), (-5, "w0 w2")]
    return docs, items


@pytest.mark.parametrize("top, docs_in_range, bundle", [(20, 8192, 256), (5, 37, 7), (3, 1, 1)])
def test_search_is_exact_whatever_is_dropped_on_the_way(spark, monkeypatch, top, docs_in_range, bundle):
    docs, items = corpus()
    monkeypatch.setattr(ranked_search, "BUNDLE_ITEMS", bundle)
    monkeypatch.setattr(ranked_search, "RANGE_DOCS", docs_in_range)
    small = docs[::12] + docs[-5:] if docs_in_range == 1 else docs
    frame = spark.createDataFrame([(d, t, "clash", 3) for d, t in small], "doc_id long, text string, item_id string, rank int").repartition(4)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(row) for row in ranked_search.search(frame, bench, top).collect()]
    assert len(got) == len(set(got)) and set(got) == ranked(small, items, top)


def test_search_in_several_blocks_of_terms(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 60)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(row) for row in ranked_search.search(frame, bench, 4).collect()} == ranked(docs, items, 4)


def test_search_of_nothing_and_of_rows_without_id(spark):
    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    got = [(r.rank, r.doc_id) for r in ranked_search.search(frame, bench).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 1), (3, None)]
    assert ranked_search.search(frame.limit(0), bench).count() == ranked_search.search(frame, bench.limit(0)).count() == 0


def test_accumulators_that_cannot_win_are_dropped():
    """Of 1000 documents with a frequent word, the bundle keeps few once the rare word has found its 20."""
    import pyarrow as pa

    totals = ranked_search.Totals(1000, 50_000)
    lengths, bounds = np.full(1000, 50), np.array([1, 1, 50, 2, 1, 50])
    state = pa.table([[0], [0], [-1], [lengths], [bounds]], pa.schema(ranked_search._BUNDLE))
    bundles = [{0: [(1, 6000, 0), (2, 10, 1)]}]
    rare = pa.table({"term": [1], "docs": [list(range(25))], "tfs": [[1] * 25]})
    frequent = pa.table({"term": [2], "docs": [list(range(1000))], "tfs": [[1] * 1000]})
    first = ranked_search._owner(0, bundles, totals, 20)(state, rare)
    second = ranked_search._owner(1, bundles, totals, 20)(first, frequent)
    assert [len(x) for x in second.column("docs").to_pylist()] == [1000, 25]


def test_rank_one_updates_give_the_spectrum():
    rng = np.random.default_rng(3)
    for dims, rows in ((16, 300), (5, 40), (1, 6), (3, 2), (4, 1)):
        x = np.floor(rng.normal(size=(rows, dims)) @ rng.normal(size=(dims, dims)) * 100)
        if dims == 5:
            x[:, 2], x[:10] = x[:, 1], x[0]
        x -= x.mean(axis=0)
        spectra = []
        for part in np.array_split(x, 3):
            values, basis = np.zeros(dims), np.eye(dims)
            for row in part:
                values, basis = whitening.rank_one_update(values, basis, row)
            spectra.append((values, basis))
        values, basis = whitening.combine(spectra)
        whole = x.T @ x
        assert np.allclose(basis.T @ basis, np.eye(dims), atol=1e-12)
        assert np.allclose((basis * values) @ basis.T, whole, atol=1e-8 * max(1, np.abs(whole).max()))
        assert np.allclose(values, np.linalg.eigvalsh(whole), atol=1e-8 * max(1, np.abs(whole).max()))


def expected(rows, top=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [int(((n * row - sums) ** 2).sum()) for row in x]
    return n, deviation, centred @ vectors[:, :top] / np.sqrt(values[:top]), values[:top] / values.sum()


def test_whitening_of_rows_that_remain(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 12)) @ rng.normal(size=(12, 12)) / 3
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows[10] = (10, rows[11][1])
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0] * 5), (905, [])]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows + odd], "vec_id long, embedding array<float>, n int, x string").repartition(20)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    n, deviation, white, explained = expected(rows)
    assert len(got) == 500 * 8
    signs = {k: np.sign(sum(got[i, k].whitened * white[i, k - 1] for i in range(500))) for k in range(1, 9)}
    for (i, k), row in got.items():
        assert (row.n, row.deviation) == (n, deviation[i])
        assert row.whitened * signs[k] == pytest.approx(white[i, k - 1], abs=1e-8)
        assert row.explained == pytest.approx(explained[k - 1], rel=1e-10)
        assert 0 <= row.identity_error < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).orderBy("component").collect()][::3] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    line = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], schema)
    got = whitening.whiten(line).orderBy("component", "vec_id").collect()
    assert [r.whitened is None for r in got] == [False] * 4 + [True] * 4 and got[0].identity_error < 1e-12
    far = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0])], schema)
    assert whitening.whiten(far).first().deviation is None
    farther = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1e-40, -0.0])], schema)
    assert sorted(r.whitened for r in whitening.whiten(farther).where("component = 1").collect()) == pytest.approx([-1.5**0.5, 0, 1.5**0.5], abs=1e-6)
    for none in (same.limit(0), spark.createDataFrame([(1, [])], schema), spark.createDataFrame([(1, None)], schema)):
        empty = whitening.whiten(none)
        assert empty.count() == 0 and empty.schema.simpleString() == whitening.whiten(line).schema.simpleString()
