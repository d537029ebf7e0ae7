"""Scores, toxicity, quality rules and languages against plain loops, and on held-out rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
from newsloom.llm import language_id, lm_scoring, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def test_base_scores_and_windows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(90001, None), (90002, ""), (None, "the of")], "doc_id long, text string"))
    rows, counts, ends = docs.collect(), collections.Counter(), 0

    def held(doc_id):
        return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2

    for doc_id, text in rows:
        if not held(doc_id):
            counts.update(lm_scoring.normal(text or ""))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    got = {r.doc_id: r for r in lm_scoring.score(docs, frequent=2000).collect()}
    for doc_id, text in rows:
        words = lm_scoring.normal(text or "")
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(counts[w] for w in words), ends])
        row = got[doc_id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total)
        assert row.held_out == held(doc_id) and abs(row.base_score - base) < 1e-6 * abs(base) and row.score < 0
    assert lm_scoring.score(docs.limit(0)).count() == 0
    sizes = np.array([1, 5, 32, 33, 40, 56, 57, 100, 300])
    read, predicted, use = lm_scoring.windows(np.arange(sizes.sum()), sizes)
    assert sorted(predicted[use].tolist()) == list(range(sizes.sum()))
    assert ((predicted[use] - 1 == read[use]) | (read[use] == -1)).all()


def test_every_id_is_trained_on_once():
    docs = [(i, f"d{i} " + " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([0, 1, 3, 9, 20, 40, 150, 600])] + [(50, None), (51, "")]
    training = [text or "" for doc_id, text in docs if zlib.crc32(str(doc_id).encode()) % 7 != 2]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        end = sum(1 for _ in f)
    code = lm_scoring.WordIds(lm_scoring.read_pieces(path), public_tokenizers.PATTERN)
    coded = lm_scoring.Coded(training, code, end)
    want = [i for text in training for i in [*code(lm_scoring.normal(text))[0].tolist(), end]]
    assert coded.ids.tolist() == want and coded.per_doc.sum() == len(want)
    counts = np.bincount(want, minlength=end + 1)
    coding = lm_scoring.Coding(counts, np.ones(end + 1))
    coding.target = np.arange(end + 1)
    seen = collections.Counter()
    for turn in range(lm_scoring.ROUNDS):
        _, target, weight = lm_scoring.training_windows(coded.ids, coded.per_doc, coding, turn)
        seen.update(target[weight > 0].tolist())
    assert seen == collections.Counter(want)


def test_ids_of_words_are_kept_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(lm_scoring, "KEPT", 40)
    pieces = lm_scoring.read_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    code, plain = (lm_scoring.WordIds(pieces, public_tokenizers.PATTERN) for _ in range(2))
    rnd, most = random.Random(3), 0
    for _ in range(60):
        words = [f"wörd{rnd.randrange(90)}!".encode() for _ in range(rnd.randrange(15))]
        words = list(dict.fromkeys(words))
        ids, lengths = code(words)
        assert ids.dtype == np.int64 and ids.tolist() == [i for word in words for i in plain.encode(" " + word.decode())]
        assert lengths.tolist() == [len(plain.encode(" " + word.decode())) for word in words]
        most = max(most, len(code.place))
    assert 40 < most <= 55


def test_places_without_weight_do_not_matter_to_the_gradient():
    rnd = np.random.default_rng(2)
    model = lm_scoring.Model(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES))
    p = {name: part.astype(float) for name, part in model.parts(model.vector).items()}
    ids, target = rnd.integers(0, 50, (5, lm_scoring.WINDOW)), rnd.integers(0, lm_scoring.CLASSES, (5, lm_scoring.WINDOW))
    weight = (rnd.random(ids.shape) < 0.7).astype(float)

    def loss():
        logits = lm_scoring.logits_of(p, lm_scoring.forward(p, ids, 0)["hidden"])
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return -(logits[np.arange(len(logits)), target.ravel()] * weight.ravel()).sum() / weight.sum()

    found = lm_scoring.gradient(p, ids, target, weight)
    for name, part in p.items():
        places = [tuple(rnd.integers(0, n) for n in part.shape) for _ in range(6)]
        for at in [(int(ids[0, 0]), 3)] if name == "embed" else places:
            was, sides = part[at], []
            for step in (1e-5, -1e-5):
                part[at] = was + step
                sides.append(loss())
            part[at] = was
            assert abs((sides[0] - sides[1]) / 2e-5 - found[name][at]) < 1e-6
    assert lm_scoring.gradient(p, ids, target, weight * 0)["out"].any() == 0


def test_places_without_weight_get_no_logits(monkeypatch):
    """Only places with a weight are given logits; large logits are safe, and a step is that of Adam."""
    rnd = np.random.default_rng(6)
    model = lm_scoring.Model(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES))
    ids, target = rnd.integers(0, 50, (9, lm_scoring.WINDOW)), rnd.integers(0, lm_scoring.CLASSES, (9, lm_scoring.WINDOW))
    weight = (rnd.random(ids.shape) < 0.7).astype(np.float32)
    asked, real = [], lm_scoring.logits_of
    monkeypatch.setattr(lm_scoring, "logits_of", lambda p, hidden: asked.append(len(hidden)) or real(p, hidden))
    found = lm_scoring.gradient(model.parts(model.vector), ids, target, weight)
    assert asked == [int(weight.sum())]
    copy = lm_scoring.Training(model, model.vector)
    copy.learn(ids, target, weight)
    g = np.concatenate([found[name].ravel() for name in model.shapes])
    assert np.allclose(copy.vector, model.vector - lm_scoring.RATE / math.sqrt(1.02) * g / (np.abs(g) + 1e-6), atol=1e-5)
    p = model.parts(model.vector.copy())
    p["out"] *= 1e5
    assert all(np.isfinite(part).all() for part in lm_scoring.gradient(p, ids, target, weight).values())


def test_texts_are_coded_once(spark, tmp_path):
    """Scoring reads the ids that were staged, not the texts again."""
    rows = [(i, f"Word{i % 7} and  more\u00a0of it\n") for i in range(40)] + [(40, None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    scored = lm_scoring.score(spark.read.parquet(path))
    assert scored.inputFiles() and not [name for name in scored.inputFiles() if "documents.parquet" in name]
    assert {r.doc_id: r.n_tokens for r in scored.collect()} == {i: len((text or "").encode().split()) + 1 for i, text in rows}


def test_words_come_back_from_their_ids():
    pieces = lm_scoring.read_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    code, alone = (lm_scoring.WordIds(pieces, public_tokenizers.PATTERN) for _ in range(2))
    words, rnd = lm_scoring.Words(pieces), random.Random(8)
    odd = ["The", "don't", "x\u00a0y", "\u00a0", "a\x85", "\x1c\x1f", "\u2003z", "ÄÖß", "İ", "<|endoftext|>", "日本語", "1234567", "https://a.b/c?d=e", "e\u0301", "\ufffd", "…"]
    texts = ["".join(rnd.choice(odd) + rnd.choice([" ", "  ", "\n", "\t\r", "\x0b", "\x0c"]) for _ in range(rnd.randrange(9))) for _ in range(80)]
    texts += ["", " ", "\n lead", "trail \t", *odd]
    coded = lm_scoring.Coded(texts, code, len(pieces))
    want = [lm_scoring.normal(text) for text in texts]
    assert coded.per_doc.tolist() == [1 + sum(len(alone.encode(" " + word.decode())) for word in own) for own in want]
    assert coded.ids.tolist() == [i for own in want for i in [*(i for word in own for i in alone.encode(" " + word.decode())), len(pieces)]]
    own, number, lengths = words(coded.ids)
    assert own.take(number).to_pylist() == [word for words_of in want for word in [*words_of, b""]] and lengths.sum() == len(coded.ids)
    counted = np.arange(len(texts)) % 3 > 0
    counts = coded.counts(counted).to_pydict()
    assert dict(zip(*counts.values(), strict=True)) == collections.Counter(word for own, use in zip(want, counted, strict=True) if use for word in own)


def test_large_scores_and_logits_stay_within_limits():
    rnd = np.random.default_rng(5)
    model = lm_scoring.Model(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES))
    ids, target = rnd.integers(0, 50, (4, lm_scoring.WINDOW)), rnd.integers(0, lm_scoring.CLASSES, 4 * (lm_scoring.WINDOW - 8))
    begins = rnd.random(lm_scoring.CLASSES).astype(np.float32)
    for size in (1.0, 40.0, 4000.0):
        p = model.parts(model.vector.copy())
        p["query"] *= size
        p["out"] *= size
        x = p["embed"][ids].astype(float)
        scores = np.clip((x @ p["query"])[:, 8:] @ (x @ p["key"]).transpose(0, 2, 1), -60, 60)
        seen = np.exp(scores) * np.tri(lm_scoring.WINDOW)[8:]
        hidden = (x[:, 8:] + seen / seen.sum(2, keepdims=True) @ (x @ p["value"])).reshape(-1, lm_scoring.WIDTH)
        ready = lm_scoring.Ready(p)
        found = lm_scoring.forward(p, ids, 8, ready)
        assert np.allclose(found["hidden"], hidden, atol=1e-3)
        logits = np.clip(found["hidden"].astype(float) @ p["out"] + p["bias"], -60, 60)
        log_sums = np.log(np.exp(logits).sum(1))
        both = lm_scoring.log_shares(ready, found["full"], target, np.column_stack([np.ones_like(begins), begins]))
        assert np.allclose(both[0], logits[np.arange(len(target)), target] - log_sums, atol=1e-2)
        assert np.allclose(both[1], np.log(np.exp(logits) @ begins) - log_sums, atol=1e-2)


def test_automaton_is_edit_distance():
    terms, rnd = ["idiot", "worthless", "scum", "disgusting", "moron"], random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    def edits(term):
        return next((n for length, n in toxicity.EDITS if len(term) >= length), 0)

    lexicon = toxicity.Lexicon(terms)
    for _ in range(1500):
        word = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            word.insert(rnd.randrange(len(word) + 1), rnd.choice("abio"))
            if rnd.random() < 0.6:
                del word[rnd.randrange(len(word))]
        word = "".join(word)
        want = min((d for t in terms if (d := distance(word, t)) <= edits(t)), default=-1)
        assert lexicon.distance(word) == want


def test_toxic_documents_are_found(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    clean = [r.predicted for r in rows if r.held_out and r.toxic == 0]
    found = [r.predicted for r in rows if r.held_out and r.toxic == 1]
    assert sum(clean) <= 1 and sum(found) * 2 >= len(found)
    small = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "idiot", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(small, none).collect()] == [0, 0, 0]
    assert toxicity.drop_toxic(small, none).count() == 3 and toxicity.score(small.limit(0), none).count() == 0


def test_quoted_matches_count_apart():
    matcher = toxicity.Matcher(["idiot"], [])
    assert matcher.features("you are an idiot") == (1.0, 0.0)
    assert matcher.features('he said "what an idiot" and left') == (0.0, 1.0)
    assert matcher.features("you ldiot") == (toxicity.MISSPELLED, 0.0)


def test_base_rules(spark):
    texts = [None, "", "one", "a b c a b c\na b c\n\na b c\n \n \n", "\n".join(["# x | y"] * 30), " ".join(f"w{i}" for i in range(200)), "é x\x1cy z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for doc_id, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, again = set(), 0
        for line in text.split("\n"):
            again += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
            seen.add(line)
        runs = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        row = got[doc_id]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == want
    assert got[5].kept and not got[4].kept


def test_coverage_and_verdict_of_repetition():
    rnd = random.Random(4)
    fresh = (f"n{i}" * rnd.randint(1, 3) for i in range(1000, 10**6))

    def prose(n):
        return [next(fresh) for _ in range(n)]

    def ngram_share(text):
        words, lines, place, heading = text.split(), text.split("\n"), 0, set()
        again = {line for line in lines if line.split() and lines.count(line) > 1}
        for line in lines:
            if line in again:
                heading |= set(range(place, place + len(line.split())))
            place += len(line.split())
        chars = [len(w) for w in words]
        short = sum(len(line.split()) for line in again) <= quality_rules.HEADING
        if not short or sum(chars[i] for i in heading) > quality_rules.HEADING_LIMIT * sum(chars):
            heading = set()
        most = 0.0
        for n, limit in quality_rules.NGRAM_LIMITS.items():
            runs = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            covered = {i + k for i in range(len(words) - n + 1) if runs[tuple(words[i : i + n])] > 1 for k in range(n)} - heading
            most = max(most, sum(chars[i] for i in covered) / sum(chars) / limit)
        return most

    texts, heading, passage = [], " ".join(prose(12)), " ".join(prose(14))
    # A heading above and below: kept. One that covers more than a third of its page, or a passage inside lines: not kept.
    texts.append(f"{heading}\n{' '.join(prose(60))}\n{heading}")
    texts.append(f"{heading}\n{' '.join(prose(32))}\n{heading}")
    texts.append(" ".join([*prose(30), passage, *prose(20), passage, *prose(25)]))
    for _ in range(60):
        lines = [" ".join(prose(rnd.randint(1, 14))) for _ in range(rnd.randint(3, 12))]
        lines += rnd.choices(lines, k=rnd.randint(0, 3))
        at = rnd.randrange(len(lines))
        lines[at] += " " + " ".join(lines[0].split()[: rnd.randint(0, 12)])
        rnd.shuffle(lines)
        texts.append("\n".join(lines))
    found = quality_rules.measure(texts)
    want = [ngram_share(text) for text in texts]
    assert np.allclose(found["ngram_share"], want)
    assert found["kept"].tolist() == [bool(not b and s <= 1 and line <= quality_rules.LINE_LIMIT) for b, s, line in zip(found["base_failed"], want, found["line_share"], strict=True)]
    assert found["kept"][:3].tolist() == [True, False, False]
    assert not found["base_failed"][:3].any() and (found["line_share"][:3] <= quality_rules.LINE_LIMIT).all()


def test_languages(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    rows = language_id.languages(pages, docs)
    assert rows.count() == docs.count() + pages.count()
    right = rows.join(docs.selectExpr("doc_id", "lang as known"), "doc_id").where("lang = known").count()
    assert right >= 0.99 * docs.count()
    odd = spark.createDataFrame([(1, None, None), (2, "nohost", ""), (3, "http://a.b.de/x", "<html lang=de><p>der")], "page_id long, url string, html string")
    got = {r.page_id: r for r in language_id.languages(odd, docs).where("page_id is not null").collect()}
    assert got[1].text_lang is None and got[3].lang == "de" and got[3].host == "a.b.de"
    assert language_id.languages(pages.limit(0), docs.limit(0)).count() == 0
