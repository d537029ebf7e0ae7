"""Language of pages and documents by Bayes' rule: evidence of the text, the declared language, the address and the host.

The posterior of a language is in proportion to its prior on the host, times the likelihood of the text, of the language that the markup declares and of the
address suffix. The text's likelihood is that of its letter sequences, learned from a bounded sample of documents with a known language. Likelihoods of
declarations and suffixes, and the priors of hosts, are counted over all pages with the posterior of the text alone as weight: one page adds to a host what its text
says. Priors are smoothed along a chain: a host falls back on its parent domain, that on its suffix, and that on all pages.

All counts are grouped aggregations with partial sums, so no host's pages meet in one task; what joins the pages are tables of one row for each
host or suffix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import staged, text_steps

#: Documents of each language that are learned from at most, the first by a hash of doc_id, and languages at most.
SAMPLE_ROWS, LANGUAGES = 1_000, 64
#: Letters of a sequence and table size of their hashes.
SEQUENCE, TABLE = 3, 1 << 16
#: What a sequence counts that was never seen.
SMOOTHING = 0.5
#: The part of a text's log likelihood that counts: neighbouring sequences say the same thing, and a text is cut short by this many sequences.
TEMPER, ENOUGH = 0.3, 400
#: Pages that a fallback is worth in a prior, a declaration's or suffix's likelihood.
STRENGTH = 4.0
#: Characters of text scored at a time.
STEP = 2_000_000
#: Elements without text, and other markup.
MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; null where there is none."""
    found = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def parent_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def declared_in(html: Column) -> Column:
    """The language in the attribute of the html element, without its region; null where there is none."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.when(found != "", F.lower(found))


def sequences(text: str) -> np.ndarray:
    """Hashes of all runs of letters, in lower case; other characters count as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    letters = (codes >= 97) & (codes <= 122) | (codes >= 0xC0)
    codes = np.where(letters, codes, 32).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    if len(codes) < SEQUENCE:
        return np.zeros(0, np.int64)
    out = np.zeros(len(codes) - SEQUENCE + 1, np.uint64)
    for k in range(SEQUENCE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - SEQUENCE + 1 + k] + np.uint64(1)
    return ((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % TABLE


def text_of(html: str) -> str:
    return MARKUP.sub(" ", html)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of each sequence in each, from a bounded sample of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    lang = F.lower(docs["lang"].cast("string"))
    known = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), lang.alias("lang"))
    names = sorted(row["lang"] for row in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    # Each row of the chosen languages has an equal chance by its hash; the limits bound what is read.
    chosen = []
    for name in names:
        rows = known.where(F.col("lang") == name).select("doc_id").distinct()
        chosen += [(row["doc_id"], name) for row in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()]
    counts = np.zeros((len(names), TABLE))
    if chosen:
        sample = spark.createDataFrame(chosen, "doc_id long, lang string")
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros((len(names), TABLE), np.int64)
            for batch in batches:
                for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    own[names.index(name)] += np.bincount(sequences(text or ""), minlength=TABLE)
            lang_at, at = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(lang_at), pa.array(at), pa.array(own[lang_at, at])], names=["lang", "at", "n"])

        summed = texts.select("lang", "text").mapInArrow(count, "lang long, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
        counts[summed["lang"].to_numpy(), summed["at"].to_numpy()] = summed["n"].to_numpy()
    smooth = counts + SMOOTHING
    return names, np.log(smooth / smooth.sum(1, keepdims=True))


def with_text_evidence(rows: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` (…, text, is_html) with the log likelihood of the text in each language instead of the text."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(table.T.astype(np.float32).copy())
    kept = [c for c in rows.columns if c not in ("text", "is_html")]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihood = shared.value
        for batch in batches:
            for part in text_steps(batch, most=STEP):
                out = []
                for text, html in zip(part.column("text").to_pylist(), part.column("is_html").to_pylist(), strict=True):
                    seen = sequences(text_of(text) if html else text)
                    mean = likelihood[seen].mean(0, dtype=np.float64) if len(seen) else np.zeros(len(names))
                    out.append((mean * min(len(seen), ENOUGH) * TEMPER).tolist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.list_(pa.float64()))], names=[*kept, "evidence"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return rows.mapInArrow(weigh, f"{fields}, evidence array<double>")


def posterior(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials of ``logs``."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda n, x: n + x)
    return F.transform(weights, lambda x: x / total)


def sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Sums of the text's posterior by language, as an array, for each ``by``."""
    parts = [F.sum(F.get("own", F.lit(k))) for k in range(n)]
    return rows.groupBy(*by).agg(F.array(*parts).alias("sums"))


def smoothed(own: Column, fallback: Column) -> Column:
    """Shares of ``own`` sums, the fallback being worth ``STRENGTH`` pages; the fallback alone where there are none."""
    return F.coalesce(
        F.transform(own, lambda x, k: (x + STRENGTH * F.get(fallback, k)) / (F.aggregate(own, F.lit(0.0), lambda n, y: n + y) + STRENGTH)), fallback
    )


def identify(rows: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` (…, text, is_html, host, declared) with lang, probability and the languages of single pieces of evidence.

    ``text_lang`` is the language of the text alone, null for a text without letters; ``prior_lang`` that of the host's smoothed prior. Of
    equally likely languages the first by name is taken. Nulls in any column are missing evidence. Repeated rows each count. Without any known language, lang is null.
    """
    kept = [c for c in rows.columns if c not in ("text", "is_html")]
    if not names:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("lang", "text_lang", "prior_lang")]
        return rows.select(*kept, *nothing, F.lit(None).cast("double").alias("probability"))
    n = len(names)
    weighed = staged(with_text_evidence(rows, names, table), "text-evidence")
    parent, suffix = parent_of(F.col("host")), suffix_of(F.col("host"))
    weighed = weighed.withColumn("parent", parent).withColumn("suffix", suffix).withColumn("own", posterior(F.col("evidence")))

    # Counts of hosts first; those of parents, suffixes and all come from them.
    hosts = staged(sums(weighed, ["host", "parent", "suffix"], n), "host-sums")
    again = hosts.withColumn("own", F.col("sums"))
    uniform = F.array(*[F.lit(1.0 / n)] * n)
    whole = F.array(*(F.lit(float(x or 0.0)) for x in (sums(again, [], n).first()["sums"] or [0.0] * n)))
    everywhere = smoothed(whole, uniform)
    by_suffix = sums(again, ["suffix"], n).select("suffix", smoothed(F.col("sums"), everywhere).alias("suffix_prior"), F.col("sums").alias("suffix_sums"))
    by_parent = sums(again, ["parent", "suffix"], n).join(by_suffix, "suffix").select("parent", smoothed(F.col("sums"), F.col("suffix_prior")).alias("parent_prior"))
    priors = hosts.join(by_parent, "parent").select("host", smoothed(F.col("sums"), F.col("parent_prior")).alias("prior")).where("host is not null")

    # How likely each language's pages declare what they declare, and have their suffix.
    declared = sums(weighed.where("declared is not null"), ["declared"], n)
    total = F.array(*(F.lit(float(x or 0.0)) for x in (sums(weighed.where("declared is not null"), [], n).first()["sums"] or [0.0] * n)))
    matched = F.transform(F.array(*map(F.lit, names)), lambda name: F.when(name == F.col("declared"), 0.9).otherwise(0.1 / n))
    of_declared = declared.withColumn("matched", matched)
    of_declared = of_declared.select("declared", F.transform("sums", lambda x, k: F.log((x + STRENGTH * F.get("matched", k)) / (F.get(total, k) + STRENGTH))).alias("declared_log"))
    of_suffix = by_suffix.where("suffix is not null").select(
        "suffix", F.transform("suffix_sums", lambda x, k: F.log((x + STRENGTH * 0.01) / (F.get(whole, k) + STRENGTH))).alias("suffix_log")
    )

    joined = weighed.join(priors, "host", "left").join(of_declared, "declared", "left").join(of_suffix, "suffix", "left")
    prior = F.coalesce("prior", everywhere)
    fused = F.transform(
        "evidence",
        lambda x, k: x + F.log(F.get(prior, k)) + F.coalesce(F.get("declared_log", k), F.lit(0.0)) + F.coalesce(F.get("suffix_log", k), F.lit(0.0)),
    )
    out = joined.withColumn("prior", prior).withColumn("fused", posterior(fused))
    languages = F.array(*map(F.lit, names))

    def best(values: Column) -> Column:
        return F.get(languages, (F.array_position(values, F.array_max(values)) - 1).cast("int"))

    no_text = F.forall("evidence", lambda x: x == 0)
    return out.select(
        *kept, best(F.col("fused")).alias("lang"), F.when(~no_text, best(F.col("evidence"))).alias("text_lang"), best(F.col("prior")).alias("prior_lang"),
        F.array_max("fused").alias("probability"),
    )


def languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The language of every row of ``pages`` (page_id, url, html) and of ``docs`` (doc_id, text, source), learned from ``docs`` (lang) as far as ``learn`` says.

    One row each: page_id or doc_id, host, declared, lang, text_lang, prior_lang, probability. A document's host is its source; it declares nothing, and its
    lang is not looked at but in the sample. Other columns are ignored; either table may be empty.
    """
    names, table = learn(docs)
    url, html = pages["url"].cast("string"), pages["html"].cast("string")
    of_pages = pages.select(
        pages["page_id"].cast("long").alias("page_id"), F.lit(None).cast("long").alias("doc_id"), host_of(url).alias("host"),
        declared_in(html).alias("declared"), F.coalesce(html, F.lit("")).alias("text"), F.lit(True).alias("is_html"),
    )
    of_docs = docs.select(
        F.lit(None).cast("long").alias("page_id"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("host"),
        F.lit(None).cast("string").alias("declared"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), F.lit(False).alias("is_html"),
    )
    return identify(of_pages.unionByName(of_docs), names, table)
