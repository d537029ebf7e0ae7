"""The operators of this subpackage as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import byte_bpe, decontamination, extraction, language_id, line_dedup, lm_scoring, near_dedup, quality_rules, ranked_search, token_counts, token_files, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", counts["n_tokens"] > 512)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.crc32(token_files.round_trip(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("a", "b")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "is_first")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Terms as lists of an array column; every count and weight as the contract gives them.
OP13_SQL = """
WITH terms AS (
    SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
        lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
    FROM documents
), wanted AS (
    SELECT item_id, term, count(*) AS repeats
    FROM (
        SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
            lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
        FROM benchmark
    )
    GROUP BY ALL
), totals AS (
    SELECT count(*) AS documents, sum(len(terms))::BIGINT AS terms FROM terms WHERE len(terms) > 0
), found AS (
    SELECT doc_id, len(terms) AS n, term, count(*) AS tf
    FROM (SELECT doc_id, terms, unnest(terms) AS term FROM terms)
    WHERE term IN (SELECT term FROM wanted)
    GROUP BY doc_id, terms, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM found, totals GROUP BY term, documents
), scores AS (
    SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // totals.terms))))::BIGINT AS score
    FROM wanted JOIN found USING (term) JOIN weights USING (term), totals
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""

#: Name of a query: the query and its SQL, or None where SQL cannot express it.
QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_lm_scoring": (op2_lm_scoring, None),
    "op3_byte_bpe": (op3_byte_bpe, None),
    "op4_token_files": (op4_token_files, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_line_dedup": (op6_line_dedup, None),
    "op7_language_id": (op7_language_id, None),
    "op8_decontamination": (op8_decontamination, None),
    "op9_near_dedup": (op9_near_dedup, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_extraction": (op11_extraction, None),
    "op12_whitening": (op12_whitening, None),
    "op13_ranked_search": (op13_ranked_search, OP13_SQL),
}
