"""The named queries of the training-data operators; each takes its operator's result down to the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import bpe, fingerprints, langid, licenses, packing, quality, simhash, substring, suffixtree, toxicity
from ticketloom.session import load


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).selectExpr("doc_id", "loom_n_words n_words", "loom_n_removed n_removed", "loom_sha256 kept_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents")).drop("text_key")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(load(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.licences(docs, licenses.train(docs))


def op7_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixtree.score_documents(docs, "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")
    return found.withColumn("held_out", langid.held_out(10)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, load(spark, sf_dir, "labels").filter(~langid.held_out()))
    found = toxicity.score_documents(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_simhash": op2_simhash,
    "op3_langid": op3_langid,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_suffixtree": op7_suffixtree,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
}

# The other operators' results rest on trained models, XXH64, vocabulary files or sketches, which SQL has not;
# tests hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_quality": quality.sql(),
    "op1_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word, len(w) AS n FROM w),
k AS (SELECT doc_id, p, word, CASE WHEN p + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS win FROM x),
f AS (SELECT doc_id, p, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM k),
c AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f)
SELECT d.doc_id, count(c.p) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id""",
}
