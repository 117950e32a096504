"""A corpus made ready for training: five stages over ``documents``, each an operator of ``ticketloom.llm``.

In every stage null texts are empty texts, rows with a null or a shared doc_id are rows like others, very long texts
are taken whole, an empty table gives an empty table, and extra columns pass through, whatever their names, up to the
last stage, which ignores them. Ties and repeated rows are as each stage's docstring says.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All stages but the last
return the columns of documents. Where SQL cannot express a stage (the trained
models, the fingerprints' links, the tokens), tests hold the result against
brute force, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import langid, packing, quality, simhash, substring
from ticketloom.session import drop_table, load, materialise, ship_code

#: Least score of a language that is accepted; below it no language stands out.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; null texts, texts without letters, and those equally far from several languages, go.

    Equal texts are judged alike. Without labelled rows no language is known and all documents go.
    """
    ship_code(spark)
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the certified cutoffs; repeated rows are judged alike, and without labels only the base counts."""
    ship_code(spark)
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: texts that share 0.8 of their 5-word shingles.

    Null and empty texts are near-duplicates of each other. Different texts that share a doc_id, or have none, stay apart;
    of rows equal in doc_id and text one stays.
    """
    ship_code(spark)
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words in windows that start earlier; n_chars is that of the text that is left.

    Rows that share a doc_id tie: a window counts as earlier by its start in the row alone.
    """
    ship_code(spark)
    kept = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence; equal rows are packed each."""
    ship_code(spark)
    return packing.pack_documents(docs, keep=False)  # other stages use the same workers


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_windows),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            drop_table(written)  # read for the last time
        written = docs
    return docs
