"""Corpus pipeline: documents through language ID, near duplicates, decontamination, secrets and tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; stages are written as Parquet and reread. Part of the training-data subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.llm import decontaminate, jaccard, langid, pieces, secrets
from basketflow.llm.store import forget, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language (null, without letters) go; lang becomes the language found."""
    docs = docs.select(*COLUMNS)
    got = langid.identified(docs, langid.profiles(docs)).where(F.col("lang_pred") != langid.UNKNOWN)
    return got.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with a component's smallest id stays (once, where rows repeat); one with no id stays alone."""
    docs = docs.select(*COLUMNS)
    found = jaccard.join(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(found, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("d"))
    return kept.select("doc_id", "d.*").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are replaced in the text; all documents stay."""
    return secrets.redacted(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_pieces, pieces): the ids of each text, which decode to it again."""
    got = pieces.encoded(docs.select(*COLUMNS))
    return got.select("doc_id", "lang", "source", "n_chars", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("without_secrets", without_secrets), ("tokens", tokens)]
ORACLE_SQL = None  # language ID, template windows and pieces have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
            if before is not None:
                forget(before)
            before = docs
    return docs
