"""From raw documents to packed training sequences: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import language_id, mixing, near_copies, packing, secrets
from sluicework.llm.common import crc_mod, saved
from sluicework.llm.tokens import default_tokenizer

#: A prediction below this posterior is a rejection.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, without a text, or whose language is not clear."""
    model = language_id.train(docs, where=crc_mod(F.col("doc_id"), 3) != 1)
    out = language_id.identify(docs, model, lang_col="_sw_lang", score_col="_sw_score")
    return out.where((F.col("_sw_lang") != language_id.UNKNOWN) & (F.col("_sw_score") >= LEAST_SCORE)).drop("_sw_lang", "_sw_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id."""
    return near_copies.drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    mixed = mixing.mix(docs).where(F.col("copies") > 0)
    return mixed.withColumn("_sw_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, default_tokenizer(), 1)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing sources to target weights", mix_sources), ("packing", pack)]

#: SQL cannot express the trained models, the tokenizer and the random rounding; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
