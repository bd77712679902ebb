"""Cleans and packs a corpus: language, exact copies, near copies, repeated passages, packing.

Each stage takes all rows its predecessor kept and, but for the last, returns the columns of ``documents``. The result of a stage is written
as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import exact_dedup, langid, minhash, packing, suffix
from evidentia.llm.common import written
from evidentia.partitions import spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, whose language can't be told. Repeated rows and null ids stay; without labels to learn from, all texts with a letter."""
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    if not model:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = ("ev_lang_", "ev_score_")  # a user's column of the operator's usual names isn't touched
    return langid.identify(docs, model, names=names).filter(F.col(names[0]) != langid.UND).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, keeps the row of the largest doc_id."""
    return exact_dedup.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each class of texts whose five-word shingles are similar by 0.8 or more."""
    return minhash.drop_near(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every 400-byte passage that occurs twice out of the texts; all rows stay, n_chars follows the text."""
    return suffix.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else F.length("text")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens; one row a piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("packing", packed),
]

#: SQL can't express the signatures, suffix arrays and packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
