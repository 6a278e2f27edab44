"""The training-data pipeline: stages that each write their documents for the next one.

A stage gets the documents that its predecessor kept.  Columns and their types stay as they are in the table
``documents`` until the last stage, which returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, langid, linededup, neardup, packing
from spanloom.llm.common import stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no learned language is found: null texts, texts without a letter, or of strange ones.

    The filters are learned from the labelled documents of the stage's own input that are not held out.
    """
    filters = langid.learn(docs.where(~langid.held_out()))
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), "text")  # whatever else the columns are called
    judged = langid.identify(whole, filters)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.ACCEPTED)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the lines that are alike; documents of which no line is left go."""
    left = linededup.without_lines(docs, linededup.removals(docs, **linededup.EVERY_LINE))
    left = left.where("text is not null")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of five-word Jaccard 0.8 or more, and documents without an id."""
    return neardup.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs)).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: Tokenizing, union-find and Bloom filters have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
