"""The queries of this subpackage, bound to the driver's tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, decontam, hostrep, kmtree, langid, linededup, packing, pii, simhash, suffixes
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, numbers of base matches, base_sha256 and spans of every document; null texts are empty; repeated rows give rows each."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_hostrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and the posterior of every page; null urls have an empty host and path."""
    return hostrep.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document; null texts are one token."""
    packed = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return packed.withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; null texts are empty."""
    return suffixes.digest(suffixes.repeated_spans(table(spark, sf_dir, "documents")))


def op5_kmtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 5 nearest found of every vector whose id 50 divides, among all."""
    return kmtree.search(table(spark, sf_dir, "embeddings"), 5, lambda vec_id: vec_id % 50 == 0)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; texts that are null or without letters are ``und``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = langid.learn(docs.where(~langid.held_out()))
    held = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.identify(held, filters).select("doc_id", "held_out", "lang_pred", "score")


def op7_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, numbers of base matches, base_sha256, spans, and how many base matches look live or like examples."""
    return credentials.digest(credentials.find(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null and blank texts have fingerprint zero."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, whether it holds an item of the benchmark, which items, and how many windows of these."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), "items", "windows")


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines of every document; null texts have no line."""
    docs = table(spark, sf_dir, "documents")
    gone = linededup.removals(docs, **linededup.EVERY_LINE).withColumnRenamed("id", "doc_id")
    size = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines")
    counted = docs.select("doc_id", size).join(gone, "doc_id", "left")
    return counted.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_hostrep": op2_hostrep,
    "op3_packing": op3_packing,
    "op4_suffixes": op4_suffixes,
    "op5_kmtree": op5_kmtree,
    "op6_langid": op6_langid,
    "op7_credentials": op7_credentials,
    "op8_simhash": op8_simhash,
    "op9_decontam": op9_decontam,
    "op10_linededup": op10_linededup,
}

ORACLE_SQL: dict[str, str] = {"op2_hostrep": hostrep.oracle()}
