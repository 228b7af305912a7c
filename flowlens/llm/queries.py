"""Queries of this subpackage over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, embeddings, licenses, lines, mixing, packing, pages, phrases, quality, simhash, substrings, toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, most_bits=4)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(quality.ledger(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", *quality.MEASURES, "fail_bits", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train_model(docs, read(spark, sf_dir, "labels")))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_pages": op2_pages,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_lines": op6_lines,
    "op7_substrings": op7_substrings,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_codes": op11_codes,
    "op12_bpe": op12_bpe,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op5_licenses": licenses.ORACLE_SQL,
    "op6_lines": lines.ORACLE_SQL,
    "op9_quality": quality.ORACLE_SQL,
    "op11_codes": codes.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
