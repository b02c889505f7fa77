"""The queries of the problems whose operators live in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergewell.llm.canonical_values import canonical_values
from mergewell.llm.eval_leaks import find_leaks
from mergewell.llm.linkage import matched_records
from mergewell.llm.name_variants import name_variants
from mergewell.llm.tokenize_corpus import encode_texts
from mergewell.llm.truncation import truncated, truncation_rates
from mergewell.runtime import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values(*(read(spark, sf_dir, t) for t in ("raw_candidate", "recruiter", "skill_ref", "location_ref")))


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_records(read(spark, sf_dir, "raw_candidate"), read(spark, sf_dir, "location_ref"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_confidence(spark, sf_dir).select("raw_id_a", "raw_id_b")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants(read(spark, sf_dir, "recruiter"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The search takes one edit in a window; the query asks for those without any.
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).filter("edits = 0").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(read(spark, sf_dir, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(read(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_confidence": p3_confidence, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_rates": p9_rates}
_GRAMS = """SELECT DISTINCT {id}, array_to_string(w[i : i + 11], ' ') AS g FROM (
  SELECT {id}, w, unnest(generate_series(1, len(w) - 11)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12)"""
ORACLE = {
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(id='doc_id', table='documents')}) d JOIN ({_GRAMS.format(id='item_id', table='eval_items')}) i ON d.g = i.g",
}
