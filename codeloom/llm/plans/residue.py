"""Problem 8: documents with template residue, filler, error pages or requests to allow scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.residue import residue_documents
from codeloom.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each kind of residue."""
    return residue_documents(table(spark, sf_dir, "documents")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_docs"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(residue_documents(docs).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


QUERIES = {"p8_found": p8_found, "p8_kinds": p8_kinds, "p8_clean": p8_clean}
ORACLE: dict[str, str] = {}
