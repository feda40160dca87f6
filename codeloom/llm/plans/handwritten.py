"""Problem 4: files and manifest entries that nobody wrote by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.handwritten import classified_entries, classified_files
from codeloom.session import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_files(table(spark, sf_dir, "file_payloads"), table(spark, sf_dir, "known_packages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    payloads = files.where("verdict IS NOT NULL").select(F.lit("payload").alias("record_src"), F.col("payload_id").alias("record_id"))
    entries = classified_entries(table(spark, sf_dir, "manifest_entries"), files).select(F.lit("manifest").alias("record_src"), F.col("entry_id").alias("record_id"))
    return payloads.unionByName(entries)


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each kind for each project."""
    return _files(spark, sf_dir).groupBy("project_root", F.coalesce("verdict", F.lit("hand-written")).alias("verdict")).agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds}
ORACLE: dict[str, str] = {}
