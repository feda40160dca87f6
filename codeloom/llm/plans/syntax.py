"""Problem 3: files that don't parse, and rates per project and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.syntax_check import checked_files, error_rates
from codeloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_files(table(spark, sf_dir, "file_payloads")).where("error_line IS NOT NULL").select("payload_id")


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unrecoverable error of every file that has one."""
    return checked_files(table(spark, sf_dir, "file_payloads")).where("error_line IS NOT NULL")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_rates(checked_files(table(spark, sf_dir, "file_payloads")))


QUERIES = {"p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates}
ORACLE: dict[str, str] = {}
