"""Problem 5: credentials in files, and the files with them masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.credentials import redacted_files, secret_lines
from codeloom.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_lines(table(spark, sf_dir, "file_payloads")).select("payload_id", "line_number")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_files(table(spark, sf_dir, "file_payloads"))


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a credential by the context it stands in."""
    return secret_lines(table(spark, sf_dir, "file_payloads")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_lines"))


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted, "p5_kinds": p5_kinds}
ORACLE: dict[str, str] = {}
