"""Problem 6: documents packed into containers of each capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.packing import fill_report, packed
from codeloom.llm.tokens import sized
from codeloom.session import kept, table


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(sized(table(spark, sf_dir, "documents"), ["doc_id"]))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_bins"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, with fixed counts alone and topped up."""
    sizes, bins = _sizes(spark, sf_dir), table(spark, sf_dir, "pack_bins")
    reports = [fill_report(packed(sizes, bins, top_up=t)).withColumn("topped_up", F.lit(t)) for t in (False, True)]
    return reports[0].unionByName(reports[1])


QUERIES = {"p6_packed": p6_packed, "p6_fill": p6_fill}
ORACLE: dict[str, str] = {}
