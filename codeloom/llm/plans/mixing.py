"""Problem 7: documents drawn so that sources reach their shares of all tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import strip
from codeloom.llm.mixing import drawn, share_report
from codeloom.llm.tokens import sized
from codeloom.session import kept, table


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple]]:
    docs = table(spark, sf_dir, "documents")
    sizes = kept(sized(docs.select("doc_id", F.lower(strip(F.col("source"))).alias("source"), "text"), ["doc_id", "source"]))
    return drawn(sizes, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares."""
    used, plan = _drawn(spark, sf_dir)
    return share_report(used, plan)


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE: dict[str, str] = {}
