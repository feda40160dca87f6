"""Tests, types, suites and measures over the scanned files."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import call_graph as C
from codeloom.operators import indices as X
from codeloom.operators import pytest_facts as T
from codeloom.operators import suites as S
from codeloom.operators.nested_flatten import child_records
from codeloom.operators.python_facts import python_facts
from codeloom.plans.nested import GRAPH
from codeloom.session import kept, table


def _facts(spark, sf_dir):
    return python_facts(table(spark, sf_dir, "file_payloads").select("payload_id", "project_root", "path", "content"))


def _kept(spark, sf_dir):
    return kept(_facts(spark, sf_dir))


def public_reference(spark, sf_dir):
    """A-26, J-13, DF-25."""
    return T.reference_ratio(_kept(spark, sf_dir))


def pytest_findings(spark, sf_dir):
    """P-19, J-14."""
    return T.pytest_findings(_kept(spark, sf_dir))


def test_completeness(spark, sf_dir):
    """DF-25."""
    return T.completeness_findings(_kept(spark, sf_dir))


def untyped_public(spark, sf_dir):
    """P-18."""
    return T.untyped_public(_facts(spark, sf_dir))


def mutation_candidates(spark, sf_dir):
    """P-24."""
    return T.mutation_candidates(_facts(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def annoyance_index(spark, sf_dir):
    """DF-21."""
    return T.annoyance(_kept(spark, sf_dir))


def call_graph_summary(spark, sf_dir):
    """A-17, GR-07 over the table of call graphs."""
    kids = child_records(table(spark, sf_dir, "call_graphs"), GRAPH).select(F.col("root_id").alias("graph"), "table")
    return C.graph_summary(kids.where("table = 'nodes'"), kids.where("table = 'edges'"), kids.where("table = 'unknown_calls'"))


def _cases(spark, sf_dir):
    """One case a part: a path that is safe or not by size."""
    p = table(spark, sf_dir, "part")
    bad = F.col("p_size") % 3 == 0
    payload = F.when(bad, F.concat(F.lit("a/../p"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("a/p"), F.col("p_partkey").cast("string"), F.lit(".py")))
    expected = F.when(F.col("p_size") % 6 == 0, F.array(F.lit("PATH"))).when(bad, F.array(F.lit("!PATH"))).otherwise(F.array(F.lit("!PATH")))
    return p.select(F.col("p_partkey").cast("string").alias("case_id"), F.col("p_brand").alias("family"), payload.alias("payload"), expected.alias("expected"))


def suite_failures(spark, sf_dir):
    """§2.16: expectations of the path suite that don't hold."""
    return S.suite_failures(_cases(spark, sf_dir), S.path_detector).select("case_id", "expected")


def suite_inventory(spark, sf_dir):
    """A-35."""
    return S.suite_inventory(_cases(spark, sf_dir))


def branch_coverage(spark, sf_dir):
    """A-28 over parts: size of 50 branches."""
    p = table(spark, sf_dir, "part")
    return X.branch_coverage(p.select(F.col("p_partkey").alias("file"), (50 - F.col("p_size")).alias("missing"), F.col("p_size").alias("covered_branches"), F.when(F.col("p_size") > 2, 50).otherwise(0).alias("branches")))


ORACLE = {
    "suite_failures": "SELECT p_partkey::VARCHAR AS case_id, '!PATH' AS expected FROM part WHERE p_size % 6 = 3",
    "suite_inventory": "SELECT p_brand AS family, count(*) AS n FROM part GROUP BY 1",
    "branch_coverage": "SELECT p_partkey AS file, 50 - p_size AS missing, CASE WHEN p_size > 2 THEN 100.0 * p_size / 50 END::DOUBLE AS percent FROM part",
}
QUERIES = {n: globals()[n] for n in ("public_reference", "pytest_findings", "test_completeness", "untyped_public", "mutation_candidates", "annoyance_index", "call_graph_summary", *ORACLE)}
