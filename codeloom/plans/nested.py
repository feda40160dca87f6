"""Problem 2: call graphs and issue evidence as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.nested_flatten import Layout, child_paths, child_records, child_table, merged_schema
from codeloom.session import kept, table

LONE = frozenset({"edges", "unknown_calls", "markers", "taint_path", "hops", "via"})
EMBEDDED = frozenset({"evidence", "original"})
GRAPH = Layout("graph", "graph_id", ("nodes", "edges", "unknown_calls"), lone=LONE, embedded=EMBEDDED, keyed=frozenset({"nodes"}))
ISSUE = Layout("issue", "row_id", ("evidence",), bare=True, lone=LONE, embedded=EMBEDDED)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_paths(table(spark, sf_dir, "call_graphs"), GRAPH).unionByName(child_paths(table(spark, sf_dir, "issue_snapshots"), ISSUE))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_records(table(spark, sf_dir, "call_graphs"), GRAPH).unionByName(child_records(table(spark, sf_dir, "issue_snapshots"), ISSUE))


def p2_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged schema of every child table."""
    return merged_schema(_children(spark, sf_dir))


def p2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges as a flat table whose fields and types are inferred over all records."""
    return child_table(kept(child_records(table(spark, sf_dir, "call_graphs"), GRAPH)), "edges")


def p2_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops below the edges, joined to the edge they belong to by the parent's path."""
    children = kept(child_records(table(spark, sf_dir, "call_graphs"), GRAPH))
    hops = child_table(children, "edges/evidence/hops")
    edges = child_table(children, "edges", [("caller", "string"), ("callee", "string")]).select("root_id", F.col("child_path").alias("parent_path"), "caller", "callee")
    return hops.join(edges, ["root_id", "parent_path"])


QUERIES = {"p2_found": p2_found, "p2_schema": p2_schema, "p2_edges": p2_edges, "p2_hops": p2_hops}
ORACLE: dict[str, str] = {}
