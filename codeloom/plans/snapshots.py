"""Problem 1: Issues added, removed or changed between a project's consecutive reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import confidence_name, relative_posix, severity_name, strip
from codeloom.operators.snapshot_diff import snapshot_changes
from codeloom.session import table


def issue_changes(issues: DataFrame) -> DataFrame:
    return snapshot_changes(
        issues,
        group={"project_root": F.col("project_root")},
        snapshot="snapshot_no",
        key={
            "file": relative_posix(F.col("file"), F.col("project_root")),
            "category": strip(F.col("category")),
            "line_number": F.coalesce(F.col("line_number"), F.lit(0)).cast("int"),
        },
        compare=[severity_name(F.col("severity")), confidence_name(F.col("confidence")), F.col("description")],
        version=(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.col("row_id")),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issue_changes(table(spark, sf_dir, "issue_snapshots"))


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project, report and kind: how many Issues differ."""
    return p1_found(spark, sf_dir).groupBy("project_root", "snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts}

_FOUND = r"""
WITH normal AS (
  SELECT project_root, snapshot_no, ingested_at, row_id, description,
    regexp_replace(regexp_replace(
      CASE WHEN starts_with(replace(file, '\', '/'), rtrim(project_root, '/') || '/') AND length(rtrim(project_root, '/')) > 0
           THEN substr(replace(file, '\', '/'), length(rtrim(project_root, '/')) + 2)
           ELSE replace(file, '\', '/') END, '/(\.?/)+', '/', 'g'), '^(\./)+', '') AS file,
    trim(category, E' \t\r\n\x0b\x0c') AS category,
    coalesce(line_number, 0)::INTEGER AS line_number,
    CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN severity ELSE 'MEDIUM' END AS severity,
    CASE WHEN lower(confidence) IN ('low', 'medium', 'high') THEN lower(confidence) ELSE 'medium' END AS confidence
  FROM issue_snapshots WHERE snapshot_no IS NOT NULL
), kept AS (
  SELECT * FROM normal QUALIFY row_number() OVER (
    PARTITION BY project_root, snapshot_no, file, category, line_number
    ORDER BY ingested_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1
), steps AS (
  SELECT project_root, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project_root ORDER BY snapshot_no) AS before
  FROM (SELECT DISTINCT project_root, snapshot_no FROM normal)
), new AS (
  SELECT k.*, s.before FROM kept k JOIN steps s ON k.project_root IS NOT DISTINCT FROM s.project_root AND k.snapshot_no = s.snapshot_no WHERE s.before IS NOT NULL
), old AS (
  SELECT k.*, s.snapshot_no AS after FROM kept k JOIN steps s ON k.project_root IS NOT DISTINCT FROM s.project_root AND k.snapshot_no = s.before
), found AS (
SELECT coalesce(n.project_root, o.project_root) AS project_root, coalesce(n.snapshot_no, o.after) AS snapshot_no,
  coalesce(n.file, o.file) AS file, coalesce(n.category, o.category) AS category, coalesce(n.line_number, o.line_number) AS line_number,
  CASE WHEN o.after IS NULL THEN 'added' WHEN n.before IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new n FULL JOIN old o ON n.project_root IS NOT DISTINCT FROM o.project_root AND n.before = o.snapshot_no AND n.file IS NOT DISTINCT FROM o.file
  AND n.category IS NOT DISTINCT FROM o.category AND n.line_number = o.line_number
WHERE o.after IS NULL OR n.before IS NULL OR n.severity <> o.severity OR n.confidence <> o.confidence OR n.description IS DISTINCT FROM o.description
)
"""

ORACLE = {
    "p1_found": _FOUND + "SELECT * FROM found",
    "p1_change_counts": _FOUND + "SELECT project_root, snapshot_no, change_kind, count(*) AS n FROM found GROUP BY ALL",
}
