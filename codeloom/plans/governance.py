"""Governance over the Issues of all reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import rule_id
from codeloom.operators import governance as G
from codeloom.operators.suites import counts_by
from codeloom.session import table
from codeloom.sinks.reports import annotation_command

# A fixed list to suppress by; the fourth is shadowed by the second, the fifth matches nothing.
SUPPRESSIONS = [
    {"rule_id": "TXT002", "owner": "docs", "reason": "tracked elsewhere", "expires": "2031-01-31"},
    {"rule_id": "PY001", "file": "tests/test_invoice.py", "owner": "qa", "reason": "fixture", "expires": "2020-01-01"},
    {"rule_id": "SUPPLY010", "owner": "", "reason": "pinned in the image", "expires": "soon"},
    {"rule_id": "TXT002", "owner": "docs", "reason": "again", "expires": "2031-01-31"},
    {"rule_id": "NONE999", "owner": "nobody", "reason": "unused", "expires": "2031-01-31"},
]


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issue_snapshots").withColumn("issue_id", F.col("row_id"))


def _norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.normalised(issues(spark, sf_dir))


def _suppressed(spark: SparkSession, sf_dir: str):
    return G.apply_suppressions(_norm(spark, sf_dir), G.suppression_frame(spark, SUPPRESSIONS))


def issue_fingerprints(spark, sf_dir):
    """X-10, F-02: normalised Issues with their fingerprints."""
    return _norm(spark, sf_dir).select("row_id", "severity", "confidence", "fingerprint")


def issue_dedupe(spark, sf_dir):
    """A-05: the first Issue of each fingerprint and how many repeat it."""
    return G.deduplicated(_norm(spark, sf_dir), [F.col("row_id")]).select("fingerprint", "row_id", "duplicates")


def severity_counts(spark, sf_dir):
    """A-01 over all Issues."""
    return G.severity_summary(_norm(spark, sf_dir))


def by_detector(spark, sf_dir):
    """A-02."""
    return issues(spark, sf_dir).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


def by_category(spark, sf_dir):
    """A-02 by rule id (F-04)."""
    return issues(spark, sf_dir).groupBy(rule_id(F.btrim("category")).alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


def blocking_projects(spark, sf_dir):
    """A-03 for each project and report."""
    return _norm(spark, sf_dir).groupBy("project_root", "snapshot_no").agg(F.bool_or(F.col("severity").isin("CRITICAL", "HIGH")).alias("blocking"))


def severity_budgets(spark, sf_dir):
    """A-04: severities beyond their budget."""
    return G.budget_failures(_norm(spark, sf_dir), G.Policy({"CRITICAL": 100, "HIGH": 5000, "MEDIUM": 100000000, "LOW": 10}))


def suppress_first_match(spark, sf_dir):
    """J-01: the suppression that removes each Issue."""
    return _suppressed(spark, sf_dir)[1].select("row_id", "idx")


def suppressed_rest(spark, sf_dir):
    """GV-03: Issues left for each severity."""
    return _suppressed(spark, sf_dir)[0].groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def unused_suppressions(spark, sf_dir):
    """GV-04."""
    return _suppressed(spark, sf_dir)[2].select("idx", "rule_id")


def suppression_errors(spark, sf_dir):
    """GV-02, against a fixed day."""
    return G.suppression_errors(G.suppression_frame(spark, SUPPRESSIONS), F.lit("2025-06-30").cast("date"))


def new_vs_baseline(spark, sf_dir):
    """J-02: Issues of a project's last report that its first report lacks, HIGH and up."""
    all_ = _norm(spark, sf_dir)
    ends = all_.groupBy("project_root").agg(F.min("snapshot_no").alias("_first"), F.max("snapshot_no").alias("_last"))
    tagged = all_.join(ends, "project_root")
    last, first = tagged.where("snapshot_no = _last"), tagged.where("snapshot_no = _first")
    return G.new_issues(last, first, "HIGH", ("project_root", "fingerprint")).select("row_id", "fingerprint")


def review_queues(spark, sf_dir):
    """T-03, A-20: the first 25 of queue P0 and 50 of P1 and P2 for each report.

    Order: severity, file, row.
    """
    q = G.review_queue(F.col("severity"), F.col("detector"))
    w = Window.partitionBy("project_root", "snapshot_no", "queue").orderBy(F.desc("rank"), "file", "row_id")
    rows = _norm(spark, sf_dir).withColumn("queue", q).withColumn("rank", G.severity_order(F.col("severity")))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.when(F.col("queue") == "P0", 25).otherwise(50)).select("project_root", "snapshot_no", "queue", "place", "row_id")


def review_plan_files(spark, sf_dir):
    """A-20: the twenty files with most Issues, by count and name."""
    return issues(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(20)


def maturity_score(spark, sf_dir):
    """A-21 for each report; the table has no failed or skipped files."""
    c = lambda s: F.count_if(F.col("severity") == s)
    return _norm(spark, sf_dir).groupBy("project_root", "snapshot_no").agg(G.maturity(c("CRITICAL"), c("HIGH"), c("MEDIUM"), F.count(F.lit(1)), F.lit(0), F.lit(0)).alias("score"))


def scorecard(spark, sf_dir):
    """A-22: each detector is a gate; 10 for a CRITICAL or HIGH issue kind, else 3, floor 0."""
    kinds = _norm(spark, sf_dir).select("project_root", "detector", rule_id(F.btrim("category")).alias("rule_id"), "severity").distinct()
    cost = F.sum(F.when(F.col("severity").isin("CRITICAL", "HIGH"), 10).otherwise(3))
    return kinds.groupBy("project_root").agg(F.greatest(F.lit(100) - cost, F.lit(0)).alias("score"))


def gate_matrix(spark, sf_dir):
    """A-23, X-14: Issues, blockers and kinds of every gate."""
    rows = _norm(spark, sf_dir).withColumn("gate", F.concat(F.lit("quality_matrix."), "detector"))
    return rows.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("blockers"), F.countDistinct(rule_id(F.btrim("category"))).alias("kinds"))


def coverage_matrix(spark, sf_dir):
    """A-18: counts by detector, severity and confidence in one pass of grouping sets."""
    return counts_by(_norm(spark, sf_dir), ("detector", "severity", "confidence"))


def trend_dashboard(spark, sf_dir):
    """A-33, SNK-09: severities of each report, side by side."""
    return _norm(spark, sf_dir).groupBy("project_root", "snapshot_no").pivot("severity", ["CRITICAL", "HIGH", "MEDIUM", "LOW"]).agg(F.count(F.lit(1))).na.fill(0)


def annotations(spark, sf_dir):
    """SNK-07: the first fifty annotation commands."""
    return _norm(spark, sf_dir).orderBy("row_id").limit(50).select("row_id", annotation_command().alias("command"))


def confusion(spark, sf_dir):
    """A-24: each detector against the last report as truth; Issues of the report before it are the forecast."""
    w = Window.partitionBy("project_root").orderBy(F.desc("snapshot_no"))
    steps = issues(spark, sf_dir).select("project_root", "snapshot_no").distinct().withColumn("back", F.row_number().over(w)).where("back <= 2")
    rows = _norm(spark, sf_dir).join(steps, ["project_root", "snapshot_no"]).select("project_root", "detector", "fingerprint", "back").distinct()
    each = rows.groupBy("project_root", "detector", "fingerprint").agg(F.bool_or(F.col("back") == 1).alias("truth"), F.bool_or(F.col("back") == 2).alias("said"))
    tp, fp, fn = F.count_if(F.col("truth") & F.col("said")), F.count_if(~F.col("truth") & F.col("said")), F.count_if(F.col("truth") & ~F.col("said"))
    return each.groupBy("detector").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0)).alias("recall"))


_N = """WITH norm AS (SELECT * REPLACE (CASE WHEN severity IN ('CRITICAL','HIGH','MEDIUM','LOW') THEN severity ELSE 'MEDIUM' END AS severity,
 CASE WHEN lower(confidence) IN ('low','medium','high') THEN lower(confidence) ELSE 'medium' END AS confidence),
 left(sha256(coalesce(file,'') || chr(10) || coalesce(category,'') || chr(10) || coalesce(detector,'') || chr(10) || coalesce(nullif(line_number,0)::VARCHAR,'') || chr(10) || coalesce(location,'') || chr(10) || coalesce(description,'')), 16) AS fingerprint,
 CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 2 END AS rank FROM issue_snapshots)
"""
_S = "sup AS (SELECT * FROM (VALUES (0,'TXT002',NULL),(1,'PY001','tests/test_invoice.py'),(2,'SUPPLY010',NULL),(3,'TXT002',NULL),(4,'NONE999',NULL)) t(idx, rule_id, sfile)), m AS (SELECT row_id, min(idx) AS idx FROM norm JOIN sup ON starts_with(category, sup.rule_id || ':') AND (sfile IS NULL OR sfile = file) GROUP BY 1)"
ORACLE = {
    "issue_fingerprints": _N + "SELECT row_id, severity, confidence, fingerprint FROM norm",
    "issue_dedupe": _N + "SELECT fingerprint, min(row_id) AS row_id, count(*) - 1 AS duplicates FROM norm GROUP BY 1",
    "severity_counts": _N + "SELECT count(*) FILTER (severity='CRITICAL') AS CRITICAL, count(*) FILTER (severity='HIGH') AS HIGH, count(*) FILTER (severity='MEDIUM') AS MEDIUM, count(*) FILTER (severity='LOW') AS LOW, count(*) AS TOTAL, 0::BIGINT AS FAILED_FILES, 0::BIGINT AS SKIPPED_FILES FROM norm",
    "by_detector": "SELECT detector, count(*) AS n FROM issue_snapshots GROUP BY 1",
    "by_category": "SELECT split_part(trim(category), ':', 1) AS rule_id, count(*) AS n FROM issue_snapshots GROUP BY 1",
    "blocking_projects": _N + "SELECT project_root, snapshot_no, bool_or(severity IN ('CRITICAL','HIGH')) AS blocking FROM norm GROUP BY 1, 2",
    "severity_budgets": _N + "SELECT severity, n, most FROM (SELECT severity, count(*) AS n FROM norm GROUP BY 1) JOIN (VALUES ('CRITICAL',100),('HIGH',5000),('MEDIUM',100000000),('LOW',10)) b(severity, most) USING (severity) WHERE n > most",
    "suppress_first_match": _N.rstrip()[:-1] + "), " + _S + " SELECT row_id, idx FROM m",
    "suppressed_rest": _N.rstrip()[:-1] + "), " + _S + " SELECT severity, count(*) AS n FROM norm ANTI JOIN m USING (row_id) GROUP BY 1",
    "unused_suppressions": _N.rstrip()[:-1] + "), " + _S + " SELECT idx, rule_id FROM sup WHERE idx NOT IN (SELECT idx FROM m)",
    "suppression_errors": "SELECT * FROM (VALUES (1,'expired'),(2,'owner'),(2,'expires invalid')) t(idx, error)",
    "new_vs_baseline": _N + "SELECT n.row_id, n.fingerprint FROM norm n JOIN (SELECT project_root, max(snapshot_no) AS l FROM norm GROUP BY 1) e ON n.project_root = e.project_root AND n.snapshot_no = e.l WHERE rank >= 3 AND NOT EXISTS (SELECT 1 FROM norm b WHERE b.project_root = n.project_root AND b.fingerprint = n.fingerprint AND b.snapshot_no = (SELECT min(snapshot_no) FROM norm x WHERE x.project_root = n.project_root))",
    "review_queues": _N + "SELECT project_root, snapshot_no, queue, place::INT AS place, row_id FROM (SELECT *, row_number() OVER (PARTITION BY project_root, snapshot_no, queue ORDER BY rank DESC, file, row_id) AS place FROM (SELECT *, CASE WHEN rank = 4 OR rank = 3 AND detector IN ('python_dataflow', 'python_cross_file_dataflow', 'unknown_call_validator') THEN 'P0' WHEN rank = 3 THEN 'P1' ELSE 'P2' END AS queue FROM norm)) WHERE place <= CASE queue WHEN 'P0' THEN 25 ELSE 50 END",
    "review_plan_files": "SELECT file, count(*) AS n FROM issue_snapshots GROUP BY 1 ORDER BY n DESC, file LIMIT 20",
    "maturity_score": _N + "SELECT project_root, snapshot_no, greatest(least(100 - (18 * count(*) FILTER (rank = 4) + 8 * count(*) FILTER (rank = 3) + 3 * count(*) FILTER (rank = 2)), 100), 0) AS score FROM norm GROUP BY 1, 2",
    "scorecard": _N + "SELECT project_root, greatest(100 - sum(CASE WHEN severity IN ('CRITICAL','HIGH') THEN 10 ELSE 3 END), 0)::BIGINT AS score FROM (SELECT DISTINCT project_root, detector, split_part(trim(category), ':', 1), severity FROM norm) GROUP BY 1",
    "gate_matrix": _N + "SELECT 'quality_matrix.' || detector AS gate, count(*) AS n, count(*) FILTER (rank >= 3) AS blockers, count(DISTINCT split_part(trim(category), ':', 1)) AS kinds FROM norm GROUP BY 1",
    "coverage_matrix": _N + "SELECT 'detector' AS dimension, detector AS value, count(*) AS n FROM norm GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM norm GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM norm GROUP BY 2",
    "trend_dashboard": _N + "SELECT project_root, snapshot_no, count(*) FILTER (rank = 4) AS CRITICAL, count(*) FILTER (rank = 3) AS HIGH, count(*) FILTER (rank = 2) AS MEDIUM, count(*) FILTER (rank = 1) AS LOW FROM norm GROUP BY 1, 2",
    "annotations": _N + "SELECT row_id, '::' || CASE WHEN rank >= 3 THEN 'error' WHEN rank = 2 THEN 'warning' ELSE 'notice' END || ' file=' || esc(coalesce(file, '')) || ',line=' || greatest(coalesce(line_number, 1), 1) || '::' || esc(coalesce(description, '')) AS command FROM norm ORDER BY row_id LIMIT 50",
    "confusion": _N.rstrip()[:-1] + "), steps AS (SELECT project_root, snapshot_no, row_number() OVER (PARTITION BY project_root ORDER BY snapshot_no DESC) AS back FROM (SELECT DISTINCT project_root, snapshot_no FROM norm)), each AS (SELECT project_root, detector, fingerprint, bool_or(back = 1) AS truth, bool_or(back = 2) AS said FROM norm JOIN steps USING (project_root, snapshot_no) WHERE back <= 2 GROUP BY 1, 2, 3) SELECT detector, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn, coalesce(tp / nullif(tp + fp, 0), 1.0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 1.0)::DOUBLE AS recall FROM each GROUP BY 1",
}
for _k in ("annotations",):
    import re as _re

    ORACLE[_k] = _re.sub(r"esc\((coalesce\(file, ''\)|coalesce\(description, ''\))\)", lambda m: f"replace(replace(replace(replace(replace({m[1]}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')", ORACLE[_k])
QUERIES = {name: globals()[name] for name in ORACLE}
