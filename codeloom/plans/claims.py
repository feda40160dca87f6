"""Claim documents made from the parts, one of four templates by size; SQL counts the parts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from codeloom.operators import claims as C
from codeloom.session import table

_ITEM = {"id": "F1", "title": "late close", "classification": "reproduced_defect", "status": "fixed", "before_version": "1.0.0", "after_version": "1.0.1", "regression_test": True, "test_path": "tests/test_x.py", "evidence_type": "command_output", "reproduction": {"command": "a", "observed_before": "b", "verified_after": "c"}, "source": {"method": "tool_self_scan", "command": "scan", "tool_version": "1.0.0", "evidence": ["out/a.txt"]}}
_GOOD = {"artifact_kind": "fixes", "schema_version": "1.0", "fixed_count": 1, "audit_provenance": {"claim_boundary": "tool and external", "automated_tool_found_all": False}, "claim_summary": {"by_source": {"tool_self_scan": 1}, "total_count": 1}, "verification_commands": [{"command": "pytest -q", "status": "passed", "exit_code": 0, "artifact": "out/log.txt"}], "fixes": [_ITEM]}
TEMPLATES = (
    json.dumps(_GOOD),
    json.dumps(_GOOD | {"fixed_count": 2, "claim_summary": {"by_source": {"tool_self_scan": 2}, "total_count": 1}}),
    json.dumps(_GOOD | {"fixes": [_ITEM | {"after_version": "1.0.0"}], "verification_commands": [{"command": "a && b", "status": "passed", "exit_code": 3, "artifact": "../x"}]}),
    "[]",
)


def _docs(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("p_size") % len(TEMPLATES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def claim_findings(spark, sf_dir):
    """PROV, EVID and EAS rules, with J-19."""
    d = _docs(spark, sf_dir)
    found = C.provenance_findings(d).unionByName(C.evidence_findings(d)).unionByName(C.artifact_findings(d, F.lit("2025-01-01").cast("date")))
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


ORACLE = {"claim_findings": "SELECT rule_id, severity, count(*) AS n FROM part JOIN (VALUES (1,'PROV007','HIGH'),(1,'EVID004','HIGH'),(2,'PROV035','HIGH'),(2,'EVID036','HIGH'),(2,'EVID011','HIGH'),(2,'EAS013','HIGH'),(2,'EAS007','HIGH'),(3,'PROV001','HIGH'),(3,'EVID001','HIGH'),(3,'EAS001','HIGH')) t(k, rule_id, severity) ON p_size % 4 = k GROUP BY 1, 2"}
QUERIES = {"claim_findings": claim_findings}
