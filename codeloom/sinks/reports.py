"""Reports out: tables at any size, single documents for a person or a tool.

The table writers are distributed. A single document (SARIF, JUnit, Markdown, HTML) is
assembled from at most ``limit`` Issues in order and says how many there are in all; the
counts it shows are over all Issues.
"""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import annotation_escape, rule_id
from codeloom.operators.governance import severity_order, severity_summary

# Levels of the report formats.
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
_FIELDS = ("file", "category", "severity", "detector", "description", "line_number", "location", "confidence")


def write_tables(issues: DataFrame, path: str, skipped: DataFrame | None = None, failed: DataFrame | None = None) -> None:
    """SNK-01: Issues, skips and failures as JSON tables, and the summaries by severity, detector and category."""
    issues.write.mode("overwrite").json(f"{path}/issues")
    severity_summary(issues, failed, skipped).write.mode("overwrite").json(f"{path}/summary")
    for c in ("detector", "category"):
        issues.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(c).write.mode("overwrite").json(f"{path}/by_{c}")
    for name, df in (("skipped", skipped), ("failed", failed)):
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")


def _top(issues: DataFrame, limit: int, order: list[str]) -> tuple[list[dict], dict]:
    cols = [c for c in _FIELDS if c in issues.columns]
    rows = [r.asDict() for r in issues.orderBy(*order).select(*cols).limit(limit).collect()]
    return rows, severity_summary(issues).first().asDict()


def sarif(issues: DataFrame, limit: int = 5000, order: tuple[str, ...] = ("file", "line_number", "category"), failed: DataFrame | None = None, skipped: DataFrame | None = None) -> str:
    """SNK-02: a SARIF 2.1.0 document; rules are the distinct rule ids in order of appearance.

    ``failed`` and ``skipped`` have ``file, reason``; the first ``limit`` of each are notifications of the run.
    """
    notes = [{"level": level, "message": {"text": f"{r['file']}: {r['reason']}"}} for df, level in ((failed, "error"), (skipped, "note")) if df is not None for r in df.orderBy("file", "reason").limit(limit).collect()]
    rows, counts = _top(issues, limit, list(order))
    rules = list(dict.fromkeys((r["category"] or "").split(":")[0] for r in rows))
    results = [
        {
            "ruleId": (r["category"] or "").split(":")[0],
            "level": SARIF_LEVEL.get(r["severity"], "warning"),
            "message": {"text": r["description"] or ""},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"] or ""}, "region": {"startLine": max(1, r["line_number"] or 1)}}}],
            "partialFingerprints": {"issue": f"{r['file']}:{r['category']}:{r['line_number']}"},
        }
        for r in rows
    ]
    invocation = {"executionSuccessful": not any(n["level"] == "error" for n in notes), "toolExecutionNotifications": notes}
    run = {"invocations": [invocation], "tool": {"driver": {"name": "codeloom", "rules": [{"id": i} for i in rules]}}, "results": results, "properties": {"total": counts["TOTAL"]}}
    return json.dumps({"version": "2.1.0", "runs": [run]}, indent=1)


def junit(issues: DataFrame, limit: int = 5000, order: tuple[str, ...] = ("file", "line_number", "category")) -> str:
    """SNK-03: a JUnit document in which every Issue is a failed case; at least one case. It counts the cases that it holds; the number of all Issues is a property."""
    rows, counts = _top(issues, limit, list(order))
    cases = [f"<testcase classname={quoteattr(r['file'] or '')} name={quoteattr(r['category'] or '')}><failure message={quoteattr(r['description'] or '')}>{escape(r['severity'] or '')}</failure></testcase>" for r in rows] or ['<testcase classname="codeloom" name="clean"/>']
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="codeloom" tests="{len(cases)}" failures="{len(rows)}"><properties><property name="total" value="{counts["TOTAL"]}"/></properties>' + "".join(cases) + "</testsuite>\n"


def markdown(issues: DataFrame, limit: int = 200, order: tuple[str, ...] = ("file", "line_number", "category")) -> str:
    """SNK-04, SNK-08: counts and a table of the first Issues; descriptions are cut at 220 characters."""
    rows, counts = _top(issues, limit, list(order))
    cell = lambda v: str(v if v is not None else "").replace("|", "\\|").replace("\n", " ")[:220]
    head = "# Report\n\n" + "\n".join(f"- {k}: {v}" for k, v in counts.items()) + "\n\n| severity | rule | place | description |\n| - | - | - | - |\n"
    body = "".join(f"| {cell(r['severity'])} | {cell(r['category'])} | {cell(r['file'])}:{r['line_number'] or 1} | {cell(r['description'])} |\n" for r in rows)
    return head + body + (f"\n{counts['TOTAL'] - len(rows)} more.\n" if counts["TOTAL"] > len(rows) else "")


def html(issues: DataFrame, limit: int = 200) -> str:
    """SNK-05."""
    return f"<!doctype html><html><body><pre>{escape(markdown(issues, limit))}</pre></body></html>\n"


def console(issues: DataFrame, limit: int = 50, width: int = 140) -> str:
    """SNK-06."""
    rows, counts = _top(issues, limit, ["file", "line_number", "category"])
    lines = [f"{r['severity']:<8} {r['file']}:{r['line_number'] or 1} {r['category']} {r['description'] or ''}"[:width] for r in rows]
    return "\n".join([*lines, " ".join(f"{k}={v}" for k, v in counts.items())])


def dashboard(issues: DataFrame, run: str, limit: int = 500) -> str:
    """SNK-09: severities by run as an HTML table."""
    t = issues.groupBy(run).pivot("severity", list(SARIF_LEVEL)).agg(F.count(F.lit(1))).na.fill(0).orderBy(run).limit(limit).collect()
    body = "".join("<tr><td>" + escape(str(r[run])) + "</td>" + "".join(f"<td>{r[s]}</td>" for s in SARIF_LEVEL) + "</tr>" for r in t)
    return "<table><tr><th>run</th>" + "".join(f"<th>{s}</th>" for s in SARIF_LEVEL) + f"</tr>{body}</table>\n"


def write_manifest(lines: DataFrame, path: str) -> None:
    """SNK-10: manifest lines sorted by path, as text. The sort is by range, so it needs no single task."""
    lines.orderBy("path").select("value").write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, unknown: DataFrame, path: str) -> None:
    """SNK-12: a call graph as three tables."""
    for name, df in (("nodes", nodes), ("edges", edges), ("unknown_calls", unknown)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_summary(summary: DataFrame, path: str) -> None:
    """SNK-14, SNK-15: any small summary as one JSON table."""
    summary.write.mode("overwrite").json(path)


def annotation_command() -> Column:
    """SNK-07: an Issue as an annotation command."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("notice")
    return F.concat(F.lit("::"), level, F.lit(" file="), annotation_escape(F.coalesce("file", F.lit(""))), F.lit(",line="), F.greatest(F.coalesce("line_number", F.lit(1)), F.lit(1)).cast("string"), F.lit("::"), annotation_escape(F.coalesce("description", F.lit(""))))


def annotations(issues: DataFrame, limit: int = 50) -> list[str]:
    """SNK-07: the first Issues as annotation commands, in report order (``seq`` if there)."""
    order = ["seq"] if "seq" in issues.columns else ["file", "line_number", "category"]
    return [r[0] for r in issues.orderBy(*order).limit(limit).select(annotation_command()).collect()]


def fix_suggestions(issues: DataFrame) -> DataFrame:
    """T-04: suggestions for the rules that have one, worst first."""
    rid = rule_id(F.col("category"))
    hint = F.when(rid == "PY008", "pass timeout= to the request").when(rid == "PY007", "use the safe loader").when(rid.isin("PYDF002", "PYXDF002"), "pass a list and no shell")
    return issues.withColumn("suggestion", hint).where("suggestion IS NOT NULL").orderBy(F.desc(severity_order(F.col("severity"))), "file", "line_number")
