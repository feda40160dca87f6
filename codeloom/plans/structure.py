"""Scripts, registries and indices over the scanned files and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import indices as X
from codeloom.operators.python_facts import python_facts
from codeloom.operators.registries import ambiguities, array_elements
from codeloom.operators.script_structure import structure_findings
from codeloom.session import table


def _files(spark, sf_dir):
    return table(spark, sf_dir, "file_payloads").select("payload_id", "project_root", "path", "content")


SCRIPT_TEMPLATES = (
    "win.postMessage(data, '*');\n",
    "addEventListener('message', (event) => {\n  run(event.data);\n});\n",
    "const q = new URLSearchParams(location.search);\nlocation.href = q.get('to');\n",
    "setTimeout('go()', 10);\n",
    "// setTimeout('go()', 10);\nwindow.open(url);\n",
    "const raw = location.search;\nel.innerHTML = raw;\n",
    "document.domain = 'x.example';\n",
    "addEventListener('message', (event) => {\n  if (allowedOrigins.includes(event.origin)) run(event.data);\n});\n",
)


def script_rule_counts(spark, sf_dir):
    """DF-08 to DF-11 over code made from the parts; SQL counts the parts."""
    code = F.element_at(F.array(*map(F.lit, SCRIPT_TEMPLATES)), (F.col("p_size") % len(SCRIPT_TEMPLATES) + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload_id"), F.format_string("web/p%d.js", "p_partkey").alias("path"), code.alias("content"))
    return structure_findings(parts).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def script_structure(spark, sf_dir):
    return structure_findings(_files(spark, sf_dir))


def registry_ambiguities(spark, sf_dir):
    """DF-12, DF-13."""
    return ambiguities(array_elements(_files(spark, sf_dir)))


def stereotype_scores(spark, sf_dir):
    """DF-22 over the documents."""
    return X.stereotype(table(spark, sf_dir, "documents"), "doc_id", "text")


def fatigue_index(spark, sf_dir):
    """DF-20."""
    f = _files(spark, sf_dir)
    return X.fatigue(f.where("content IS NOT NULL"), python_facts(f))


def detector_recall(spark, sf_dir):
    """A-25: files with a Syntax Issue against files that don't parse as Python."""
    f = _files(spark, sf_dir)
    said = table(spark, sf_dir, "issue_snapshots").where("category LIKE '%Syntax%' AND file LIKE '%.py'").select("project_root", F.col("file").alias("path"))
    return X.confusion(said, python_facts(f).where("kind = 'syntax'"), ["project_root", "path"])


_N = len(SCRIPT_TEMPLATES)
ORACLE = {"script_rule_counts": f"SELECT rule_id, count(*) AS n FROM part JOIN (VALUES (0,'JSSTR001'),(1,'JSSTR002'),(2,'JSSTR003'),(3,'JSSTR004'),(5,'JSSTR007'),(6,'JSSTR006')) t(k, rule_id) ON p_size % {_N} = k GROUP BY 1"}
QUERIES = {n: globals()[n] for n in ("script_rule_counts", "script_structure", "registry_ambiguities", "stereotype_scores", "fatigue_index", "detector_recall")}
