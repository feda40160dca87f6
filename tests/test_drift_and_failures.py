import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators import drift as D
from codeloom.operators import suites as S
from codeloom.sources import corpus
from tests.conftest import rows

H = "project_root string, path string, seq int, signatures array<string>, safety_checks array<string>, interface_hash string, verdict string"


def test_contract_drift(spark):
    steps = [(["f(a)", "g()"], ["type_check"]), (["f(a, b)", "h()"], []), (["async f(a, b)", "h()"], []), (["f(a)", "g()"], ["type_check"])]
    data = [("p", "a.py", i, s, c, str(s), "REJECTED" if i == 0 else "UNKNOWN") for i, (s, c) in enumerate(steps)] + [("p", None, 0, ["x()"], [], "x", None)]
    h = spark.createDataFrame(data, H)
    got = D.contract_steps(h).where("path IS NOT NULL").orderBy("seq").select("delta", "negative").collect()
    assert [(round(d, 6), n) for d, n in got] == [(0.0, False), (3.0, True), (0.5, False), (1.8, True)]
    found = rows(D.contract_drift(h).select("seq", "rule_id", F.round("score", 3)))
    assert found == [(2, "Cumulative drift", 3.5), (3, "Cumulative drift", 5.3), (3, "Regression", None)]
    assert D.contract_drift(h.limit(0)).count() == 0


def test_history(spark, tmp_path):
    h = spark.createDataFrame([("p", "a.py", 0, ["f()"], [], "x", None)], H)
    path = str(tmp_path / "history")
    assert D.read_history(spark, path, H).count() == 0
    D.append_history(h, path)
    D.append_history(h.withColumn("seq", F.lit(1)), path)
    assert rows(D.read_history(spark, path, H).select("seq")) == [(0,), (1,)]


def test_safety_checks(spark):
    d = spark.createDataFrame([(1, "if x is not None:\n  pass\n"), (2, "try:\n  validate(x)\n"), (3, None), (4, "")], "id int, t string")
    assert [r[0] for r in d.select(D.safety_checks(F.col("t"))).collect()] == [["null_check"], ["input_validation", "error_handling"], [], []]


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("y = 1\n")
    t = corpus.tree(spark, str(tmp_path)).withColumn("error", F.when(F.col("path") == "b.py", "Permission denied"))
    assert rows(corpus.routed(t).select("path", "status")) == [("a.py", "row"), ("b.py", "failed")]
    assert rows(corpus.failure_issues(t).select("file", "severity")) == [("b.py", "HIGH")]
    first, truncated = corpus.first_files(t, 1)
    assert rows(first.select("path")) == [("a.py",)] and truncated.first()[0] is True


@pytest.mark.skipif(os.geteuid() == 0, reason="root reads everything")
def test_a_file_without_permission(spark, tmp_path):
    (tmp_path / "c.py").write_text("z = 1\n")
    os.chmod(tmp_path / "c.py", 0)
    assert corpus.tree(spark, str(tmp_path)).first()["error"]


def test_counts(spark):
    d = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x")], "domain string, status string")
    assert rows(S.counts_by(d, ("domain", "status"))) == [("domain", "a", 2), ("domain", "b", 1), ("status", None, 1), ("status", "x", 2)]
    r = spark.createDataFrame([(1, "3 passed, 1 error in 2s\n2 passed, 2 errors"), (2, "nothing"), (3, None)], "id int, text string")
    assert rows(S.run_counts(r, "id")) == [(1, "errors", 3), (1, "passed", 5)]
