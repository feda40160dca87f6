from pyspark.sql import functions as F

from codeloom.operators import governance as G
from tests.conftest import rows

I = "seq int, file string, category string, severity string, detector string, description string, line_number int, location string, confidence string"


def _issues(spark, *r):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(r)], I)


A = ("a.py", "PY001: secret", "HIGH", "d", "x", 1, None, "HIGH")
B = ("b.py", "TXT002: marker", "odd", "d", "y", 0, "", None)


def test_fingerprint_treats_null_and_zero_alike(spark):
    x = G.normalised(_issues(spark, B, ("b.py", "TXT002: marker", None, "d", "y", None, None, "certain")))
    assert x.select("fingerprint").distinct().count() == 1
    assert rows(x.select("severity", "confidence").distinct()) == [("MEDIUM", "medium")]
    assert len(x.first()["fingerprint"]) == 16


def test_dedupe_keeps_the_first(spark):
    d = G.deduplicated(G.normalised(_issues(spark, A, B, A, A)), [F.col("seq")])
    assert rows(d.select("seq", "duplicates")) == [(0, 2), (1, 0)]
    assert G.deduplicated(G.normalised(_issues(spark, A).limit(0)), [F.col("seq")]).count() == 0


def test_suppressions(spark):
    x = G.normalised(_issues(spark, A, B)).withColumn("issue_id", F.col("seq"))
    s = G.suppression_frame(spark, [{"rule_id": "PY001", "file": "other.py"}, {"rule_id": "PY001"}, {"rule_id": "PY001", "file": "a.py"}, {"fingerprint": "nope"}])
    stay, skipped, unused = G.apply_suppressions(x, s)
    assert rows(stay.select("seq")) == [(1,)]
    assert rows(skipped.select("seq", "idx")) == [(0, 1)]
    assert rows(unused.select("idx")) == [(0,), (2,), (3,)]


def test_process_reports_gates(spark):
    s = G.suppression_frame(spark, [{"rule_id": "ZZZ", "owner": "o", "reason": "r", "expires": "2020-01-01"}])
    r = G.process(_issues(spark, A, A, B), s, G.Policy({"HIGH": 0}, "HIGH"), None, [F.col("seq")], F.lit("2024-01-01").cast("date"))
    kinds = rows(r.issues.groupBy("category").agg(F.count(F.lit(1))))
    assert kinds == [("PY001: secret", 1), ("Quality gate", 2), ("Suppression governance", 2), ("TXT002: marker", 1)]
    assert G.blocking(r.issues).first()[0] is True


def test_empty_summary(spark):
    row = G.severity_summary(_issues(spark, A).limit(0)).first().asDict()
    assert set(row.values()) == {0}
    assert G.blocking(_issues(spark, A).limit(0)).first()[0] is False
