import json

from pyspark.sql import functions as F

from codeloom.operators import drift as D
from codeloom.operators import indices as X
from codeloom.plugins import Registry, policy_pack
from codeloom.sinks import reports as W
from codeloom.sources import corpus as C
from codeloom.sources import reports as R
from codeloom.streaming import findings as S
from tests.conftest import rows


def test_tree_and_routing(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, data in {"a b/x+y.py": b"x = 1\n", "blank.md": b" \n", "bad.txt": b"\xff\xfe\x00", "pic.png": b"1", "node_modules/z.js": b"1", ".env": b"A=1\n"}.items():
        (tmp_path / name).write_bytes(data)
    ok, skips = C.payloads(spark, str(tmp_path))
    assert rows(ok.select("path", "content")) == [("a b/x+y.py", "x = 1\n")]
    assert rows(skips) == [("bad.txt", "encoding"), ("blank.md", "blank")]
    assert {r.path for r in C.text_files(C.tree(spark, str(tmp_path))).collect()} == {"a b/x+y.py", "blank.md", "bad.txt", ".env"}
    assert C.synthetic_ring(spark, 5).count() == 5


def test_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"issues": [{"file": "a", "severity": "odd", "line_number": 3}, {"file": "b", "severity": "HIGH", "category": "X: y"}]}))
    (tmp_path / "bad.json").write_text("[]")
    t = R.whole_files(spark, str(tmp_path))
    assert rows(R.native_issues(t).select("file", "severity", "seq")) == [("a", "MEDIUM", 0), ("b", "HIGH", 1)]
    assert R.unreadable_reports(t).count() == 1
    assert R.baseline_fingerprints(t).count() == 2
    s = spark.createDataFrame([('[{"rule_id": "A"}]',), ('{"suppressions": [{"rule_id": "B", "extra": 1}]}',), ("x",)], "text string")
    assert {r.rule_id for r in R.suppressions(s).collect()} == {"A", "B"}


def test_external(spark):
    data = [
        ("ruff", json.dumps([{"filename": "a.py", "code": "E501", "message": "m", "location": {"row": 4}}])),
        ("bandit", json.dumps({"results": [{"filename": "b.py", "line_number": 2, "test_id": "B105", "issue_severity": "HIGH", "issue_text": "t"}]})),
        ("semgrep", json.dumps({"results": [{"check_id": "c", "path": "c.py", "start": {"line": 9}, "extra": {"severity": "ERROR", "message": "m"}}]})),
        ("pyright", json.dumps({"generalDiagnostics": [{"file": "d.py", "severity": "error", "message": "m", "range": {"start": {"line": 0}}}]})),
        ("other", "{}"),
        ("ruff", "{"),
    ]
    got = rows(R.external_issues(spark.createDataFrame(data, "tool string, text string")).select("category", "severity", "line_number"))
    assert got == sorted([("EXTN001", "HIGH", None), ("EXTN002", "MEDIUM", None), ("external.bandit.B105", "HIGH", 2), ("external.pyright.unknown", "HIGH", 1), ("external.ruff.E501", "MEDIUM", 4), ("external.semgrep.c", "HIGH", 9)], key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_dependencies(spark):
    t = spark.createDataFrame([('[project]\ndependencies = ["a>=1"]\n[tool.poetry.dependencies]\npython = "3"\nb = "^2"\n',), ("[",)], "text string")
    assert rows(R.pyproject(t)) == [("poetry", "b ^2"), ("project", "a>=1")]
    p = spark.createDataFrame([('{"dependencies": {"x": "^1"}, "devDependencies": {"y": "2"}}',)], "text string")
    assert rows(R.package_json(p)) == [("dependencies", "x", "^1"), ("devDependencies", "y", "2")]
    q = spark.createDataFrame([("A_b==1 # c",), ("-r x",), ("",)], "value string")
    assert rows(R.requirements(q)) == [("a_b", "A_b==1")]


ISSUES = "file string, category string, severity string, detector string, description string, line_number int, location string, confidence string"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a<b", "PY008: x", "HIGH", "d", "50% | a\nb", 3, None, "high"), ("c", "T: y", "LOW", "d", None, None, None, "low")], ISSUES)
    s = json.loads(W.sarif(df))
    assert [r["ruleId"] for r in s["runs"][0]["results"]] == ["PY008", "T"]
    texts = spark.createDataFrame([("ok", json.dumps(s)), ("no", "{}")], "path string, text string")
    assert {r.rule_id for r in R.sarif_errors(texts).where("path = 'ok'").collect()} == set()
    assert "SARIF002" in {r.rule_id for r in R.sarif_errors(texts).where("path = 'no'").collect()}
    assert 'tests="2"' in W.junit(df) and 'tests="1"' in W.junit(df.limit(0))
    assert "\\|" in W.markdown(df) and "&lt;" in W.html(df)
    assert "TOTAL=2" in W.console(df)
    assert W.annotations(df)[0] == "::error file=a<b,line=3::50%25 | a%0Ab"
    assert "<td>1</td>" in W.dashboard(df, "detector")
    assert [r.suggestion for r in W.fix_suggestions(df).collect()] == ["pass timeout= to the request"]
    W.write_tables(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/issues")).count() == 2


def test_plugins(spark, tmp_path):
    (tmp_path / "p.py").write_text("from codeloom.plugins import Rule\nfrom pyspark.sql import functions as F\ndef run(c):\n    return c.where(F.contains('content', F.lit('zz'))).select('payload_id', 'path', F.lit(1).alias('line'), F.lit('P1').alias('rule_id'), F.lit('LOW').alias('severity'))\ndef register_rules():\n    return [Rule('P1', 'LOW', run)]\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('no')\n")
    r = Registry()
    for f in ("p.py", "bad.py", "p.py"):
        r.load(str(tmp_path / f))
    assert len(r.rules) == 1 and len(r.errors) == 2
    corpus = spark.createDataFrame([(1, "a", "zz"), (2, "b", None)], "payload_id bigint, path string, content string")
    assert r.run(corpus).count() == 3
    got = rows(policy_pack(corpus, lambda p, t: [("has", 1)] if t else 1 / 0, "k").select("payload_id", "rule_id"))
    assert got == [(1, "k.has"), (2, "PLUGINAPI002")]


def test_measures(spark):
    e = spark.createDataFrame([("a",), ("b",)], "k string")
    o = spark.createDataFrame([("b",), ("c",), ("d",)], "k string")
    assert tuple(X.confusion(e, o, ["k"]).first()) == (1, 1, 2, 0.5, 1 / 3)
    assert tuple(X.confusion(e.limit(0), o.limit(0), ["k"]).first())[3:] == (1.0, 1.0)
    m = spark.createDataFrame([("killed",), ("survived",), ("skipped",)], "status string")
    assert X.mutation_score(m).first()[0] == 50.0


STEPS = [("e", 1, 1.0, True), ("e", 2, 1.0, True), ("e", 3, 0.5, True), ("f", 1, None, False), ("e", 4, 1.0, False)]


def test_drift_stream_agrees_with_batch(spark, tmp_path):
    schema = "entity string, seq bigint, weight double, negative boolean"
    df = spark.createDataFrame(STEPS, schema)
    batch = rows(D.drift_state(df, "entity", ["seq"], F.col("weight"), F.col("negative")).select("entity", "seq", "score", "run", "alert"))
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = S.drift_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("drift_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("drift_out")) == batch
    assert [r[4] for r in batch] == [False, False, True, True, False]


def test_finding_stream(spark, tmp_path):
    rows_ = [(1, "p", "a.py", "# TODO x\n", "2024-01-01T00:00:00"), (2, "p", "a.py", "# TODO x\n", "2024-01-01T00:10:00")]
    spark.createDataFrame(rows_, "payload_id bigint, project_root string, path string, content string, scanned_at string").coalesce(1).write.json(str(tmp_path / "in"))
    out = S.finding_stream(S.payload_stream(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("found_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("found_out").count() == 1


def test_claims(spark):
    from codeloom.operators import claims as K

    docs = spark.createDataFrame([(1, "{"), (2, "[]"), (3, None), (4, "{}")], "doc_id bigint, text string")
    p = {(r.doc_id, r.rule_id) for r in K.provenance_findings(docs).collect()}
    assert {(1, "PROV020"), (2, "PROV001"), (4, "PROV002"), (4, "PROV026")} <= p and not [x for x in p if x[0] == 3]
    assert {(4, "EVID002"), (4, "EVID006")} <= {(r.doc_id, r.rule_id) for r in K.evidence_findings(docs).collect()}
