import json
import math

from pyspark.sql import functions as F

from codeloom.operators import call_graph as C
from codeloom.operators import claims
from codeloom.operators import governance as G
from codeloom.operators import indices as X
from codeloom.operators import integrity as I
from codeloom.operators import line_rules as L
from codeloom.operators import settings as S
from codeloom.operators.registries import ambiguities, array_elements
from codeloom.plans.claims import TEMPLATES
from codeloom.sinks import reports
from tests.conftest import rows


def _corpus(spark, *files):
    return spark.createDataFrame([(i, "p", path, text) for i, (path, text) in enumerate(files)], "payload_id bigint, project_root string, path string, content string")


def test_file_rules_on_very_long_files(spark):
    long = "owner: x\n" + "value = 1  # nothing\n" * 100_000
    names = ("a.py", "Dockerfile", "compose.yml", ".github/workflows/a.yml", "a.service", "nginx.conf", "migrations/1.py", "x.md")
    found = L.file_findings(_corpus(spark, *[(n, long) for n in names]))
    assert found.count() > 0
    hit = L.file_findings(_corpus(spark, ("a.py", long + "# bypass review\n"), ("b.md", "Ignore  Owner"), ("c.js", "bypass review"), ("d.py", "owner: a\nnot the owner\n")))
    assert rows(hit.where("rule_id = 'OWN010'").select("payload_id")) == [(0,), (1,)]


def test_docker_user(spark):
    found = L.file_findings(_corpus(spark, ("Dockerfile", "USER app\nUSER root\nHEALTHCHECK x\n"), ("a/Dockerfile", "USER app\nHEALTHCHECK x\n"), ("b/Dockerfile", "HEALTHCHECK x\n")))
    assert rows(found.select("payload_id", "rule_id")) == [(0, "DEPLOY012"), (2, "DEPLOY012")]


def test_rules_that_ask_the_whole_file(spark):
    files = (("app/router.py", "decision = 1\n"), ("app/a.py", "bot.deleteWebhook()\nbot.setWebhook()\n"), ("admin/r.py", "@r.get('/x')\n"), ("admin/s.py", "@r.get('/x')\nDepends(a)\n"), ("b.py", "execute(x)\n"), ("c.py", "execute(x)\nverify(x)\n"), ("d.py", None))
    found = L.line_findings(_corpus(spark, *files)).select("payload_id", "rule_id")
    assert rows(found) == [(0, "autonomy_canon.second_brain.risk"), (1, "messaging.webhook.lifecycle_mix"), (2, "fastapi.route_without_dependency_signal"), (4, "autonomy_canon.execution_without_evidence.risk")]


def test_long_lines_are_kept(spark):
    line = "x = 1  # TODO " + "y" * 500
    assert L.line_findings(_corpus(spark, ("src/a.py", f"  {line}\t\n"))).first()["line"] == line


def test_broken_patterns_and_budget(spark):
    patterns = [L.GrepPattern("bad", "a("), L.GrepPattern("good", "a")]
    good, bad = L.broken_patterns(spark, patterns)
    assert [p.id for p in good] == ["good"] and rows(bad) == [("bad", "GREP000", "HIGH")]
    found = L.grep(_corpus(spark, ("x", "a\na\n")), patterns)
    assert found.count() == 2 and rows(L.over_budget(found, 2)) == [("GREP010", "HIGH", 2)] and L.over_budget(found, 3).count() == 0


def test_suppressions_by_every_prefix(spark):
    i = spark.createDataFrame([(1, "a.py", "GREP001:merge_marker: x", "f1"), (2, "a.py", "GREP001", "f2"), (3, "a.py", None, "f3")], "issue_id int, file string, category string, fingerprint string")
    s = G.suppression_frame(spark, [{"rule_id": "GREP001:merge_marker"}, {"rule_id": "GREP001"}])
    assert rows(G.suppression_matches(i, s)) == [(1, 0)]


def test_long_and_short_lists_of_suppressions_agree(spark):
    i = spark.createDataFrame([(1, "a.py", "R1:x: y", "f1"), (2, "b.py", "R1:x", "f2"), (3, "c.py", None, "f3"), (4, None, "R2: z", "f4"), (5, "a.py", "R2: z", None)], "issue_id int, file string, category string, fingerprint string")
    s = G.suppression_frame(spark, [{"rule_id": "R1", "file": "b.py"}, {"rule_id": "R1:x"}, {"fingerprint": "f3", "rule_id": "R9"}, {"rule_id": "R2", "file": "a.py"}, {"owner": "o"}, {"rule_id": "", "fingerprint": ""}])
    short = [rows(x.select("idx") if "issue_id" not in x.columns else x.select("issue_id")) for x in G.apply_suppressions(i, s)]
    G._INLINE, was = 2, G._INLINE
    try:
        long = [rows(x.select("idx") if "issue_id" not in x.columns else x.select("issue_id")) for x in G.apply_suppressions(i, s)]
    finally:
        G._INLINE = was
    assert short == long == [[(4,)], [(1,), (2,), (3,), (5,)], [(4,), (5,)]]


def test_queues_and_maturity(spark):
    d = spark.createDataFrame([("CRITICAL", "x"), ("HIGH", "python_dataflow"), ("HIGH", "x"), ("HIGH", None), ("LOW", "x")], "s string, d string")
    assert [r[0] for r in d.select(G.review_queue(F.col("s"), F.col("d"))).collect()] == ["P0", "P0", "P1", "P1", "P2"]
    m = spark.createDataFrame([(1, 1, 1, 3, 0, 0), (0, 0, 0, 0, 0, 3), (0, 0, 0, 0, 1, 1), (9, 0, 0, 9, 0, 0)], "c int, h int, m int, t int, f int, s int")
    assert [r[0] for r in m.select(G.maturity(*map(F.col, "chmtfs"))).collect()] == [71, 94, 78, 0]


def test_databases(spark):
    files = ((".env.example", "DATABASE_URL=postgres://x\nSQLITE_PATH=a.db\n# mysql\n"), ("deploy/run.py", "x = 'sqlite:///a'\n"), ("tests/sample.py", "import sqlite3\nimport psycopg2\n"), (None, None))
    found = S.db_findings(S.db_markers(_corpus(spark, *files))).select("path", "rule_id", "severity")
    assert rows(found) == [(".env.example", "DB001", "HIGH"), (".env.example", "DB004", "HIGH"), ("<db-consistency>", "DB002", "HIGH"), ("deploy/run.py", "DB003", "HIGH"), ("tests/sample.py", "DB001", "MEDIUM")]


def test_settings_defaults(spark):
    c = _corpus(spark, (".env.example", "API_TOKEN=abc\nHOST_NAME='localhost'\nEMPTY_SECRET=\nDEBUG=debug\n"), ("a.py", "os.getenv('API_TOKEN'); os.getenv('NEW_ONE')\n"))
    found = S.env_contract(S.env_used(c), S.env_documented(c)).select("name", "rule_id")
    assert rows(found) == [("API_TOKEN", "CFG003"), ("DEBUG", "CFG002"), ("EMPTY_SECRET", "CFG002"), ("HOST_NAME", "CFG002"), ("HOST_NAME", "CFG004"), ("NEW_ONE", "CFG001")]


def test_migrations_and_dependencies(spark):
    c = _corpus(spark, ("migrations/a.py", "revision = 'r1'\n"), ("migrations/b.py", "revision = 'r1'\n"), ("pyproject.toml", '[project]\ndependencies = [\n  "a>=1",\n  "b==2",\n]\n'), ("web/package.json", json.dumps({"dependencies": {"x": "^1", "y": "git+ssh://h", "z": "1.0"}})))
    assert rows(S.migration_findings(c).select("path", "rule_id")) == [("migrations/b.py", "MIG010")]
    assert rows(S.migration_findings(_corpus(spark, ("app.py", "DATABASE_URL = 'x'\n"))).select("rule_id")) == [("MIG001",)]
    assert rows(S.supply_files(c).select("rule_id", "detail")) == [("SUPPLY012", "a>=1"), ("SUPPLY030", ""), ("SUPPLY040", "x"), ("SUPPLY041", "y")]
    assert rows(S.supply_files(_corpus(spark, ("a.py", ""))).select("rule_id")) == [("SUPPLY001",)]


def test_claims_of_the_tool_itself(spark):
    d = spark.createDataFrame([(1, TEMPLATES[0]), (2, TEMPLATES[0].replace("late close", "found by the tool").replace('"tool_self_scan", "command"', '"human_review", "command"'))], "doc_id int, text string")
    found = claims.provenance_findings(d)
    assert found.where("doc_id = 1").count() == 0
    assert "PROV018" in {r.rule_id for r in found.where("doc_id = 2").collect()}


def test_stock_wording_by_hand(spark):
    text = "Это важный api. Один два три. Один два три."
    words, lengths = 9, {3: 3}
    assert words == sum(k * v for k, v in lengths.items())
    want = 1 / (1 + math.exp(-(10 / words - 3 * 1 / words - 2)))
    got = X.stereotype(spark.createDataFrame([(1, text), (2, "plain words"), (3, None), (4, "")], "id int, t string"), "id", "t").collect()
    assert abs(got[0].score - want) < 1e-9 and [r.score for r in got[1:]] == [0, 0, 0]
    assert X.above(spark.createDataFrame([(1, 0.8), (2, 0.7)], "id int, score double"), "score", 0.7, "Stereotype").count() == 1


def test_registries_in_scripts(spark):
    text = "const r = [['/a', f], ['/b', g], ['/A', h]];\nconst o = [{ route: '/x' }, { route: '/x' }];\nconst p = [{ effect: 'allow' }, { effect: 'deny' }];\n"
    assert rows(ambiguities(array_elements(_corpus(spark, ("a.ts", text)))).select("rule_id")) == [("ARR003",), ("ARR004",), ("ARR006",)]
    assert ambiguities(array_elements(_corpus(spark, ("a.py", "rules = ['', '', None, None]\n")))).count() == 0


def test_entries_behind_a_wildcard_need_no_join(spark):
    entry = lambda who, where: {"role": who, "resource": where}
    a = [entry("r", "/early"), entry("r", "*"), entry("s", "/other"), entry("R", "/late"), entry("r", "/*"), {"role": "r"}, entry("r", "/later")]
    b = {"x": [entry("r", "*")], "y": [entry("r", "/a"), {"resource": "**"}, {"path": "/b"}, entry("r", "/c")]}
    df = spark.createDataFrame([(1, "a.json", json.dumps(a)), (2, "b.json", json.dumps(b)), (None, "c.json", json.dumps(a))], "payload_id bigint, path string, content string")
    found = ambiguities(array_elements(df)).where("rule_id = 'ARR005'")
    assert rows(found.select("payload_id", "array_id", "idx")) == [(1, "$", 3), (1, "$", 6), (2, "$.y", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_bytes_and_links(spark):
    d = spark.createDataFrame([(1, "a.py", None, bytearray(b"\xff\xfe")), (2, "b.md", "%PDF-1\n", bytearray(b"%PDF-1\n")), (3, "c.go", "x", bytearray(b"x"))], "id int, path string, content string, data binary")
    assert rows(I.hygiene(d, ["id"])) == [(1, "EMPTY001"), (1, "ENCODING001"), (2, "CORRUPT002")]
    m = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "path string, size bigint, sha256 string")
    t = spark.createDataFrame([("a", 2, "y", True), ("b", 2, "x", False)], "path string, size bigint, sha256 string, is_link boolean")
    assert rows(I.manifest_diff(m, t, ["path"])) == [("a", "MANIFEST006"), ("b", "MANIFEST003")]


def test_graph_findings(spark):
    s = spark.createDataFrame([("g", 0.5), ("h", 0.1)], "graph string, unknown_ratio double")
    u = spark.createDataFrame([("g", "getattr", "getattr"), ("g", "d[k]()", "container lookup")], "graph string, raw string, reason string")
    assert rows(C.graph_findings(s, u, 0.25).select("graph", "rule_id")) == [("g", "CALLGRAPH001"), ("g", "CALLGRAPH002")]
    assert C.graph_findings(s, u).count() == 1


def test_reports_count_what_they_hold(spark):
    i = spark.createDataFrame([(f"{k}.py", "A: x", "HIGH", 1) for k in range(5)], "file string, category string, severity string, line_number int").withColumns({"detector": F.lit("d"), "description": F.lit("x"), "location": F.lit(""), "confidence": F.lit("low")})
    text = reports.junit(i, limit=3)
    assert 'tests="3" failures="3"' in text and text.count("<testcase") == 3 and 'name="total" value="5"' in text
    failed = spark.createDataFrame([("z.py", "gone")], "file string, reason string")
    run = json.loads(reports.sarif(i, failed=failed))["runs"][0]
    assert run["invocations"][0]["executionSuccessful"] is False and run["invocations"][0]["toolExecutionNotifications"][0]["message"]["text"] == "z.py: gone"
