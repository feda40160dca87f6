import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions.text import chunks_of, explode_lines, module_name
from codeloom.operators import integrity as I
from codeloom.operators import line_rules as L
from codeloom.operators import registries as R
from codeloom.operators import settings as S
from codeloom.operators.script_structure import blank_comments, structure_findings
from tests.conftest import rows

BAD = ["", " a", "a  b", "x" * 300, "~/a", "/a", "a\\b", "a/../b", "a//b", "./a", "a:b", "a/CON.txt", "a/com¹", "a/b.", "a%2Fb", "a%252Fb", "%2e%2e/a", "a/․․/b", "a／b", "a\u200bb", "a\ue000b", "a/" + "y" * 200, "a/ b"]
GOOD = ["a/b.py", "docs/x-1_2.md", "a%20b", "ünï/c.txt", ".env"]


@pytest.mark.parametrize("path", BAD)
def test_unsafe(path):
    assert P.unsafe_reason(path)


@pytest.mark.parametrize("path", GOOD)
def test_safe(path):
    assert P.unsafe_reason(path) is None


def test_path_columns(spark):
    df = spark.createDataFrame([("ok.py",), ("../x",), (None,), (" a",), ("https://x",)], "ref string")
    assert [r[0] for r in df.select(P.evidence_path_problem(F.col("ref"))).collect()] == [None, "traversal", "not a text", "blank at the ends", "remote"]
    assert [r[0] for r in df.select(P.unsafe_path(F.col("ref"))).collect()][:3] == [None, "dot part", "empty"]


def test_lines_and_chunks(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "x\u2028y\n\n")], "i int, content string")
    assert rows(explode_lines(df)) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (4, 1, "x"), (4, 2, "y"), (4, 3, "")]
    c = spark.createDataFrame([("abcdefghij",), ("ab",), ("",)], "t string").select(F.inline(chunks_of(F.col("t"), 4, 1)))
    assert [tuple(r) for r in c.collect()] == [(0, 0, "abcd"), (1, 3, "defg"), (2, 6, "ghij"), (0, 0, "ab"), (0, 0, "")]
    with pytest.raises(ValueError):
        chunks_of(F.lit(""), 3, 3)
    m = spark.createDataFrame([("a/b/__init__.py",), ("a/c.py",)], "p string").select(module_name(F.col("p")))
    assert [r[0] for r in m.collect()] == ["a.b", "a.c"]


def test_manifest(spark):
    m = spark.createDataFrame([("a", 1, "AA"), ("b", 2, "bb"), ("c", 3, "cc"), ("d", None, None)], "path string, size bigint, sha256 string")
    t = spark.createDataFrame([("a", 1, "aa"), ("b", 3, "xx"), ("e", 1, "ee"), ("d", 5, "dd")], "path string, size bigint, sha256 string")
    assert rows(I.manifest_diff(m, t, ["path"])) == [("b", "MANIFEST003"), ("b", "MANIFEST004"), ("c", "MANIFEST002"), ("e", "MANIFEST005")]
    lines = spark.createDataFrame([("a" * 64 + "  x y.py  size=3",), ("bad",), ("",)], "value string")
    assert rows(I.parse_manifest(lines).select("path", "size", "error")) == [(None, None, "MANIFEST001"), ("x y.py", 3, None)]


def test_collisions_hygiene_structure_links(spark):
    df = spark.createDataFrame([("p", "A.py"), ("p", "a.py"), ("p", "a.py"), ("q", "a.py"), ("p", None)], "project_root string, path string")
    assert rows(I.path_collisions(df, ["project_root"])) == [("p", "a.py", "A.py")]
    t = spark.createDataFrame([(1, "a.json", '{"a":1,"a":2}'), (2, "b.toml", "a = "), (3, "c.xml", "<a>"), (4, "d.ini", "x\n[a"), (5, "e.json", "{}\n"), (6, "f.txt", "\ufeffa\r\nb\nc"), (7, "g.txt", None)], "i int, path string, content string")
    assert rows(I.structured_errors(t, ["i"])) == [(1, "STRUCT001"), (2, "STRUCT002"), (3, "STRUCT003"), (4, "STRUCT008")]
    assert ("6", "LINES001") in {(str(a), b) for a, b in rows(I.hygiene(t, ["i"]))}
    links = I.links(spark.createDataFrame([("p", "d/a.md", "[x](../b.md) [y](c.md#z) <a href='http://h'> [r]: ./b.md\n")], "project_root string, path string, content string"), ["project_root", "path"])
    files = spark.createDataFrame([("p", "b.md")], "project_root string, path string")
    assert rows(I.unresolved_links(links, files).distinct()) == [("p", "d/a.md", "c.md#z")]


YAML = {"a: 1\nb:\n  a: 1\n": None, "a: 1\na: 2\n": "STRUCT007", "- a: 1\n  b: 2\n- a: 1\n": None, "- a: 1\n  a: 2\n": "STRUCT007", "k:\n  - a: 1\n    b: 1\n  - a: 2\nm:\n  a: 1\n": None, "a: {b: 1, b: 2}\n": "STRUCT009", "\ta: 1\n": "STRUCT004", "a: [1\n": "STRUCT005", "x:\n  a: 1\ny:\n  a: 1\n": None}


@pytest.mark.parametrize("text,want", YAML.items())
def test_yaml(text, want):
    assert I._yaml(text) == want


def test_zip(spark, tmp_path):
    for name, members in {"ok.zip": ["r/a", "r/b"], "bad.zip": ["r/a", "r/A", "../x"]}.items():
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for m in members:
                z.writestr(m, "x")
        (tmp_path / name).write_bytes(b.getvalue())
    (tmp_path / "no.zip").write_bytes(b"nope")
    members = I.zip_members(spark.read.format("binaryFile").load(str(tmp_path)))
    got = {(r.archive.rsplit("/", 1)[1], r.rule_id) for r in I.archive_findings(members).collect()}
    assert got == {("bad.zip", "ARCHIVE006"), ("bad.zip", "ARCHIVE002"), ("bad.zip", "ARCHIVE015"), ("no.zip", "ARCHIVE003")}


def test_scripts(spark):
    assert blank_comments("a // b\n'// c' /* d\ne */ f") == "a     \n'// c'     \n     f"
    code = "const q = location.search;\n" + "\n" * 19 + "el.innerHTML = q;\n" + "\n" * 3 + "el.innerHTML = q;\n"
    df = spark.createDataFrame([(1, "a.js", code), (2, "b.js", "// document.domain = 'x'\n"), (3, "c.py", "document.domain = 1\n"), (4, "d.ts", None)], "payload_id int, path string, content string")
    assert rows(structure_findings(df)) == [(1, 21, "JSSTR007")]


def test_line_rules(spark):
    df = spark.createDataFrame([(1, "p", "a.js", "eval (x)\n<a target='_blank'>\n<a target='_blank' rel='noopener'>\n"), (2, "p", "a.py", "eval(x)  # TODO\n"), (3, "p", "tests/a.py", "# TODO\n"), (4, None, None, "# FIXME\n")], "payload_id int, project_root string, path string, content string")
    assert rows(L.line_findings(df).select("payload_id", "line_number", "rule_id")) == [(1, 1, "JS001"), (1, 2, "JS007"), (2, 1, "TXT002"), (4, 1, "TXT002")]
    js = spark.createDataFrame([(1, "a.js", "try {\n\nfetch(u)\n"), (2, "b.js", "try {\n\n\nfetch(u)\n")], "payload_id int, path string, content string")
    assert rows(L.fetch_without_handler(js)) == [(2, 4)]
    d = spark.createDataFrame([(1, "Dockerfile", "FROM x\n"), (2, "Dockerfile", "FROM x\nHEALTHCHECK y\nUSER app\n"), (3, "m/versions/a.py", "down_revision = 1\nDROP TABLE t\n")], "payload_id int, path string, content string").withColumn("project_root", F.lit("p"))
    assert rows(L.file_findings(d).select("payload_id", "rule_id")) == [(1, "DEPLOY010"), (1, "DEPLOY012"), (3, "MIG020"), (3, "MIG040")]
    g = L.grep(df, [L.GrepPattern("e", "EVAL", include=("*.js",), ignore_case=True), L.GrepPattern("t", "TODO", exclude=("tests/**",))])
    assert rows(g.select("payload_id", "rule_id")) == [(1, "GREP001:e"), (2, "GREP001:t")]
    assert L.grep(df, []).count() == 0


def test_registries(spark):
    code = "RULES = ['a', 'A ', 'b']\nPOLICY = [{'role': 'x', 'resource': '*', 'effect': 'allow', 'on': 'true'}, {'role': 'x', 'resource': '/a', 'effect': 'allow'}, {'role': 'x', 'resource': '/a', 'effect': 'deny'}]\nROUTES = {'k': 1, 'k': 2}\nother = ['a', 'a']\n"
    js = json.dumps({"rules": [{"id": 1}, {"id": 2}, {"id": 1}]})
    df = spark.createDataFrame([(1, "a.py", code), (2, "b.json", js), (3, "c.json", "{"), (4, "d.py", "x = [")], "payload_id bigint, path string, content string")
    got = {(r.payload_id, r.rule_id) for r in R.ambiguities(R.array_elements(df)).collect()}
    assert got == {(1, "ARR001"), (1, "ARR002"), (1, "ARR004"), (1, "ARR005"), (2, "ARR003")}


def test_settings(spark):
    df = spark.createDataFrame([(1, "p", "a.py", "os.environ['DB_URL']\nos.getenv('KEY_A')\nimport redis\n"), (2, "p", ".env.example", "DB_URL=postgres://x\nOLD_ONE=1\n"), (3, "q", "b.py", "os.getenv('ZZZ')")], "payload_id int, project_root string, path string, content string")
    assert rows(S.env_contract(S.env_used(df), S.env_documented(df))) == [("p", "KEY_A", "CFG001"), ("p", "OLD_ONE", "CFG002")]
    inline = spark.createDataFrame([("src/a/x.py", ["@t1"]), ("src/b.py", ["@t2"])], "path string, owners array<string>")
    owners = spark.createDataFrame([("/src/", ["@t2"]), ("src/a/*", ["@t3"])], "pattern string, owners array<string>")
    assert rows(S.owner_conflicts(inline, owners).select("path")) == [("src/a/x.py",)]
