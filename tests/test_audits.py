import pytest

from codeloom.operators import pytest_facts as T
from codeloom.operators import suites as S
from codeloom.operators.python_facts import python_facts
from tests.conftest import rows

FILES = [
    ("pkg/core.py", "def used(a: int) -> int:\n    return a\n\ndef unused(a):\n    return a\n\nclass Box:\n    def open(self):\n        pass\n"),
    ("tests/test_core.py", "import pytest\nfrom pkg.core import used, Box\n\ndef check(x):\n    assert x\n\n@pytest.mark.skip()\ndef test_a():\n    used(1)\n\ndef test_b():\n    check(used(1))\n\ndef test_c():\n    try:\n        Box().open()\n    except Exception:\n        pass\n"),
]


@pytest.fixture(scope="module")
def facts(spark):
    return python_facts(spark.createDataFrame([(i, "/p", p, c) for i, (p, c) in enumerate(FILES)], "payload_id bigint, project_root string, path string, content string")).cache()


def test_references(facts):
    got = {r.leaf: r.covered for r in T.referenced(facts).collect()}
    assert got == {"used": True, "unused": False, "Box": True, "open": True}


def test_findings(facts):
    assert rows(T.pytest_findings(facts)) == [(1, 14, "PYTEST021"), (1, 17, "PYTEST022"), (1, 7, "PYTEST020"), (1, 8, "PYTEST021")]
    assert rows(T.untyped_public(facts)) == [("/p", 2)]


def test_completeness(facts):
    assert rows(T.completeness_findings(facts, 0.9)) == [("/p", "PYTEST031", "3 of 4"), ("/p", "PYTEST034", "1")]


def test_attributes(spark):
    f = python_facts(spark.createDataFrame([(1, "/p", "a.py", "import json as j\nj.dumps(1)\nj.nope(1)\nother.x\n")], "payload_id bigint, project_root string, path string, content string"))
    assert rows(T.unknown_attributes(f, T.module_index(spark, ["json"], True)).select("name")) == [("json.nope",)]
    assert T.unknown_attributes(f, T.module_index(spark, ["json"])).count() == 0


SUITE = [("1", "sql", "q = input()\ncur.execute(q)\n", ["PYDF001"]), ("2", "sql", "cur.execute('x')\n", ["!PYDF"]), ("3", "eval", "eval(x)\n", ["PY002"]), ("4", "eval", "x = 1\n", ["PY002"]), ("5", "eval", "eval(y)\n", ["!PY002"])]


def test_suites(spark):
    cases = spark.createDataFrame(SUITE, S.CASES)
    assert rows(S.suite_failures(cases, S.python_detector)) == [("4", "PY002"), ("5", "!PY002")]
    assert rows(S.suite_inventory(cases)) == [("eval", 3), ("sql", 2)]
    assert S.check_profiles([]) == ("generic",)
    with pytest.raises(ValueError):
        S.check_profiles(["nope"])


def test_registries_and_policies(spark):
    e = spark.createDataFrame([("a", "x", "on"), ("a", "y", "on"), (None, "z", "odd"), ("b", None, "on")], "id string, owner string, status string")
    assert rows(S.registry_errors(e, ["owner"], {"status": ("on", "off")})) == [(None, "bad status"), (None, "blank id"), ("a", "duplicate id"), ("b", "missing owner")]
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    m = spark.createDataFrame([("issues", 5.0)], "name string, value double")
    got = rows(S.policy_errors({"required_gates": ["a", "b"], "required_artifacts": ["f"], "budgets": {"issues": 3}}, one("a"), one(), m))
    assert got == [("POL010", "b"), ("POL012", "f"), ("POL020", "issues")]


def test_throughput(spark):
    t = S.throughput(spark, 60)
    assert t["rows"] == 60 and t["files_per_second"] > 1
