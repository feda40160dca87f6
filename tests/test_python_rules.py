"""A positive and a negative twin for each rule over Python facts, and the flows."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import call_graph as C
from codeloom.operators import python_facts as P
from codeloom.operators import taint as T
from tests.conftest import rows

TWINS = {
    "PY001": ("api_key = 'abcdefghijklmnopqrstuvwxyz0123'\n", "name = 'abcdefghijklmnopqrstuvwxyz0123'\n"),
    "PY002": ("eval(x)\n", "model.eval(x)\n"),
    "PY003": ("try:\n    f()\nexcept E:\n    pass\n", "try:\n    f()\nexcept E:\n    log()\n"),
    "PY004": ("try:\n    f()\nexcept:\n    g()\n", "try:\n    f()\nexcept E:\n    g()\n"),
    "PY005": ("import subprocess as sp\nsp.run(c, shell=True)\n", "import subprocess as sp\nsp.run(c)\n"),
    "PY006": ("from pickle import loads\nloads(b)\n", "from json import loads\nloads(b)\n"),
    "PY007": ("import yaml\nyaml.load(s)\n", "import yaml\nyaml.load(s, Loader=yaml.SafeLoader)\n"),
    "PY008": ("import requests\nrequests.get(u)\n", "import requests\nrequests.get(u, timeout=3)\n"),
    "PY009": ("import time\nasync def f():\n    time.sleep(1)\n", "import time\ndef f():\n    time.sleep(1)\n"),
    "PY010": ("price: float = 1.0\n", "price: int = 1\n"),
    "PY011": ("def f(a=[]):\n    return a\n", "def f(a=None):\n    return a\n"),
    "PY012": ("import os\nos.system(c)\n", "import os\nos.stat(c)\n"),
    "PY013": ("import tempfile\ntempfile.mktemp()\n", "import tempfile\ntempfile.mkstemp()\n"),
    "PY014": ("assert x\n", "x = 1\n"),
    "PY015": ("cur.execute('a' + b)\n", "cur.execute('a', (b,))\n"),
    "PY016": ("import asyncio\nasyncio.create_task(f())\n", "import asyncio\nt = asyncio.create_task(f())\n"),
    "PY017": ("import hashlib\nhashlib.md5(b)\n", "import hashlib\nhashlib.sha256(b)\n"),
    "PY018": ("datetime.now()\n", "datetime.now(tz)\n"),
    "PY019": ("from a import *\n", "from a import b\n"),
    "PY020": ("open(p)\n", "open(p, 'rb')\n"),
    "PY021": ("import logging\nlogging.info(token)\n", "import logging\nlogging.info(size)\n"),
    "PY022": ("r.json()\n", "try:\n    r.json()\nexcept E:\n    f()\n"),
    "PY023": ("import random\ntoken = random.random()\n", "import random\nsize = random.random()\n"),
    "PY024": ("import requests\nrequests.get(u, verify=False, timeout=1)\n", "import requests\nrequests.get(u, timeout=1)\n"),
    "PY025": ("import urllib.request\nurllib.request.urlopen(u)\n", "import urllib.request\nurllib.request.urlopen(u, timeout=1)\n"),
    "PY026": ("import ssl\nssl._create_unverified_context()\n", "import ssl\nssl.create_default_context()\n"),
    "PY027": ("app.run(debug=True)\n", "app.run()\n"),
    "PY028": ("DEBUG = True\n", "DEBUG = False\n"),
    "Syntax": ("def f(:\n", "def f():\n    pass\n"),
    "Condition contradiction": ("if a:\n    if not a:\n        f()\n", "if a:\n    if not b:\n        f()\n"),
    "Type contradiction": ("n: int = 'x'\n", "n: int = 1\n"),
    "Docstring contradiction": ('def f():\n    """Returns an int."""\n    return None\n', 'def f():\n    """Returns an int."""\n    return 1\n'),
}


def _corpus(spark, files):
    return spark.createDataFrame([(i, "/p", p, c) for i, (p, c) in enumerate(files)], "payload_id bigint, project_root string, path string, content string")


def test_rule_twins(spark):
    files = [(f"src/m{i}_{j}.py", code) for i, pair in enumerate(TWINS.values()) for j, code in enumerate(pair)]
    found = {(r.path, r.rule_id) for r in P.rule_findings(P.python_facts(_corpus(spark, files))).collect()}
    for i, rule in enumerate(TWINS):
        assert (f"src/m{i}_0.py", rule) in found, rule
        assert (f"src/m{i}_1.py", rule) not in found, rule


def test_facts_edge_cases(spark):
    c = _corpus(spark, [("a.py", ""), ("b.py", None), (None, "x = 1"), ("c.txt", "def f(:"), ("d.py", "x\x00")])
    assert {r.path for r in P.python_facts(c).collect()} == {"d.py"}


SOURCE = "q = request.args.get('q')\n"
FLOWS = [
    (SOURCE + "cur.execute('a' + q)\n", {"PYDF001"}),
    (SOURCE + "cur.execute('a', (q,))\n", set()),
    (SOURCE + "q = escape(q)\ncur.execute(q)\n", set()),
    (SOURCE + "if x:\n    q = 'safe'\ncur.execute(q)\n", {"PYDF001"}),
    (SOURCE + "import os\nos.system(q)\n", {"PYDF002"}),
    (SOURCE + "import subprocess\nsubprocess.run(q)\n", set()),
    (SOURCE + "import subprocess\nsubprocess.run(q, shell=True)\n", {"PYDF002"}),
    (SOURCE + "Markup(q)\n", {"PYDF003"}),
    (SOURCE + "Runner.execute(q)\n", set()),
    ("def w(s):\n    cur.execute(s)\n\ndef v():\n    w(request.form.get('a'))\n", {"PYDF001"}),
    ("def src():\n    return input()\n\ndef v():\n    cur.execute(src())\n", {"PYDF001"}),
    ("def w(*a):\n    cur.execute(a)\n\ndef v():\n    w(1, input())\n", {"PYDF001"}),
    ("def w(**k):\n    cur.execute(k)\n\ndef v():\n    w(z=input())\n", {"PYDF001"}),
    ("for q in request.args:\n    cur.execute(q)\n", {"PYDF001"}),
]


def test_flows_in_a_file(spark):
    found = {}
    for r in T.taint_findings(T.python_flows(_corpus(spark, [(f"m{i}.py", c) for i, (c, _) in enumerate(FLOWS)]))).collect():
        found.setdefault(r.payload_id, set()).add(r.rule_id)
    for i, (code, want) in enumerate(FLOWS):
        assert found.get(i, set()) == want, code


PASSED = [
    ("def ident(x):\n    return x\nq = ident(request.args.get('q'))\ncur.execute(q)\n", 1),
    ("def ident(x):\n    return x\ncur.execute(ident(x=request.args.get('q')))\n", 1),
    ("def second(a, b):\n    return b\ncur.execute(second(request.args.get('q'), 'x'))\n", 0),
    ("def second(a, b):\n    return b\ncur.execute(second(*request.args.get('q')))\n", 1),
    ("def rest(a, *more, **named):\n    return more\ncur.execute(rest('x', request.args.get('q')))\n", 1),
    ("def rest(a, *more, **named):\n    return named\ncur.execute(rest('x', y=request.args.get('q')))\n", 1),
    ("def rest(a, *more, **named):\n    return named\ncur.execute(rest(request.args.get('q'), 'y'))\n", 0),
    ("def outer(x):\n    return inner('a' + x)\ndef inner(y):\n    return y\ncur.execute(outer(request.args.get('q')))\n", 1),
    ("class C:\n    def m(self, x):\n        return x\ncur.execute(C.m(c, request.args.get('q')))\n", 1),
    ("import html\ndef clean(x):\n    return html.escape(x)\ncur.execute(clean(request.args.get('q')))\n", 0),
]


@pytest.mark.parametrize("code,n", PASSED)
def test_helpers_hand_on_their_arguments(code, n):
    sources = [r for r in T.flows_of(code, "m", "m.py") if r[0] == "sink" and r[6].startswith("source:")]
    assert len(sources) == n


def test_flow_through_a_helper_is_a_finding(spark):
    found = rows(T.taint_findings(T.python_flows(_corpus(spark, [("m.py", PASSED[0][0])]))).select("line", "rule_id", "source"))
    assert found == [(4, "PYDF001", "flask-request-args")]


def test_flows_across_files(spark):
    files = [
        ("pkg/db.py", "def run(sql):\n    cursor.execute(sql)\n"),
        ("pkg/web.py", "def arg():\n    return request.args.get('q')\n"),
        ("app.py", "from pkg.db import run as r\nfrom pkg import web\n\ndef view():\n    r(sql=web.arg())\n    r('fixed')\n"),
    ]
    found = rows(T.taint_findings(T.python_flows(_corpus(spark, files))).select("path", "line", "rule_id", "source"))
    assert found == [("app.py", 5, "PYXDF001", "flask-request-args")]


def test_call_graph(spark):
    files = [
        ("pkg/__init__.py", "from .core import helper\n"),
        ("pkg/core.py", "def helper():\n    pass\n\nclass A:\n    def m(self):\n        self.n()\n    def n(self):\n        helper()\n"),
        ("main.py", "from pkg import helper\nimport json\n\ndef go():\n    helper()\n    json.dumps(1)\n"),
    ]
    e = C.edges_of(P.python_facts(_corpus(spark, files)))
    got = {(r.caller, r.callee, r.kind) for r in e.collect()}
    assert got == {("pkg.core.A.m", "pkg.core.A.n", "internal"), ("pkg.core.A.n", "pkg.core.helper", "internal"), ("main.go", "pkg.core.helper", "internal"), ("main.go", "json.dumps", "external")}


@pytest.mark.parametrize("parts", [1, 7])
def test_independent_of_partitions(spark, data, parts):
    df = spark.read.parquet(f"{data}/file_payloads.parquet").select("payload_id", "project_root", "path", "content").repartition(parts)
    n = P.rule_findings(P.python_facts(df)).agg(F.count(F.lit(1)), F.sum(F.hash("payload_id", "line", "rule_id"))).first()
    test_independent_of_partitions.seen = getattr(test_independent_of_partitions, "seen", tuple(n))
    assert tuple(n) == test_independent_of_partitions.seen


def test_long_and_deep_code_keeps_its_facts():
    long = "log.info(" + ", ".join(f"'part number {i}'" for i in range(60)) + ", password)\n"
    assert P.facts_of(long, "m", "m.py")[0][5].endswith("password)")
    args = ", ".join(f"argument_{i}" for i in range(60))
    a, b = (P.facts_of(f"def f({args}, {last}):\n    pass\n", "m", "m.py")[0][5] for last in "ab")
    assert a != b
    kinds = {f[0] for f in P.facts_of("eval(x)\ny = f(" + " + ".join(["a"] * 1500) + ")\n", "m", "m.py")}
    assert "syntax" not in kinds and "call" in kinds
