"""Facts, rules and flows of the scanned Python files."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import python_facts as P
from codeloom.operators import taint as T
from codeloom.session import kept, table


def _files(spark, sf_dir):
    return table(spark, sf_dir, "file_payloads").select("payload_id", "project_root", "path", "content")


def kept_facts(spark, sf_dir):
    """The facts as a table, for queries that use them more than once: files are parsed once."""
    return kept(P.python_facts(_files(spark, sf_dir)))


# A template for each rule, by part size, for rules that the scanned files rarely break.
TEMPLATES = {
    "PY002": "eval(x)\n",
    "PY003": "try:\n    f()\nexcept ValueError:\n    pass\n",
    "PY005": "import subprocess as sp\nsp.run(c, shell=True)\n",
    "PY006": "from pickle import loads as ld\nld(b)\n",
    "PY008": "import requests\nrequests.get(u)\n",
    "PY011": "def f(a=[]):\n    return a\n",
    "PY015": "cur.execute(f'select {x}')\n",
    "PY017": "import hashlib\nhashlib.md5(b)\n",
    "PY001": "api_key = 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123'\n",
    "PY004": "try:\n    f()\nexcept:\n    g()\n",
    "PY007": "import yaml\nyaml.load(x)\n",
    "PY009": "import time\nasync def f():\n    time.sleep(1)\n",
    "PY010": "price: float = 1.0\n",
    "PY012": "import os\nos.system(c)\n",
    "PY013": "import tempfile\ntempfile.mktemp()\n",
    "PY014": "assert x\n",
    "PY016": "import asyncio\nasyncio.create_task(f())\n",
    "PY018": "from datetime import datetime\ndatetime.utcnow()\n",
    "PY019": "from a import *\n",
    "PY020": "open(p)\n",
    "PY021": "import logging\nlogging.info(token)\n",
    "PY022": "r.json()\n",
    "PY023": "import random\ntoken = random.random()\n",
    "PY024": "import requests\nrequests.get(u, timeout=1, verify=False)\n",
    "PY025": "import urllib.request\nurllib.request.urlopen(u)\n",
    "PY026": "import ssl\nssl._create_unverified_context()\n",
    "PY027": "app.run(debug=True)\n",
    "PY028": "DEBUG = True\n",
    "PYDF002": "import os\nc = input()\nos.system(c)\n",
    "PYDF003": "v = request.args.get('v')\nrender_template_string(v)\n",
    "PYDF001": "q = request.args.get('q')\ncur.execute('select ' + q)\n",
    "": "import subprocess\nsubprocess.run(['ls'])\n",
}


def _templated(spark, sf_dir):
    keys = list(TEMPLATES)
    code = F.lit(TEMPLATES[keys[-1]])
    for i, k in enumerate(keys[:-1]):
        code = F.when(F.col("p_size") % len(keys) == i, F.lit(TEMPLATES[k])).otherwise(code)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload_id"), F.lit("/srv/parts").alias("project_root"), F.format_string("src/part_%d.py", "p_partkey").alias("path"), code.alias("content"))


def ast_rule_counts(spark, sf_dir):
    """PY rules over code made from the parts; SQL counts the parts."""
    return P.rule_findings(P.python_facts(_templated(spark, sf_dir))).where(F.col("rule_id").isin([k for k in TEMPLATES if k.startswith("PY0")])).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def templated_taint(spark, sf_dir):
    return T.taint_findings(T.python_flows(_templated(spark, sf_dir))).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def ast_fact_counts(spark, sf_dir):
    """X-05: facts of each kind."""
    return P.python_facts(_files(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def python_rule_findings(spark, sf_dir):
    return P.rule_findings(P.python_facts(_files(spark, sf_dir))).select("payload_id", "line", "rule_id", "severity")


def duplicate_definitions(spark, sf_dir):
    return P.duplicate_definitions(kept_facts(spark, sf_dir))


def unknown_exports(spark, sf_dir):
    return P.unknown_exports(kept_facts(spark, sf_dir))


def unknown_call_ratio(spark, sf_dir):
    return P.unknown_call_ratio(kept_facts(spark, sf_dir))


def branching_entropy(spark, sf_dir):
    return P.branching_entropy(kept_facts(spark, sf_dir))


def interface_hashes(spark, sf_dir):
    return P.contract(P.python_facts(_files(spark, sf_dir))).select("payload_id", F.size("signatures").alias("n"), "interface_hash")


def taint_findings(spark, sf_dir):
    return T.taint_findings(kept(T.python_flows(_files(spark, sf_dir))))


# What each template breaks: its own rule, and for those of a flow also the rule on the sink.
_BREAKS = [(i, k) for i, k in enumerate(TEMPLATES) if k.startswith("PY0")] + [(list(TEMPLATES).index("PYDF001"), "PY015"), (list(TEMPLATES).index("PYDF002"), "PY012")]
_FLOWS = [(i, k) for i, k in enumerate(TEMPLATES) if k.startswith("PYDF")]


def _counted(pairs: list[tuple[int, str]]) -> str:
    return f"SELECT rule_id, count(*) AS n FROM part JOIN (VALUES {', '.join(map(str, pairs))}) t(k, rule_id) ON p_size % {len(TEMPLATES)} = k GROUP BY 1"


ORACLE = {"ast_rule_counts": _counted(_BREAKS), "templated_taint": _counted(_FLOWS)}
QUERIES = {n: globals()[n] for n in ("ast_rule_counts", "templated_taint", "ast_fact_counts", "python_rule_findings", "duplicate_definitions", "unknown_exports", "unknown_call_ratio", "branching_entropy", "interface_hashes", "taint_findings")}
