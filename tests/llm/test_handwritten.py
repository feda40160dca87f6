import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm.handwritten import _features, classified_entries, classified_files, head_says, path_verdict, repair
from tests.conftest import rows


def _hand(seed, lang="py"):
    r = random.Random(seed)
    w = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    out = ["import os"]
    for _ in range(12):
        a, b, c = w(), w(), w()
        out += [f"def {a}({b}, {c}={r.randint(1, 99)}):", f"    if {b} is None or {c} > {r.randint(1, 9)}:", f"        return {w()}({b})", f"    {w()} = [{w()}(x) for x in {b}.{w()}]", f"    return {w()}.{w()}({c})", ""]
    return "\n".join(out) + "\n"


GEN = "# Code generated by tool. DO NOT EDIT.\n" + "".join(f"FIELD_{i} = {i}\n" for i in range(30))
BLOB = "ROWS = [\n" + "".join("    " + ", ".join(f"{random.Random(i * 9 + j).random():.4f}" for j in range(8)) + ",\n" for i in range(40)) + "]\n"
MIN = "!function(e,t){" + "".join(f"e.a{i}=function(n){{return n<<{i}^t[{i}]}};" for i in range(40)) + "}(this,1);"


def test_files(spark):
    lib = "# somelib - release 1.2.3\n" + _hand(1)
    altered = "\n".join(lib.split("\n")[1:40]) + "\nextra = 1\n" + "\n".join(lib.split("\n")[40:])
    known = "# plain\n" + _hand(2)
    data = [
        (1, "p", "src/a.py", _hand(3)), (2, "p", "src/b.py", GEN), (3, "p", "src/c.py", BLOB), (4, "p", "web/d.js", MIN), (5, "p", "lib/e.py", lib), (6, "q", "src/f.py", altered), (7, "q", "src/g.py", known), (8, "q", "package-lock.json", "{}"),
        (9, "q", "src/vendor/probe_model.py", _hand(4)), (10, "q", "vendor/pkg/pkg.py", _hand(5)), (11, "q", "src/h.py", 'HEADER = "# Code generated by x. DO NOT EDIT."\n' + _hand(6)), (12, "q", None, None), (13, None, "x.py", ""), (14, "q", "docs/generated.md", GEN), (1, "p", "src/a.py", _hand(3)),
    ]
    df = spark.createDataFrame([(*d, "c") for d in data], "payload_id bigint, project_root string, path string, content string, verdict string")
    k = spark.createDataFrame([(hashlib.sha256(known.encode()).hexdigest().upper(),), (None,)], "sha256 string")
    files = classified_files(df, k)
    got = {r.payload_id: r.verdict for r in files.collect()}
    assert got == {1: None, 2: "generated", 3: "data", 4: "minified", 5: "vendored", 6: "vendored", 7: "vendored", 8: "lock", 9: None, 10: "vendored", 11: None, 12: None, 13: None, 14: None}
    assert files.count() == len(data)
    e = spark.createDataFrame([(1, "p", "./src/b.py"), (2, "p", "src/a.py"), (3, "p", "static/x.min.js"), (4, "p", "static/x.min.js.map"), (5, "p", "node_modules/x/README.md"), (6, "p", None), (7, "p", "node_modules/x/index.js")], "entry_id bigint, project_root string, path string")
    assert rows(classified_entries(e, files)) == [(1, "generated"), (3, "minified"), (4, "map"), (7, "vendored")]
    assert classified_files(df.limit(0), k).count() == 0


def test_grammars_decide_alone(spark):
    lib = _hand(1) + _hand(21)
    altered = lib.replace("import os", "import sys")
    accessors = "".join(f"int get{chr(97 + i % 26)}{i}() {{ return field{i}; }}\n" for i in range(300))
    listed = "# Code generated by tool. DO NOT EDIT.\n" + _hand(9)
    third = "# somelib - release 1.2.3\n" + lib
    # One copy says where it comes from; any number of others in other repositories doesn't take its word away.
    data = [(1, "a", "lib/x.py", third)] + [(10 + i, f"r{i}", f"src/m{i}.py", altered) for i in range(20)]
    data += [(2, "a", "src/Model.java", accessors), (3, "a", "src/t.py", BLOB), (4, "a", "src/h.py", _hand(5)), (5, "a", "src/i.py", listed)]
    df = spark.createDataFrame(data, "payload_id bigint, project_root string, path string, content string")
    none = spark.createDataFrame([], "sha256 string")
    bare = {r.payload_id: r.verdict for r in classified_files(df, none, trust_marks=False).collect()}
    assert bare.pop(1) is not None
    assert bare == {2: "generated", 3: "data", 4: None, 5: None} | {10 + i: "vendored" for i in range(20)}
    two = {r.payload_id: r.verdict for r in classified_files(df.where("payload_id IN (1, 10)"), none).collect()}
    assert two == {1: "vendored", 10: "vendored"}


def test_bare_literals():
    r = random.Random(3)
    fresh = [r.getrandbits(60) for _ in range(200)]
    g = repair(np.array(fresh + fresh[:2] * 50, np.uint64), np.array([0] * 200 + [1] * 100), 2, np.ones(300))
    assert g["bare"].tolist() == [200.0, 0.0]


def test_repair_by_hand():
    s = np.array([1, 2, 1, 2, 1, 2, 1, 2, 9, 1, 2, 3, 4, 5], np.uint64)
    f = np.array([0] * 9 + [1] * 5)
    g = repair(s, f, 3)
    assert g["size"].tolist() == [9, 5, 0]
    assert g["left"][0] < 5 and g["left"][1] == 5


def test_repair_counts_uses():
    line = [1, 7, 2, 8]
    g = repair(np.array(line * 20 + list(range(10, 30)), np.uint64), np.zeros(100, np.int64), 1)
    assert g["share"][0] == pytest.approx(0.8) and g["uses"][0] >= 4


def test_equal_files_have_equal_rules():
    a = _hand(7)
    f = _features(["x = 1\n", a, "y\n" + a, ""])
    assert f["rules"][1] and set(f["rules"][1]) & set(f["rules"][2])
    assert f["n_tokens"][3] == 0
    assert _features([a])["rules"][0] == f["rules"][1]


def test_heads():
    assert head_says("// Code generated by x. DO NOT EDIT.\npackage a\n") == (True, False)
    assert head_says("import a\n# auto-generated\n") == (False, False)
    assert head_says("# not generated: keep by hand\n") == (False, False)
    assert head_says("/* @license MIT */\nx") == (False, True)
    assert head_says("// channel v2.5 - see docs/bucket.md\nx") == (False, False)


def test_paths(spark):
    want = {"a/x_pb2.py": "generated", "tests/test_x_pb2.py": None, "app/generated/x_override.py": None, "api/zz_generated.x.go": "generated", "web/assets/a.chunk.js": "minified", "tools/generator_x.go": None, "src/distribution/a.java": None, "third_party/a/src/b.go": "vendored", "yarn.lock": "lock", None: None}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r[0]: r[1] for r in df.select("path", path_verdict(df.path)).collect()} == want


def test_heads_and_lock_keys_are_read_to_their_end():
    from codeloom.llm.handwritten import _run

    banner = "# This notice is long.\n" * 400
    assert head_says(banner + "# Code generated by gen. DO NOT EDIT.\nx = 1\n") == (True, False)
    assert head_says("/*\n" + "notice\n" * 1000 + "Code generated by gen. DO NOT EDIT.\n*/\nint x;\n") == (True, False)
    assert head_says(banner + "x = 1\n# Code generated by gen. DO NOT EDIT.\n") == (False, False)
    text = '{"name": "' + "a" * 700 + '", "lockfileVersion": 3}'
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["r"]), pa.array(["deps.json"]), pa.array([""]), pa.array([text])], ["payload_id", "project_root", "path", "sha", "content"])
    assert next(_run(iter([b]))).column("lock").to_pylist() == [True]
