import json

import pyarrow.parquet as pq

from codeloom.operators.nested_flatten import child_paths, child_records, child_table, merged_schema
from codeloom.plans.nested import GRAPH, ISSUE
from tests.conftest import rows

G = "graph_id bigint, nodes string, edges string, unknown_calls string, child_path string"


def _brute(layout, root, name, text):
    """Plain recursion, written apart from the operator."""
    def load(t):
        while isinstance(t, str):
            try:
                t = json.loads(t)
            except ValueError:
                return t
        return t

    out = []

    def walk(v, path, parent, field, top):
        if isinstance(v, str) and field in layout.embedded:
            v = load(v)
        keyed = top and name in layout.keyed
        if isinstance(v, list) or keyed and isinstance(v, dict) or isinstance(v, dict) and field in layout.lone:
            pairs = list(enumerate(v)) if isinstance(v, list) else list(v.items()) if keyed else [(0, v)]
            for i, x in pairs:
                if keyed and isinstance(v, list) and isinstance(x, dict) and isinstance(x.get("id"), str):
                    i = x["id"]
                here = f"{path}/{i}" if path else str(i)
                if isinstance(x, dict):
                    out.append((root, here, parent))
                    for k, y in x.items():
                        walk(y, f"{here}/{k}", here, k, False)
                elif isinstance(x, list):
                    walk(x, here, parent, None, False)
        elif isinstance(v, dict):
            for k, y in v.items():
                walk(y, f"{path}/{k}" if path else k, parent, k, False)

    v = load(text) if text is not None else None
    if isinstance(v, (dict, list)):
        walk(v, "" if layout.bare else name, "", name, True)
    return out


def test_against_brute_force(spark, data):
    t = pq.read_table(f"{data}/call_graphs.parquet").to_pylist()
    want = {x for r in t for c in GRAPH.columns for x in _brute(GRAPH, r["graph_id"], c, r[c])}
    got = child_paths(spark.read.parquet(f"{data}/call_graphs.parquet"), GRAPH)
    assert {(r.root_id, r.child_path, r.parent_path) for r in got.collect()} == want
    assert got.count() == len(want) > 100
    t = pq.read_table(f"{data}/issue_snapshots.parquet", columns=["row_id", "evidence"]).to_pylist()
    want = {x for r in t for x in _brute(ISSUE, r["row_id"], "evidence", r["evidence"])}
    got = child_paths(spark.read.parquet(f"{data}/issue_snapshots.parquet"), ISSUE)
    assert {(r.root_id, r.child_path, r.parent_path) for r in got.collect()} == want


def test_shapes(spark):
    edges = [{"evidence": '{"hops": {"via": [null, {"a": 1}, 3]}}'}, None, [[{"x": 1}]], "s"]
    data = [
        (1, json.dumps({"n.a": {"kind": "f", "attributes": [{"types": [{"t": 1}]}]}, "n.b": None}), json.dumps(edges), json.dumps(json.dumps({"caller": "x"})), "c"),
        (1, None, json.dumps(edges), None, "c"),
        (2, "not json", "NaN", "", "c"),
        (None, '[{"id": null}, {"id": 7}]', "[]", None, "c"),
    ]
    got = rows(child_paths(spark.createDataFrame(data, G), GRAPH))
    assert got == sorted(
        [
            ("graph", None, "nodes/0", ""),
            ("graph", None, "nodes/7", ""),
            ("graph", 1, "edges/0", ""),
            ("graph", 1, "edges/0/evidence/hops/0", "edges/0"),
            ("graph", 1, "edges/0/evidence/hops/0/via/1", "edges/0/evidence/hops/0"),
            ("graph", 1, "edges/2/0/0", ""),
            ("graph", 1, "nodes/n.a", ""),
            ("graph", 1, "nodes/n.a/attributes/0", "nodes/n.a"),
            ("graph", 1, "nodes/n.a/attributes/0/types/0", "nodes/n.a/attributes/0"),
            ("graph", 1, "unknown_calls/0", ""),
        ],
        key=lambda t: tuple((v is not None, str(v)) for v in t),
    )
    assert child_paths(spark.createDataFrame([], G), GRAPH).count() == 0


def test_schema_and_tables(spark):
    data = [(1, None, '[{"a": 1, "e": {"b": "x"}}, {"a": 2.5, "child_path": true}]', None, ""), (2, None, '[{"a": 1}]', None, "")]
    kids = child_records(spark.createDataFrame(data, G), GRAPH)
    schema = {(r.field): (r.kind, r.n) for r in merged_schema(kids).collect()}
    assert schema == {"a": ("double", 3), "e.b": ("string", 1), "child_path": ("boolean", 1)}
    t = child_table(kids, "edges", [("a", "double"), ("e.b", "string"), ("child_path", "boolean")])
    assert t.columns == ["record_src", "root_id", "child_path", "parent_path", "ordinal", "a", "e_b", "child_path_"]
    assert rows(t.select("root_id", "ordinal", "a", "e_b", "child_path_")) == [(1, 0, 1.0, "x", None), (1, 1, 2.5, None, True), (2, 0, 1.0, None, None)]
