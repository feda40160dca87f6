"""Call graphs of the table and of the scanned code; drift over reports and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.operators import call_graph as C
from codeloom.operators import drift as D
from codeloom.functions.columns import relative_posix
from codeloom.operators.python_facts import contract, python_facts
from codeloom.operators.registries import ambiguities, array_elements
from codeloom.operators.script_structure import structure_findings
from codeloom.plans.python_code import kept_facts
from codeloom.session import table


def _facts(spark, sf_dir):
    return python_facts(table(spark, sf_dir, "file_payloads").select("payload_id", "project_root", "path", "content"))


def code_call_edges(spark, sf_dir):
    """GR-01, GR-02, J-22 over the scanned files."""
    return C.edges_of(kept_facts(spark, sf_dir)).groupBy("project_root", "kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


def code_graph_nodes(spark, sf_dir):
    return C.nodes_of(_facts(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def code_unknown_calls(spark, sf_dir):
    """GR-03."""
    return C.unknown_calls(_facts(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def code_graph_findings(spark, sf_dir):
    """GR-07: CALLGRAPH001 for projects with more than a quarter of unknown calls, CALLGRAPH002."""
    f = kept_facts(spark, sf_dir)
    project = F.col("project_root").alias("graph")
    unknown = C.unknown_calls(f).select(project, "raw", "reason")
    return C.graph_findings(C.graph_summary(C.nodes_of(f).select(project), C.edges_of(f).select(project), unknown), unknown, 0.25).groupBy("graph", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def contract_drift(spark, sf_dir):
    """ST-01 to ST-03 over the scans of the Python files: each scan of a path is a snapshot; one without any check is taken for rejected."""
    p = table(spark, sf_dir, "file_payloads").withColumn("path", relative_posix(F.col("path"), F.col("project_root")))
    contracts = contract(kept_facts(spark, sf_dir)).select("payload_id", "signatures", "interface_hash")
    seq = F.struct("scanned_at", "payload_id").alias("seq")
    rows = p.select("payload_id", "project_root", "path", seq, D.safety_checks(F.col("content")).alias("safety_checks")).join(contracts, "payload_id")
    return D.contract_drift(rows.withColumn("verdict", F.when(F.size("safety_checks") == 0, "REJECTED").otherwise("UNKNOWN"))).select("project_root", "path", F.col("seq.payload_id").alias("payload_id"), "rule_id", "severity", "score", "run")


def nation_edges(spark, sf_dir):
    """A small directed graph: in each region, every nation leads to the next two by key."""
    n = table(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = n.select(F.col("n_regionkey").alias("graph"), F.col("n_name").alias("src"), F.lead("n_name", 1, None).over(w).alias("a"), F.lead("n_name", 2, None).over(w).alias("b"), F.first("n_name").over(w).alias("f"))
    return rows.select("graph", "src", F.explode(F.array(F.coalesce("a", "f"), F.coalesce("b", "f"))).alias("dst")).where("src <> dst").distinct()


def bounded_paths(spark, sf_dir):
    """GR-04."""
    e = nation_edges(spark, sf_dir)
    sinks = e.groupBy("graph").agg(F.max("dst").alias("dst"))
    return C.bounded_paths(e, sinks, 4).select("graph", F.array_join("path", ">").alias("path"))


def neighbourhood(spark, sf_dir):
    """GR-05: two steps around the first nation of each region."""
    e = nation_edges(spark, sf_dir)
    return C.neighbourhood(e, e.groupBy("graph").agg(F.min("src").alias("node")), 2)


def first_chain(spark, sf_dir):
    """GR-06."""
    e = nation_edges(spark, sf_dir)
    roots = e.select("graph", F.col("src").alias("node")).distinct()
    return C.first_chain(e, roots).select("graph", "root", F.array_join("chain", ">").alias("chain"))


def drift_state(spark, sf_dir):
    """ST-02, W-07 over events: a user is an entity, an error a bad step."""
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type").isin("error", "signup")
    step = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "signup", 0.5).otherwise(0.0)
    return D.drift_state(e, "user_id", ["ts", "event_id"], step, bad, 20.0, 3).select("event_id", "score", "run", "alert")


def regressions(spark, sf_dir):
    """ST-03, W-08: an event whose value class an earlier error of the user had."""
    e = table(spark, sf_dir, "events").withColumn("bucket", F.floor(F.col("value") / 10).cast("int"))
    return D.regressions(e, "user_id", ["ts", "event_id"], "bucket", F.col("event_type") == "error").select("event_id", "user_id", "bucket")


def _parts(spark, sf_dir, path: str, text):
    """A file for each part, with text that depends on its size."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload_id"), F.lit("/srv/parts").alias("project_root"), F.format_string(path, "p_partkey").alias("path"), text.alias("content"))


def _apart(spark, sf_dir, first: str, last: str):
    """Scripts whose last line comes as many lines after the first as the part's size says, and one more."""
    return _parts(spark, sf_dir, "web/p%d.js", F.concat(F.lit(first), F.repeat(F.lit("step();\n"), F.col("p_size")), F.lit(last)))


def _rule(found, rule_id: str):
    return found.where(F.col("rule_id") == rule_id).select("payload_id", "line_number")


def lookback_14(spark, sf_dir):
    """W-04, JSSTR003: a jump with query parameters among the fourteen lines before it."""
    return _rule(structure_findings(_apart(spark, sf_dir, "const q = new URLSearchParams(text);\n", "location.href = next;\n")), "JSSTR003")


def lookahead_19(spark, sf_dir):
    """W-01, JSSTR002: a message listener without a check of the origin in it or the nineteen lines after it."""
    return _rule(structure_findings(_apart(spark, sf_dir, "addEventListener('message', (event) => {\n", "if (trustedOrigins.includes(event.origin)) run();\n});\n")), "JSSTR002")


def asof_source_to_sink(spark, sf_dir):
    """J-06, JSSTR007: markup written from a name whose latest assignment, at most twenty lines before, is a source."""
    return _rule(structure_findings(_apart(spark, sf_dir, "const raw = location.search;\n", "el.innerHTML = raw;\n")), "JSSTR007")


def _registries(spark, sf_dir):
    """A registry of four lists for each part; which of them contradict themselves follows from its size."""
    size = F.col("p_size")
    pick = lambda n, a, b: F.when(size % n == 0, F.lit(a)).otherwise(F.lit(b))
    flips = pick(2, '[{"role":"r","resource":"/a","on":true},{"role":"r","resource":"/a","on":false}]', '[{"role":"r","resource":"/a","on":true},{"role":"r","resource":"/a","on":true}]')
    effects = pick(3, '[{"role":"r","action":"read","resource":"/a","effect":"allow"},{"role":"r","action":"read","resource":"/a","effect":"deny"}]', '[{"role":"r","action":"read","resource":"/a","effect":"allow"},{"role":"r","action":"write","resource":"/a","effect":"deny"}]')
    ids = pick(4, '[{"id":"a"},{"id":"b"},{"id":"a"}]', '[{"id":"a"},{"id":"b"},{"id":"c"}]')
    routes = pick(5, '[{"role":"r","resource":"*"},{"role":"r","resource":"/a"}]', '[{"role":"r","resource":"/a"},{"role":"r","resource":"*"}]')
    text = F.concat(F.lit('{"flips":'), flips, F.lit(',"effects":'), effects, F.lit(',"ids":'), ids, F.lit(',"routes":'), routes, F.lit("}"))
    return ambiguities(array_elements(_parts(spark, sf_dir, "conf/p%d.json", text)))


def _ambiguous(spark, sf_dir, rule_id: str):
    return _registries(spark, sf_dir).where(F.col("rule_id") == rule_id).select("payload_id", "array_id", "idx")


def boolean_flip(spark, sf_dir):
    """A-09, ARR008: a flag that differs from the one before it for the same identity."""
    return _ambiguous(spark, sf_dir, "ARR008")


def policy_conflicts(spark, sf_dir):
    """A-08, ARR004: both effects on one subject, action and resource, at the second."""
    return _ambiguous(spark, sf_dir, "ARR004")


def duplicate_registry_keys(spark, sf_dir):
    """A-07, W-05, ARR003: the second and later occurrence of an id in a list."""
    return _ambiguous(spark, sf_dir, "ARR003")


def wildcard_shadowing(spark, sf_dir):
    """W-06, ARR005: a specific entry after a wildcard that covers it."""
    return _ambiguous(spark, sf_dir, "ARR005")


_E = """WITH RECURSIVE seq AS (SELECT n_regionkey AS graph, n_name AS src, lead(n_name, 1) OVER w AS a, lead(n_name, 2) OVER w AS b, first_value(n_name) OVER w AS f FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
e AS (SELECT DISTINCT graph, src, dst FROM (SELECT graph, src, coalesce(a, f) AS dst FROM seq UNION ALL SELECT graph, src, coalesce(b, f) FROM seq) WHERE src <> dst)"""
ORACLE = {
    "bounded_paths": _E + ", walk AS (SELECT graph, [src, dst] AS path, dst AS fin, 1 AS d FROM e UNION ALL SELECT w.graph, list_append(w.path, e.dst), e.dst, d + 1 FROM walk w JOIN e ON e.graph = w.graph AND e.src = w.fin WHERE d < 4 AND len(list_distinct(w.path)) = len(w.path)), s AS (SELECT graph, max(dst) AS fin FROM e GROUP BY 1) SELECT w.graph, array_to_string(w.path, '>') AS path FROM walk w JOIN s ON s.graph = w.graph AND s.fin = w.fin",
    "neighbourhood": _E + ", u AS (SELECT * FROM e UNION SELECT graph, dst, src FROM e), s AS (SELECT graph, min(src) AS node FROM e GROUP BY 1), w AS (SELECT graph, 0 AS hop, node FROM s UNION SELECT w.graph, hop + 1, u.dst FROM w JOIN u ON u.graph = w.graph AND u.src = w.node WHERE hop < 2) SELECT graph, min(hop) AS hop, node FROM w GROUP BY graph, node",
    "first_chain": _E + ", n AS (SELECT graph, src, min(dst) AS dst FROM e GROUP BY 1, 2), w AS (SELECT DISTINCT graph, src AS root, [src] AS chain, src AS at FROM e UNION ALL SELECT w.graph, root, list_append(chain, n.dst), n.dst FROM w JOIN n ON n.graph = w.graph AND n.src = w.at WHERE NOT list_contains(chain, n.dst) AND len(chain) <= 15) SELECT graph, root, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM w GROUP BY 1, 2",
    "drift_state": "SELECT event_id, score, run::BIGINT AS run, score > 20.0 OR run >= 3 AS alert FROM (SELECT *, sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM (SELECT *, sum(step) OVER w AS score, sum(1 - bad) OVER w AS island FROM (SELECT *, CASE event_type WHEN 'error' THEN 1.0 WHEN 'signup' THEN 0.5 ELSE 0.0 END::DOUBLE AS step, (event_type IN ('error','signup'))::INT AS bad FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))",
    "regressions": "WITH b AS (SELECT *, floor(value / 10)::INT AS bucket FROM events) SELECT event_id, user_id, bucket FROM b x WHERE EXISTS (SELECT 1 FROM b y WHERE y.user_id = x.user_id AND y.bucket = x.bucket AND y.event_type = 'error' AND (y.ts < x.ts OR y.ts = x.ts AND y.event_id < x.event_id))",
    "lookback_14": "SELECT p_partkey AS payload_id, p_size + 2 AS line_number FROM part WHERE p_size + 1 <= 14",
    "lookahead_19": "SELECT p_partkey AS payload_id, 1 AS line_number FROM part WHERE p_size + 1 > 19",
    "asof_source_to_sink": "SELECT p_partkey AS payload_id, p_size + 2 AS line_number FROM part WHERE p_size + 1 <= 20",
    "boolean_flip": "SELECT p_partkey AS payload_id, '$.flips' AS array_id, 1 AS idx FROM part WHERE p_size % 2 = 0",
    "policy_conflicts": "SELECT p_partkey AS payload_id, '$.effects' AS array_id, 1 AS idx FROM part WHERE p_size % 3 = 0",
    "duplicate_registry_keys": "SELECT p_partkey AS payload_id, '$.ids' AS array_id, 2 AS idx FROM part WHERE p_size % 4 = 0",
    "wildcard_shadowing": "SELECT p_partkey AS payload_id, '$.routes' AS array_id, 1 AS idx FROM part WHERE p_size % 5 = 0",
}
QUERIES = {n: globals()[n] for n in [*ORACLE, "code_call_edges", "contract_drift", "code_graph_findings", "code_graph_nodes", "code_unknown_calls"]}
