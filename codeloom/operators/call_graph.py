"""Call graphs: building them from code, and walking them by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import ensure_checkpoint_dir


def nodes_of(facts: DataFrame) -> DataFrame:
    """GR-01: functions and classes as vertices ``project_root, id, kind, payload_id, line``."""
    f = facts.where("kind IN ('function','class')")
    return f.select("project_root", F.concat_ws(".", "module", "canonical").alias("id"), F.when(F.col("kind") == "class", "class").when(F.col("owner") == "<module>", "function").otherwise("method").alias("kind"), "payload_id", "line")


def edges_of(facts: DataFrame) -> DataFrame:
    """GR-01, GR-02, J-22: calls with their targets, resolved by ranked candidates.

    Candidates of a call, best first: a function of the caller's class (``self.x``), of the
    same module, the name as imports spell it, an export of an imported module by re-export,
    and the raw name. The best candidate that is a vertex wins; else the raw name stays,
    with lower confidence. Calls outside functions are left out.
    """
    ids = nodes_of(facts).select("project_root", F.col("id").alias("callee")).distinct().withColumn("_there", F.lit(True))
    reexport = facts.where("kind = 'import' AND array_contains(flags, 'from')").select("project_root", F.concat_ws(".", "module", "raw").alias("callee"), F.col("canonical").alias("_to")).distinct()
    calls = facts.where("kind = 'call' AND raw <> '' AND owner <> '<module>'").withColumn("call_no", F.monotonically_increasing_id())
    owner_class = F.regexp_replace("owner", r"\.?[^.]*$", "")
    mine = F.when(F.col("raw").startswith("self."), F.concat_ws(".", "module", F.when(owner_class != "", owner_class), F.substr("raw", F.lit(6))))
    cands = F.array(mine, F.concat_ws(".", "module", "canonical"), F.col("canonical"))
    base = calls.select("payload_id", "project_root", "line", F.concat_ws(".", "module", "owner").alias("caller"), F.col("raw").alias("raw_call"), "call_no", F.posexplode(cands).alias("rank", "callee")).where("callee IS NOT NULL")
    through = base.join(reexport, ["project_root", "callee"]).select(*[c for c in base.columns if c not in ("callee", "rank")], (F.col("rank") + 3).alias("rank"), F.col("_to").alias("callee"))
    tried = base.unionByName(through).join(ids, ["project_root", "callee"], "left")
    best = tried.groupBy("payload_id", "project_root", "line", "caller", "raw_call", "call_no").agg(F.min_by("callee", F.struct(F.coalesce("_there", F.lit(False)) == F.lit(False), F.col("rank") == 1, "rank")).alias("callee"), F.max(F.coalesce("_there", F.lit(False))).alias("internal"))
    return best.select("project_root", "payload_id", "line", "caller", "raw_call", F.when(F.col("internal"), F.col("callee")).otherwise(F.regexp_replace("callee", r"^\.", "")).alias("callee"), F.when(F.col("internal"), "high").when(F.contains("callee", F.lit(".")), "medium").otherwise("low").alias("confidence"), F.when(F.col("internal"), "internal").otherwise("external").alias("kind"))


def unknown_calls(facts: DataFrame) -> DataFrame:
    """GR-03: calls that can't be resolved, with the reason."""
    calls = facts.where("kind = 'call'")
    reason = F.when(F.col("raw").isin("getattr", "globals", "locals"), "getattr").when(F.col("canonical").startswith("importlib."), "importlib").when(F.col("raw") == "", "dynamic-call-result").when(F.col("text").rlike(r"^[\w.]+\[[^\]]*\]\("), "container lookup")
    return calls.withColumn("reason", reason).where("reason IS NOT NULL").select("payload_id", "project_root", "line", "raw", "reason")


def bounded_paths(edges: DataFrame, sinks: DataFrame, max_depth: int = 4, start: DataFrame | None = None) -> DataFrame:
    """GR-04: ``graph, path`` of every walk of at most ``max_depth`` edges that ends in a sink.

    ``edges``: ``graph, src, dst``; ``sinks``: ``graph, dst``; ``start``: ``graph, src``, all
    sources unless given. A walk doesn't visit a node twice, but for its last edge, and goes
    on past a sink. One join a step; a node's walks are as many as the graph has, which is
    what this operator returns.
    """
    e = edges.select("graph", "src", "dst").distinct()
    walks = e if start is None else e.join(start.select("graph", "src").distinct(), ["graph", "src"], "left_semi")
    level = walks.select("graph", F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    out = level
    for _ in range(max_depth - 1):
        open_ = level.where(F.size(F.array_distinct("path")) == F.size("path"))
        level = open_.join(e.select("graph", F.col("src").alias("at"), F.col("dst").alias("_next")), ["graph", "at"]).select("graph", F.concat("path", F.array("_next")).alias("path"), F.col("_next").alias("at"))
        out = out.unionByName(level)
    return out.join(sinks.select("graph", F.col("dst").alias("at")).distinct(), ["graph", "at"], "left_semi").select("graph", "path")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """GR-05: ``graph, hop, node`` of nodes within ``hops`` undirected steps of the seeds, each with its least hop.

    Lineage is cut by a checkpoint after each step.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("graph", "src", "dst").unionByName(edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("graph", "node").distinct().withColumn("hop", F.lit(0))
    for k in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == k - 1)
        step = frontier.select("graph", F.col("node").alias("src")).join(both, ["graph", "src"]).select("graph", F.col("dst").alias("node")).distinct()
        new = step.join(seen, ["graph", "node"], "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(new)
        if k < hops:
            seen = seen.checkpoint()
    return seen.select("graph", "hop", "node")


def first_chain(edges: DataFrame, roots: DataFrame, longest: int = 15) -> DataFrame:
    """GR-06: ``graph, root, chain``: from each root along the alphabetically first edge until a node repeats, at most ``longest`` steps."""
    nxt = edges.groupBy("graph", F.col("src").alias("at")).agg(F.min("dst").alias("_to"))
    walk = roots.select("graph", F.col("node").alias("root"), F.array("node").alias("chain"), F.col("node").alias("at"))
    for _ in range(longest):
        walk = walk.join(nxt, ["graph", "at"], "left")
        go = F.col("_to").isNotNull() & ~F.array_contains("chain", F.col("_to"))
        walk = walk.select("graph", "root", F.when(go, F.concat("chain", F.array("_to"))).otherwise(F.col("chain")).alias("chain"), F.when(go, F.col("_to")).alias("at"))
    return walk.select("graph", "root", "chain")


def graph_findings(summary: DataFrame, unknown: DataFrame, max_unknown_ratio: float | None = None) -> DataFrame:
    """GR-07: ``graph, rule_id, severity, detail``.

    CALLGRAPH001: a graph's share of unknown calls is over the budget, if there is one.
    CALLGRAPH002: a dynamic call (``graph, raw, reason``) that someone has to look at.
    """
    dynamic = unknown.where(F.col("reason").isin("getattr", "importlib", "dynamic-call-result")).select("graph", F.lit("CALLGRAPH002").alias("rule_id"), F.lit("LOW").alias("severity"), F.col("raw").alias("detail"))
    if max_unknown_ratio is None:
        return dynamic
    over = summary.where(F.col("unknown_ratio") > max_unknown_ratio).select("graph", F.lit("CALLGRAPH001").alias("rule_id"), F.lit("HIGH").alias("severity"), F.col("unknown_ratio").cast("string").alias("detail"))
    return over.unionByName(dynamic)


def graph_summary(nodes: DataFrame, edges: DataFrame, unknown: DataFrame) -> DataFrame:
    """A-17, GR-07: ``graph, n_nodes, n_edges, n_unknown, unknown_ratio`` (four digits, half to even)."""
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("n_edges"))
    u = unknown.groupBy("graph").agg(F.count(F.lit(1)).alias("n_unknown"))
    j = n.join(e, "graph", "full").join(u, "graph", "full").na.fill(0, ["n_nodes", "n_edges", "n_unknown"])
    return j.withColumn("unknown_ratio", F.bround(F.coalesce(F.try_divide("n_unknown", F.col("n_edges") + F.col("n_unknown")), F.lit(0.0)), 4))
