"""Drift of an entity over its snapshots: steps, running score, runs of bad steps, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def drift_state(df: DataFrame, entity: str, order: list[str], weight: Column, negative: Column, score_limit: float = 3.0, run_limit: int = 3) -> DataFrame:
    """ST-01, ST-02, W-07: adds ``score`` (running sum), ``run`` (negative steps in a row, reset by any other) and ``alert``.

    One sort by entity; entities with a third of all rows stream through a window that holds
    only the running values. Null weights count 0.
    """
    w = Window.partitionBy(entity).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = F.coalesce(negative, F.lit(False))
    rows = df.withColumn("score", F.sum(F.coalesce(weight, F.lit(0.0))).over(upto)).withColumn("_island", F.sum((~bad).cast("int")).over(upto))
    inside = Window.partitionBy(entity, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("run", F.sum(bad.cast("int")).over(inside)).withColumn("alert", (F.col("score") > score_limit) | (F.col("run") >= run_limit)).drop("_island")


def regressions(df: DataFrame, entity: str, order: list[str], value: str, rejected: Column) -> DataFrame:
    """ST-03, W-08: rows whose value an earlier rejected row of the same entity had.

    The first rejection of each value is all that matters, so it is aggregated and joined;
    no set grows along the window.
    """
    first = df.where(F.coalesce(rejected, F.lit(False))).groupBy(entity, value).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, [entity, value]).where(F.struct(*order) > F.col("_first")).drop("_first")


def signature_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """ST-01: weighted step between two contracts ``*keys, signatures``: removed 1.0, changed 0.5, added 0.3 each."""
    name = lambda d, a: d.select(*keys, F.explode("signatures").alias("_s")).select(*keys, F.substring_index(F.regexp_replace("_s", "^async ", ""), "(", 1).alias("name"), F.col("_s").alias(a)).groupBy(*keys, "name").agg(F.array_sort(F.collect_set(a)).alias(a))
    j = name(old, "a").join(name(new, "b"), [*keys, "name"], "full")
    cost = F.when(F.col("b").isNull(), 1.0).when(F.col("a").isNull(), 0.3).when(F.col("a") != F.col("b"), 0.5).otherwise(0.0)
    return j.groupBy(*keys).agg(F.sum(cost).alias("delta"))


# Signs of safety checks in code.
SAFETY = {
    "null_check": r"if\s+\w+\s+(?:is\s+not\s+None|!=\s*None)",
    "range_check": r"if\s+\d+\s*[<>=]+\s*\w+\s*[<>=]+\s*\d+",
    "input_validation": r"(?:validate|sanitize|check)\s*\(",
    "error_handling": r"try\s*:",
    "auth_check": r"(?:is_admin|is_authorized|has_permission|check_auth)",
    "type_check": r"isinstance\s*\(",
}


def safety_checks(content: Column) -> Column:
    """Names of the kinds of checks that a text has, in the order above; an empty array for null."""
    return F.array_compact(F.array(*[F.when(content.rlike("(?i)" + p), F.lit(n)) for n, p in SAFETY.items()]))


def contract_steps(history: DataFrame) -> DataFrame:
    """ST-01, U-04: adds ``delta`` and ``negative``, the step from the snapshot before of the same project and path.

    ``history``: ``project_root, path, seq, signatures, safety_checks``. A function that is
    gone costs 1.0, a changed one 0.5, a new one 0.3, a kind of check that is gone 1.2; a step
    with anything gone is negative. The first snapshot of a file has no step (0, not
    negative). One sort by file; null paths are one file each project.
    """
    w = Window.partitionBy("project_root", "path").orderBy("seq")
    name = lambda s: F.substring_index(F.regexp_replace(s, "^async ", ""), "(", 1)
    of = lambda sigs, n: F.array_sort(F.filter(sigs, lambda s: name(s) == n))
    rows = history.withColumns({"_s": F.lag("signatures").over(w), "_c": F.lag("safety_checks").over(w)})
    rows = rows.withColumns({"_old": F.array_distinct(F.transform("_s", name)), "_new": F.array_distinct(F.transform("signatures", name))})
    gone, fresh = F.size(F.array_except("_old", "_new")), F.size(F.array_except("_new", "_old"))
    changed = F.size(F.filter(F.array_intersect("_old", "_new"), lambda n: of(F.col("_s"), n) != of(F.col("signatures"), n)))
    unchecked = F.size(F.array_except("_c", "safety_checks"))
    first = F.col("_s").isNull()
    delta = F.when(first, 0.0).otherwise(1.0 * gone + 0.5 * changed + 0.3 * fresh + 1.2 * unchecked)
    return rows.withColumns({"delta": delta, "negative": ~first & ((gone > 0) | (unchecked > 0))}).drop("_s", "_c", "_old", "_new")


def contract_drift(history: DataFrame) -> DataFrame:
    """ST-02, ST-03: ``project_root, path, seq, rule_id, severity, score, run`` of files beyond the limits of drift, and of those back at a rejected interface.

    ``history`` also has ``interface_hash`` and ``verdict``.
    """
    rows = contract_steps(history).withColumn("entity", F.to_json(F.struct("project_root", "path")))
    keep = ["project_root", "path", "seq"]
    state = drift_state(rows, "entity", ["seq"], F.col("delta"), F.col("negative"))
    late = state.where("alert").select(*keep, F.lit("Cumulative drift").alias("rule_id"), F.lit("HIGH").alias("severity"), "score", "run")
    back = regressions(rows, "entity", ["seq"], "interface_hash", F.col("verdict") == "REJECTED").select(*keep, F.lit("Regression").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("run"))
    return late.unionByName(back)


def append_history(snapshots: DataFrame, path: str) -> None:
    """SNK-11: snapshots added to a history table; earlier ones are never rewritten."""
    snapshots.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-26: the history table; one that isn't there yet is empty."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
