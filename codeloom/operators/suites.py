"""Acceptance suites as tables, registries and policies checked, and run measures."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "case_id string, family string, payload string, expected array<string>"


def suite_failures(cases: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """§2.16: ``case_id, expected`` of expectations that no finding starts with.

    ``detect`` maps ``case_id, payload`` to ``case_id, rule_id`` over all cases at once. An
    expectation that begins with ``!`` must not be found.
    """
    found = detect(cases.select("case_id", "payload")).select("case_id", "rule_id").distinct()
    want = cases.select("case_id", F.explode("expected").alias("expected")).withColumn("_x", F.ltrim("expected", F.lit("!")))
    hit = want.join(found, "case_id").where(F.startswith("rule_id", F.col("_x"))).select("case_id", "expected").distinct().withColumn("_hit", F.lit(True))
    j = want.join(hit, ["case_id", "expected"], "left")
    return j.where(F.coalesce("_hit", F.lit(False)) == F.startswith("expected", F.lit("!"))).select("case_id", "expected")


def suite_inventory(cases: DataFrame) -> DataFrame:
    """A-35: cases of each family."""
    return cases.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def counts_by(df: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """A-18, A-19: ``dimension, value, n`` for each of the dimensions, in one pass of grouping sets."""
    dimension = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d)) for d in dimensions])
    sets = df.groupingSets([[F.col(d)] for d in dimensions], *map(F.col, dimensions))
    return sets.agg(dimension.alias("dimension"), value.alias("value"), F.count(F.lit(1)).alias("n")).select("dimension", "value", "n")


# Fixed value: the counts in a test run's summary.
RUN_COUNT = r"(\d+)\s+(passed|failed|skipped|xfailed|xpassed|errors?|warnings?)"


def run_counts(runs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """F-20: ``key, kind, n``: the counts of each kind that a test run's output names, added up."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(RUN_COUNT), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(RUN_COUNT), F.lit(2)).alias("kind"))
    rows = runs.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("x"))
    kind = F.regexp_replace("x.kind", r"^error$", "errors")
    return rows.groupBy(key, F.regexp_replace(kind, r"^warning$", "warnings").alias("kind")).agg(F.sum(F.col("x.n").cast("bigint")).alias("n"))


def path_detector(cases: DataFrame) -> DataFrame:
    """Findings of the path-safety predicate, for suites whose payload is a path."""
    from codeloom.functions.paths import unsafe_path

    return cases.withColumn("_r", unsafe_path(F.col("payload"))).where("_r IS NOT NULL").select("case_id", F.lit("PATH001").alias("rule_id"))


def python_detector(cases: DataFrame) -> DataFrame:
    """Findings of the Python rules and flows, for suites whose payload is a source text."""
    from codeloom.operators.python_facts import python_facts, rule_findings
    from codeloom.operators.taint import python_flows, taint_findings

    numbered = cases.withColumn("payload_id", F.xxhash64("case_id"))
    corpus = numbered.select("payload_id", F.col("case_id").alias("project_root"), F.lit("src/case.py").alias("path"), F.col("payload").alias("content"))
    a = rule_findings(python_facts(corpus)).select(F.col("project_root").alias("case_id"), "rule_id")
    return a.unionByName(taint_findings(python_flows(corpus)).select(F.col("project_root").alias("case_id"), "rule_id"))


def registry_errors(entries: DataFrame, required: list[str], vocabularies: dict[str, tuple[str, ...]], key: str = "id") -> DataFrame:
    """P-22, J-16, HON002 to HON004: ``key, error``: blank or repeated keys, missing fields, values outside their vocabulary."""
    n = entries.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    blank = lambda c: F.col(c).isNull() | (F.btrim(F.col(c).cast("string")) == "")
    tests = [F.when(blank(key), "blank id"), F.when(F.col("_n") > 1, "duplicate id")]
    tests += [F.when(blank(f), f"missing {f}") for f in required]
    tests += [F.when(~blank(f) & ~F.col(f).isin(*v), f"bad {f}") for f, v in vocabularies.items()]
    return entries.join(n, F.col(key).eqNullSafe(F.col("_key"))).select(key, F.explode(F.array_compact(F.array(*tests))).alias("error")).distinct()


def policy_errors(policy: dict, commands: DataFrame, artifacts: DataFrame, measured: DataFrame) -> DataFrame:
    """J-15 for a quality policy: ``rule_id, detail``: required gates that no command has, required artifacts that are gone, budgets that are exceeded."""
    spark = commands.sparkSession
    names = lambda k: spark.createDataFrame([(x,) for x in policy.get(k, [])], "name string")
    gates = names("required_gates").join(commands.select("name"), "name", "left_anti").select(F.lit("POL010").alias("rule_id"), F.col("name").alias("detail"))
    gone = names("required_artifacts").join(artifacts.select("name"), "name", "left_anti").select(F.lit("POL012").alias("rule_id"), F.col("name").alias("detail"))
    limits = spark.createDataFrame([(k, float(v)) for k, v in policy.get("budgets", {}).items()], "name string, most double")
    over = limits.join(measured, "name").where("value > most").select(F.lit("POL020").alias("rule_id"), F.col("name").alias("detail"))
    return gates.unionByName(gone).unionByName(over)


def corpus_profiles(projects: DataFrame) -> DataFrame:
    """A-32: projects of each profile, from ``name, profiles``."""
    return projects.select(F.explode("profiles").alias("profile")).groupBy("profile").agg(F.count(F.lit(1)).alias("n"))


PROFILES = ("generic", "messaging-bot", "autonomy-canon", "fastapi", "flask", "django", "sqlalchemy")


def check_profiles(names: list[str]) -> tuple[str, ...]:
    """P-06: the profiles to use; none means generic, an unknown one is an error."""
    unknown = sorted(set(names) - set(PROFILES))
    if unknown:
        raise ValueError(f"unknown profiles: {', '.join(unknown)}")
    return tuple(dict.fromkeys(names)) or ("generic",)


def throughput(spark: SparkSession, files: int = 500) -> dict[str, float]:
    """A-31: files a second of the Python rules and the call graph over a synthetic ring."""
    from codeloom.operators.call_graph import edges_of
    from codeloom.operators.python_facts import python_facts, rule_findings
    from codeloom.sources.corpus import synthetic_ring

    began = time.time()
    facts = python_facts(synthetic_ring(spark, files))
    n = rule_findings(facts).count() + edges_of(facts).count()
    took = time.time() - began
    return {"files": files, "rows": n, "seconds": took, "files_per_second": files / took}
