"""Tests against the code they test, from facts of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEST_PATH = r"(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$|(^|/)tests/"


def in_tests(path: Column) -> Column:
    return path.rlike(_TEST_PATH)


def public_symbols(facts: DataFrame) -> DataFrame:
    """``project_root, symbol, leaf, module, path, line`` of public functions and classes outside tests."""
    f = facts.where("kind IN ('function','class')").where(~in_tests(F.col("path")) & ~F.col("raw").startswith("_"))
    return f.select("project_root", F.concat_ws(".", "module", "canonical").alias("symbol"), F.col("raw").alias("leaf"), "module", "path", "line")


def referenced(facts: DataFrame) -> DataFrame:
    """J-13: public symbols with ``covered``: tests name them in full or by leaf, or name the leaf's method and import the module."""
    s = public_symbols(facts)
    t = facts.where(in_tests(F.col("path")))
    names = t.where("kind IN ('call','attribute','import')").select("project_root", F.explode(F.array("raw", "canonical")).alias("n")).distinct()
    full = names.select("project_root", F.col("n").alias("symbol"), F.lit(True).alias("_a")).distinct()
    leaf = names.where(~F.contains("n", F.lit("."))).select("project_root", F.col("n").alias("leaf"), F.lit(True).alias("_b")).distinct()
    called = t.where("kind = 'call'").select("project_root", "payload_id", F.substring_index("raw", ".", -1).alias("leaf"))
    imports = t.where("kind = 'import'").select("payload_id", F.regexp_replace("canonical", r"\.[^.]*$", "").alias("module")).unionByName(t.where("kind = 'import'").select("payload_id", F.col("canonical").alias("module")))
    by_method = called.join(imports, "payload_id").select("project_root", "leaf", "module", F.lit(True).alias("_c")).distinct()
    j = s.join(full, ["project_root", "symbol"], "left").join(leaf, ["project_root", "leaf"], "left").join(by_method, ["project_root", "leaf", "module"], "left")
    return j.withColumn("covered", F.coalesce("_a", "_b", "_c", F.lit(False))).drop("_a", "_b", "_c")


def reference_ratio(facts: DataFrame) -> DataFrame:
    """A-26, DF-25: ``project_root, n_public, ratio`` of public symbols that tests refer to."""
    return referenced(facts).groupBy("project_root").agg(F.count(F.lit(1)).alias("n_public"), F.avg(F.col("covered").cast("double")).alias("ratio"))


def pytest_findings(facts: DataFrame) -> DataFrame:
    """P-19, J-14: ``payload_id, line, rule_id``: skips without a reason, tests without an assertion (a helper of the file that asserts counts), broad handlers in tests."""
    t = facts.where(in_tests(F.col("path")))
    skip = t.where(F.col("kind") == "call").where(F.col("canonical").rlike(r"^pytest\.(mark\.)?(skip|xfail)$") & ~F.coalesce(F.array_contains(F.map_keys("keywords"), "reason"), F.lit(False)) & (F.col("n_args") == 0)).select("payload_id", "line", F.lit("PYTEST020").alias("rule_id"))
    tests = t.where("kind = 'function' AND raw LIKE 'test_%'").where(~F.array_contains("flags", "assert")).select("payload_id", "line", F.col("raw").alias("owner"))
    helpers = t.where("kind = 'function'").where(F.array_contains("flags", "assert")).select("payload_id", F.col("raw").alias("callee")).distinct()
    calls = t.where("kind = 'call'").select("payload_id", F.substring_index("owner", ".", -1).alias("owner"), F.substring_index("raw", ".", -1).alias("callee"))
    asserts = calls.join(helpers, ["payload_id", "callee"], "left_semi").select("payload_id", "owner").unionByName(calls.where(F.col("callee").rlike(r"^(assert\w*|raises|warns|fail)$")).select("payload_id", "owner")).distinct()
    bare = tests.join(asserts, ["payload_id", "owner"], "left_anti").select("payload_id", "line", F.lit("PYTEST021").alias("rule_id"))
    broad = t.where(F.col("kind") == "except").where(F.col("raw").isin("Exception", "BaseException") | F.array_contains("flags", "untyped")).select("payload_id", "line", F.lit("PYTEST022").alias("rule_id"))
    return skip.unionByName(bare).unionByName(broad)


def completeness_findings(facts: DataFrame, least: float = 0.5) -> DataFrame:
    """DF-25: ``project_root, rule_id, detail``.

    PYTEST030 tests refer to no public symbol, PYTEST031 to less than ``least`` of at least
    three, PYTEST032 a symbol that branches or raises is not referred to, PYTEST033 nothing
    tests that a referred symbol raises, PYTEST034 all assertions only test for truth.
    """
    s = referenced(facts)
    body = facts.where("kind = 'function'").select("project_root", F.concat_ws(".", "module", "canonical").alias("symbol"), F.element_at("keywords", F.lit("branches")).cast("int").alias("branches"), F.array_contains("flags", "raises").alias("raises"))
    s = s.join(body.groupBy("project_root", "symbol").agg(F.max("branches").alias("branches"), F.bool_or("raises").alias("raises")), ["project_root", "symbol"], "left")
    tests = facts.where(in_tests(F.col("path")))
    with_tests = tests.select("project_root").distinct()
    raised = tests.where("kind = 'call'").where(F.col("canonical").rlike(r"(^|\.)(raises|assertRaises\w*)$")).select("project_root").distinct()
    asserted = tests.where("kind = 'assert'").groupBy("project_root").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike(r"^[\w.]+$|^[\w.]+ is not None$|^True$")).alias("weak"))
    g = s.join(with_tests, "project_root", "left_semi").groupBy("project_root").agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("c"), F.bool_or(F.col("covered") & F.coalesce("raises", F.lit(False))).alias("r"))
    detail = F.format_string("%d of %d", "c", "n")
    none = g.where("c = 0").select("project_root", F.lit("PYTEST030").alias("rule_id"), detail.alias("detail"))
    few = g.where((F.col("c") > 0) & (F.col("c") < least * F.col("n")) & (F.col("n") >= 3)).select("project_root", F.lit("PYTEST031").alias("rule_id"), detail.alias("detail"))
    risky = s.where(~F.col("covered") & ((F.col("branches") >= 2) | F.col("raises"))).select("project_root", F.lit("PYTEST032").alias("rule_id"), F.col("symbol").alias("detail"))
    silent = g.where("r").join(raised, "project_root", "left_anti").select("project_root", F.lit("PYTEST033").alias("rule_id"), F.lit("").alias("detail"))
    weak = asserted.where("n = weak").select("project_root", F.lit("PYTEST034").alias("rule_id"), F.format_string("%d", "n").alias("detail"))
    return none.unionByName(few).unionByName(risky).unionByName(silent).unionByName(weak)


def untyped_public(facts: DataFrame, budget: int = 0) -> DataFrame:
    """P-18: ``project_root, n`` of projects with more public functions without full annotations than the budget."""
    f = facts.where("kind = 'function'").where(F.array_contains("flags", "public") & ~F.array_contains("flags", "typed") & ~in_tests(F.col("path")))
    return f.groupBy("project_root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > budget)


def mutation_candidates(facts: DataFrame) -> DataFrame:
    """P-24: ``payload_id, line, kind`` of comparisons and constants in conditions."""
    return facts.where("kind = 'if'").where(F.size("flags") > 0).select("payload_id", "line", F.get("flags", F.lit(0)).alias("kind"))


def annoyance(facts: DataFrame) -> DataFrame:
    """DF-21: ``payload_id, index``: silent handlers, broad handlers, handlers per call, and how far branching entropy is from the corpus' mean."""
    from codeloom.operators.python_facts import branching_entropy

    g = facts.groupBy("payload_id").agg(
        F.count_if((F.col("kind") == "except") & F.array_contains("flags", "all_pass")).alias("silent"),
        F.count_if((F.col("kind") == "except") & (F.col("raw").isin("Exception", "") | F.array_contains("flags", "untyped"))).alias("broad"),
        F.count_if(F.col("kind") == "except").alias("handlers"),
        F.count_if(F.col("kind") == "call").alias("calls"),
    )
    e = branching_entropy(facts)
    gap = F.coalesce(F.abs(F.col("entropy") - F.col("corpus_entropy")) / F.greatest("corpus_entropy", F.lit(1e-9)), F.lit(0.0))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return g.join(e, "payload_id", "left").select("payload_id", (0.35 * share("silent", "handlers") + 0.25 * share("broad", "handlers") + 0.2 * F.least(share("handlers", "calls"), F.lit(1.0)) + 0.2 * F.least(gap, F.lit(1.0))).alias("index"))


def unknown_attributes(facts: DataFrame, index: DataFrame) -> DataFrame:
    """DF-19: ``payload_id, line, name``: attributes of imported packages of the index (``package, attribute``) that it lacks."""
    uses = facts.where("kind = 'attribute'").select("payload_id", "line", F.substring_index("canonical", ".", 1).alias("package"), F.substring_index("canonical", ".", -1).alias("attribute"), F.substring_index("raw", ".", 1).alias("_alias"))
    imported = facts.where("kind = 'import'").where(~F.array_contains("flags", "from")).select("payload_id", F.col("raw").alias("_alias")).distinct()
    known = index.select("package").distinct()
    return uses.join(imported, ["payload_id", "_alias"], "left_semi").join(known, "package", "left_semi").join(index.select("package", "attribute").distinct(), ["package", "attribute"], "left_anti").select("payload_id", "line", F.concat_ws(".", "package", "attribute").alias("name"))


def module_index(spark, names: list[str], load: bool = False) -> DataFrame:
    """SRC-27: ``package, attribute`` of the named modules; nothing is imported unless ``load``."""
    import importlib

    rows = [(n, a) for n in names for a in dir(importlib.import_module(n))] if load else []
    return spark.createDataFrame(rows, "package string, attribute string")
