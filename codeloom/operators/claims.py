"""Claim and evidence documents checked rule by rule.

A document is parsed into a VARIANT, its items and commands are exploded, and every rule is
one boolean column; the ids of the columns that hold are inlined. Document rules, item rules
and command rules each run in one projection. Rules that count over a document's items are
small aggregates joined back by the document's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import evidence_path_problem

# Vocabularies of the documents.
KINDS = {"fixes": "fixed_count", "audit_findings": "finding_count", "acceptance_report": "item_count"}
LISTS = ("fixes", "findings", "items")
SELF_METHODS = ("tool_self_scan", "release_audit")
SUITES = ("adversarial_suite", "blindspot_suite", "path_portability_suite", "structured_hardening_suite", "encoded_collision_hardening_suite", "provenance_honesty_suite", "claim_evidence_contract_suite", "claim_summary_verification_suite", "evidence_artifact_safety_suite", "array_ambiguity_suite", "fuzz_suite")
TOOL_METHODS = SELF_METHODS + SUITES + ("capability_registry", "mass_audit", "dependency_audit")
OUTSIDE_METHODS = ("external_adversarial_audit", "human_review")
METHODS = TOOL_METHODS + OUTSIDE_METHODS + ("regression_fixture",)
CLASSES = ("reproduced_defect", "blind_spot", "regression_fixture", "documentation_consistency", "policy_gap", "hardening_gap")
STATUSES = ("detected", "fixed", "guarded", "verified")
_FINDER = r"(tool|codeloom|v\d+|v?\d+\.\d+\.\d+)"
TOOL_CLAIM = rf"(?i)\b(found|detected|reported|discovered)\s+by\s+(the\s+)?{_FINDER}\b|\b{_FINDER}\s+(found|detected|reported|discovered)\b"
SEMVER = r"^\d+\.\d+\.\d+$"
CANONICAL = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"
SHELL_TOKENS = r"[\n\r\x00;`<|]|&&|\|\||\$\(|\$\{| >|>>"
NO_NAMES = ("unknown", "n/a", "na", "none", "tbd", "anonymous")


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _type(v: Column | str, path: str) -> Column:
    """VOID, BOOLEAN, BIGINT, STRING, ARRAY or OBJECT; null where the field is missing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")), r"^([A-Z]+)", 1)


def _is(v: Column | str, path: str, kind: str) -> Column:
    return F.coalesce(_type(v, path) == kind, F.lit(False))


def _text(v: Column | str, path: str) -> Column:
    """A string that isn't blank."""
    return _is(v, path, "STRING") & (F.btrim(F.coalesce(_get(v, path), F.lit(""))) != "")


def _version(v: Column | str, path: str) -> Column:
    parts = F.split(_get(v, path), r"\.")
    return F.when(_get(v, path).rlike(SEMVER), F.struct(*[F.get(parts, F.lit(i)).try_cast("int") for i in range(3)]))


def _issues(df: DataFrame, rules: dict[str, tuple[str, Column]], *keep: str) -> DataFrame:
    hits = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, (s, c) in rules.items()]
    return df.select(*keep, F.inline(F.array_compact(F.array(*hits))))


def parsed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, v, list, items, n_items``: the document, which list it has, and that list."""
    d = docs.select(key, F.try_parse_json(text).alias("v"))
    lists = F.array_compact(F.array(*[F.when(_is("v", x, "ARRAY"), F.lit(x)) for x in LISTS]))
    items = F.coalesce(*[_get("v", x, "array<variant>") for x in LISTS])
    return d.withColumn("lists", lists).withColumn("items", F.when(F.size("lists") == 1, items)).withColumn("n_items", F.coalesce(F.size("items"), F.lit(0)))


def items_of(p: DataFrame, key: str = "doc_id") -> DataFrame:
    return p.select(key, F.posexplode("items").alias("no", "i"))


def commands_of(p: DataFrame, key: str = "doc_id") -> DataFrame:
    return p.select(key, F.posexplode(_get("v", "verification_commands", "array<variant>")).alias("no", "c"))


def provenance_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """PROV001 to PROV043: ``key, no, rule_id, severity``; ``no`` is null for rules on the document. Null texts are no documents."""
    p = parsed(docs.where(F.col(text).isNotNull()), key, text)
    obj = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = p.select(key, F.lit(None).cast("int").alias("no"), F.when(F.col("v").isNull(), F.lit("PROV020")).when(~obj, F.lit("PROV001")).alias("rule_id"), F.lit("HIGH").alias("severity")).where("rule_id IS NOT NULL")
    good = p.where(obj)
    kind = _get("v", "artifact_kind")
    counter = F.when(kind == "fixes", _type("v", KINDS["fixes"])).when(kind == "audit_findings", _type("v", KINDS["audit_findings"])).otherwise(_type("v", KINDS["acceptance_report"]))
    number = F.when(kind == "fixes", _get("v", KINDS["fixes"], "bigint")).when(kind == "audit_findings", _get("v", KINDS["audit_findings"], "bigint")).otherwise(_get("v", KINDS["acceptance_report"], "bigint"))
    known = F.coalesce(kind.isin(*KINDS), F.lit(False))
    prov = _is("v", "audit_provenance", "OBJECT")
    others = F.array_size(F.array_compact(F.array(*[F.when(_type("v", c).isNotNull() & (kind != k), F.lit(1)) for k, c in KINDS.items()]))) > 0
    document = {
        "PROV002": ("HIGH", ~known),
        "PROV021": ("MEDIUM", ~_text("v", "schema_version")),
        "PROV022": ("MEDIUM", _text("v", "schema_version") & (_get("v", "schema_version") != "1.0")),
        "PROV003": ("HIGH", ~prov),
        "PROV004": ("MEDIUM", prov & ~_text("v", "audit_provenance.claim_boundary")),
        "PROV023": ("MEDIUM", _text("v", "audit_provenance.claim_boundary") & ~_get("v", "audit_provenance.claim_boundary").rlike("(?i)tool|external|source|origin|provenance|claim")),
        "PROV024": ("MEDIUM", prov & ~_is("v", "audit_provenance.automated_tool_found_all", "BOOLEAN")),
        "PROV005": ("HIGH", _get("v", "audit_provenance.automated_tool_found_all", "boolean")),
        "PROV025": ("HIGH", F.size("lists") > 1),
        "PROV026": ("HIGH", F.size("lists") == 0),
        "PROV027": ("HIGH", F.exists("items", lambda i: ~F.schema_of_variant(i).startswith("OBJECT"))),
        "PROV028": ("MEDIUM", known & others),
        "PROV029": ("HIGH", known & counter.isNull()),
        "PROV006": ("MEDIUM", known & counter.isNotNull() & (counter != "BIGINT")),
        "PROV030": ("HIGH", (counter == "BIGINT") & (number < 0)),
        "PROV007": ("HIGH", (counter == "BIGINT") & (number != F.col("n_items"))),
        "PROV008": ("MEDIUM", (F.size("lists") == 1) & (F.col("n_items") == 0)),
    }
    rows = items_of(good, key).where(F.schema_of_variant("i").startswith("OBJECT"))
    ids = rows.select(key, "no", _get("i", "id").alias("id")).where("id IS NOT NULL")
    first = ids.groupBy(key, "id").agg(F.min("no").alias("_first"))
    rows = rows.withColumn("id", _get("i", "id")).join(first, [key, "id"], "left")
    src = _is("i", "source", "OBJECT")
    method, cls, status = _get("i", "source.method"), _get("i", "classification"), _get("i", "status")
    before, after = _version("i", "before_version"), _version("i", "after_version")
    has_v = _text("i", "before_version") & _text("i", "after_version")
    evidence = _is("i", "source.evidence", "ARRAY") & (F.coalesce(F.size(_get("i", "source.evidence", "array<variant>")), F.lit(0)) > 0)
    command = _text("i", "source.command")
    tool, outside, fixture, own = method.isin(*TOOL_METHODS), method.isin(*OUTSIDE_METHODS), method.isin("regression_fixture"), method.isin(*SELF_METHODS)
    gap = cls.isin("blind_spot", "hardening_gap")
    tested = F.coalesce(_get("i", "regression_test", "boolean"), F.lit(False))
    item = {
        "PROV031": ("MEDIUM", ~_text("i", "id") & ~_text("i", "case_id")),
        "PROV032": ("HIGH", F.col("no") > F.col("_first")),
        "PROV033": ("MEDIUM", ~_text("i", "title")),
        "PROV009": ("HIGH", ~src),
        "PROV010": ("HIGH", src & ~F.coalesce(method.isin(*METHODS), F.lit(False))),
        "PROV011": ("MEDIUM", src & ~F.coalesce(cls.isin(*CLASSES), F.lit(False))),
        "PROV012": ("MEDIUM", src & ~F.coalesce(status.isin(*STATUSES), F.lit(False))),
        "PROV013": ("MEDIUM", src & ~has_v),
        "PROV034": ("MEDIUM", src & has_v & (before.isNull() | after.isNull())),
        "PROV035": ("HIGH", src & (before == after)),
        "PROV042": ("HIGH", src & (after < before)),
        "PROV036": ("HIGH", src & _type("i", "source.evidence").isNotNull() & ~_is("i", "source.evidence", "ARRAY")),
        "PROV037": ("HIGH", src & _type("i", "source.command").isNotNull() & ~_text("i", "source.command")),
        "PROV014": ("HIGH", src & ~evidence & ~command),
        "PROV015": ("HIGH", src & tool & ~command),
        "PROV038": ("MEDIUM", src & tool & ~_text("i", "source.tool_version")),
        "PROV043": ("MEDIUM", src & _text("i", "source.tool_version") & ~_get("i", "source.tool_version").rlike(SEMVER)),
        "PROV016": ("MEDIUM", src & outside & ~_text("i", "source.reviewer")),
        "PROV039": ("MEDIUM", src & fixture & ~evidence),
        "PROV017": ("HIGH", src & (cls == "blind_spot") & own),
        "PROV018": ("HIGH", src & F.concat_ws(" ", *[_get("i", k) for k in ("title", "description", "summary")]).rlike(TOOL_CLAIM) & ~F.coalesce(own, F.lit(False))),
        "PROV019": ("MEDIUM", src & gap & ~tested),
        "PROV040": ("HIGH", src & gap & ~outside & ~fixture),
        "PROV041": ("MEDIUM", src & (status == "fixed") & ~tested & (cls != "documentation_consistency")),
    }
    return bad.unionByName(_issues(good.withColumn("no", F.lit(None).cast("int")), document, key, "no")).unionByName(_issues(rows, item, key, "no"))


def evidence_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """EVID001 to EVID036 without those of PROV, which run on their own; J-19 compares declared and actual counts."""
    p = parsed(docs.where(F.col(text).isNotNull()), key, text)
    obj = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = p.select(key, F.lit(None).cast("int").alias("no"), F.when(F.col("v").isNull(), F.lit("EVID023")).when(~obj, F.lit("EVID001")).alias("rule_id"), F.lit("HIGH").alias("severity")).where("rule_id IS NOT NULL")
    good = p.where(obj)
    summary = _is("v", "claim_summary", "OBJECT")
    source = F.coalesce(_get("v", "claim_summary.by_source", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    total = _type("v", "claim_summary.total_count")
    document = {
        "EVID002": ("HIGH", ~summary),
        "EVID003": ("MEDIUM", summary & (F.cardinality(source) == 0)),
        "EVID027": ("MEDIUM", summary & ~F.coalesce(total == "BIGINT", F.lit(False))),
        "EVID028": ("HIGH", (total == "BIGINT") & (_get("v", "claim_summary.total_count", "bigint") != F.col("n_items"))),
        "EVID006": ("HIGH", ~_is("v", "verification_commands", "ARRAY") | (F.coalesce(F.size(_get("v", "verification_commands", "array<variant>")), F.lit(0)) == 0)),
    }
    declared = good.where(summary).select(key, F.explode(source).alias("method", "x")).withColumn("n", F.try_variant_get("x", "$", "bigint"))
    whole = F.schema_of_variant("x") == "BIGINT"
    items = items_of(good, key)
    actual = items.select(key, _get("i", "source.method").alias("method")).where("method IS NOT NULL").groupBy(key, "method").agg(F.count(F.lit(1)).alias("real"))
    j = declared.join(actual, [key, "method"], "full").withColumn("no", F.lit(None).cast("int"))
    counts = {
        "EVID024": ("HIGH", F.col("x").isNotNull() & ~F.col("method").isin(*METHODS)),
        "EVID025": ("HIGH", F.col("x").isNotNull() & ~whole),
        "EVID026": ("HIGH", whole & (F.col("n") < 0)),
        "EVID004": ("HIGH", whole & (F.col("n") >= 0) & (F.col("n") != F.coalesce("real", F.lit(0)))),
        "EVID005": ("MEDIUM", F.col("x").isNull() & F.col("real").isNotNull()),
    }
    cmds = commands_of(good, key)
    c = cmds.withColumn("command", _get("c", "command"))
    first = c.where("command IS NOT NULL").groupBy(key, "command").agg(F.min("no").alias("_first"))
    c = c.join(first, [key, "command"], "left")
    is_obj = F.schema_of_variant("c").startswith("OBJECT")
    st, code = _get("c", "status"), _get("c", "exit_code", "bigint")
    code_ok = _is("c", "exit_code", "BIGINT") & (code >= 0)
    command = {
        "EVID007": ("HIGH", ~is_obj),
        "EVID008": ("MEDIUM", is_obj & ~_text("c", "command")),
        "EVID029": ("MEDIUM", F.col("no") > F.col("_first")),
        "EVID009": ("MEDIUM", is_obj & ~F.coalesce(st.isin("passed", "failed", "skipped"), F.lit(False))),
        "EVID010": ("MEDIUM", is_obj & ~code_ok),
        "EVID011": ("HIGH", code_ok & (st == "passed") & (code != 0)),
        "EVID012": ("HIGH", code_ok & (st == "failed") & (code == 0)),
        "EVID030": ("HIGH", code_ok & (st == "skipped") & (code != 0)),
        "EVID031": ("MEDIUM", (st == "skipped") & ~_text("c", "skip_reason")),
        "EVID013": ("LOW", is_obj & ~_text("c", "artifact")),
    }
    method, cls, et = _get("i", "source.method"), _get("i", "classification"), _get("i", "evidence_type")
    tool, outside, fixture = method.isin(*TOOL_METHODS), method.isin(*OUTSIDE_METHODS), method == "regression_fixture"
    tested = F.coalesce(_get("i", "regression_test", "boolean"), F.lit(False))
    rep = _is("i", "reproduction", "OBJECT")
    lacks = sum(((~_text("i", f"reproduction.{k}")).cast("int") for k in ("command", "observed_before", "verified_after")), F.lit(0))
    item = {
        "EVID014": ("MEDIUM", ~F.coalesce(et.isin("artifact_report", "command_output", "manual_review", "fixture", "regression_test"), F.lit(False))),
        "EVID015": ("HIGH", tool & ~F.coalesce(et.isin("artifact_report", "command_output"), F.lit(False))),
        "EVID032": ("MEDIUM", tool & ~_text("i", "source.tool_version")),
        "EVID033": ("MEDIUM", tool & _text("i", "source.tool_version") & ~_get("i", "source.tool_version").rlike(SEMVER)),
        "EVID016": ("HIGH", outside & ~F.coalesce(et.isin("manual_review", "fixture", "regression_test"), F.lit(False))),
        "EVID017": ("MEDIUM", outside & ~_text("i", "source.reviewer")),
        "EVID018": ("MEDIUM", outside & _get("i", "source.review_date").try_cast("date").isNull()),
        "EVID034": ("HIGH", fixture & ~F.coalesce(et.isin("regression_test", "fixture"), F.lit(False))),
        "EVID035": ("MEDIUM", fixture & ~tested),
        "EVID036": ("HIGH", _version("i", "after_version") <= _version("i", "before_version")),
        "EVID019": ("HIGH", (cls == "reproduced_defect") & ~rep),
        "EVID020": ("MEDIUM", (cls == "reproduced_defect") & rep & (lacks > 0)),
        "EVID021": ("MEDIUM", tested & ~_text("i", "test_path")),
        "EVID022": ("MEDIUM", cls.isin("blind_spot", "hardening_gap") & ~_text("i", "threat_model_gap")),
    }
    parts = [_issues(good.withColumn("no", F.lit(None).cast("int")), document, key, "no"), _issues(j, counts, key, "no"), _issues(c, command, key, "no"), _issues(items, item, key, "no")]
    for x in parts:
        bad = bad.unionByName(x)
    return bad


def artifact_findings(docs: DataFrame, today: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """EAS001 to EAS031; the day of today is a parameter."""
    p = parsed(docs.where(F.col(text).isNotNull()), key, text)
    obj = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = p.select(key, F.lit(None).cast("int").alias("no"), F.when(F.col("v").isNull(), F.lit("EAS031")).when(~obj, F.lit("EAS001")).alias("rule_id"), F.lit("HIGH").alias("severity")).where("rule_id IS NOT NULL")
    good = p.where(obj)
    c = commands_of(good, key).withColumn("command", _get("c", "command")).withColumn("bare", F.btrim("command")).withColumn("artifact", F.when(_is("c", "artifact", "STRING"), _get("c", "artifact")))
    f1 = c.where("bare IS NOT NULL").groupBy(key, "bare").agg(F.min("no").alias("_fc"))
    f2 = c.where("artifact IS NOT NULL").groupBy(key, "artifact").agg(F.min("no").alias("_fa"))
    c = c.join(f1, [key, "bare"], "left").join(f2, [key, "artifact"], "left")
    command = {
        "EAS014": ("MEDIUM", F.col("command") != F.col("bare")),
        "EAS015": ("MEDIUM", F.col("no") > F.col("_fc")),
        "EAS013": ("HIGH", F.col("command").rlike(SHELL_TOKENS)),
        "EAS007": ("HIGH", F.col("artifact").isNotNull() & evidence_path_problem(F.col("artifact")).isNotNull()),
        "EAS012": ("MEDIUM", F.col("no") > F.col("_fa")),
        "EAS008": ("MEDIUM", _type("c", "artifact").isNotNull() & ~_is("c", "artifact", "STRING") & ~_is("c", "artifact", "VOID")),
    }
    i = good.select(key, _get("v", "artifact_kind").alias("kind"), F.posexplode("items").alias("no", "i"))
    b, a = _version("i", "before_version"), _version("i", "after_version")
    rev = _get("i", "source.reviewer")
    refs = F.coalesce(_get("i", "source.evidence", "array<string>"), F.array().cast("array<string>"))
    test = _get("i", "test_path")
    item = {
        "EAS027": ("HIGH", (F.col("kind") == "fixes") & ~F.coalesce(_get("i", "status").isin("fixed", "verified"), F.lit(False))),
        "EAS029": ("MEDIUM", (_get("i", "classification") == "policy_gap") & ~_text("i", "threat_model_gap")),
        "EAS024": ("MEDIUM", _text("i", "before_version") & ~_get("i", "before_version").rlike(CANONICAL)),
        "EAS025": ("MEDIUM", _text("i", "after_version") & ~_get("i", "after_version").rlike(CANONICAL)),
        "EAS026": ("MEDIUM", (a.getField("col1") - b.getField("col1") > 10) | ((a.getField("col1") == b.getField("col1")) & (a.getField("col2") - b.getField("col2") > 100))),
        "EAS020": ("HIGH", test.isNotNull() & evidence_path_problem(test).isNotNull()),
        "EAS022": ("MEDIUM", test.isNotNull() & ~test.endswith(".py")),
        "EAS002": ("HIGH", F.exists(refs, lambda r: evidence_path_problem(r).isNotNull())),
        "EAS006": ("MEDIUM", F.size(refs) > F.size(F.array_distinct(refs))),
        "EAS017": ("MEDIUM", rev.isNotNull() & (rev != F.regexp_replace(F.btrim(rev), r"\s+", " "))),
        "EAS016": ("HIGH", F.lower(F.btrim(rev)).isin(*NO_NAMES)),
        "EAS018": ("HIGH", _get("i", "source.review_date").try_cast("date") > today),
        "EAS030": ("MEDIUM", ~F.coalesce(_get("i", "source.method").isin(*METHODS), F.lit(False))),
    }
    return bad.unionByName(_issues(c, command, key, "no")).unionByName(_issues(i, item, key, "no"))
