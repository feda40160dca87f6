"""Reports, suppressions, baselines, patterns and results of other tools as Issue rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import severity_name
from codeloom.operators.governance import normalised

ISSUE = "struct<file:string,category:string,severity:string,detector:string,description:string,recommendation:string,location:string,line_number:int,confidence:string,evidence:string>"
FIELDS = ("file", "category", "severity", "detector", "description", "recommendation", "location", "line_number", "confidence")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of files, each in one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def native_issues(texts: DataFrame) -> DataFrame:
    """SRC-09, SRC-10: Issues of native reports with defaults; a text that is no report gives no rows. ``seq`` keeps the order."""
    report = F.from_json("text", f"issues array<{ISSUE}>")
    rows = texts.select("path", F.posexplode(report["issues"]).alias("seq", "i")).select("path", "seq", "i.*")
    return rows.withColumns({"severity": severity_name(F.col("severity")), "detector": F.coalesce("detector", F.lit("unknown")), "description": F.coalesce("description", F.lit(""))})


def unreadable_reports(texts: DataFrame) -> DataFrame:
    """Paths of texts that are no object with a list of issues."""
    return texts.where(F.get_json_object("text", "$.issues").isNull() | ~F.btrim(F.get_json_object("text", "$.issues")).startswith("[")).select("path")


def suppressions(texts: DataFrame) -> DataFrame:
    """SRC-11: suppressions of a list or of an object with that list; ``idx`` is the order."""
    item = "array<struct<fingerprint:string,rule_id:string,file:string,owner:string,reason:string,expires:string>>"
    rows = F.coalesce(F.from_json(F.get_json_object("text", "$.suppressions"), item), F.when(F.btrim("text").startswith("["), F.from_json("text", item)))
    return texts.select(F.posexplode(rows).alias("idx", "s")).select("idx", "s.*")


def baseline_fingerprints(texts: DataFrame) -> DataFrame:
    """SRC-12: distinct fingerprints of a baseline report, computed again."""
    return normalised(native_issues(texts)).select("fingerprint").distinct()


def baseline_audit(issues: DataFrame, baseline: DataFrame, files: DataFrame, max_growth: int = 0) -> DataFrame:
    """baseline-audit: ``category, detail``: growth, repeated fingerprints, Issues of files that are gone."""
    b = normalised(baseline)
    twice = b.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("baseline_contract.duplicate_fingerprint").alias("category"), F.col("fingerprint").alias("detail"))
    gone = b.select("file").distinct().join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti").select(F.lit("baseline_contract.missing_file").alias("category"), F.col("file").alias("detail"))
    grown = normalised(issues).agg(F.count(F.lit(1)).alias("a")).crossJoin(b.agg(F.count(F.lit(1)).alias("b"))).where(F.col("a") - F.col("b") > max_growth).select(F.lit("baseline_contract.growth").alias("category"), (F.col("a") - F.col("b")).cast("string").alias("detail"))
    return twice.unionByName(gone).unionByName(grown)


def _level(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.isin("CRITICAL", "BLOCKER"), "CRITICAL").when(u.isin("ERROR", "HIGH"), "HIGH").when(u.isin("INFO", "LOW", "NOTE", "INFORMATION", "HINT"), "LOW").otherwise("MEDIUM")


def external_issues(texts: DataFrame) -> DataFrame:
    """SRC-16, X-13: Issues of ruff, bandit, semgrep and pyright from ``tool, text``.

    An unknown tool is one EXTN001 Issue, a text that isn't the tool's JSON one EXTN002.
    """
    t = texts.withColumn("tool", F.lower("tool"))

    def rows(tool: str, items: Column, file: str, line: str, code: str, level: Column, text: str, base: int = 0) -> DataFrame:
        x = t.where(F.col("tool") == tool).select("tool", F.posexplode(items).alias("seq", "x"))
        return x.select(F.col(f"x.{file}").alias("file"), F.concat(F.lit(f"external.{tool}."), F.coalesce(F.col(f"x.{code}"), F.lit("unknown"))).alias("category"), level.alias("severity"), F.lit(f"external.{tool}").alias("detector"), F.coalesce(F.col(f"x.{text}"), F.lit("")).alias("description"), (F.col(f"x.{line}") + base).cast("int").alias("line_number"))

    ruff = F.from_json("text", "array<struct<filename:string,code:string,message:string,location:struct<row:int>>>")
    bandit = F.from_json("text", "results array<struct<filename:string,line_number:int,test_id:string,issue_severity:string,issue_confidence:string,issue_text:string>>")["results"]
    semgrep = F.from_json("text", "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>")["results"]
    pyright = F.from_json("text", "generalDiagnostics array<struct<file:string,severity:string,rule:string,message:string,range:struct<start:struct<line:int>>>>")["generalDiagnostics"]
    out = rows("ruff", ruff, "filename", "location.row", "code", F.lit("MEDIUM"), "message")
    out = out.unionByName(rows("bandit", bandit, "filename", "line_number", "test_id", _level(F.col("x.issue_severity")), "issue_text"))
    out = out.unionByName(rows("semgrep", semgrep, "path", "start.line", "check_id", _level(F.col("x.extra.severity")), "extra.message"))
    out = out.unionByName(rows("pyright", pyright, "file", "range.start.line", "rule", _level(F.col("x.severity")), "message", 1))
    known = F.col("tool").isin("ruff", "bandit", "semgrep", "pyright")
    readable = F.when(F.col("tool") == "ruff", F.btrim("text").startswith("[")).otherwise(F.btrim("text").startswith("{")) & F.try_parse_json("text").isNotNull()
    wrong = t.where(~known | ~F.coalesce(readable, F.lit(False))).select(F.lit("<external>").alias("file"), F.when(~known, "EXTN001").otherwise("EXTN002").alias("category"), F.when(~known, "HIGH").otherwise("MEDIUM").alias("severity"), F.lit("external").alias("detector"), F.col("tool").alias("description"), F.lit(None).cast("int").alias("line_number"))
    return out.unionByName(wrong)


def mypy_issues(lines: DataFrame) -> DataFrame:
    """SRC-18: Issues of a type checker's ``file:line: level: text`` lines; others are left out."""
    rx = r"^([^:\n]+):(\d+): (error|warning|note): (.*)$"
    ok = lines.where(F.col("value").rlike(rx))
    g = lambda i: F.regexp_extract("value", rx, i)
    return ok.select(g(1).alias("file"), g(2).cast("int").alias("line_number"), _level(g(3)).alias("severity"), g(4).alias("description"), F.lit("Type checker").alias("category"), F.lit("type_tool").alias("detector"))


def grep_patterns(texts: DataFrame) -> DataFrame:
    """SRC-25: user patterns of a list or an object with it, in order."""
    item = "array<struct<id:string,regex:string,severity:string,description:string,include:array<string>,exclude:array<string>,flags:array<string>>>"
    rows = F.coalesce(F.from_json(F.get_json_object("text", "$.patterns"), item), F.when(F.btrim("text").startswith("["), F.from_json("text", item)))
    return texts.select(F.posexplode(rows).alias("idx", "p")).select("idx", "p.*")


def codeowners(lines: DataFrame) -> DataFrame:
    """SRC-20: ``pattern, owners`` of the lines that aren't comments."""
    t = F.btrim(F.regexp_replace("value", r"#.*$", ""))
    parts = F.split(t, r"\s+")
    return lines.where((t != "") & (F.size(parts) > 1)).select(F.get(parts, F.lit(0)).alias("pattern"), F.slice(parts, 2, 1000).alias("owners"))


def requirements(lines: DataFrame) -> DataFrame:
    """SRC-15: ``name, spec`` of requirement lines."""
    t = F.btrim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    return lines.where((t != "") & ~t.startswith("-")).select(F.lower(F.regexp_extract(t, r"^([A-Za-z0-9_.\-]+)", 1)).alias("name"), t.alias("spec"))


def package_json(texts: DataFrame) -> DataFrame:
    """SRC-15: ``section, name, spec`` of the four dependency maps of a package file."""
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    maps = F.array(*[F.struct(F.lit(s).alias("section"), F.from_json(F.get_json_object("text", f"$.{s}"), "map<string,string>").alias("m")) for s in sections])
    return texts.select(F.inline(maps)).select("section", F.explode("m").alias("name", "spec"))


def pyproject(texts: DataFrame) -> DataFrame:
    """SRC-15: ``section, spec`` of PEP 621 and poetry dependencies; unreadable files give none."""
    def run(s: pd.Series) -> pd.Series:
        import tomllib

        out = []
        for t in s:
            try:
                d = tomllib.loads(t or "")
            except tomllib.TOMLDecodeError:
                d = {}
            p = d.get("project", {})
            rows = [("project", x) for x in p.get("dependencies", [])] + [(f"optional:{g}", x) for g, xs in p.get("optional-dependencies", {}).items() for x in xs]
            rows += [("poetry", f"{n} {v if isinstance(v, str) else v.get('version', '')}".strip()) for n, v in d.get("tool", {}).get("poetry", {}).get("dependencies", {}).items() if n != "python"]
            out.append([{"section": a, "spec": b} for a, b in rows])
        return pd.Series(out, dtype=object)

    return texts.select(F.inline(F.pandas_udf(run, "array<struct<section:string,spec:string>>")("text")))


def sarif_errors(texts: DataFrame) -> DataFrame:
    """sarif-github-audit: ``path, rule_id``: version, runs, tool rules, results' rule ids, locations and fingerprints."""
    s = F.from_json("text", "version string, runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string>>>>,results:array<struct<ruleId:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>,partialFingerprints:map<string,string>>>>>")
    d = texts.select("path", s.alias("s"))
    runs = F.col("s.runs")
    results = F.flatten(F.transform(runs, lambda r: F.coalesce(r["results"], F.array())))
    hits = F.array_compact(
        F.array(
            F.when(F.col("s").isNull(), "SARIF001"),
            F.when(~F.col("s.version").eqNullSafe("2.1.0"), "SARIF002"),
            F.when(F.coalesce(F.size(runs), F.lit(0)) < 1, "SARIF003"),
            F.when(F.exists(runs, lambda r: r["tool"]["driver"]["name"].isNull()), "SARIF004"),
            F.when(F.exists(results, lambda x: x["ruleId"].isNull()), "SARIF005"),
            F.when(F.exists(results, lambda x: F.get(x["locations"], F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].isNull()), "SARIF006"),
            F.when(F.exists(results, lambda x: x["partialFingerprints"].isNull()), "SARIF007"),
        )
    )
    return d.select("path", F.explode(hits).alias("rule_id"))
