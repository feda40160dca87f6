"""Rules over single lines, nearby lines and whole files.

A rule is data: languages, a pattern, what cancels it, and the reach of the lines that may
cancel it. All rules over lines run in one fused projection (an array of structs that is
inlined), so the lines are read once however many rules there are; patterns that a user
brings at run time are joined instead (``grep``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import strip
from codeloom.functions.text import explode_lines, suffix

SCRIPTS = (".js", ".ts", ".jsx", ".tsx")


@dataclass(frozen=True)
class LineRule:
    """``pattern`` has to be found in the line and ``unless`` must not; ``skip_tests`` leaves test files out.

    ``path`` and ``file_has`` have to be found in the path and the whole file, ``path_lacks``
    and ``file_lacks`` must not; each file is asked once, not each line.
    """

    id: str
    severity: str
    title: str
    pattern: str
    suffixes: tuple[str, ...] = ()
    unless: str | None = None
    skip_tests: bool = False
    path: str | None = None
    path_lacks: str | None = None
    file_has: str | None = None
    file_lacks: str | None = None


# Identifiers, severities and patterns of the line rules.
LINE_RULES = (
    LineRule("TXT002", "LOW", "open marker", r"(?i)\b(TODO|FIXME|HACK|XXX)\b", unless=r"pat = re\.compile|re\.findall", skip_tests=True),
    LineRule("TXT003", "MEDIUM", "muted linter", r"(?i)\b(noqa|type:\s*ignore|eslint-disable|ts-ignore|nosec)\b", unless=r"pat = re\.compile|re\.findall", skip_tests=True),
    LineRule("JS001", "CRITICAL", "dynamic evaluation", r"\beval\s*\(", SCRIPTS),
    LineRule("JS002", "HIGH", "raw markup sink", r"\.innerHTML\s*=", SCRIPTS),
    LineRule("JS003", "HIGH", "secret in browser storage", r"(?i)localStorage\.(setItem|getItem)\s*\([^\n]*(token|secret|password|apiKey)", SCRIPTS),
    LineRule("JS004", "LOW", "left-over console call", r"\bconsole\.(log|debug|info)\s*\(", SCRIPTS),
    LineRule("JS005", "HIGH", "raw markup property", r"dangerouslySetInnerHTML", SCRIPTS),
    LineRule("JS006", "MEDIUM", "cookie written by script", r"document\.cookie\s*=", SCRIPTS),
    LineRule("JS007", "MEDIUM", "blank target without rel", r"(?i)target=[\"']_blank[\"']", SCRIPTS, unless=r"(?i)rel=[\"'][^\"']*(noopener|noreferrer)"),
    LineRule("GREP001:merge_marker", "HIGH", "merge marker", r"^(<<<<<<<|=======|>>>>>>>)( |$)"),
    LineRule("GREP001:private_key", "CRITICAL", "private key", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    LineRule("messaging.secret.token_literal", "CRITICAL", "bot token literal", r"(?i)(?:bot|messaging)_?token\s*=\s*['\"][0-9]{6,}:[A-Za-z0-9_-]{20,}", (".py",)),
    LineRule("messaging.async.raw_create_task", "MEDIUM", "raw task", r"create_task\(", (".py",), path_lacks=r"(?i)aiogram"),
    LineRule("messaging.webhook.lifecycle_mix", "MEDIUM", "webhook set and deleted", r"(?i)deletewebhook", (".py",), file_has=r"(?i)setwebhook"),
    LineRule("messaging.callback_without_answer", "MEDIUM", "callback without answer", r"(?i)callback_query", (".py",), file_lacks=r"(?i)\.answer\("),
    LineRule("autonomy_canon.second_brain.risk", "HIGH", "decision in a router", r"(?i)decision", (".py",), unless=r"decisioncore", path=r"(?i)router|strategy"),
    LineRule("autonomy_canon.raw_effect.risk", "HIGH", "raw effect", r"\b(requests\.|subprocess\.|os\.system\(|open\()", (".py",), path_lacks=r"(?i)effect|provider"),
    LineRule("autonomy_canon.execution_without_evidence.risk", "MEDIUM", "execution without evidence", r"(?i)execute", (".py",), file_lacks=r"(?i)verify|evidence"),
    LineRule("fastapi.route_without_dependency_signal", "MEDIUM", "route without guard", r"@\w+\.(get|post|put|delete|patch)\(", (".py",), path=r"(?i)auth|admin", file_lacks=r"(?i)depends\("),
    LineRule("flask.route_without_auth_signal", "MEDIUM", "route without login", r"(?i)@app\.route", (".py",), path=r"(?i)admin|auth", file_lacks=r"(?i)login_required|jwt_required"),
    LineRule("fastapi.html_response.dynamic_html", "HIGH", "dynamic response markup", r"(?i)^(?=.*htmlresponse)(?=.*(f\"|f'|request\.))", (".py",)),
    LineRule("flask.render_template_string.risk", "HIGH", "template from a string", r"(?i)render_template_string\s*\(", (".py",)),
    LineRule("flask.open_redirect.risk", "HIGH", "redirect to a request value", r"(?i)redirect\s*\(.*request\.", (".py",)),
    LineRule("flask.debug_true.risk", "HIGH", "debug server", r"app\.run\(.*debug\s*=\s*True", (".py",)),
    LineRule("django.mark_safe.risk", "HIGH", "markup marked safe", r"\bmark_safe\s*\(", (".py",)),
    LineRule("django.raw_sql.review", "MEDIUM", "raw query", r"\.raw\s*\(|RawSQL\s*\(", (".py",)),
    LineRule("sqlalchemy.text.fstring_sql", "HIGH", "formatted query text", r"\btext\s*\(\s*f['\"]", (".py",)),
    LineRule("sqlalchemy.raw_sql_string", "HIGH", "query string", r"session\.execute\(\s*f?['\"]", (".py",)),
    LineRule("django.csrf_exempt", "HIGH", "request check switched off", r"(?i)csrf_exempt", (".py",)),
    LineRule("TYPE031", "MEDIUM", "type check muted without reason", r"#\s*type:\s*ignore(\[[^\]]*\])?\s*$", (".py",)),
)


@dataclass(frozen=True)
class FileRule:
    """A rule over a whole file: ``has`` and ``also`` are found (if given) and ``lacks`` is not (if given); ``either``: one of ``has`` and ``lacks`` is enough.

    Patterns are looked for anywhere and have no repeated groups, so texts of any length are safe.
    """

    id: str
    severity: str
    path: str
    has: str | None = None
    lacks: str | None = None
    also: str | None = None
    either: bool = False
    path_lacks: str | None = None


# Fixed value: where migrations lie.
MIGRATION_PATH = r"(?i)(^|/)(migrations|migration|alembic|versions)/(.*/)?[^/]+\.(py|sql)$|(^|/)[0-9]{4,}[^/]*\.(py|sql)$|_migration\.py$|\.sql$"
# Rules over whole files.
FILE_RULES = (
    FileRule("DEPLOY010", "MEDIUM", r"(?i)(^|/)dockerfile[^/]*$", lacks=r"(?i)HEALTHCHECK"),
    FileRule("DEPLOY011", "HIGH", r"(?i)(^|/)dockerfile[^/]*$", has=r"(?i)(COPY|ADD)\s+\.env\b"),
    FileRule("DEPLOY012", "MEDIUM", r"(?i)(^|/)dockerfile[^/]*$", has=r"(?i)USER\s+root\b", lacks=r"(?im)^\s*USER\s+", either=True),
    FileRule("DEPLOY020", "HIGH", r"(?i)(^|/)(docker-)?compose[^/]*\.ya?ml$", has=r"(?i)POSTGRES_PASSWORD\s*[:=]\s*['\"]?(password|postgres|changeme)"),
    FileRule("DEPLOY021", "MEDIUM", r"(?i)(^|/)(docker-)?compose[^/]*\.ya?ml$", lacks=r"restart:"),
    FileRule("DEPLOY030", "MEDIUM", r"(^|/)(\.github/workflows|ci)/[^/]+\.ya?ml$", lacks=r"pytest"),
    FileRule("DEPLOY031", "HIGH", r"(^|/)(\.github/workflows|ci)/[^/]+\.ya?ml$", has=r"(?i)echo\s+\$\{\{\s*secrets\."),
    FileRule("DEPLOY040", "MEDIUM", r"\.service$", lacks=r"Restart="),
    FileRule("DEPLOY041", "MEDIUM", r"\.service$", lacks=r"WorkingDirectory="),
    FileRule("DEPLOY042", "HIGH", r"\.service$", has=r"Environment=.*(TOKEN|SECRET)="),
    FileRule("DEPLOY050", "MEDIUM", r"(?i)nginx[^/]*\.conf$", has=r"proxy_pass", lacks=r"proxy_set_header"),
    FileRule("MIG020", "HIGH", MIGRATION_PATH, has=r"(?i)DROP\s+TABLE|DROP\s+COLUMN|TRUNCATE\s+TABLE|DELETE\s+FROM"),
    FileRule("MIG030", "HIGH", MIGRATION_PATH, has=r"(?i)sqlite", also=r"(?i)postgres"),
    FileRule("MIG040", "MEDIUM", MIGRATION_PATH, has=r"down_revision", lacks=r"def downgrade"),
    FileRule("OWN010", "MEDIUM", r"\.(py|md|txt|yml|yaml|json|toml)$", has=r"(?im)(do\s+not\s+use|bypass|ignore|disable)\s+(owner|approval|review|governance|guard)"),
    FileRule("messaging.webhook.secret_optional", "HIGH", r"\.py$", has=r"(?i)messaging_webhook_secret_token\s*="),
    FileRule("messaging.transport.polling_webhook_conflict", "HIGH", r"\.py$", has=r"(?i)start_polling", also=r"(?i)webhook"),
    FileRule("autonomy_canon.prod_sqlite_fallback", "HIGH", r"\.py$", has=r"(?i)sqlite", also=r"(?i)prod"),
    FileRule("messaging.callback_query.missing_answer_signal", "MEDIUM", r"\.py$", has=r"(?i)callback_query", lacks=r"(?i)callback_query\.answer\(|answer_callback_query"),
    FileRule("autonomy_canon.admin_surface.missing_signal", "LOW", r"\.py$", has=r"(?i)capability|feature", lacks=r"(?i)admin", path_lacks=r"(?i)control"),
)


def is_test_path(path: Column) -> Column:
    return path.rlike(r"^(tests/|test_)")


def _language(rule: LineRule, suffix_: Column) -> Column:
    return suffix_.isin(*rule.suffixes) if rule.suffixes else F.lit(True)


def _file_test(rule: LineRule, path: Column) -> Column:
    """What a line rule asks of the path and the whole file."""
    c = _language(rule, suffix(path))
    for text, has, lacks in ((path, rule.path, rule.path_lacks), (F.col("content"), rule.file_has, rule.file_lacks)):
        c = c & text.rlike(has) if has else c
        c = c & ~text.rlike(lacks) if lacks else c
    return c


def line_findings(corpus: DataFrame, rules: tuple[LineRule, ...] = LINE_RULES, key: tuple[str, ...] = ("payload_id", "project_root", "path")) -> DataFrame:
    """``*key, line_number, rule_id, severity, line`` of every match; one pass over the lines, no shuffle.

    ``corpus`` has the key columns and ``content``. Null paths belong to no language but are
    text; null and empty contents give no rows.
    """
    path = F.coalesce("path", F.lit(""))
    asked = [i for i, r in enumerate(rules) if r.path or r.path_lacks or r.file_has or r.file_lacks]
    rows = explode_lines(corpus.select(*key, "content", suffix(path).alias("_suffix"), is_test_path(path).alias("_test"), *[_file_test(rules[i], path).alias(f"_file{i}") for i in asked]))
    hits = []
    for i, r in enumerate(rules):
        c = F.col("line").rlike(r.pattern)
        if i in asked:
            c = F.col(f"_file{i}") & c
        if r.unless:
            c = c & ~F.col("line").rlike(r.unless)
        if r.skip_tests:
            c = c & ~F.col("_test")
        hits.append(F.when(_language(r, F.col("_suffix")) & c, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))))
    # An empty array gives no row, so no filter has to evaluate the patterns a second time.
    return rows.select(*key, "line_number", F.inline(F.array_compact(F.array(*hits))), strip(F.col("line")).alias("line"))


def file_findings(corpus: DataFrame, rules: tuple[FileRule, ...] = FILE_RULES, key: tuple[str, ...] = ("payload_id", "project_root", "path")) -> DataFrame:
    """``*key, rule_id, severity`` of the rules over whole files; a null content is an empty file."""
    text, path = F.coalesce("content", F.lit("")), F.coalesce("path", F.lit(""))
    hits = []
    for r in rules:
        c = path.rlike(r.path)
        if r.path_lacks:
            c = c & ~path.rlike(r.path_lacks)
        if r.either:
            c = c & (text.rlike(r.has) | ~text.rlike(r.lacks))
        else:
            for wanted in filter(None, (r.has, r.also)):
                c = c & text.rlike(wanted)
            if r.lacks:
                c = c & ~text.rlike(r.lacks)
        hits.append(F.when(c, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))))
    return corpus.select(*key, F.inline(F.array_compact(F.array(*hits))))


def header_claims(corpus: DataFrame, key: tuple[str, ...] = ("payload_id", "project_root", "path")) -> DataFrame:
    """TXT001: among the first thirty lines, a comment or one of the first five with all of complete, final and production."""
    line = F.lower("line")
    rows = explode_lines(corpus.select(*key, "content")).where("line_number <= 30")
    comment = F.col("line").rlike(r"^\s*(#|//|/\*|\*|--|\"\"\"|''')")
    return rows.where((comment | (F.col("line_number") <= 5)) & line.contains("complete") & line.contains("final") & line.contains("production")).select(*key, "line_number", F.lit("TXT001").alias("rule_id"), F.lit("HIGH").alias("severity"))


def _files_window(key: tuple[str, ...]) -> Window:
    return Window.partitionBy(*key).orderBy("line_number")


def fetch_without_handler(corpus: DataFrame, key: tuple[str, ...] = ("payload_id",)) -> DataFrame:
    """JS008 (W-02): a ``fetch(`` line whose window of two lines before and three after has neither ``.catch(`` nor ``try``."""
    rows = explode_lines(corpus.where(suffix(F.col("path")).isin(*SCRIPTS)).select(*key, "content"))
    guard = F.max((F.contains("line", F.lit(".catch(")) | F.contains("line", F.lit("try"))).cast("int")).over(_files_window(key).rowsBetween(-2, 3))
    return rows.withColumn("_guard", guard).where(F.contains("line", F.lit("fetch(")) & (F.col("_guard") == 0)).select(*key, "line_number")


def overclaims(corpus: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """HON001 (W-03): a claim of completeness without limiting words within two lines before and after."""
    rows = explode_lines(corpus.select(*key, "content"))
    claim = r"(?i)\b(guarantee[ds]?|complete(ly)?|fully|all (bugs|issues|findings)|never|100 ?%|production[- ]ready)\b"
    limit = r"(?i)\b(limit(s|ed|ation|ations)?|except|unless|but|however|may|might|approximate(ly)?|not)\b"
    near = F.max(F.col("line").rlike(limit).cast("int")).over(_files_window(key).rowsBetween(-2, 2))
    return rows.withColumn("_near", near).where(F.col("line").rlike(claim) & (F.col("_near") == 0)).select(*key, "line_number")


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob: ``**`` crosses folders, ``*`` and ``?`` do not; a pattern without ``/`` matches names."""
    import re

    if pattern in ("**", "**/*"):
        return ".*"
    anchored = "/" in pattern.strip("/")
    out, i = "", 0
    p = pattern.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif p.startswith("**", i):
            out += ".*"
            i += 2
        elif p[i] == "*":
            out += "[^/]*"
            i += 1
        elif p[i] == "?":
            out += "[^/]"
            i += 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            out += "[" + p[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = j + 1
        else:
            out += re.escape(p[i])
            i += 1
    return f"^{out}$" if anchored else f"(?:^|/){out}$"


@dataclass(frozen=True)
class GrepPattern:
    id: str
    regex: str
    severity: str = "MEDIUM"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ignore_case: bool = False


def broken_patterns(spark: SparkSession, patterns: list[GrepPattern]) -> tuple[list[GrepPattern], DataFrame]:
    """(patterns that can be used, rows ``pattern_id, rule_id, severity`` of GREP000 for the others)."""
    good, bad = [], []
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    for p in patterns:
        try:
            compile_(p.regex)
            good.append(p)
        except Exception:  # the JVM refuses the expression
            bad.append((p.id, "GREP000", "HIGH"))
    return good, spark.createDataFrame(bad, "pattern_id string, rule_id string, severity string")


def over_budget(found: DataFrame, max_matches: int) -> DataFrame:
    """GREP010: one row ``rule_id, severity, n`` if a search has ``max_matches`` or more matches. ``found`` is the search without a budget."""
    return found.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_matches).select(F.lit("GREP010").alias("rule_id"), F.lit("HIGH").alias("severity"), "n")


def grep(corpus: DataFrame, patterns: list[GrepPattern], max_matches: int | None = None, key: tuple[str, ...] = ("payload_id", "path")) -> DataFrame:
    """P-01, T-01: user patterns over lines, in the order path, pattern, line, up to ``max_matches`` rows.

    The budget is a feature of the search: the first ``max_matches`` rows by that order, as a
    top-k; without it every match is returned. Patterns that aren't valid Java expressions
    are left out; ``broken_patterns`` reports them. An empty list gives no rows.
    """
    usable = broken_patterns(corpus.sparkSession, patterns)[0]
    rows = explode_lines(corpus.select(*key, "content"))
    hits = []
    for i, p in enumerate(patterns):
        if p not in usable:
            continue
        c = F.col("line").rlike(("(?i)" if p.ignore_case else "") + p.regex)
        if p.include:
            c = c & F.col("path").rlike("|".join(map(glob_regex, p.include)))
        if p.exclude:
            c = c & ~F.col("path").rlike("|".join(map(glob_regex, p.exclude)))
        hits.append(F.when(c, F.struct(F.lit(i).alias("pattern_no"), F.lit(f"GREP001:{p.id}").alias("rule_id"), F.lit(p.severity).alias("severity"))))
    none = F.array().cast("array<struct<pattern_no:int,rule_id:string,severity:string>>")
    found = rows.select(*key, "line_number", F.inline(F.array_compact(F.array(*hits)) if hits else none))
    return found if max_matches is None else found.orderBy("path", "pattern_no", "line_number", *[k for k in key if k != "path"]).limit(max_matches)
