"""Line, window and whole-file rules over the scanned files and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import chunks_of, explode_lines, module_name
from codeloom.operators import governance as G
from codeloom.operators import integrity as I
from codeloom.operators import line_rules as L
from codeloom.session import table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_payloads").select("payload_id", "project_root", "path", "content")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as text files."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("payload_id"), "project_root", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


def severity_summary(spark, sf_dir):
    """The flagship: files and documents -> lines -> rules -> fingerprints -> duplicates folded -> counts by severity."""
    found = L.line_findings(files(spark, sf_dir).unionByName(texts(spark, sf_dir)))
    issues = found.select(F.col("path").alias("file"), F.col("rule_id").alias("category"), "severity", F.lit("rule_catalog").alias("detector"), F.lit("line rule").alias("description"), "line_number", F.col("line").alias("location"), F.lit("medium").alias("confidence"))
    kept = G.deduplicated(G.normalised(issues), [F.col("file"), F.col("line_number")])
    return G.severity_summary(kept)


def code_line_findings(spark, sf_dir):
    """Every line rule over the files."""
    return L.line_findings(files(spark, sf_dir)).select("payload_id", "line_number", "rule_id", "severity")


def doc_line_findings(spark, sf_dir):
    return L.line_findings(texts(spark, sf_dir)).select("payload_id", "line_number", "rule_id", "severity")


def file_rule_findings(spark, sf_dir):
    """P-08, P-10, P-12, parts of P-03 and P-04."""
    return L.file_findings(files(spark, sf_dir)).select("payload_id", "rule_id", "severity")


def framework_signals(spark, sf_dir):
    """P-05, P-07: matches of the framework rules by signal."""
    names = [r.id for r in L.LINE_RULES if r.id.split(".")[0] in ("fastapi", "flask", "django", "sqlalchemy", "messaging")]
    rules = tuple(r for r in L.LINE_RULES if r.id in names)
    return L.line_findings(files(spark, sf_dir), rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("payload_id").alias("n_files"))


def header_claims(spark, sf_dir):
    return L.header_claims(texts(spark, sf_dir)).select("payload_id", "line_number")


def missing_guard_window(spark, sf_dir):
    """JS008."""
    return L.fetch_without_handler(files(spark, sf_dir))


def overclaim_lines(spark, sf_dir):
    """HON001 over the documents."""
    return L.overclaims(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))


GREP = [
    L.GrepPattern("limit", r"\blimit\b", include=("src/**", "app/**"), exclude=("**/generators/**",)),
    L.GrepPattern("return", r"return \[", severity="LOW", include=("*.js", "*.ts")),
]


def grep_audit(spark, sf_dir):
    """P-01, P-02, T-01: two patterns with globs, the first 500 matches in order."""
    return L.grep(files(spark, sf_dir), GREP, 500).select("payload_id", "line_number", "rule_id")


def line_explode(spark, sf_dir):
    """X-01: lines and characters of each file."""
    return explode_lines(files(spark, sf_dir)).groupBy("payload_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_number").alias("last_line"))


def overlap_chunks(spark, sf_dir):
    """X-04: chunks of 400 characters that overlap by 50."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.inline(chunks_of(F.col("text"), 400, 50)))
    return rows.select("doc_id", "chunk_no", "start", F.md5("text").alias("digest"))


def module_names(spark, sf_dir):
    """X-02."""
    return files(spark, sf_dir).where(F.col("path").endswith(".py")).select("payload_id", module_name(F.col("path")).alias("module"))


def large_modules(spark, sf_dir):
    """A-30, T-05: the twenty files with most lines."""
    return line_explode(spark, sf_dir).select("payload_id", "n_lines").orderBy(F.desc("n_lines"), "payload_id").limit(20)


def link_extract(spark, sf_dir):
    """X-11: targets of the links of the documents, in all four forms."""
    return I.links(table(spark, sf_dir, "documents"), ["doc_id"], "text").groupBy("doc_id", "target").agg(F.count(F.lit(1)).alias("n"))


def magic_numbers(spark, sf_dir):
    """A-12, A-16: comment density, marker count, number lines and long lines of each file, against the mean comment density of all."""
    rows = explode_lines(files(spark, sf_dir))
    one = rows.groupBy("payload_id").agg(
        F.avg(F.col("line").rlike(r"^\s*(#|//)").cast("double")).alias("comment_density"),
        F.least(F.count_if(F.col("line").rlike(r"\b(TODO|FIXME)\b")), F.lit(10)).alias("markers"),
        F.avg(F.col("line").rlike(r"\b[0-9]{2,}\b").cast("double")).alias("number_lines"),
    )
    mean = one.agg(F.avg("comment_density").alias("corpus_density"))  # one row
    return one.crossJoin(F.broadcast(mean)).select("payload_id", "comment_density", "markers", "number_lines", (F.col("comment_density") > F.col("corpus_density")).alias("above_mean"))


_LINES = "string_split_regex(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"


def _lines_sql(source: str) -> str:
    return f"lines AS (SELECT * EXCLUDE (parts), parts[line_number] AS line FROM (SELECT * EXCLUDE (content, all_parts), content AS whole, unnest(generate_series(1, len(all_parts) - CASE WHEN all_parts[-1] = '' THEN 1 ELSE 0 END)) AS line_number, all_parts AS parts FROM (SELECT *, {_LINES} AS all_parts FROM {source} WHERE length(content) > 0)))"


_FILES = "(SELECT payload_id, path, content FROM file_payloads)"
_BOTH = "(SELECT payload_id, path, content FROM file_payloads UNION ALL SELECT doc_id, 'docs/' || doc_id || '.md', text FROM documents)"
_TEXTS = "(SELECT doc_id AS payload_id, 'docs/' || doc_id || '.md' AS path, text AS content FROM documents)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck_pattern(p: str) -> str:
    # RE2 has no lookahead; the one rule that uses it is two tests in SQL.
    return _q(p)


def _rule_sql(r: L.LineRule) -> str:
    if r.id == "fastapi.html_response.dynamic_html":
        c = "regexp_matches(line, '(?i)htmlresponse') AND regexp_matches(line, '(?i)f\"|f''|request\\.')"
    else:
        c = f"regexp_matches(line, {_duck_pattern(r.pattern)})"
    if r.unless:
        c += f" AND NOT regexp_matches(line, {_q(r.unless)})"
    for text, has, lacks in (("path", r.path, r.path_lacks), ("whole", r.file_has, r.file_lacks)):
        c += f" AND regexp_matches({text}, {_q(has)})" if has else ""
        c += f" AND NOT regexp_matches({text}, {_q(lacks)})" if lacks else ""
    if r.skip_tests:
        c += " AND NOT regexp_matches(path, '^(tests/|test_)')"
    if r.suffixes:
        c += " AND lower(regexp_extract(path, '[^/.](\\.[^./]+)$', 1)) IN (" + ", ".join(_q(s) for s in r.suffixes) + ")"
    return f"SELECT payload_id, line_number, {_q(r.id)} AS rule_id, {_q(r.severity)} AS severity, path, line FROM lines WHERE {c}"


_ALL = " UNION ALL ".join(_rule_sql(r) for r in L.LINE_RULES)


def _file_sql(r: L.FileRule) -> str:
    c = f"regexp_matches(path, {_q(r.path)})"
    found = lambda p: f"regexp_matches(coalesce(content, ''), {_q(p)})"
    if r.path_lacks:
        c += f" AND NOT regexp_matches(path, {_q(r.path_lacks)})"
    if r.either:
        c += f" AND ({found(r.has)} OR NOT {found(r.lacks)})"
    else:
        c += "".join(f" AND {found(p)}" for p in (r.has, r.also) if p) + (f" AND NOT {found(r.lacks)}" if r.lacks else "")
    return f"SELECT payload_id, {_q(r.id)} AS rule_id, {_q(r.severity)} AS severity FROM file_payloads WHERE {c}"


_OVER = r"(?i)\b(guarantee[ds]?|complete(ly)?|fully|all (bugs|issues|findings)|never|100 ?%|production[- ]ready)\b"
_LIMIT = r"(?i)\b(limit(s|ed|ation|ations)?|except|unless|but|however|may|might|approximate(ly)?|not)\b"
ORACLE = {
    "severity_summary": f"WITH {_lines_sql(_BOTH)}, found AS ({_ALL}), kept AS (SELECT DISTINCT path, rule_id, severity, line_number, trim(line, E' \t\r\n\x0b\x0c') AS l FROM found) SELECT count(*) FILTER (severity='CRITICAL') AS CRITICAL, count(*) FILTER (severity='HIGH') AS HIGH, count(*) FILTER (severity='MEDIUM') AS MEDIUM, count(*) FILTER (severity='LOW') AS LOW, count(*) AS TOTAL, 0::BIGINT AS FAILED_FILES, 0::BIGINT AS SKIPPED_FILES FROM kept",
    "code_line_findings": f"WITH {_lines_sql(_FILES)} SELECT payload_id, line_number::INT AS line_number, rule_id, severity FROM ({_ALL})",
    "doc_line_findings": f"WITH {_lines_sql(_TEXTS)} SELECT payload_id, line_number::INT AS line_number, rule_id, severity FROM ({_ALL})",
    "file_rule_findings": " UNION ALL ".join(_file_sql(r) for r in L.FILE_RULES),
    "framework_signals": f"WITH {_lines_sql(_FILES)} SELECT rule_id, count(*) AS n, count(DISTINCT payload_id) AS n_files FROM ({_ALL}) WHERE split_part(rule_id, '.', 1) IN ('fastapi','flask','django','sqlalchemy','messaging') GROUP BY 1",
    "header_claims": f"WITH {_lines_sql(_TEXTS)} SELECT payload_id, line_number::INT AS line_number FROM lines WHERE line_number <= 30 AND (line_number <= 5 OR regexp_matches(line, '^\\s*(#|//|/\\*|\\*|--|\"\"\"|'''''')')) AND contains(lower(line), 'complete') AND contains(lower(line), 'final') AND contains(lower(line), 'production')",
    "missing_guard_window": f"WITH {_lines_sql(_FILES)}, w AS (SELECT *, max((contains(line, '.catch(') OR contains(line, 'try'))::INT) OVER (PARTITION BY payload_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS g FROM lines WHERE regexp_matches(lower(path), '\\.(js|ts|jsx|tsx)$')) SELECT payload_id, line_number::INT AS line_number FROM w WHERE contains(line, 'fetch(') AND g = 0",
    "overclaim_lines": f"WITH {_lines_sql('(SELECT doc_id, text AS content FROM documents)')}, w AS (SELECT *, max(regexp_matches(line, {_q(_LIMIT)})::INT) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS g FROM lines) SELECT doc_id, line_number::INT AS line_number FROM w WHERE regexp_matches(line, {_q(_OVER)}) AND g = 0",
    "grep_audit": f"WITH {_lines_sql(_FILES)} SELECT payload_id, line_number::INT AS line_number, rule_id FROM (SELECT *, 0 AS no, 'GREP001:limit' AS rule_id FROM lines WHERE regexp_matches(line, '\\blimit\\b') AND (starts_with(path, 'src/') OR starts_with(path, 'app/')) AND NOT contains('/' || path, '/generators/') UNION ALL SELECT *, 1, 'GREP001:return' FROM lines WHERE regexp_matches(line, 'return \\[') AND regexp_matches(path, '\\.(js|ts)$')) ORDER BY path, no, line_number, payload_id LIMIT 500",
    "line_explode": f"WITH {_lines_sql(_FILES)} SELECT payload_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, max(line_number)::INT AS last_line FROM lines GROUP BY 1",
    "overlap_chunks": "SELECT doc_id, c::INT AS chunk_no, (c * 350)::INT AS start, md5(substr(text, c * 350 + 1, 400)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(ceil((length(text) - 400) / 350.0), 0)::INT)) AS c FROM documents WHERE text IS NOT NULL)",
    "module_names": "SELECT payload_id, array_to_string(list_filter(string_split(regexp_replace(path, '\\.[^./]*$', ''), '/'), lambda p: p <> '__init__' AND p <> ''), '.') AS module FROM file_payloads WHERE ends_with(path, '.py')",
    "large_modules": f"WITH {_lines_sql(_FILES)} SELECT payload_id, count(*) AS n_lines FROM lines GROUP BY 1 ORDER BY n_lines DESC, payload_id LIMIT 20",
    "link_extract": "SELECT doc_id, target, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, {_q(p)}, 1)) AS target FROM documents" for p in I.LINKS) + ") GROUP BY 1, 2",
    "magic_numbers": f"WITH {_lines_sql(_FILES)}, one AS (SELECT payload_id, avg(regexp_matches(line, '^\\s*(#|//)')::DOUBLE) AS comment_density, least(count(*) FILTER (regexp_matches(line, '\\b(TODO|FIXME)\\b')), 10) AS markers, avg(regexp_matches(line, '\\b[0-9]{{2,}}\\b')::DOUBLE) AS number_lines FROM lines GROUP BY 1) SELECT *, comment_density > (SELECT avg(comment_density) FROM one) AS above_mean FROM one",
}
QUERIES = {name: globals()[name] for name in ORACLE}
