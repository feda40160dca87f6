"""Manifests, paths, hygiene, settings and markers over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.columns import relative_posix
from codeloom.functions.paths import evidence_path_problem, unsafe_path
from codeloom.operators import integrity as I
from codeloom.operators import line_rules as L
from codeloom.operators import settings as S
from codeloom.session import table


def _files(spark, sf_dir):
    return table(spark, sf_dir, "file_payloads").select("payload_id", "project_root", "path", "content")


def _tree(spark, sf_dir):
    """The last scan of each path."""
    p = table(spark, sf_dir, "file_payloads").select("project_root", relative_posix(F.col("path"), F.col("project_root")).alias("path"), F.octet_length("content").cast("bigint").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "scanned_at", "payload_id")
    return p.groupBy("project_root", "path").agg(F.max_by(F.struct("size", "sha256"), F.struct("scanned_at", "payload_id")).alias("s")).select("project_root", "path", "s.*")


def _manifest(spark, sf_dir):
    """The last entry of each path."""
    e = table(spark, sf_dir, "manifest_entries").select("project_root", relative_posix(F.col("path"), F.col("project_root")).alias("path"), "size", "sha256", "written_at", "entry_id")
    return e.groupBy("project_root", "path").agg(F.max_by(F.struct("size", "sha256"), F.struct("written_at", "entry_id")).alias("s")).select("project_root", "path", "s.*")


def manifest_diff(spark, sf_dir):
    """J-10, F-03: the last manifest entries against the last scan."""
    return I.manifest_diff(_manifest(spark, sf_dir), _tree(spark, sf_dir), ["project_root", "path"])


def manifest_text(spark, sf_dir):
    """SNK-10 and back (SRC-13): lines that parse again."""
    lines = I.manifest_lines(_tree(spark, sf_dir).where("size IS NOT NULL"))
    return I.parse_manifest(lines.select("value")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def text_hygiene(spark, sf_dir):
    """P-13."""
    return I.hygiene(_files(spark, sf_dir), ["payload_id"])


def structured_errors(spark, sf_dir):
    """P-14."""
    return I.structured_errors(_files(spark, sf_dir), ["payload_id"])


def path_collisions(spark, sf_dir):
    """A-10 over the manifest paths as written."""
    return I.path_collisions(table(spark, sf_dir, "manifest_entries"), ["project_root"])


def unsafe_paths(spark, sf_dir):
    """P-15: reasons of the manifest paths as written."""
    return table(spark, sf_dir, "manifest_entries").select(unsafe_path(F.col("path")).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def evidence_paths(spark, sf_dir):
    """P-16 over the paths that manifests and Issues name."""
    p = table(spark, sf_dir, "issue_snapshots").select(F.col("file").alias("ref")).unionByName(table(spark, sf_dir, "file_payloads").select(F.col("path").alias("ref")))
    return p.select(evidence_path_problem(F.col("ref")).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def unresolved_links(spark, sf_dir):
    """J-17: links of the documents against the scanned files of their project."""
    docs = table(spark, sf_dir, "documents").select("project_root", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return I.unresolved_links(I.links(docs, ["project_root", "path"], "text"), _files(spark, sf_dir)).groupBy("project_root", "path", "target").agg(F.count(F.lit(1)).alias("n"))


def env_used(spark, sf_dir):
    return S.env_used(_files(spark, sf_dir))


def env_contract(spark, sf_dir):
    """DF-23, J-09."""
    f = _files(spark, sf_dir)
    return S.env_contract(S.env_used(f), S.env_documented(f))


def db_markers(spark, sf_dir):
    """DF-24, U-06."""
    return S.db_markers(_files(spark, sf_dir)).groupBy("backend", "source").agg(F.count(F.lit(1)).alias("n"))


def db_findings(spark, sf_dir):
    """DF-24: DB001 to DB004."""
    return S.db_findings(S.db_markers(_files(spark, sf_dir)))


def migration_findings(spark, sf_dir):
    """J-11: MIG001, MIG010."""
    return S.migration_findings(_files(spark, sf_dir))


def supply_files(spark, sf_dir):
    """P-09 over the dependency files."""
    return S.supply_files(_files(spark, sf_dir))


def mixed_backends(spark, sf_dir):
    """A-15."""
    return S.mixed_backends(S.db_markers(_files(spark, sf_dir)))


def supply_chain(spark, sf_dir):
    """P-09: requirement lines made from the packages: pinned, open or from a URL by size."""
    k = table(spark, sf_dir, "known_packages")
    line = F.when(F.col("size") % 3 == 0, F.concat("pkg_name", F.lit("=="), "pkg_version")).when(F.col("size") % 3 == 1, F.concat("pkg_name", F.lit(">="), "pkg_version")).otherwise(F.concat(F.lit("git+https://x.example/"), "pkg_name"))
    return S.supply_lines(k.select("pkg_name", line.alias("line"))).select("pkg_name", "rule_id")


def release_repeats(spark, sf_dir):
    """A-34, A-13: manifest paths with more than one digest over the releases."""
    e = table(spark, sf_dir, "manifest_entries").select("project_root", F.col("path").alias("name"), F.lower("sha256").alias("spec"))
    return S.repeated_versions(e, ["project_root"])


def changed_files(spark, sf_dir):
    """J-23, SRC-19: Issues of the last report that lie in files scanned in the last thirty days."""
    p = table(spark, sf_dir, "file_payloads")
    last = p.agg(F.max("scanned_at").alias("_last"))  # one row
    recent = p.crossJoin(F.broadcast(last)).where(F.col("scanned_at") >= F.col("_last") - F.expr("INTERVAL 30 DAYS")).select("project_root", F.col("path").alias("file")).distinct()
    return table(spark, sf_dir, "issue_snapshots").join(recent, ["project_root", "file"], "left_semi").select("row_id")


def missing_payloads(spark, sf_dir):
    """J-15: manifest paths without a scanned file."""
    return S.missing(_manifest(spark, sf_dir).select("project_root", "path"), _tree(spark, sf_dir), ["project_root", "path"])


# The files of a project for each of six kinds, which break the rules beside them.
GATES = (
    ((".env.example", "DATABASE_URL=postgres://x\nSQLITE_PATH=a.db\n"), ("requirements.txt", "")),
    (("deploy/run.py", "x = 'sqlite:///a'\n"),),
    (("migrations/a.py", "revision = 'r1'\n"), ("migrations/b.py", "revision = 'r1'\n"), ("pyproject.toml", 'dependencies = [\n  "a>=1",\n]\n')),
    (("package.json", '{"dependencies":{"x":"^1","y":"git+ssh://h"}}'),),
    (("a.py", "# bypass review\n"), ("Dockerfile", "USER app\nUSER root\nHEALTHCHECK x\n"), ("requirements.txt", "")),
    ((".env.example", "API_TOKEN=abc\nHOST_NAME=localhost\n"), ("a.py", "os.getenv('NEW_ONE')\n"), ("requirements.txt", "")),
)
_BROKEN = ((0, "DB001"), (0, "DB002"), (0, "DB004"), (0, "CFG002"), (0, "CFG002"), (1, "DB003"), (1, "MIG001"), (1, "SUPPLY001"), (2, "MIG010"), (2, "SUPPLY012"), (2, "SUPPLY030"), (3, "SUPPLY040"), (3, "SUPPLY041"), (4, "OWN010"), (4, "DEPLOY012"), (5, "CFG001"), (5, "CFG002"), (5, "CFG002"), (5, "CFG003"), (5, "CFG004"))


def gate_findings(spark, sf_dir):
    """DF-23, DF-24, J-11, P-08 to P-10, P-12 over projects made from the parts; SQL counts the parts."""
    kinds = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for p, t in files]) for files in GATES])
    files = F.inline(F.get(kinds, (F.col("p_size") % len(GATES)).cast("int")))
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload_id"), F.col("p_partkey").cast("string").alias("project_root"), files)
    found = [S.db_findings(S.db_markers(c)), S.migration_findings(c), S.supply_files(c), S.env_contract(S.env_used(c), S.env_documented(c)), L.file_findings(c)]
    rules = found[0].select("rule_id")
    for df in found[1:]:
        rules = rules.unionByName(df.select("rule_id"))
    return rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def _rel(col: str) -> str:
    root = "rtrim(project_root, '/') || '/'"
    plain = f"replace({col}, '\\', '/')"
    return f"regexp_replace(regexp_replace(CASE WHEN starts_with({plain}, {root}) THEN substr({plain}, length({root}) + 1) ELSE {plain} END, '/(\\.?/)+', '/', 'g'), '^(\\./)+', '')"


_SIDES = f"""m AS (SELECT project_root, path, arg_max({{'size': size, 'sha': lower(sha256)}}, (written_at, entry_id)) AS s FROM (SELECT project_root, {_rel('path')} AS path, size, sha256, written_at, entry_id FROM manifest_entries) GROUP BY 1, 2),
t AS (SELECT project_root, path, arg_max({{'size': size, 'sha': sha}}, (scanned_at, payload_id)) AS s FROM (SELECT project_root, {_rel('path')} AS path, octet_length(encode(content)) AS size, sha256(content) AS sha, scanned_at, payload_id FROM file_payloads) GROUP BY 1, 2)"""
_L = "unnest(string_split_regex(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'))"
_HITS = " UNION ALL ".join(f"SELECT *, '{b}' AS backend FROM l WHERE regexp_matches(line, '{rx}')" for b, rx in S.BACKENDS.items())
_PROD = "(?i)prod|production|release|deploy|docker|compose|systemd|gunicorn|uvicorn"
_ENVNAME = "regexp_replace(trim(regexp_extract(line, '^(export )?([^=]*)=', 2)), '^[\"'']+|[\"'']+$', '', 'g')"
_DBL = f"""SELECT *, CASE WHEN env IS NOT NULL THEN 'database_env_contract' WHEN regexp_matches(line, 'create_engine|DATABASE|DB_|SQLALCHEMY') THEN 'database_runtime_code' ELSE 'free_text' END AS source,
 name IN ('.env', '.env.example', '.env.sample', 'env.example', 'env.sample') OR NOT (regexp_matches(low, 'test|fixture|sample|example|migration|alembic|docs?/|readme|changelog') AND NOT regexp_matches(low, 'prod|deploy|config|settings'))
   AND (name IN ('settings.py', 'config.py', 'database.py', 'db.py', 'alembic.ini', 'pyproject.toml', 'docker-compose.yml', 'docker-compose.yaml') OR regexp_matches(low, 'settings|config|database|db|\\.env|docker|compose|systemd|deploy|runtime|wiring')) AS runs
 FROM (SELECT *, regexp_extract(low, '([^/]+)$', 1) AS name, CASE WHEN regexp_matches({_ENVNAME}, '(?i)^(DATABASE_URL|DB_URL|DB_URI|DB_DSN|DB_ENGINE|DB_BACKEND|DB_DRIVER|SQLALCHEMY_DATABASE_URI|POSTGRES(QL)?_DSN|POSTGRES(QL)?_URL|SQLITE(_URL|_PATH|_DB)?|DATABASE_ENGINE)$') THEN {_ENVNAME} END AS env
  FROM (SELECT project_root, path, lower(replace(path, '\\', '/')) AS low, i::INT AS line_number, trim(parts[i], E' \\t\\r\\n\\x0b\\x0c') AS line FROM (SELECT project_root, path, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT *, string_split_regex(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS parts FROM file_payloads))) WHERE line <> '' AND NOT starts_with(line, '#'))"""
_ENVD = f"SELECT DISTINCT project_root, regexp_extract(line, '^\\s*(?:export\\s+)?([A-Z][A-Z0-9_]{{2,}})\\s*=\\s*(.*)$', 1) AS name, regexp_replace(trim(regexp_extract(line, '^\\s*(?:export\\s+)?([A-Z][A-Z0-9_]{{2,}})\\s*=\\s*(.*)$', 2)), '^[\"'']+|[\"'']+$', '', 'g') AS value FROM (SELECT project_root, {_L} AS line FROM file_payloads WHERE regexp_extract(path, '([^/\\\\]+)$', 1) IN ('.env.example', '.env.sample', 'env.example', 'env.sample')) WHERE regexp_matches(line, '^\\s*(?:export\\s+)?[A-Z][A-Z0-9_]{{2,}}\\s*=')"
_USED = "SELECT DISTINCT project_root, unnest(regexp_extract_all(content, '" + S.ENV_USE.replace("'", "''") + "', 1)) AS name FROM file_payloads"
ORACLE = {
    "gate_findings": f"SELECT rule_id, count(*) AS n FROM part JOIN (VALUES {', '.join(map(str, _BROKEN))}) t(k, rule_id) ON p_size % {len(GATES)} = k GROUP BY 1",
    "manifest_diff": f"WITH {_SIDES}, j AS (SELECT coalesce(m.project_root, t.project_root) AS project_root, coalesce(m.path, t.path) AS path, m.project_root IS NOT NULL AS hm, t.project_root IS NOT NULL AS ht, m.s AS ms, t.s AS ts FROM m FULL JOIN t ON m.project_root = t.project_root AND m.path = t.path) SELECT project_root, path, 'MANIFEST002' AS rule_id FROM j WHERE NOT ht UNION ALL SELECT project_root, path, 'MANIFEST005' FROM j WHERE NOT hm UNION ALL SELECT project_root, path, 'MANIFEST003' FROM j WHERE ms.size <> ts.size UNION ALL SELECT project_root, path, 'MANIFEST004' FROM j WHERE ms.sha <> ts.sha",
    "manifest_text": f"WITH {_SIDES} SELECT NULL::VARCHAR AS error, count(*) AS n FROM t WHERE s.size IS NOT NULL",
    "text_hygiene": "SELECT payload_id, rule_id FROM (SELECT payload_id, unnest([CASE WHEN starts_with(c, chr(65279)) AND s IN ('.py','.json','.toml','.xml','.yaml','.yml') THEN 'ENCODING003' END, CASE WHEN contains(c, chr(65533)) THEN 'ENCODING002' END, CASE WHEN (starts_with(c, chr(127) || 'ELF') OR starts_with(c, 'PK' || chr(3) || chr(4)) OR starts_with(c, '%PDF')) AND s IN ('.py','.md','.txt','.json','.toml','.xml','.yaml','.yml','.html','.css','.js','.ts','.tsx','.jsx','.rst','.ini','.cfg') THEN 'CORRUPT002' END, CASE WHEN contains(c, chr(13) || chr(10)) AND contains(replace(c, chr(13) || chr(10), ''), chr(10)) THEN 'LINES001' END, CASE WHEN contains(replace(c, chr(13) || chr(10), ''), chr(13)) THEN 'LINES002' END, CASE WHEN c <> '' AND NOT ends_with(c, chr(10)) AND s IN ('.py','.md','.rst','.txt','.json','.toml','.xml','.yaml','.yml') THEN 'TRUNC001' END, CASE WHEN c = '' THEN 'EMPTY001' END]) AS rule_id FROM (SELECT payload_id, coalesce(content, '') AS c, lower(regexp_extract(path, '[^/.](\\.[^./]+)$', 1)) AS s FROM file_payloads)) WHERE rule_id IS NOT NULL",
    "evidence_paths": "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN ref IS NULL OR trim(ref) = '' THEN 'not a text' WHEN trim(ref) <> ref THEN 'blank at the ends' WHEN regexp_matches(ref, '[\\x00-\\x1f\\x7f]') THEN 'control character' WHEN regexp_matches(ref, '(?i)^(https?|ftp|file|s3|gs):|^//') THEN 'remote' WHEN starts_with(ref, '~') THEN 'home' WHEN regexp_matches(ref, '^[A-Za-z]:[\\\\/]') THEN 'drive' WHEN regexp_matches(ref, '^[/\\\\]') THEN 'absolute' WHEN contains(ref, '\\') THEN 'backslash' WHEN regexp_matches(ref, '(^|/)\\.\\.(/|$)') THEN 'traversal' WHEN regexp_matches(ref, '(^|/)\\s|\\s(/|$)') THEN 'blank in a part' END AS problem FROM (SELECT file AS ref FROM issue_snapshots UNION ALL SELECT path FROM file_payloads)) GROUP BY 1",
    "env_used": _USED,
    "env_contract": f"WITH u AS ({_USED}), v AS ({_ENVD}), d AS (SELECT DISTINCT project_root, name FROM v) SELECT DISTINCT project_root, name, 'CFG003' AS rule_id FROM v WHERE regexp_matches(name, '(?i)token|secret|password|passwd|api[_-]?key|private[_-]?key') AND value <> '' AND NOT starts_with(value, '<') UNION ALL SELECT DISTINCT project_root, name, 'CFG004' FROM v WHERE regexp_matches(value, '(?i)changeme|change-me|secret|password|token|debug|sqlite|localhost|127\\.0\\.0\\.1') AND name NOT IN ('DEBUG', 'ENV', 'APP_ENV') UNION ALL SELECT coalesce(u.project_root, d.project_root) AS project_root, coalesce(u.name, d.name) AS name, CASE WHEN d.name IS NULL THEN 'CFG001' ELSE 'CFG002' END AS rule_id FROM u FULL JOIN d ON u.project_root = d.project_root AND u.name = d.name WHERE (u.name IS NULL OR d.name IS NULL) AND coalesce(u.project_root, d.project_root) IN (SELECT project_root FROM d)",
    "db_markers": f"WITH l AS ({_DBL}) SELECT backend, source, count(*) AS n FROM ({_HITS}) GROUP BY 1, 2",
    "db_findings": f"WITH l AS ({_DBL}), m AS ({_HITS}), run AS (SELECT * FROM m WHERE runs) SELECT project_root, path, NULL::INT AS line_number, 'DB001' AS rule_id, CASE WHEN bool_or(runs) THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM m GROUP BY 1, 2 HAVING count(DISTINCT backend) > 1 UNION ALL SELECT project_root, '<db-consistency>', NULL, 'DB002', 'HIGH' FROM run GROUP BY 1 HAVING bool_or(backend = 'sqlite') AND bool_or(backend = 'postgres') UNION ALL SELECT DISTINCT project_root, path, line_number, 'DB003', 'HIGH' FROM run WHERE backend = 'sqlite' AND (regexp_matches(path, '{_PROD}') OR regexp_matches(line, '{_PROD}')) UNION ALL SELECT project_root, path, NULL, 'DB004', 'HIGH' FROM run WHERE env IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT env) > 1 AND count(DISTINCT backend) > 1",
    "mixed_backends": f"WITH l AS ({_DBL}) SELECT project_root, path, array_to_string(list_sort(list_distinct(list(backend))), ',') AS backends, count(*) AS n_lines FROM ({_HITS}) GROUP BY 1, 2 HAVING count(DISTINCT backend) > 1",
    "supply_chain": "SELECT pkg_name, 'SUPPLY010' AS rule_id FROM known_packages WHERE size % 3 > 0 UNION ALL SELECT pkg_name, 'SUPPLY020' FROM known_packages WHERE size % 3 = 2 UNION ALL SELECT pkg_name, 'SUPPLY011' FROM known_packages WHERE size % 3 = 1 AND starts_with(pkg_version, '0')",
    "release_repeats": "SELECT project_root, path AS name, count(DISTINCT lower(sha256)) AS n FROM manifest_entries GROUP BY 1, 2 HAVING count(DISTINCT lower(sha256)) > 1",
    "changed_files": "SELECT row_id FROM issue_snapshots i WHERE EXISTS (SELECT 1 FROM file_payloads p WHERE p.project_root = i.project_root AND p.path = i.file AND p.scanned_at >= (SELECT max(scanned_at) FROM file_payloads) - INTERVAL 30 DAY)",
    "missing_payloads": f"WITH {_SIDES} SELECT project_root, path FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.project_root = m.project_root AND t.path = m.path)",
}
QUERIES = {n: globals()[n] for n in [*ORACLE, "migration_findings", "supply_files", "structured_errors", "path_collisions", "unsafe_paths", "unresolved_links"]}
