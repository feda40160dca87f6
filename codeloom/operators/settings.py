"""Settings in code against documented ones, database markers, dependencies, owners, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import strip
from codeloom.functions.text import explode_lines
from codeloom.operators.line_rules import MIGRATION_PATH

# How code reads an environment variable, and signs of database backends.
ENV_USE = r"(?:os\.environ(?:\.get\(|\[)|os\.getenv\(|process\.env[.\[]|System\.getenv\(|os\.Getenv\(|\$\{)\s*[\"']?([A-Z][A-Z0-9_]{2,})"
BACKENDS = {
    "sqlite": r"(?i)(sqlite(\+aiosqlite)?://|sqlite3\b|aiosqlite\b|pysqlite\b|\bsqlite\b|[\w./-]+\.sqlite3?\b|[\w./-]+\.db\b)",
    "postgres": r"(?i)(postgresql(\+asyncpg|\+psycopg2?)?://|postgres://|\bpostgresql\b|\bpostgres\b|\basyncpg\b|\bpsycopg2?\b)",
    "mysql": r"(?i)(mysql(\+pymysql)?://|\bmysql\b|\bmariadb\b|\bpymysql\b)",
}
DB_ENV = r"(?i)^(DATABASE_URL|DB_URL|DB_URI|DB_DSN|DB_ENGINE|DB_BACKEND|DB_DRIVER|SQLALCHEMY_DATABASE_URI|POSTGRES(QL)?_DSN|POSTGRES(QL)?_URL|SQLITE(_URL|_PATH|_DB)?|DATABASE_ENGINE)$"
# Files whose databases are those of a running system.
ENV_NAMES = (".env", ".env.example", ".env.sample", "env.example", "env.sample")
CONFIG_NAMES = (*ENV_NAMES, "settings.py", "config.py", "database.py", "db.py", "alembic.ini", "pyproject.toml", "docker-compose.yml", "docker-compose.yaml")
_NOT_RUNTIME, _EVEN_SO = r"(?i)(test|fixture|sample|example|migration|alembic|docs?/|readme|changelog)", r"prod|production|deploy|config|settings"
_RUNTIME = r"settings|config|database|db|\.env|docker|compose|systemd|deploy|runtime|wiring"
_PRODUCTION = r"(?i)(prod|production|release|deploy|docker|compose|systemd|gunicorn|uvicorn)"
# Names of secrets, and defaults that are dangerous in production.
SECRET_NAME, DANGEROUS = r"(?i)(token|secret|password|passwd|api[_-]?key|private[_-]?key)", r"(?i)(changeme|change-me|secret|password|token|debug|sqlite|localhost|127\.0\.0\.1)"
ENV_DOCS = (".env.example", ".env.sample", "env.example", "env.sample")


def env_used(corpus: DataFrame) -> DataFrame:
    """``project_root, name``: variables that code reads, distinct."""
    return corpus.where("content IS NOT NULL").select("project_root", F.explode(F.regexp_extract_all("content", F.lit(ENV_USE), F.lit(1))).alias("name")).distinct()


def env_documented(corpus: DataFrame) -> DataFrame:
    """SRC-08, F-13: ``project_root, name, value``: lines of the files that document settings."""
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/\\]+)$", 1)
    rows = explode_lines(corpus.where(name.isin(*ENV_DOCS)).select("project_root", "content"))
    rx = r"^\s*(?:export\s+)?([A-Z][A-Z0-9_]{2,})\s*=\s*(.*)$"
    return rows.where(F.col("line").rlike(rx)).select("project_root", F.regexp_extract("line", rx, 1).alias("name"), F.regexp_extract("line", rx, 2).alias("value"))


def env_contract(used: DataFrame, documented: DataFrame) -> DataFrame:
    """DF-23, J-09, U-02: ``project_root, name, rule_id``.

    CFG001 used but not documented, CFG002 documented but not used, CFG003 a documented
    secret has a value, CFG004 a default is dangerous in production; projects that document
    nothing are left out. ``documented`` has ``value``; without it only the first two are found.
    """
    values = documented.withColumn("_v", F.regexp_replace(F.btrim("value"), r"^[\"']+|[\"']+$", "")) if "value" in documented.columns else documented.withColumn("_v", F.lit(""))
    secret = F.col("name").rlike(SECRET_NAME) & (F.col("_v") != "") & ~F.col("_v").startswith("<")
    risky = F.col("_v").rlike(DANGEROUS) & ~F.col("name").isin("DEBUG", "ENV", "APP_ENV")
    defaults = values.select("project_root", "name", F.explode(F.array_compact(F.array(F.when(secret, "CFG003"), F.when(risky, "CFG004")))).alias("rule_id")).distinct()
    d = documented.select("project_root", "name").distinct()
    with_docs = d.select("project_root").distinct()
    j = used.withColumn("_u", F.lit(True)).join(d.withColumn("_d", F.lit(True)), ["project_root", "name"], "full").join(with_docs, "project_root", "left_semi")
    return j.select("project_root", "name", F.when(F.col("_d").isNull(), "CFG001").when(F.col("_u").isNull(), "CFG002").alias("rule_id")).where("rule_id IS NOT NULL").unionByName(defaults)


def db_markers(corpus: DataFrame, key: str = "payload_id") -> DataFrame:
    """DF-24, U-06, F-14: ``project_root, path, key, backend, line_number, line, env, source`` of lines that name a database, each once; blank lines and comments don't count.

    ``env`` is the database variable that the line sets, if it sets one.
    """
    rows = explode_lines(corpus.select(key, "project_root", "path", "content")).withColumn("line", strip(F.col("line"))).where("line <> '' AND NOT startswith(line, '#')")
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(rx), F.lit(b)) for b, rx in BACKENDS.items()]))
    name = F.regexp_replace(strip(F.regexp_extract("line", r"^(export )?([^=]*)=", 2)), r"^[\"']+|[\"']+$", "")
    env = F.when(name.rlike(DB_ENV), name)
    source = F.when(env.isNotNull(), "database_env_contract").when(F.col("line").rlike(r"create_engine|DATABASE|DB_|SQLALCHEMY"), "database_runtime_code").otherwise("free_text")
    return rows.select(key, "project_root", "path", "line_number", "line", env.alias("env"), source.alias("source"), F.explode(hits).alias("backend"))


def runtime_config(path: Column) -> Column:
    """Whether a file sets up a running system."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(low, r"([^/]+)$", 1)
    beside = low.rlike(_NOT_RUNTIME) & ~low.rlike(_EVEN_SO)
    return name.isin(*ENV_NAMES) | (~beside & (name.isin(*CONFIG_NAMES) | low.rlike(_RUNTIME)))


def db_findings(markers: DataFrame) -> DataFrame:
    """DF-24: ``project_root, path, line_number, rule_id, severity``.

    DB001 a file names several backends (HIGH where it sets up a running system), DB002 a
    project's running system names both SQLite and Postgres, DB003 SQLite in a set-up for
    production, DB004 database variables of one file name different backends.
    """
    m = markers.withColumn("_run", runtime_config(F.col("path")))
    none = F.lit(None).cast("int").alias("line_number")
    mixed = m.groupBy("project_root", "path").agg(F.count_distinct("backend").alias("n"), F.bool_or("_run").alias("_run")).where("n > 1")
    one = mixed.select("project_root", "path", none, F.lit("DB001").alias("rule_id"), F.when(F.col("_run"), "HIGH").otherwise("MEDIUM").alias("severity"))
    run = m.where("_run")
    both = run.groupBy("project_root").agg(F.bool_or(F.col("backend") == "sqlite").alias("a"), F.bool_or(F.col("backend") == "postgres").alias("b")).where("a AND b")
    two = both.select("project_root", F.lit("<db-consistency>").alias("path"), none, F.lit("DB002").alias("rule_id"), F.lit("HIGH").alias("severity"))
    three = run.where((F.col("backend") == "sqlite") & (F.col("path").rlike(_PRODUCTION) | F.col("line").rlike(_PRODUCTION))).select("project_root", "path", "line_number", F.lit("DB003").alias("rule_id"), F.lit("HIGH").alias("severity")).distinct()
    envs = run.where("env IS NOT NULL").groupBy("project_root", "path").agg(F.count_distinct("env").alias("e"), F.count_distinct("backend").alias("b")).where("e > 1 AND b > 1")
    four = envs.select("project_root", "path", none, F.lit("DB004").alias("rule_id"), F.lit("HIGH").alias("severity"))
    return one.unionByName(two).unionByName(three).unionByName(four)


# Files in which a project sets up a database, and how.
_DB_SETUP_FILE = r"(?i)(\.(py|toml|yaml|yml|json|ini)$|(^|/)[^/]*\.env$)"
_DB_SETUP = r"(?i)\b(database_url|postgres_dsn|db_engine)\b\s*[:=]|(sqlite|postgresql)://"


def migration_findings(corpus: DataFrame) -> DataFrame:
    """J-11, MIG001 and MIG010: ``project_root, path, rule_id``: a project sets up a database and has no migrations; a migration whose revision an earlier one by path has."""
    path, text = F.coalesce("path", F.lit("")), F.coalesce("content", F.lit(""))
    moves = corpus.where(path.rlike(MIGRATION_PATH)).select("project_root", "path", text.alias("content"))
    tests = path.rlike(r"(^|/)tests?/|(^|/)test_[^/]*$")
    setups = corpus.where(path.rlike(_DB_SETUP_FILE) & ~tests & text.rlike(_DB_SETUP)).select("project_root").distinct()
    lone = setups.join(moves.select("project_root").distinct(), "project_root", "left_anti").select("project_root", F.lit(None).cast("string").alias("path"), F.lit("MIG001").alias("rule_id"))
    said, named = F.regexp_extract("content", r"revision\s*=\s*['\"]([^'\"]+)", 1), F.regexp_extract("path", r"(?:^|/)(\d{4,}|[a-f0-9]{8,})[^/]*$", 1)
    revisions = moves.select("project_root", "path", F.when(said != "", said).when(named != "", named).alias("_r")).where("_r IS NOT NULL").distinct()
    first = revisions.groupBy("project_root", "_r").agg(F.min("path").alias("_first"))
    again = revisions.join(first, ["project_root", "_r"]).where("path > _first").select("project_root", "path", F.lit("MIG010").alias("rule_id"))
    return lone.unionByName(again)


def mixed_backends(markers: DataFrame) -> DataFrame:
    """A-15: ``project_root, path, backends, n_lines`` of files that name more than one kind of database."""
    g = markers.groupBy("project_root", "path").agg(F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"), F.count(F.lit(1)).alias("n_lines"))
    return g.where(F.contains("backends", F.lit(",")))


def supply_lines(lines: DataFrame) -> DataFrame:
    """P-09: ``line, rule_id`` of requirement lines: from a URL, without version, or with an empty one."""
    t = F.btrim("line")
    rows = lines.where((t != "") & ~t.rlike(r"^[#\-]"))
    found = F.array_compact(F.array(F.when(t.rlike(r"git\+|https?://"), "SUPPLY020"), F.when(~t.contains("==") & ~t.contains(" @ "), "SUPPLY010"), F.when(t.rlike(r"==\s*\*|>=\s*0"), "SUPPLY011")))
    return rows.select(*lines.columns, F.explode(found).alias("rule_id"))


def supply_files(corpus: DataFrame) -> DataFrame:
    """P-09: ``project_root, path, rule_id, detail`` of dependency files.

    SUPPLY001 a project without any at its root, SUPPLY012 a range in pyproject, SUPPLY030
    ranges without a lock file, SUPPLY040 and SUPPLY041 ranges and addresses in package files.
    """
    path = F.coalesce("path", F.lit(""))
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    at_root = corpus.groupBy("project_root").agg(F.bool_or(path.isin("requirements.txt", "pyproject.toml", "package.json")).alias("_any"), F.bool_or(path.isin("requirements.txt", "requirements.lock", "uv.lock", "poetry.lock", "Pipfile.lock")).alias("_lock"))
    none = at_root.where("NOT _any").select("project_root", F.lit(None).cast("string").alias("path"), F.lit("SUPPLY001").alias("rule_id"), F.lit("").alias("detail"))
    py = corpus.where((name == "pyproject.toml") & F.col("content").isNotNull())
    entry = F.regexp_replace(F.btrim("line"), r"^[\",]+|[\",]+$", "")
    lines = explode_lines(py.select("project_root", "path", "content")).where(F.col("line").rlike(r"^\s*['\"][A-Za-z0-9_.-]+"))
    wide = lines.where(entry.rlike(r"[<>~]=|>") & ~entry.contains("==")).select("project_root", "path", F.lit("SUPPLY012").alias("rule_id"), entry.alias("detail"))
    open_ = py.where(~F.contains("content", F.lit("dependencies = []"))).join(at_root.where("NOT _lock").select("project_root"), "project_root", "left_semi").select("project_root", "path", F.lit("SUPPLY030").alias("rule_id"), F.lit("").alias("detail"))
    js = corpus.where((name == "package.json") & F.col("content").isNotNull())
    sections = F.array(*[F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>") for s in ("dependencies", "devDependencies")])
    specs = js.select("project_root", "path", F.explode(sections).alias("m")).select("project_root", "path", F.explode("m").alias("detail", "spec"))
    rule = F.when(F.col("spec").rlike(r"^[\^~>*]"), "SUPPLY040").when(F.col("spec").rlike(r"^(https?://|git\+)"), "SUPPLY041")
    npm = specs.select("project_root", "path", rule.alias("rule_id"), "detail").where("rule_id IS NOT NULL")
    return none.unionByName(wide).unionByName(open_).unionByName(npm)


def import_root(requirement):
    """F-16: name of a requirement without extras, version and marker, in import form."""
    return F.lower(F.replace(F.regexp_extract(requirement, r"^\s*([A-Za-z0-9_.\-]+)", 1), F.lit("-"), F.lit("_")))


def owner_conflicts(inline: DataFrame, codeowners: DataFrame) -> DataFrame:
    """J-18: ``path, owners, listed`` where the owners a file names share none with those of the longest prefix that covers it.

    ``inline``: ``path, owners``; ``codeowners``: ``pattern, owners``. A prefix is matched by
    joining on every prefix of the path, so it is an equi-join.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    c = codeowners.select(F.regexp_replace(F.regexp_replace("pattern", r"^/", ""), r"/?\**$", "").alias("_p"), F.col("owners").alias("listed"))
    j = inline.withColumn("_p", F.explode(prefixes)).join(c, "_p")
    best = j.groupBy("path", "owners").agg(F.max_by("listed", F.length("_p")).alias("listed"))
    return best.where(~F.arrays_overlap("owners", "listed"))


def repeated_versions(deps: DataFrame, keys: list[str]) -> DataFrame:
    """A-34, A-13: ``*keys, name, n``: names with more than one specification."""
    return deps.groupBy(*keys, "name").agg(F.count_distinct("spec").alias("n")).where("n > 1")


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """J-15, J-16, J-21, J-25: required rows without a counterpart. Null keys match nothing."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")
