"""Trees of files as rows, with the reasons for those that aren't read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import suffix

# Suffixes that are scanned, folders that are not, suffixes of binary files.
EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".md", ".txt", ".yml", ".yaml", ".toml", ".ini", ".cfg", ".json")
IGNORED = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "build", ".tox")
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".7z", ".exe", ".dll", ".so", ".dylib", ".pyc", ".woff", ".woff2", ".ttf", ".mp3", ".mp4", ".sqlite", ".db")
LARGEST = 2_000_000


def project_root(paths: list[str]) -> str:
    """SRC-03: the first path, or its folder if it is a file."""
    first = os.path.abspath(paths[0])
    return first if os.path.isdir(first) else os.path.dirname(first)


TREE = "path string, size bigint, modified timestamp, is_link boolean, data binary, error string"


def tree(spark: SparkSession, root: str, largest: int = LARGEST) -> DataFrame:
    """SRC-01, SRC-06: ``path`` (relative, POSIX), ``size``, ``modified``, ``is_link``, ``data`` of all files below a folder that all executors see.

    Spark's own file sources leave out names that begin with a dot or an underscore, package
    initialisers among them, so folders are walked in the tasks: the driver lists only the
    first levels, until there are enough folders to share out. Files beyond ``largest``
    bytes come without their data; links aren't followed and have none. A file that can't be
    read is a row with its ``error``.
    """
    units, level = [("", True)], 0
    while level < 3 and len(units) < 4 * spark.sparkContext.defaultParallelism:
        level += 1
        units = [x for u, folder in units for x in ([(os.path.join(u, e.name), e.is_dir(follow_symlinks=False)) for e in os.scandir(os.path.join(root, u))] if folder else [(u, False)])]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "size", "modified", "is_link", "data", "error"]
        types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_(), pa.binary(), pa.string()]
        for b in batches:
            for unit, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                found = ((d, f) for d, _, fs in os.walk(os.path.join(root, unit)) for f in sorted(fs)) if folder else [(os.path.join(root, os.path.dirname(unit)), os.path.basename(unit))]
                for d, f in found:
                    full = os.path.join(d, f)
                    rel, data = os.path.relpath(full, root).replace(os.sep, "/"), None
                    try:
                        st = os.lstat(full)
                        link = os.path.islink(full)
                        if not link and st.st_size <= largest:
                            with open(full, "rb") as h:
                                data = h.read()
                        rows.append((rel, st.st_size, datetime.fromtimestamp(st.st_mtime, UTC), link, data, None))
                    except OSError as e:
                        rows.append((rel, None, None, False, None, e.strerror or str(e)))
                    held += len(data or b"")
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(6)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(6)], names)

    if not units:
        return spark.createDataFrame([], TREE)
    return spark.createDataFrame(units, "unit string, folder boolean").repartition(max(1, min(len(units), 10_000))).mapInArrow(walk, TREE)


def object_tree(spark: SparkSession, root: str) -> DataFrame:
    """The same columns from an object store by Spark's ``binaryFile`` source, which leaves out hidden names."""
    base = root.rstrip("/") + "/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substr("path", F.locate(base, F.col("path")) + len(base))
    return df.select(F.try_url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(False).alias("is_link"), F.col("content").alias("data"), F.lit(None).cast("string").alias("error"))


def ignored(path: Column, folders: tuple[str, ...] = IGNORED) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def scanned(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, folders: tuple[str, ...] = IGNORED) -> DataFrame:
    """SRC-01: files by suffix outside ignored folders, each path once."""
    return files.where(suffix(F.col("path")).isin(*[e.lower() for e in extensions]) & ~ignored(F.col("path"), folders)).dropDuplicates(["path"])


def routed(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """SRC-02, SRC-04: adds ``content`` and ``status``: ``row``, ``failed`` for files that can't be read, or the reason of a skip: binary, link, large, encoding, blank."""
    text = F.try_validate_utf8(F.col("data").cast("string"))
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    status = F.when(failed, "failed").when(suffix(F.col("path")).isin(*BINARY), "binary").when(F.col("is_link"), "link").when(F.col("size") > largest, "large").when(text.isNull(), "encoding").when(text.rlike(r"^\s*$"), "blank").otherwise("row")
    return files.withColumn("status", status).withColumn("content", F.when(F.col("status") == "row", text)).drop("data")


def payloads(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(files with content, skips with their reason)."""
    r = routed(scanned(tree(spark, root), extensions))
    return r.where("status = 'row'").select(F.lit(root).alias("project_root"), "path", "size", "content"), r.where("status <> 'row'").select("path", F.col("status").alias("reason"))


def failure_issues(files: DataFrame) -> DataFrame:
    """SRC-04: a HIGH Issue for each file of a tree that can't be read."""
    return files.where("error IS NOT NULL").select(F.col("path").alias("file"), F.lit("Analyzer error").alias("category"), F.lit("HIGH").alias("severity"), F.lit("pipeline").alias("detector"), F.col("error").alias("description"), F.lit(None).cast("int").alias("line_number"), F.lit("high").alias("confidence"))


def first_files(files: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """T-02: (the first ``most`` files by path, one row ``truncated``): the budget of a call graph is a feature of it."""
    return files.orderBy("path").limit(most), files.agg((F.count(F.lit(1)) > most).alias("truncated"))


def text_files(files: DataFrame) -> DataFrame:
    """SRC-05: what a text search reads: text suffixes and files named without one."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.where(~ignored(F.col("path")) & (suffix(F.col("path")).isin(*EXTENSIONS, ".html", ".css", ".sh", ".sql") | name.rlike(r"^\.env") | name.isin("dockerfile", "makefile", "codeowners")))


def named(files: DataFrame, pattern: str) -> DataFrame:
    """SRC-07, SRC-08, SRC-21 to SRC-23: files whose path matches."""
    return files.where(F.col("path").rlike(pattern))


TESTS = r"(^|/)(test_[^/]*|[^/]*_test)\.py$"
MIGRATIONS = r"(^|/)(migrations|alembic/versions|versions)/[^/]+\.(py|sql)$"
DEPLOYMENT = r"(?i)(^|/)(dockerfile[^/]*|(docker-)?compose[^/]*\.ya?ml|[^/]+\.service|nginx[^/]*\.conf)$|(^|/)\.github/workflows/[^/]+\.ya?ml$"
ENV_CONTRACT = r"(^|/)\.env(\.example|\.sample|\.template)?$"


def synthetic_ring(spark: SparkSession, n: int) -> DataFrame:
    """SRC-29: ``n`` modules in a ring; each imports and calls the next."""
    nxt = (F.col("id") + 1) % n
    code = F.format_string("from mod_%d import run_%d\n\n\ndef run_%d(x):\n    return run_%d(x)\n", nxt, nxt, F.col("id"), nxt)
    return spark.range(n).select(F.col("id").alias("payload_id"), F.lit("/ring").alias("project_root"), F.format_string("mod_%d.py", "id").alias("path"), code.alias("content"))


def synthetic_copies(spark: SparkSession, n: int) -> DataFrame:
    """SRC-29: ``n`` equal modules that read a request argument."""
    code = "def clean(v):\n    return v.strip()\n\n\ndef view():\n    return clean(request.args.get('q'))\n"
    return spark.range(n).select(F.col("id").alias("payload_id"), F.lit("/copies").alias("project_root"), F.format_string("m%d.py", "id").alias("path"), F.lit(code).alias("content"))
