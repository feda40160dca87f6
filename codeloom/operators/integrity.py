"""Manifests against trees, hygiene of texts, structured files, links and archives."""

from __future__ import annotations

import configparser
import io
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import path_key
from codeloom.functions.text import suffix


def manifest_diff(manifest: DataFrame, tree: DataFrame, keys: list[str]) -> DataFrame:
    """J-10: ``*keys, rule_id`` of entries that are missing, of another size or digest, and of files without entry.

    Both sides have ``*keys, size, sha256``. Digests are compared in lower case; a null size
    or digest isn't compared. Repeated keys on either side are compared each with each. If
    the tree has ``is_link``, an entry that is a link there is MANIFEST006 and nothing else.
    """
    link = F.coalesce("is_link", F.lit(False)) if "is_link" in tree.columns else F.lit(False)
    m = manifest.select(*keys, F.col("size").alias("_ms"), F.lower("sha256").alias("_mh"), F.lit(True).alias("_m"))
    t = tree.select(*keys, F.col("size").alias("_ts"), F.lower("sha256").alias("_th"), link.alias("_link"), F.lit(True).alias("_t"))
    j = m.join(t, keys, "full")
    found = F.array_compact(
        F.array(
            F.when(F.col("_t").isNull(), "MANIFEST002"),
            F.when(F.col("_m").isNull(), "MANIFEST005"),
            F.when(F.col("_m") & F.col("_link"), "MANIFEST006"),
            F.when(~F.col("_link") & (F.col("_ms") != F.col("_ts")), "MANIFEST003"),
            F.when(~F.col("_link") & (F.col("_mh") != F.col("_th")), "MANIFEST004"),
        )
    )
    return j.select(*keys, F.explode(found).alias("rule_id"))


def parse_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """SRC-13: manifest lines as ``line_no``-free rows ``value, sha256, path, size, error``; a bad line keeps its text and an error."""
    rx = r"^([0-9a-fA-F]{64})  (.+?)  size=(\d+)$"
    ok = F.col(value).rlike(rx)
    return lines.where(F.btrim(value) != "").select(value, F.when(ok, F.regexp_extract(value, rx, 1)).alias("sha256"), F.when(ok, F.regexp_extract(value, rx, 2)).alias("path"), F.when(ok, F.regexp_extract(value, rx, 3).cast("bigint")).alias("size"), F.when(~ok, "MANIFEST001").alias("error"))


def manifest_lines(files: DataFrame) -> DataFrame:
    """SNK-10: manifest text lines ``value`` from ``path, sha256, size``."""
    return files.select(F.format_string("%s  %s  size=%d", "sha256", "path", "size").alias("value"), "path")


def path_collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """A-10: ``*keys, path, other``: paths whose key another, different path has; ``other`` is the one before it by name.

    Copies of a path are folded first, so a group holds distinct spellings only.
    """
    p = df.where("path IS NOT NULL").select(*keys, "path").distinct().withColumn("_k", path_key(F.col("path")))
    groups = p.groupBy(*keys, "_k").agg(F.array_sort(F.collect_set("path")).alias("_all")).where(F.size("_all") > 1)
    return groups.select(*keys, F.posexplode("_all").alias("_i", "path"), "_all").where("_i > 0").select(*keys, "path", F.element_at("_all", F.col("_i")).alias("other"))


# Suffixes of texts, of texts that end with a line end, and of those without a byte-order mark; how binary files begin.
TEXTS = (".py", ".md", ".txt", ".json", ".toml", ".xml", ".yaml", ".yml", ".html", ".css", ".js", ".ts", ".tsx", ".jsx", ".rst", ".ini", ".cfg")
ENDED = (".py", ".md", ".rst", ".txt", ".json", ".toml", ".xml", ".yaml", ".yml")
UNMARKED = (".py", ".json", ".toml", ".xml", ".yaml", ".yml")
BINARY_TEXT, BINARY_BYTES = ("\x7fELF", "PK\x03\x04", "%PDF"), (b"\x7fELF", b"PK\x03\x04", b"\x89PNG", b"\xff\xd8\xff", b"%PDF")


def hygiene(df: DataFrame, keys: list[str]) -> DataFrame:
    """P-13: ``*keys, rule_id`` of texts with bad encoding, a byte-order mark, binary content, replacement or null characters, mixed or bare line ends, no last line end, or nothing.

    ``df`` has ``path`` and ``content``; with a binary column ``data`` invalid UTF-8
    (ENCODING001) and binary beginnings are looked for in the bytes. Null contents are empty.
    """
    c, s = F.coalesce("content", F.lit("")), suffix(F.coalesce("path", F.lit("")))
    full = F.length(c) > 0
    if "data" in df.columns:
        binary = sum((F.coalesce(F.startswith("data", F.lit(x)), F.lit(False)).cast("int") for x in BINARY_BYTES), F.lit(0)) > 0
        invalid = F.col("data").isNotNull() & F.try_validate_utf8(F.col("data").cast("string")).isNull()
    else:
        binary = sum((F.startswith(c, F.lit(x)).cast("int") for x in BINARY_TEXT), F.lit(0)) > 0
        invalid = F.lit(False)
    found = F.array_compact(
        F.array(
            F.when(invalid, "ENCODING001"),
            F.when(F.contains(c, F.lit("\ufffd")), "ENCODING002"),
            F.when(F.startswith(c, F.lit("\ufeff")) & s.isin(*UNMARKED), "ENCODING003"),
            F.when(F.contains(c, F.lit("\x00")), "CORRUPT001"),
            F.when(binary & s.isin(*TEXTS), "CORRUPT002"),
            F.when(F.contains(c, F.lit("\r\n")) & F.replace(c, F.lit("\r\n"), F.lit("")).contains("\n"), "LINES001"),
            F.when(F.replace(c, F.lit("\r\n"), F.lit("")).contains("\r"), "LINES002"),
            F.when(full & ~F.endswith(c, F.lit("\n")) & s.isin(*ENDED), "TRUNC001"),
            F.when(~full, "EMPTY001"),
        )
    )
    return df.select(*keys, F.explode(found).alias("rule_id"))


def _yaml(text: str) -> str | None:
    """STRUCT004 a tab at the start of a line, STRUCT005 brackets that don't balance in a line,
    STRUCT009 a key twice in an inline map, STRUCT007 a key twice in one block.

    Open blocks are a stack of (indent, keys); a list item opens a new block at the indent of its
    first key, and a line of less indent closes the deeper ones.
    """
    blocks: list[tuple[int, set[str]]] = []
    for line in text.splitlines():
        if line.startswith("\t"):
            return "STRUCT004"
        if line.count("[") != line.count("]") or line.count("{") != line.count("}"):
            return "STRUCT005"
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        for inner in re.findall(r"\{([^{}]*)\}", body):
            keys = [k.strip(" '\"") for k in re.findall(r"(?:^|,)\s*([^,:]+):", inner)]
            if len(keys) != len(set(keys)):
                return "STRUCT009"
        indent = len(line) - len(line.lstrip(" "))
        fresh = False
        while body.startswith("- "):
            blocks = [b for b in blocks if b[0] <= indent]
            rest = body[2:].lstrip(" ")
            indent, body, fresh = indent + len(body) - len(rest), rest, True
        m = re.match(r"([^\s:]+)\s*:(?:\s|$)", body)
        if not m:
            continue
        blocks = [b for b in blocks if b[0] < indent or (b[0] == indent and not fresh)]
        if not blocks or blocks[-1][0] < indent:
            blocks.append((indent, set()))
        if m[1] in blocks[-1][1]:
            return "STRUCT007"
        blocks[-1][1].add(m[1])
    return None


def _structured(suffix_: str, text: str) -> str | None:
    if suffix_ in (".yml", ".yaml"):
        return _yaml(text)
    try:
        if suffix_ == ".toml":
            tomllib.loads(text)
        elif suffix_ in (".xml", ".svg"):
            if "<!ENTITY" in text:
                return "STRUCT006"
            ET.fromstring(text)
        elif suffix_ in (".ini", ".cfg"):
            configparser.ConfigParser(interpolation=None).read_string(text)
    except tomllib.TOMLDecodeError:
        return "STRUCT002"
    except ET.ParseError:
        return "STRUCT003"
    except configparser.Error:
        return "STRUCT008"
    return None


def structured_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """P-14, W-09: JSON (also repeated keys), TOML, XML, INI and YAML files that can't be read: ``*keys, rule_id``.

    JSON is checked in the JVM; only the other formats go through Python.
    """
    rows = df.where("content IS NOT NULL").withColumn("_s", suffix(F.col("path")))
    json_bad = rows.where((F.col("_s") == ".json") & F.try_parse_json("content").isNull()).select(*keys, F.lit("STRUCT001").alias("rule_id"))
    check = F.pandas_udf(lambda s, t: pd.Series([_structured(a, b) for a, b in zip(s, t, strict=True)], dtype=object), "string")
    other = rows.where(F.col("_s").isin(".toml", ".xml", ".svg", ".ini", ".cfg", ".yml", ".yaml")).withColumn("rule_id", check("_s", "content")).where("rule_id IS NOT NULL").select(*keys, "rule_id")
    return json_bad.unionByName(other)


def resolve(base: Column, target: Column) -> Column:
    """Path that a relative link target means from a file; ``..`` beyond the root stays as such."""
    bare = F.regexp_replace(target, r"[?#].*$", "")
    whole = F.when(F.startswith(bare, F.lit("/")), F.substr(bare, F.lit(2))).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), bare))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(stack, "/")


# Forms of links in Markdown and HTML.
LINKS = (r"\[[^\]\n]*\]\(<?([^)>\s]+)>?(?:\s+\"[^\"]*\")?\)", r"(?m)^\s{0,3}\[[^\]\n]+\]:\s*<?(\S+?)>?(?:\s|$)", r"(?i)(?:href|src)\s*=\s*[\"']([^\"']+)[\"']", r"(?i)(?:href|src)\s*=\s*([^\s\"'>]+)")


def links(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """X-11: ``*keys, target`` of all links of the four forms, in one pass."""
    every = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in LINKS]))
    return df.where(F.col(text).isNotNull()).select(*keys, F.explode(every).alias("target"))


def unresolved_links(found: DataFrame, files: DataFrame) -> DataFrame:
    """J-17: local links whose target no file has. ``found``: ``project_root, path, target``; ``files``: ``project_root, path``."""
    local = found.where(~F.col("target").rlike(r"^(?:[a-zA-Z][\w+.\-]*:|#|//)"))
    r = local.withColumn("_to", resolve(F.col("path"), F.col("target")))
    return r.join(files.select("project_root", F.col("path").alias("_to")).distinct(), ["project_root", "_to"], "left_anti").select("project_root", "path", "target")


MEMBERS = "archive string, member string, size bigint, packed bigint, crc bigint, is_dir boolean, is_link boolean, error string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64()), ("is_dir", pa.bool_()), ("is_link", pa.bool_()), ("error", pa.string())])


def zip_members(archives: DataFrame) -> DataFrame:
    """SRC-14: ``MEMBERS`` of zip files read as ``binaryFile``; an archive that can't be read is one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        bad = z.testzip()
                        rows += [(path, i.filename, i.file_size, i.compress_size, i.CRC, i.is_dir(), (i.external_attr >> 28) == 0xA, "crc" if i.filename == bad else None) for i in z.infolist()]
                except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                    rows.append((path, None, None, None, None, None, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW.field(k).type) for k in range(8)], schema=_ARROW)

    return archives.select("path", "content").mapInArrow(run, MEMBERS)


def archive_findings(members: DataFrame) -> DataFrame:
    """P-17, A-29: ``archive, member, rule_id``: unsafe, repeated, colliding, linked or bomb-like members."""
    from codeloom.functions.paths import unsafe_path

    m = members.where("member IS NOT NULL").withColumn("_why", unsafe_path(F.regexp_replace("member", "/$", "")))
    ratio = F.try_divide("size", "packed")
    single = m.select("archive", "member", F.explode(F.array_compact(F.array(F.when(F.col("_why").isNotNull(), "ARCHIVE006"), F.when(F.col("is_link"), "ARCHIVE007"), F.when((ratio > 1000) & (F.col("size") > 10_000_000), "ARCHIVE013")))).alias("rule_id"))
    twice = m.groupBy("archive", "member").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("archive", "member", F.lit("ARCHIVE011").alias("rule_id"))
    whole = m.groupBy("archive").agg(F.sum("size").alias("s"), F.sum("packed").alias("p")).where((F.try_divide("s", "p") > 500) & (F.col("s") > 50_000_000)).select("archive", F.lit(None).cast("string").alias("member"), F.lit("ARCHIVE012").alias("rule_id"))
    roots = m.groupBy("archive").agg(F.count_distinct(F.substring_index("member", "/", 1)).alias("n")).where("n <> 1").select("archive", F.lit(None).cast("string").alias("member"), F.lit("ARCHIVE002").alias("rule_id"))
    clash = path_collisions(m.select("archive", F.col("member").alias("path")), ["archive"]).select("archive", F.col("path").alias("member"), F.lit("ARCHIVE015").alias("rule_id"))
    broken = members.where("error IS NOT NULL").select("archive", "member", F.lit("ARCHIVE003").alias("rule_id"))
    return single.unionByName(twice).unionByName(whole).unionByName(roots).unionByName(clash).unionByName(broken)
