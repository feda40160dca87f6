"""Column expressions that several operators share. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
CONFIDENCES = ("low", "medium", "high")
_BLANKS = " \t\r\n\x0b\x0c"


def null_safe_hash(salt: int, cols: Sequence[Column]) -> Column:
    """64-bit hash of a row in which a null differs from every value and its place counts."""
    parts: list[Column] = [F.lit(salt)]
    for c in cols:
        parts += [F.isnull(c), c]
    return F.xxhash64(*parts)


def strip(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def severity_name(c: Column) -> Column:
    """One of the four names; everything else, null included, is MEDIUM."""
    return F.when(c.isin(*SEVERITIES), c).otherwise(F.lit("MEDIUM"))


def confidence_name(c: Column) -> Column:
    """low, medium or high in lower case; everything else, null included, is medium."""
    low = F.lower(c)
    return F.when(low.isin(*CONFIDENCES), low).otherwise(F.lit("medium"))


def relative_posix(path: Column, root: Column | None = None) -> Column:
    """``/`` between parts, no leading ``./``, no ``root`` in front."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if root is not None:
        prefix = F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
        p = F.when(F.startswith(p, prefix) & (F.length(prefix) > 1), F.substr(p, F.length(prefix) + 1)).otherwise(p)
    p = F.regexp_replace(p, r"/(?:\.?/)+", "/")
    return F.regexp_replace(p, r"^(?:\./)+", "")


def fingerprint(file: Column, category: Column, detector: Column, line: Column, location: Column, description: Column) -> Column:
    """First 16 hex digits of SHA-256 over six parts joined by line feeds; null and line 0 are empty parts."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (file, category, detector)]
    number = F.coalesce(F.when(line != 0, line.cast("string")), F.lit(""))
    rest = [F.coalesce(c, F.lit("")) for c in (location, description)]
    return F.substring(F.sha2(F.concat_ws("\n", *text, number, *rest), 256), 1, 16)
