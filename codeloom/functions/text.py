"""Lines, chunks and names of files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the line ends that count, longest first.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines_of(content: Column) -> Column:
    """Array of the lines of a text, without a last empty one."""
    # The text is split once: the lambda binds the result.
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.get(F.transform(F.array(F.split(content, LINE_ENDS)), whole), F.lit(0))


def explode_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with ``line_number`` from 1 and ``line``; ``content`` is dropped. Null and empty texts give no rows."""
    keep = [c for c in df.columns if c != content]
    return df.where(F.length(content) > 0).select(*keep, F.posexplode(lines_of(F.col(content))).alias("_pos", "line")).select(*keep, (F.col("_pos") + 1).alias("line_number"), "line")


def chunks_of(content: Column, size: int, overlap: int) -> Column:
    """Array of structs ``(chunk_no, start, text)``: pieces of ``size`` characters, each ``overlap`` into the one before.

    A null text gives null, an empty one a single empty chunk. ``size`` must exceed ``overlap``.
    """
    if size <= overlap:
        raise ValueError("size must exceed overlap")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(content) - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_no"), (i * step).alias("start"), F.substring(content, i * step + 1, F.lit(size)).alias("text")))


def module_name(path: Column) -> Column:
    """Dotted module of a relative path: no suffix, no ``__init__`` parts."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.array_join(F.filter(F.split(bare, "/"), lambda p: (p != "__init__") & (p != "")), ".")


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for names without one."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def rule_id(category: Column) -> Column:
    return F.substring_index(category, ":", 1)


def tail(text: Column, n: int) -> Column:
    """The last ``n`` characters."""
    return F.right(text, F.lit(n))


def annotation_escape(text: Column) -> Column:
    """Escapes of a CI annotation; the percent sign comes first."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for raw, code in (("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def html_escape(text: Column) -> Column:
    out = text
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def device_stem(name: Column) -> Column:
    """Upper-case stem of a file name with superscript digits folded, to compare with reserved device names."""
    return F.upper(F.translate(F.regexp_extract(name, r"^([^.]*)", 1), "¹²³", "123"))
