"""JavaScript and TypeScript: comments blanked, then rules over lines near each other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import explode_lines, suffix
from codeloom.operators.line_rules import SCRIPTS


def blank_comments(text: str) -> str:
    """The text with comments turned to blanks; columns and line breaks stay, strings are untouched."""
    out = list(text)
    i, n, quote = 0, len(text), ""
    while i < n:
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote or (c == "\n" and quote != "`"):
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c == "/" and i + 1 < n and text[i + 1] in "/*":
            end = text.find("\n" if text[i + 1] == "/" else "*/", i + 2)
            end = n if end < 0 else end + (0 if text[i + 1] == "/" else 2)
            for j in range(i, end):
                if out[j] not in "\r\n":
                    out[j] = " "
            i = end
            continue
        i += 1
    return "".join(out)


def without_comments(text: Column) -> Column:
    """X-03 as a column; an Arrow batch at a time. Null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else blank_comments(t))

    return F.pandas_udf(run, "string")(text)


# Sources, sinks and signs of the rules over scripts.
_PARAMS = r"new\s+URLSearchParams|URLSearchParams\(|location\.search"
_SOURCE = r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=.*(?:location\.search|URLSearchParams|\.searchParams\.get|localStorage\.getItem|sessionStorage\.getItem)"
_SINK = r"\.(?:innerHTML|outerHTML|insertAdjacentHTML)\s*(?:=|\()"


def structure_findings(corpus: DataFrame, key: str = "payload_id") -> DataFrame:
    """``key, line_number, rule_id`` of JSSTR001 to JSSTR007, over lines without comments.

    Proximity is a window over the lines of one file, several flags in one sort. For
    JSSTR007 the names in the sink lines and the assigned names of a file meet in one sort by
    file and name, in which the latest assignment so far is carried along (as-of), so no line
    meets every other line.
    """
    files = corpus.where(suffix(F.coalesce("path", F.lit(""))).isin(*SCRIPTS) & F.col("content").isNotNull())
    rows = explode_lines(files.select(key, without_comments(F.col("content")).alias("content")))
    w = Window.partitionBy(key).orderBy("line_number")
    has = lambda p: F.col("line").rlike(p)
    any_ = lambda c, a, b: F.max(c.cast("int")).over(w.rowsBetween(a, b)) == 1
    guard = any_(has(r"\b(?:event|e)\.origin\b|\borigin\b"), 0, 19) & any_(has(r"includes\s*\(|===|!==|Set\s*\(|allowedOrigins|trustedOrigins|ALLOWED_ORIGINS"), 0, 19)
    near = any_(has(_PARAMS), -14, 0)
    wide = any_(has(r"URLSearchParams|location\.search|\.searchParams\.get"), -14, 0)
    flagged = rows.withColumns({"_guard": guard, "_near": near, "_wide": wide})
    hits = F.array_compact(
        F.array(
            F.when(has(r"\.postMessage\s*\([^\n,]+,\s*['\"]\*['\"]"), "JSSTR001"),
            F.when(F.contains("line", F.lit("addEventListener")) & F.contains("line", F.lit("message")) & ~F.col("_guard"), "JSSTR002"),
            F.when(has(r"(?:window\.)?location(?:\.href|\.assign|\.replace)?\s*(?:=|\()") & F.col("_near"), "JSSTR003"),
            F.when(has(r"\b(?:setTimeout|setInterval)\s*\(\s*['\"]"), "JSSTR004"),
            F.when(has(r"\bwindow\.open\s*\(") & F.col("_wide"), "JSSTR005"),
            F.when(has(r"\bdocument\.domain\s*="), "JSSTR006"),
        )
    )
    plain = flagged.select(key, "line_number", F.explode(hits).alias("rule_id"))
    none = F.lit(None).cast("int")
    sources = rows.where(has(_SOURCE)).select(key, "line_number", F.regexp_extract("line", _SOURCE, 1).alias("_name"), F.col("line_number").alias("_src"))
    used = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))))
    sinks = rows.where(has(_SINK)).select(key, "line_number", used.alias("_name"), none.alias("_src"))
    upto = Window.partitionBy(key, "_name").orderBy("line_number", F.col("_src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = sources.unionByName(sinks).withColumn("_last", F.last("_src", ignorenulls=True).over(upto))
    latest = met.where(F.col("_src").isNull() & (F.col("line_number") - F.col("_last") <= 20))
    return plain.unionByName(latest.select(key, "line_number", F.lit("JSSTR007").alias("rule_id")).distinct())
