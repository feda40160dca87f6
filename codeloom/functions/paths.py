"""Safety and portability of relative paths. Unicode forms need Python; the rest is columns."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that look like a slash, a dot or a colon; reserved device names.
LIKE_SLASH = "⁄∕⧵⧸⧹﹨／＼∖"
LIKE_DOT = "․‥…．。﹒‧"
LIKE_COLON = "：﹕꞉∶ː"
DEVICES = frozenset(["CON", "PRN", "AUX", "NUL", "CLOCK$", "CONIN$", "CONOUT$", *[f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]])
_FOLD = str.maketrans("¹²³", "123")
LONGEST, LONGEST_PART = 240, 120


def decode(text: str, rounds: int = 8) -> str:
    """Percent-decoded until nothing changes, at most ``rounds`` times."""
    for _ in range(rounds):
        plain = unquote(text)
        if plain == text:
            break
        text = plain
    return text


def collision_key(path: str) -> str:
    """Paths with equal keys can't live together on a portable file system."""
    return unicodedata.normalize("NFKC", decode(path)).casefold()


def _part_reason(part: str) -> str | None:
    folded = unicodedata.normalize("NFKC", part)
    tests = (
        (part in ("", ".", ".."), "dot part"),
        (part != part.strip(), "blank at the end of a part"),
        (part.startswith("~"), "home part"),
        (folded in (".", ".."), "folded dot part"),
        ("/" in folded or "\\" in folded, "folded separator"),
        (":" in folded, "folded colon"),
        (folded.rstrip(" .").split(".", 1)[0].upper().translate(_FOLD) in DEVICES, "device name"),
        (folded.endswith((" ", ".")), "blank or dot at the end"),
        (len(part) > LONGEST_PART, "part too long"),
    )
    return next((reason for hit, reason in tests if hit), None)


def unsafe_reason(path: str | None) -> str | None:
    """Why a relative path isn't safe everywhere; None if it is. A null path is empty."""
    path = path or ""
    plain = decode(path)
    if plain != path:
        if any(re.search(r"[/\\]", decode(p)) for p in re.split(r"[/\\]", path)):
            return "encoded separator"
        inner = unsafe_reason(plain)
        if inner:
            return f"encoded: {inner}"
    categories = {unicodedata.category(c) for c in path}
    tests = (
        (not path, "empty"),
        (path != path.strip(), "blank at the ends"),
        ("  " in path, "double blank"),
        (len(path) > LONGEST, "too long"),
        (path.startswith("~"), "home"),
        (path.startswith("/") or "\\" in path, "absolute or backslash"),
        (any(c in LIKE_SLASH for c in path), "like a slash"),
        (any(c in LIKE_DOT for c in path), "like a dot"),
        (any(c in LIKE_COLON for c in path), "like a colon"),
        (bool(categories & {"Cc", "Cf"}), "control character"),
        (bool(categories & {"Co", "Cn", "Cs", "Zl", "Zp"}), "not portable"),
        (":" in path, "colon"),
    )
    found = next((reason for hit, reason in tests if hit), None)
    return found or next((r for r in map(_part_reason, path.split("/")) if r), None)


def unsafe_path(path: Column) -> Column:
    """P-15: ``unsafe_reason`` as a column (an Arrow batch at a time)."""
    fn = F.pandas_udf(lambda s: s.map(unsafe_reason, na_action=None), StringType())
    return fn(path)


def path_key(path: Column) -> Column:
    """F-06: ``collision_key`` as a column."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else collision_key(p))

    return F.pandas_udf(run, StringType())(path)


def evidence_path_problem(ref: Column) -> Column:
    """P-16: why a reference isn't a plain relative path; null if it is. All in the JVM."""
    t = F.btrim(ref)
    return (
        F.when(ref.isNull() | (t == ""), "not a text")
        .when(t != ref, "blank at the ends")
        .when(ref.rlike(r"[\x00-\x1f\x7f]"), "control character")
        .when(ref.rlike(r"(?i)^(https?|ftp|file|s3|gs):|^//"), "remote")
        .when(ref.startswith("~"), "home")
        .when(ref.rlike(r"^[A-Za-z]:[\\/]"), "drive")
        .when(ref.rlike(r"^[/\\]"), "absolute")
        .when(F.contains(ref, F.lit("\\")), "backslash")
        .when(ref.rlike(r"(^|/)\.\.(/|$)"), "traversal")
        .when(ref.rlike(r"(^|/)\s|\s(/|$)"), "blank in a part")
    )
