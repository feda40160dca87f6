"""Source files that don't parse in the language their suffix stands for.

Each file is cut into tokens and the whole token stream is run through the parsing tables
of a bundled grammar (``parse_tables``). The first token that no rule can take is the first
unrecoverable error. Python and JSON files that the tables refuse are read once more by the
interpreter's own parser, so that a construct the grammar doesn't know isn't reported.
"""

from __future__ import annotations

import ast
import json
import sys
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import lexers
from codeloom.llm.parse_tables import Parser, compile_grammar
from codeloom.operators.python_facts import deep
from codeloom.session import spread

# Suffix -> language.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".json": "json", ".yml": "yaml", ".yaml": "yaml"}
_GRAMMAR: dict[str, tuple[str, Callable[[str], lexers.Stream]]] = {
    "python": ("python.g", lexers.lex_python),
    "javascript": ("javascript.g", lexers.lex_javascript),
    "typescript": ("typescript.g", lexers.lex_javascript),
    "java": ("java.g", lexers.lex_java),
    "go": ("go.g", lexers.lex_go),
    "json": ("json.g", lexers.lex_json),
    "yaml": ("yaml.g", lexers.lex_yaml),
}
_DEPTH = 200_000  # nesting the tables may follow
_tables: dict[str, Parser] = {}


def _parser(language: str) -> Parser:
    if language not in _tables:
        _tables[language] = compile_grammar(_GRAMMAR[language][0])
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _DEPTH))
    return _tables[language]


def _accepted(language: str, text: str) -> bool:
    """Whether the interpreter's own parser takes a text that the tables refused."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return True
        if language == "json":
            json.loads(text, parse_constant=lambda token: json.loads(""))
            return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return False


def first_error(language: str, text: str) -> tuple[int, str] | None:
    """(line from 1, what was met) of the first unrecoverable error; None if the text is valid.

    An empty or blank text is a valid script in every language but Go and JSON.
    """
    if not text.strip("﻿ \t\r\n\f"):
        return (1, "empty") if language in ("go", "json") else None
    parser = _parser(language)
    try:
        kinds, breaks, lines = _GRAMMAR[language][1](text)
        with deep():
            at = parser.error(kinds, breaks)
        found = None if at < 0 else (lines[min(at, len(lines) - 1)], kinds[min(at, len(kinds) - 1)])
    except lexers.LexError as e:
        found = (e.line, e.what)
    except RecursionError:
        found = (1, "nesting")
    return None if found is None or _accepted(language, text) else found


def language_of(path: Column) -> Column:
    """The language a path's suffix stands for; null for other files."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for s, language in LANGUAGES.items():
        out = F.when(suffix == s, F.lit(language)).otherwise(out)
    return out


CHECKED = "payload_id bigint, project_root string, language string, error_line bigint, error string"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines, whats = [], []
        for language, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            e = first_error(language, text)
            lines.append(e and e[0])
            whats.append(e and e[1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lines, pa.int64()), pa.array(whats, pa.string())], ["payload_id", "project_root", "language", "error_line", "error"])


def checked_files(df: DataFrame) -> DataFrame:
    """One row per file of a known language with content: ``CHECKED``; ``error_line`` is null for valid files.

    Files with null content or another suffix give no row; repeated rows count each for
    itself; ids and roots may be null. Whole texts are read, one batch at a time. No shuffle.
    """
    rows = df.select(F.col("payload_id").cast("bigint").alias("payload_id"), F.col("project_root").cast("string").alias("project_root"), language_of(F.col("path")).alias("language"), F.col("content").cast("string").alias("content"))
    return spread(rows.where("language IS NOT NULL AND content IS NOT NULL"), "payload_id").mapInArrow(_check, CHECKED)


def error_rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their rate for each project and language."""
    return checked.groupBy("project_root", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("error_line").alias("n_invalid")).withColumn("rate", F.col("n_invalid") / F.col("n_files"))
