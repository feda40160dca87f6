"""Lists and registries that contradict themselves: elements as rows, then windows and aggregates."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.python_facts import parse

# Words in the name of a list that is read as a registry, and names of fields.
HINTS = ("route", "routes", "handler", "handlers", "registry", "registries", "policy", "policies", "permission", "permissions", "feature", "features", "capability", "capabilities", "plugin", "plugins", "command", "commands", "event", "events", "role", "roles", "rule", "rules", "dispatch", "mapping")
# Scalars that may repeat, pairs and fields of registries in scripts.
REPEATABLE = ("", " ", "```", None)
_PAIR = re.compile(r"[\[({,]\s*['\"]([/@\w:.-]+)['\"]\s*,")
_FIELD = re.compile(r"\b(id|name|key|route|path|command|event|role|capability)\s*:\s*['\"]([^'\"]+)['\"]")
_EFFECT = re.compile(r"effect\s*:\s*['\"](allow|deny)['\"]")
_NEAR = 200  # characters between two effects that are read together
ELEMENTS = "payload_id bigint, array_id string, idx int, kind string, key string, fields map<string,string>, line int"
_ARROW = pa.schema([("payload_id", pa.int64()), ("array_id", pa.string()), ("idx", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("line", pa.int32())])


def _fold(value) -> str:
    return " ".join(str(value).split()).casefold()


def _python_elements(text: str) -> list[tuple]:
    tree = parse(text)
    if isinstance(tree, str):
        return []
    out: list[tuple] = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.Assign, ast.AnnAssign)):
            continue
        names = " ".join(ast.unparse(t) for t in (node.targets if isinstance(node, ast.Assign) else [node.target])).lower()
        if not any(h in names for h in HINTS) or node.value is None:
            continue
        for sub in ast.walk(node.value):
            array = f"{sub.lineno if hasattr(sub, 'lineno') else 0}:{getattr(sub, 'col_offset', 0)}"
            if isinstance(sub, ast.Dict):
                for i, k in enumerate(sub.keys):
                    if isinstance(k, ast.Constant):
                        out.append((array, i, "pair", _fold(k.value), [], k.lineno))
            elif isinstance(sub, (ast.List, ast.Tuple, ast.Set)):
                for i, x in enumerate(sub.elts):
                    if isinstance(x, ast.Constant):
                        out.append((array, i, "scalar", None if x.value in REPEATABLE else _fold(x.value), [], x.lineno))
                    elif isinstance(x, ast.Dict):
                        fields = [(str(k.value), str(v.value)) for k, v in zip(x.keys, x.values, strict=True) if isinstance(k, ast.Constant) and isinstance(v, ast.Constant)]
                        out.append((array, i, "object", dict(fields).get("id") or dict(fields).get("name"), fields, x.lineno))
                    elif isinstance(x, (ast.Tuple, ast.List)) and x.elts and isinstance(x.elts[0], ast.Constant):
                        out.append((array, i, "pair", _fold(x.elts[0].value), [], x.lineno))
    return out


def _json_elements(text: str) -> list[tuple]:
    """Lists of a JSON text under their paths (X-12)."""
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return []
    out: list[tuple] = []
    todo = [("$", root)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}", x) for k, x in v.items() if isinstance(x, (dict, list))]
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    fields = [(k, str(y)) for k, y in x.items() if not isinstance(y, (dict, list)) and y is not None]
                    out.append((path, i, "object", dict(fields).get("id") or dict(fields).get("name"), fields, None))
                elif not isinstance(x, list):
                    out.append((path, i, "scalar", None if x in REPEATABLE else _fold(x), [], None))
                if isinstance(x, (dict, list)):
                    todo.append((f"{path}[{i}]", x))
    return out


def _script_elements(text: str) -> list[tuple]:
    """Pairs and identifying fields of a script's text, and effects that stand near their opposite."""
    line = lambda m: text.count("\n", 0, m.start()) + 1
    out = [("pairs", i, "script pair", _fold(m[1]), [], line(m)) for i, m in enumerate(_PAIR.finditer(text))]
    out += [(f"field {m[1]}", i, "script field", _fold(m[2]), [], line(m)) for i, m in enumerate(_FIELD.finditer(text))]
    effects = list(_EFFECT.finditer(text))
    clash = next((i for i, (a, b) in enumerate(zip(effects, effects[1:], strict=False), 1) if a[1] != b[1] and b.start() - a.end() <= _NEAR), None)
    return out + ([("effects", clash, "script clash", None, [], line(effects[clash]))] if clash else [])


def _elements(path: str, text: str) -> list[tuple]:
    name = path.lower()
    if name.endswith(".py"):
        return _python_elements(text)
    return _json_elements(text) if name.endswith(".json") else _script_elements(text)


def array_elements(corpus: DataFrame) -> DataFrame:
    """``ELEMENTS`` of registry-like literals in Python files, of all lists in JSON files and of the text of scripts. Unreadable files give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *e) for i, path, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for e in _elements(path, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW.field(k).type) for k in range(7)], schema=_ARROW)

    path = F.coalesce("path", F.lit(""))
    return corpus.where(F.lower(path).rlike(r"\.(py|json|js|ts|jsx|tsx)$") & F.col("content").isNotNull()).select(F.col("payload_id").cast("bigint"), path.alias("path"), "content").mapInArrow(run, ELEMENTS)


def ambiguities(elements: DataFrame) -> DataFrame:
    """DF-12, DF-13, A-07 to A-09, W-06: ``payload_id, array_id, idx, rule_id``.

    ARR001 repeated scalar, ARR002 repeated pair key, ARR003 repeated id, ARR004 a second
    effect on one subject, action and resource, ARR005 a specific entry after a wildcard of
    the same scope, ARR006 a pair's key again in a script, ARR008 a flag that flips between entries of one identity.
    """
    key = ["payload_id", "array_id"]
    w = Window.partitionBy(*key, "kind", "key").orderBy("idx")
    rule = F.when(F.col("kind") == "scalar", "ARR001").when(F.col("kind") == "pair", "ARR002").when(F.col("kind") == "script pair", "ARR006").otherwise("ARR003")
    twice = elements.where("key IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n > 1").select(*key, "idx", rule.alias("rule_id"))
    get = lambda *names: F.lower(F.coalesce(*[F.element_at("fields", F.lit(n)) for n in names], F.lit("<any>")))
    objects = elements.where("kind = 'object'").select(*key, "idx", get("subject", "role", "user").alias("who"), get("action", "method").alias("what"), get("resource", "path", "route").alias("where"), get("effect", "access").alias("effect"), "fields")
    effects = objects.where(F.col("effect").isin("allow", "deny")).groupBy(*key, "who", "what", "where", "effect").agg(F.min("idx").alias("i"))
    clash = effects.groupBy(*key, "who", "what", "where").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("idx")).where("n = 2").select(*key, "idx", F.lit("ARR004").alias("rule_id"))
    # A window and not a join: Spark takes the entries for far smaller than they are and would send them all through the driver.
    wild = F.col("where").isin("*", "/*", "**")
    first_wild = F.min(F.when(wild, F.col("idx"))).over(Window.partitionBy(*key, "who", "what"))
    shadow = objects.where(F.col("payload_id").isNotNull() & (F.col("where") != "<any>")).withColumn("_w", first_wild).where(~wild & (F.col("idx") > F.col("_w"))).select(*key, "idx", F.lit("ARR005").alias("rule_id"))
    flags = objects.select(*key, "idx", "who", "what", "where", F.explode("fields").alias("flag", "value")).where(F.lower("value").isin("true", "false"))
    was = F.lag(F.lower("value")).over(Window.partitionBy(*key, "who", "what", "where", "flag").orderBy("idx"))
    flips = flags.withColumn("_was", was).where((F.col("_was") != F.lower("value")) & ((F.col("who") != "<any>") | (F.col("where") != "<any>"))).select(*key, "idx", F.lit("ARR008").alias("rule_id")).distinct()
    near = elements.where("kind = 'script clash'").select(*key, "idx", F.lit("ARR004").alias("rule_id"))
    return twice.unionByName(near).unionByName(clash).unionByName(shadow).unionByName(flips)
