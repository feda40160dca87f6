"""Deeply nested JSON records as related flat tables.

Every object that is an element of an array, at any depth, becomes a row of a child
table. The row keeps the id of its root record, its own path (surrogate key), the path of
the child that encloses it, and its position. A table is named by its path without the
positions (``edges/evidence/hops``). The schema of all tables is merged over all records:
a field is in the schema if any record has it, and its type is the narrowest that holds
every value met.

One pass over the records; JSON is parsed in Python because one field may hold an object,
an array, a scalar or a JSON string from record to record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILD = "record_src string, table string, root_id bigint, child_path string, parent_path string, ordinal bigint, fields string"
SCHEMA = "record_src string, table string, field string, kind string, n bigint"
_OUT = 50_000  # rows an output batch holds at most before it is handed on


@dataclass(frozen=True)
class Layout:
    """How columns of JSON are read.

    ``columns``: JSON columns; the path starts with the column's name unless ``bare``.
    ``lone``: field or column names under which a lone object is an array of one.
    ``embedded``: field names whose string value, if it is JSON, is read as that JSON.
    ``keyed``: columns whose elements are named by their ``id`` instead of a position and
    which may be an object keyed by that id.
    """

    record_src: str
    root_id: str
    columns: tuple[str, ...]
    bare: bool = False
    lone: frozenset[str] = field(default_factory=frozenset)
    embedded: frozenset[str] = field(default_factory=frozenset)
    keyed: frozenset[str] = field(default_factory=frozenset)


def _refuse(token: str) -> None:
    raise ValueError(token)


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def parse(text: str | None):
    """The JSON value of ``text``; None if it is none. A string that holds JSON is read again."""
    value = text
    while isinstance(value, str):
        try:
            value = _decode(value)
        except (ValueError, RecursionError):
            return None if value is text else value
    return value


class _Walk:
    """Collects the child records of one value after another."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.rows: list[tuple] = []

    def column(self, root: int, name: str, text: str | None) -> None:
        value = parse(text)
        if not isinstance(value, (dict, list)):
            return
        at = "" if self.layout.bare else name
        if name in self.layout.keyed:
            if isinstance(value, dict):
                items = list(value.items())
            else:
                items = [(v["id"] if isinstance(v, dict) and isinstance(v.get("id"), (str, int)) and not isinstance(v.get("id"), bool) else i, v) for i, v in enumerate(value)]
            for ordinal, (key, v) in enumerate(items):
                self.element(root, at, at, "", key, ordinal, v)
        elif isinstance(value, list) or name in self.layout.lone:
            self.array(root, at, at, "", value if isinstance(value, list) else [value])
        else:
            self.object(root, at, at, "", value)

    def array(self, root: int, table: str, path: str, parent: str, values: list) -> None:
        for i, v in enumerate(values):
            if isinstance(v, (dict, list)):
                self.element(root, table, path, parent, i, i, v)

    def element(self, root: int, table: str, path: str, parent: str, key, ordinal: int, v) -> None:
        here = f"{path}/{key}" if path else str(key)
        if isinstance(v, dict):
            self.rows.append((table, root, here, parent, ordinal, v))
            self.object(root, table, here, here, v)
        elif isinstance(v, list):
            self.array(root, table + "/*" if table else "*", here, parent, v)

    def object(self, root: int, table: str, path: str, parent: str, value: dict) -> None:
        layout = self.layout
        for k, v in value.items():
            if isinstance(v, str):
                if k not in layout.embedded:
                    continue
                v = parse(v)
            if isinstance(v, list):
                if v:
                    self.array(root, f"{table}/{k}" if table else k, f"{path}/{k}" if path else k, parent, v)
            elif isinstance(v, dict):
                if k in layout.lone:
                    self.array(root, f"{table}/{k}" if table else k, f"{path}/{k}" if path else k, parent, [v])
                else:
                    self.object(root, f"{table}/{k}" if table else k, f"{path}/{k}" if path else k, parent, v)

    def batch(self) -> dict:
        rows, self.rows = self.rows, []
        out = {"table": [], "root_id": [], "child_path": [], "parent_path": [], "ordinal": [], "fields": []}
        for table, root, here, parent, ordinal, v in rows:
            out["table"].append(table)
            out["root_id"].append(root)
            out["child_path"].append(here)
            out["parent_path"].append(parent)
            out["ordinal"].append(ordinal)
            out["fields"].append(v)
        return out


def _clean(texts: list[str]) -> list[str]:
    """Lone surrogates can't be stored; they become question marks."""
    return [t.encode("utf-8", "replace").decode() for t in texts]


def _strings(texts: list[str]) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):
        return pa.array(_clean(texts), pa.string())


def _walks(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[dict]:
    walk = _Walk(layout)
    for b in batches:
        ids = b.column(0).to_pylist()
        columns = [(name, b.column(i + 1)) for i, name in enumerate(layout.columns)]
        for name, column in columns:
            for root, text in zip(ids, column.to_pylist(), strict=True):
                if text:
                    walk.column(root, name, text)
                    if len(walk.rows) >= _OUT:
                        yield walk.batch()
    if walk.rows:
        yield walk.batch()


def child_paths(df: DataFrame, layout: Layout) -> DataFrame:
    """``record_src, root_id, child_path, parent_path``: one distinct row per child record.

    Text that is no JSON, null text and an empty table give no rows. A null root id stays
    null. Records that are delivered again add nothing. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _walks(batches, layout):
            yield pa.RecordBatch.from_arrays([pa.array(x["root_id"], pa.int64()), _strings(x["child_path"]), _strings(x["parent_path"])], ["root_id", "child_path", "parent_path"])

    narrow = df.select(F.col(layout.root_id).cast("bigint").alias("_id"), *[F.col(c).cast("string") for c in layout.columns])
    rows = narrow.where(" OR ".join(f"`{c}` IS NOT NULL" for c in layout.columns)).mapInArrow(run, "root_id bigint, child_path string, parent_path string")
    return rows.distinct().select(F.lit(layout.record_src).alias("record_src"), "root_id", "child_path", "parent_path")


def child_records(df: DataFrame, layout: Layout) -> DataFrame:
    """All child tables in one stream with the columns of ``CHILD``.

    ``fields`` holds the scalar fields of the child, and of plain objects inside it under
    dotted names, as one JSON object. Edge cases are those of ``child_paths``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _walks(batches, layout):
            n = len(x["table"])
            texts = [json.dumps(_scalars(v, layout), ensure_ascii=True, separators=(",", ":")) for v in x["fields"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([layout.record_src] * n, pa.string()), _strings(x["table"]), pa.array(x["root_id"], pa.int64()), _strings(x["child_path"]), _strings(x["parent_path"]), pa.array(x["ordinal"], pa.int64()), pa.array(texts, pa.string())],
                ["record_src", "table", "root_id", "child_path", "parent_path", "ordinal", "fields"],
            )

    narrow = df.select(F.col(layout.root_id).cast("bigint").alias("_id"), *[F.col(c).cast("string") for c in layout.columns])
    return narrow.mapInArrow(run, CHILD).distinct()


def _scalars(value: dict, layout: Layout, prefix: str = "", out: dict | None = None) -> dict:
    """Scalar fields, arrays of scalars as JSON text; objects of the child's own under dotted names."""
    out = {} if out is None else out
    for k, v in value.items():
        name = f"{prefix}{k}"
        if isinstance(v, str) and k in layout.embedded:
            inner = parse(v)
            v = inner if isinstance(inner, (dict, list)) else v
        if isinstance(v, dict):
            if k not in layout.lone:
                _scalars(v, layout, name + ".", out)
        elif isinstance(v, list):
            if not any(isinstance(x, (dict, list)) for x in v):
                out[name] = json.dumps(v)
        else:
            out[name] = v
    return out


_KIND = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def merged_schema(children: DataFrame) -> DataFrame:
    """``record_src, table, field, kind, n``: the merged schema of all child tables.

    ``kind`` is the narrowest of boolean, bigint, double and string that holds every value;
    a field that is only ever null is a string. ``n`` counts the values that aren't null.
    Counts are merged within each task before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in batches:
            for src, table, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for k, v in json.loads(text).items():
                    key = (src, table, k, _KIND.get(type(v), "null"))
                    seen[key] = seen.get(key, 0) + 1
        if seen:
            cols = [_strings([k[i] for k in seen]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(seen.values()), pa.int64())], ["record_src", "table", "field", "kind", "n"])

    each = children.select("record_src", "table", "fields").mapInArrow(run, SCHEMA)
    kinds = F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))
    return (
        each.groupBy("record_src", "table", "field")
        .agg(kinds.alias("k"), F.sum(F.when(F.col("kind") != "null", F.col("n")).otherwise(0)).alias("n"))
        .select(
            "record_src",
            "table",
            "field",
            F.when(F.size("k") == 1, F.col("k")[0]).when((F.size("k") == 2) & F.forall("k", lambda x: x.isin("bigint", "double")), F.lit("double")).otherwise(F.lit("string")).alias("kind"),
            "n",
        )
    )


def child_table(children: DataFrame, table: str, fields: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """One flat child table: keys to root and parent, ordinal, and the typed ``fields``.

    ``fields`` are ``(name, kind)`` as ``merged_schema`` gives them; without them the schema
    is inferred from all children of the table first (one row a field comes to the driver,
    so ``children`` should be kept as a table); dots in a name become
    underscores, and a name that would repeat gets a trailing underscore.
    """
    if fields is None:
        own = children.where(F.col("table") == table)
        fields = [(r["field"], r["kind"]) for r in merged_schema(own).groupBy("field").agg(F.when(F.count_distinct("kind") == 1, F.min("kind")).otherwise("string").alias("kind")).orderBy("field").collect()]
    names: list[str] = ["record_src", "root_id", "child_path", "parent_path", "ordinal"]
    cols = []
    for name, kind in fields:
        out = name.replace(".", "_")
        while out.lower() in names:
            out += "_"
        names.append(out.lower())
        text = F.get_json_object("fields", "$['" + name.replace("'", "\\'") + "']")
        cols.append((text if kind == "string" else text.try_cast(kind)).alias(out))
    return children.where(F.col("table") == table).select("record_src", "root_id", "child_path", "parent_path", "ordinal", *cols)
