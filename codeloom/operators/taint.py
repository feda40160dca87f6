"""Data flow from untrusted sources to sinks in Python code.

Inside a file the flow is followed statement by statement. What crosses functions and files
is relational: the pass emits, per function, which parameters reach which sink and what the
function returns, and per call, where each argument comes from; calls and summaries then
meet in equi-joins on the qualified name.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.python_facts import Names, dotted, parse, python_sources

# Sources, cleaners and sinks.
SOURCE_CALLS = {"input": "stdin/input", "os.getenv": "environment-variable", "os.environ.get": "environment-variable"}
SOURCE_CALLS |= {f"{p}request.{a}": s for p in ("", "flask.") for a, s in {"args.get": "flask-request-args", "form.get": "flask-request-form", "values.get": "flask-request-values", "cookies.get": "flask-cookie", "headers.get": "http-header", "get_json": "flask-json-body"}.items()}
SOURCE_ATTRIBUTES = {"request.args": "flask-request-args", "request.form": "flask-request-form", "request.values": "flask-request-values", "request.cookies": "flask-cookie", "request.headers": "http-header", "request.json": "flask-json-body", "sys.argv": "process-argv"}
CLEANERS = frozenset(["html.escape", "markupsafe.escape", "escape", "shlex.quote", "urllib.parse.quote", "urllib.parse.quote_plus"])
SHELL = frozenset(["os.system", "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output"])
HTML = frozenset(["render_template_string", "flask.render_template_string", "markupsafe.Markup", "Markup"])

FLOWS = "payload_id bigint, project_root string, path string, kind string, line int, func string, callee string, arg int, keyword string, origin string, sink string"


def sink_kind(name: str, call: ast.Call) -> str | None:
    """sql, shell or html, if a call is a sink."""
    *front, last = name.split(".")
    if last.endswith(("execute", "executemany")) and not any(p[:1].isupper() for p in front[:1] + front[-1:]) and not name[:1].isupper():
        return "sql"
    if name in SHELL:
        shell = next((k.value for k in call.keywords if k.arg == "shell"), None)
        on = isinstance(shell, ast.Constant) and shell.value is True
        return "shell" if on or shell is None and name == "os.system" else None
    return "html" if name in HTML else None


@dataclass(frozen=True)
class Passing:
    """Parameters that a function returns: positions, -1 for ``*``, -2 for ``**``. ``skip``: positions that a call by the class's name has for ``self``."""

    names: tuple[str, ...]
    n_positional: int
    n_only: int
    skip: int
    returned: frozenset[int]

    def handed(self, call: ast.Call) -> list[ast.expr]:
        """The arguments of a call that its value holds."""
        out, starred = [], False
        for i, a in enumerate(call.args):
            i -= self.skip
            starred |= isinstance(a, ast.Starred)
            if starred:  # this and later positions are open
                on = any(r == -1 or i <= r < self.n_positional for r in self.returned)
            else:
                on = (i if i < self.n_positional else -1) in self.returned and i >= 0
            if on:
                out.append(a)
        by_name = {n: i for i, n in enumerate(self.names) if i >= self.n_only}
        for k in call.keywords:
            if any(r != -1 for r in self.returned) if k.arg is None else by_name.get(k.arg, -2) in self.returned:
                out.append(k.value)
        return out


class Flow:
    """Origins of values in one function: ``source:x``, ``param:i`` or ``call:qualified.name``."""

    def __init__(self, names: Names, module: str, functions: set[str], func: str, params: list[str], defaults: dict[str, ast.expr], passing: dict[str, list[Passing]] | None = None) -> None:
        self.names, self.module, self.functions, self.func = names, module, functions, func
        self.passing = passing or {}
        self.env: dict[str, set[str]] = {p: {f"param:{i}"} for i, p in enumerate(params)}
        for p, d in defaults.items():
            self.env.setdefault(p, set()).update(o for o in self.origins(d) if o.startswith("source:"))
        self.rows: list[tuple] = []

    def qualified(self, raw: str) -> str:
        name = self.names.canonical(raw)
        return f"{self.module}.{name}" if name in self.functions else name

    def origins(self, e: ast.AST | None) -> set[str]:
        if e is None or isinstance(e, ast.Constant):
            return set()
        if isinstance(e, ast.Name):
            return set(self.env.get(e.id, ()))
        if isinstance(e, ast.Call):
            raw = dotted(e.func)
            name = self.names.canonical(raw)
            if name in CLEANERS:
                return set()
            if name in SOURCE_CALLS:
                return {f"source:{SOURCE_CALLS[name]}"}
            out = {f"call:{self.qualified(raw)}"} if raw else set()
            parts = [e.func.value] if isinstance(e.func, ast.Attribute) else []
            own = self.qualified(raw).removeprefix(f"{self.module}.")
            # A function of this file hands on what it returns of its arguments; any other is taken to hand on all.
            handed = [a for p in self.passing.get(own, ()) for a in p.handed(e)] if own in self.functions else [*e.args, *[k.value for k in e.keywords]]
            for a in [*parts, *handed]:
                out |= self.origins(a)
            return out
        if isinstance(e, ast.Attribute):
            name = self.names.canonical(dotted(e))
            return {f"source:{SOURCE_ATTRIBUTES[name]}"} if name in SOURCE_ATTRIBUTES else self.origins(e.value)
        if isinstance(e, (ast.Lambda, ast.FunctionDef)):
            return set()
        out: set[str] = set()
        for c in ast.iter_child_nodes(e):
            if isinstance(c, (ast.expr, ast.comprehension, ast.keyword, ast.FormattedValue)):
                out |= self.origins(c.value if isinstance(c, ast.keyword) else c.iter if isinstance(c, ast.comprehension) else c)
        return out

    def calls(self, e: ast.AST | None) -> None:
        for n in ast.walk(e) if e is not None else ():
            if not isinstance(n, ast.Call) or not dotted(n.func):
                continue
            raw = dotted(n.func)
            name = self.names.canonical(raw)
            kind = sink_kind(name, n)
            if kind:
                first = n.args[:1] if kind == "sql" else n.args
                for o in sorted({o for a in first for o in self.origins(a)}):
                    self.rows.append(("sink", n.lineno, self.func, name, 0, None, o, kind))
            for i, a in enumerate(n.args):
                for o in sorted(self.origins(a)):
                    self.rows.append(("arg", n.lineno, self.func, self.qualified(raw), -1 if isinstance(a, ast.Starred) else i, None, o, None))
            for k in n.keywords:
                for o in sorted(self.origins(k.value)):
                    self.rows.append(("arg", n.lineno, self.func, self.qualified(raw), None, k.arg, o, None))

    def assign(self, target: ast.expr, value: set[str], add: bool = False) -> None:
        if isinstance(target, ast.Name):
            self.env[target.id] = (self.env.get(target.id, set()) if add else set()) | value
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.assign(t, value, add)
        elif isinstance(target, ast.Starred):
            self.assign(target.value, value, add)

    def run(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, (ast.Assign, ast.AnnAssign)):
                self.calls(s.value)
                value = self.origins(s.value)
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    self.assign(t, value)
            elif isinstance(s, ast.AugAssign):
                self.calls(s.value)
                self.assign(s.target, self.origins(s.value), True)
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                self.calls(s.iter)
                self.assign(s.target, self.origins(s.iter))
                self.run(s.body)
                self.run(s.orelse)
            elif isinstance(s, (ast.If, ast.While)):
                self.calls(s.test)
                before = {k: set(v) for k, v in self.env.items()}
                self.run(s.body)
                after, self.env = self.env, {k: set(v) for k, v in before.items()}
                self.run(s.orelse)
                for state in (before, after):  # a branch never cleans
                    for k, v in state.items():
                        self.env.setdefault(k, set()).update(v)
            elif isinstance(s, (ast.Try, ast.TryStar)):
                for part in (s.body, *[h.body for h in s.handlers], s.orelse, s.finalbody):
                    self.run(part)
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for item in s.items:
                    self.calls(item.context_expr)
                    if item.optional_vars is not None:
                        self.assign(item.optional_vars, self.origins(item.context_expr))
                self.run(s.body)
            elif isinstance(s, ast.Return):
                self.calls(s.value)
                for o in sorted(self.origins(s.value)):
                    self.rows.append(("return", s.lineno, self.func, None, None, None, o, None))
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            else:
                for c in ast.iter_child_nodes(s):
                    if isinstance(c, ast.expr):
                        self.calls(c)


def flows_of(text: str, module: str, path: str) -> list[tuple]:
    tree = parse(text)
    if isinstance(tree, str):
        return []
    names = Names(tree, module, path.endswith("__init__.py"))
    functions: list[tuple[str, ast.FunctionDef]] = []

    def collect(body: list[ast.stmt], owner: str) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                functions.append((f"{owner}{s.name}", s))
                collect(s.body, f"{owner}{s.name}.")
            elif isinstance(s, ast.ClassDef):
                collect(s.body, f"{owner}{s.name}.")

    collect(tree.body, "")
    known = {n for n, _ in functions}
    passing: dict[str, list[Passing]] = {}
    try:
        # Again until no function hands on more than was known: helpers may call helpers.
        while True:
            before = dict(passing)
            out = _flows(tree, names, module, known, functions, passing)
            if passing == before:
                return out
    except RecursionError:
        return []


def _flows(tree: ast.Module, names: Names, module: str, known: set[str], functions: list[tuple[str, ast.FunctionDef]], passing: dict[str, list[Passing]]) -> list[tuple]:
    """The flows of a file, given what its functions hand on; what they are seen to hand on goes to ``passing``."""
    top = Flow(names, module, known, f"{module}.<module>", [], {}, passing)
    top.run(tree.body)
    out = top.rows
    seen: dict[str, list[Passing]] = {}
    for name, f in functions:
        a = f.args
        params = [x.arg for x in [*a.posonlyargs, *a.args]]
        method = "." in name and params[:1] in (["self"], ["cls"])
        defaults = dict(zip(params[len(params) - len(a.defaults) :], a.defaults, strict=True)) | {k.arg: d for k, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None}
        shown = params[1:] if method else params
        extra = [x.arg for x in a.kwonlyargs]
        rest = ([a.vararg.arg] if a.vararg else []) + ([a.kwarg.arg] if a.kwarg else [])
        flow = Flow(names, module, known, f"{module}.{name}", [*shown, *extra], defaults, passing)
        for p in rest:
            flow.env[p] = {f"param:{-1 if a.vararg and p == a.vararg.arg else -2}"}
        for i, p in enumerate([*shown, *extra]):
            out.append(("param", f.lineno, f"{module}.{name}", None, i, p, None, None))
        flow.run(f.body)
        out += flow.rows
        if returned := frozenset(int(r[6][6:]) for r in flow.rows if r[0] == "return" and r[6].startswith("param:")):
            seen.setdefault(name, []).append(Passing((*shown, *extra), len(shown), max(0, len(a.posonlyargs) - method), int(method and params[0] == "self"), returned))
            passing.setdefault(name, seen[name])
    passing.update(seen)
    return out


_ARROW = pa.schema([("payload_id", pa.int64()), ("project_root", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("func", pa.string()), ("callee", pa.string()), ("arg", pa.int32()), ("keyword", pa.string()), ("origin", pa.string()), ("sink", pa.string())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, root, path, *r) for i, root, path, module, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True) for r in flows_of(text, module, path)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW.field(k).type) for k in range(11)], schema=_ARROW)


def python_flows(corpus: DataFrame) -> DataFrame:
    """``FLOWS``: sinks, arguments, returns and parameters of all Python files with the origins of their values."""
    return python_sources(corpus).mapInArrow(_run, FLOWS)


_CODE = {"sql": ("PYDF001", "PYXDF001"), "shell": ("PYDF002", "PYXDF002"), "html": ("PYDF003", "PYXDF003")}


def taint_findings(flows: DataFrame) -> DataFrame:
    """``payload_id, project_root, path, line, rule_id, source, call_path`` of flows from a source to a sink.

    Direct: the sink's value has a source, comes from a function that returns one, or from one
    of the same file that returns the argument with the source.
    One call deep: an argument with a source is bound to a parameter that reaches a sink, in
    this file (PYDF) or another (PYXDF). Positions count without ``self``; ``*`` and ``**``
    arguments bind to the parameters that collect them.
    """
    rule = lambda i: F.when(F.col("sink") == "sql", _CODE["sql"][i]).when(F.col("sink") == "shell", _CODE["shell"][i]).otherwise(_CODE["html"][i])
    returns = flows.where("kind = 'return' AND origin LIKE 'source:%'").select("project_root", F.col("func").alias("_f"), F.col("origin").alias("_source"), F.col("path").alias("_rpath")).groupBy("project_root", "_f", "_rpath").agg(F.min("_source").alias("_source"))
    resolved = (
        flows.where("kind IN ('sink','arg')")
        .withColumn("_f", F.when(F.col("origin").startswith("call:"), F.substr("origin", F.lit(6))))
        .join(returns, ["project_root", "_f"], "left")
        .withColumn("source", F.when(F.col("origin").startswith("source:"), F.col("origin")).otherwise(F.col("_source")))
        .where("source IS NOT NULL")
    )
    keep = ["payload_id", "project_root", "path", "line"]
    direct = resolved.where("kind = 'sink'").withColumn("_x", F.coalesce(F.col("_rpath") != F.col("path"), F.lit(False)))
    direct = direct.select(*keep, F.when(F.col("_x"), rule(1)).otherwise(rule(0)).alias("rule_id"), F.substr("source", F.lit(8)).alias("source"), F.col("func").alias("call_path"))
    wrappers = flows.where("kind = 'sink' AND origin LIKE 'param:%'").select("project_root", F.col("func").alias("callee"), F.col("path").alias("_wpath"), "sink", F.substr("origin", F.lit(7)).cast("int").alias("_p")).distinct()
    params = flows.where("kind = 'param'").select("project_root", F.col("func").alias("callee"), F.col("arg").alias("_p"), F.col("keyword").alias("_name"))
    named = wrappers.join(params, ["project_root", "callee", "_p"], "left")
    args = resolved.where("kind = 'arg'").select(*keep, "func", "callee", "arg", "keyword", "source")
    bound = args.join(named, ["project_root", "callee"]).where("arg = _p OR (arg = -1) OR keyword = _name OR (_p = -1 AND arg IS NOT NULL) OR (_p = -2 AND keyword IS NOT NULL AND keyword NOT IN ('shell','timeout'))")
    deep = bound.select(*keep, F.when(F.col("_wpath") == F.col("path"), rule(0)).otherwise(rule(1)).alias("rule_id"), F.substr("source", F.lit(8)).alias("source"), F.concat_ws(" > ", "func", "callee").alias("call_path"))
    return direct.unionByName(deep).distinct()
