"""Parsing tables from bundled grammars.

A grammar file holds EBNF rules. ``compile_grammar`` turns every rule into a row of a
parsing table: the alternatives of a choice are selected by FIRST sets, looked up with the
current token; where several alternatives begin alike they are tried in order, and a chart
of (rule, position) results keeps that linear. The whole token stream has to be consumed.
The furthest token that no alternative could take is the first unrecoverable error.

Notation: ``name : alternative | alternative ;`` -- ``'x'`` a token of that text, ``UPPER``
a token class, ``lower`` a rule, ``( )``, ``?``, ``*``, ``+``, ``&x`` and ``!x`` lookahead,
``<nl>`` a line break before the token, ``<never>`` nothing. ``@name`` keeps a rule in the
chart. A grammar may start with ``%extends file``; its rules replace those of that file.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib.resources import files

_TOKEN = re.compile(r"\s+|#[^\n]*|('(?:[^'\\]|\\.)+'|<\w+>|@?\w+|[:|;()?*+&!])")


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens = [m[1] for m in _TOKEN.finditer(text) if m[1]]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def rules(self) -> dict[str, tuple]:
        out: dict[str, tuple] = {}
        while self.peek():
            name = self.next()
            assert self.next() == ":", name
            out[name.lstrip("@")] = ("rule", name.startswith("@"), self.choice())
            assert self.next() == ";", name
        return out

    def choice(self) -> tuple:
        alts = [self.sequence()]
        while self.peek() == "|":
            self.next()
            alts.append(self.sequence())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("|", ";", ")", ""):
            parts.append(self.item())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def item(self) -> tuple:
        t = self.next()
        if t in "&!":
            return ("and" if t == "&" else "not", self.item())
        if t == "(":
            node = self.choice()
            assert self.next() == ")"
        elif t == "<nl>":
            node = ("nl",)
        elif t == "<never>":
            node = ("never",)
        elif t[0] == "'":
            node = ("token", t[1:-1].replace("\\'", "'"))
        elif t.isupper():
            node = ("token", t)
        else:
            node = ("ref", t)
        while self.peek() in ("?", "*", "+") and self.peek():
            op = self.next()
            node = ({"?": "opt", "*": "star", "+": "plus"}[op], node)
        return node


def read_grammar(name: str) -> dict[str, tuple]:
    text = files("codeloom.llm").joinpath("grammars", name).read_text(encoding="utf-8")
    rules: dict[str, tuple] = {}
    if text.startswith("%extends"):
        head, text = text.split("\n", 1)
        rules = dict(read_grammar(head.split()[1]))
    return rules | _Reader(text).rules()


def _first_sets(rules: dict[str, tuple]) -> Callable[[tuple], tuple[set, bool, bool]]:
    """Function of a part of a rule: its FIRST set, whether any token may begin it, whether it can be empty."""
    first: dict[str, set] = {r: set() for r in rules}
    free: dict[str, bool] = dict.fromkeys(rules, False)  # begins with a test that isn't a token
    empty: dict[str, bool] = dict.fromkeys(rules, False)

    def of(n: tuple) -> tuple[set, bool, bool]:
        kind = n[0]
        if kind == "token":
            return {n[1]}, False, False
        if kind == "ref":
            return first[n[1]], free[n[1]], empty[n[1]]
        if kind in ("opt", "star"):
            f, any_, _ = of(n[1])
            return f, any_, True
        if kind == "plus":
            return of(n[1])
        if kind in ("and", "not", "nl"):
            return set(), False, True
        if kind == "never":
            return set(), False, False
        if kind == "choice":
            parts = [of(x) for x in n[1]]
            return set().union(*(p[0] for p in parts)), any(p[1] for p in parts), any(p[2] for p in parts)
        out: set = set()
        any_ = False
        for x in n[1]:
            f, a, e = of(x)
            out |= f
            any_ |= a
            if not e:
                return out, any_, False
        return out, any_, True

    changed = True
    while changed:
        changed = False
        for r, (_, _, body) in rules.items():
            f, a, e = of(body)
            if not f <= first[r] or a != free[r] or e != empty[r]:
                first[r] |= f
                free[r], empty[r] = a, e
                changed = True
    return of


class Parser:
    """The tables of one grammar. ``error(kinds, breaks)`` is -1 for a sentence, else the index of the first token that can't be taken."""

    def __init__(self, rules: dict[str, tuple], start: str) -> None:
        self._of = _first_sets(rules)
        self._lines: list[str] = []
        self._sets: dict[frozenset, str] = {}
        self._n = 0
        charts = []
        for name, (_, keep, body) in rules.items():
            inner = self._node(body)
            if keep:
                charts.append(name)
                self._lines += [f"def r_{name}(p):", f"    q = M_{name}.get(p)", "    if q is None:", f"        q = M_{name}[p] = {inner}(p)", "    return q"]
            else:
                self._lines += [f"def r_{name}(p):", f"    return {inner}(p)"]
        env: dict = {v: k for k, v in self._sets.items()}
        head = ["T = []", "B = []", "FAR = 0", *[f"M_{c} = {{}}" for c in charts]]
        body = ["def run(kinds, breaks):", "    global T, B, FAR", "    T, B, FAR = kinds, breaks, 0", *[f"    M_{c}.clear()" for c in charts], f"    q = r_{start}(0)", "    return -1 if q == len(T) else max(FAR, q)"]
        exec(compile("\n".join(head + self._lines + body), f"<{start}>", "exec"), env)  # the table, as code
        self._run = env["run"]

    def error(self, kinds: list[str], breaks: list[bool]) -> int:
        return self._run(kinds, breaks)

    def _set(self, f: set) -> str:
        return self._sets.setdefault(frozenset(f), f"F{len(self._sets)}")

    def _guard(self, n: tuple) -> str:
        f, any_, empty = self._of(n)
        return "True" if any_ or empty else f"T[p] in {self._set(f)}"

    def _node(self, n: tuple) -> str:
        kind = n[0]
        if kind == "ref":
            return f"r_{n[1]}"
        name = f"n{self._n}"
        self._n += 1
        out = [f"def {name}(p):"]
        if kind == "token":
            out += ["    global FAR", f"    if T[p] == {n[1]!r}: return p + 1", "    if p > FAR: FAR = p", "    return -1"]
        elif kind == "never":
            out += ["    return -1"]
        elif kind == "nl":
            out += ["    return p if B[p] else -1"]
        elif kind == "and":
            out += ["    global FAR", "    far = FAR", f"    q = {self._node(n[1])}(p)", "    FAR = far", "    return p if q >= 0 else -1"]
        elif kind == "not":
            out += ["    global FAR", "    far = FAR", f"    q = {self._node(n[1])}(p)", "    FAR = far", "    return -1 if q >= 0 else p"]
        elif kind == "opt":
            out += [f"    if {self._guard(n[1])}:", f"        q = {self._node(n[1])}(p)", "        if q >= 0: return q", "    return p"]
        elif kind in ("star", "plus"):
            inner = self._node(n[1])
            if kind == "plus":
                out += [f"    p = {inner}(p)", "    if p < 0: return -1"]
            out += [f"    while {self._guard(n[1])}:", f"        q = {inner}(p)", "        if q <= p: break", "        p = q", "    return p"]
        elif kind == "choice":
            out.append("    global FAR")
            for alt in n[1]:
                out += [f"    if {self._guard(alt)}:", f"        q = {self._node(alt)}(p)", "        if q >= 0: return q"]
            out += ["    if p > FAR: FAR = p", "    return -1"]
        else:
            if any(x[0] == "token" for x in n[1]):
                out.append("    global FAR")
            for x in n[1]:
                if x[0] == "token":
                    out += [f"    if T[p] != {x[1]!r}:", "        if p > FAR: FAR = p", "        return -1", "    p += 1"]
                else:
                    out += [f"    p = {self._node(x)}(p)", "    if p < 0: return -1"]
            out.append("    return p")
        self._lines += out
        return name


def compile_grammar(name: str, start: str = "file") -> Parser:
    return Parser(read_grammar(name), start)
