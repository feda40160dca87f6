"""Valid and invalid texts of every language; the parsers against the interpreter's own."""

import ast
import json
import warnings

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.syntax_check import checked_files, error_rates, first_error
from tests.conftest import rows

VALID = {
    "python": ["", "# c\n", "x = 1", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    return a\n", "class A(B, m=C):\n    x: int\n    def f(self): ...\n", "match x:\n    case {'a': [1, *r]} | A(b=2) if y:\n        pass\n    case _:\n        pass\n", "match = 1\nmatch.x\ncase = match[0]\n", "with (open(a) as b, c):\n    pass\n", "async def f():\n    async for x in y:\n        await z\n    return [i async for i in j if i]\n", "lambda *a, k=1: (yield)\n", "x = f'{a!r:>{w}} {b}'\n", "try:\n    pass\nexcept* E as e:\n    pass\nelse:\n    pass\nfinally:\n    pass\n", "@a.b(c)\nclass D: pass\n", "if (n := f()) > 1: print(n)\nelif x: pass\nelse: y = 1; z = 2\n", "a = b = *c, d\nprint(*a, **b, sep='')\n", "x[1:2, ::3, ...] = not a is not b\n", "def f[T: int](x: T) -> T: return x\ntype A[T] = list[T]\n", "s = '''\n<<<<<<< a\n'''\n", "from . import a as b\nfrom ..x import (c, d,)\n", "d = {**a, 'b': 1, }\ns = {1, *x}\n", "if x:\n\ty = 1\n", "x = 1 if a else 2 or 3\nassert a, b\ndel a[0], b.c\nraise E from e\nglobal g\n"],
    "javascript": ["", "// c\n", "import a, { b as c } from './d';\nimport 'e';\nexport default class extends A {}\n", "export const f = async ({ a, b = 1, ...r }, [c]) => { await a; };\n", "a = b\nc = d\n", "const r = /[/\\]})]+/g.test(x) ? a / b / c : `t${`u${v}`}`;\n", "for (const [k, v] of m) { if (k) continue; else break }\nfor (;;) {}\nfor (var i in o);\n", "class A { #p = 1; static s() { return this.#p } get x() { return 1 } set x(v) {} async *g() { yield* h() } [k] = 2; }\n", "label: while (1) { break label }\ndo x++; while (x < 3)\n", "const o = { a, b() {}, get c() { return 1 }, async d() {}, ...e, 'f': 1, [g]: 2 };\n", "x?.y?.[0]?.(z) ?? w;\nnew Foo;\nnew a.b(c)(d);\n", "switch (a) { case 1: b(); break; default: c() }\n", "try { a() } catch { b() } finally { c() }\n", "return_ = typeof a === 'b' && void 0 || delete c.d;\n", "!function(e,t){var a=1;return e>>>2}(1,2);\n", "const { a: { b } = {}, ...c } = d, e = (f, g);\n", "if (a) b\nelse c\n", "const of = 1, async = of; async (of);\n", "import('x').then((m) => m.default);\nconst u = import.meta.url;\n", "let x = a ? (b) : c => d;\n"],
    "typescript": ["", "interface A<T = string> extends B { readonly a?: T; [k: string]: unknown; m<U>(x: U): void; new (y: number): A }\n", "type F = (a: number, ...b: string[]) => asserts a is string;\n", "enum E { A = 1, B }\nconst enum C { X = 'x' }\n", "abstract class K<T> implements I, J<T> { private readonly x: Map<string, Array<number>>; constructor(public a: string, private b?: T) { super() } abstract f(): void; get y(): number { return 1 } }\n", "function g<T extends keyof U, U>(x: T): x is never;\nfunction g(x: any) { return x as unknown as string }\n", "const a = <T,>(x: T): T => x;\nconst b = c!.d!;\nlet e = f satisfies G;\n", "type M = { [K in keyof T]?: T[K] extends infer U ? U : never };\n", "declare module 'x' { export const a: number; }\nnamespace N.M { export type A = 1 | 'b' | null }\n", "import type { A } from './a';\nexport type { A };\nimport fs = require('fs');\n", "let t: [a: string, b?: number, ...c: boolean[]] = x;\n", "const v = new Map<string, () => void>();\nf<number>(1);\n", "for (const row of rows as Row[]) { }\n", "@dec() class D { @p() x = 1; @m f() {} }\n", "let u: typeof import('x');\nlet w: `a${string}`;\n", "export function parse(rows: Record<string, unknown>[], n: number): string[] { return []; }\n"],
    "java": ["", "package a.b;\nimport static java.util.List.*;\nimport java.io.File;\n@A(x = 1, y = {\"b\"})\npublic final class C<T extends D & E> extends F<G> implements H, I<J> { }\n", "class A { int[] a = {1, 2}, b[]; static { a(); } <T> A(T... x) throws E, F { this(1); } }\n", "class A { void f() { for (String s : l) { if (s == null || s.startsWith(\"x\")) continue; } for (int i = 0, j; i < 3; i++, j--) ; } }\n", "interface I { default int f() { return 1; } int g(); }\nenum E implements I { A, B(1) { void f() {} }, ; int x; }\n", "record R<T>(int a, T b) { R { check(); } static int c; }\n", "class A { Object o = (String) x + (int) -1; Runnable r = () -> {}; F f = (a, b) -> a; G g = String::valueOf; H h = int[]::new; }\n", "class A { int f(Object o) { return switch (o) { case Integer i when i > 1 -> 1; case A(int x, var y) -> { yield 2; } default -> throw new E(); }; } }\n", "class A { void f() { try (var a = b(); c) { } catch (D | E e) { } finally { } synchronized (this) { } do { } while (true); lbl: break lbl; } }\n", "class A { Map<String, List<int[]>> m = new HashMap<>() {{ put(\"a\", null); }}; boolean b = c == '(' || d == '\\''; String t = \"\"\"\n  x \"y\"\n  \"\"\"; }\n", "@interface An { int value() default 1; String[] s() default {}; }\n", "class A { void f() { List<String> x = a < b ? c : d; int y = a >> 1 >>> 2; x = y = 3; assert a : b; if (o instanceof String s && s.x) return; } }\n"],
    "go": ["package a\n", "package a\n\nimport (\n\tb \"c\"\n\t. \"d\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y int = 1, 2\n", "package a\n\ntype S[T any] struct {\n\tA int `json:\"a\"`\n\t*B\n\tc.D\n}\n\ntype I interface {\n\tF(a int, b ...string) (int, error)\n\t~int | string\n}\n", "package a\n\nfunc (s *S[T]) f(n int) (r int, err error) {\n\tif v, ok := m[n]; ok {\n\t\treturn v, nil\n\t} else if n > 1 {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range x {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\treturn\n}\n", "package a\n\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase d <- 1:\n\tdefault:\n\t}\n\tgo func() { defer g() }()\n}\n", "package a\n\nvar m = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nvar s = []T{{A: 1}, {2}}\nvar r = `raw {\n\"`\nvar b = []byte{0x1, 0xff,\n\t2,\n}\n", "package a\n\nfunc f(a, b int, c func(int) chan<- string) { x := a[1:2:3]; y := *p; *p = &T{1}; x, y = y, x; z := struct{ A int }{1}; <-c; a.b().c[0](d...) }\n"],
    "json": ["{}", "[]", "1", "null", '{"a": [1.5e3, -0, "\\u00e9", {"b": false}]}', '"x"\n'],
    "yaml": ["", "# c\n", "a: 1\nb:\n  - c\n  - d: e\n    f: g\n", "- a\n- - b\n  - c\n-\n  d: e\n", "a: |\n  <<<<<<< x\n  y\n\nb: >-\n  z\n", "a: [1, {b: c}, 'd, e']\nf: {g: h,\n  i: j}\n", "a: \"x: y\"\n'b c': d # e\n", "k:\n- a\n- b\nl: m\n", "a: b\n  c\nd: e\n", "---\na: 1\n...\n---\n- b\n", "a: &x\n  b: c\nd: *x\ne: !t f\n", "url: http://x.y/z?a=b#c\ntime: 12:30\n", "plain text\n", "? a\n: b\n", "a: ${X}\n", "list:\n    - x\n    - y\n"],
}
INVALID = {
    "python": ["def f(:\n", "x = (1\n", "if x:\ny\n", "<<<<<<< HEAD\nx = 1\n", "x = 'a\n", "def f():\n    '''doc\n", "return await \n", "  x = 1\n", "print 1\n", "a b\n", "class A\n", "else:\n    pass\n", "f(a=)\n", "x = 1 +\n", "# t\n\nThis file's purpose\n"],
    "javascript": ["function f( {", "const x = ;", "a b c", "if (x { }", "import x from", "const a = 'b", "<<<<<<< ours\nlet a;\n", "class { ", "x = `a${b", "interface A { b: string }", "/* open", "export const = 1;", "{ a: 1, b: }", "<p>x's y</p>", "for (;;", ")"],
    "typescript": ["interface A { b: }", "let x: = 1;", "type = 3 4;", "function f(a: string { }", "<<<<<<< a\nlet x;\n=======\n", "enum E { A = }", "def f():\n    pass\n"],
    "java": ["class A { int x }", "class A { void f( { } }", "public static final ", "class A {", "class A { } }", "package a", "import a.b", "<<<<<<< HEAD\nclass A { }\n", "class A { String s = \"x; }", "class A { void f() { return 1 } }", "package a\n\nfunc f() {}\n"],
    "go": ["", "package a.b", "package a\nfunc f() {", "package a\nfunc f() { x := }\n", "package a\nvar x = \"a\n", "package a\n<<<<<<< b\n", "import os\n", "package a\nfunc f( {}\n", "package a\nx := 1\n"],
    "json": ["", "{", "[1,]", "{'a': 1}", '{"a": 1} x', "NaN", '{"a" 1}', '"\n"', "01", "// c\n{}"],
    "yaml": ["a: b: c\n", "a: [1, 2\n", "a: \"x\n", "a: 1\n b: 2\n", "a: 1\n<<<<<<< x\nb: 2\n", "a\nb: 1\n", "\ta: 1\n", "a: 'b' c\n", "- a\nb: c\n", "a: {b: c\n", "a: @b\n", "k: 1\nword\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        assert first_error(language, text) is None, text
        assert first_error(language, text.replace("\n", "\r\n")) is None, text


@pytest.mark.parametrize("language", INVALID)
def test_invalid(language):
    for text in INVALID[language]:
        assert first_error(language, text) is not None, text


def test_agrees_with_the_interpreter_on_the_files(data):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for r in pq.read_table(f"{data.replace('sf0.001', 'sf0.01')}/file_payloads.parquet").to_pylist():
            if r["content"] is None or not r["path"].endswith((".py", ".json")):
                continue
            try:
                ast.parse(r["content"]) if r["path"].endswith(".py") else json.loads(r["content"])
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert ok == (first_error("python" if r["path"].endswith(".py") else "json", r["content"]) is None), r["payload_id"]


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_any_json_value(value):
    assert first_error("json", json.dumps(value)) is None
    assert first_error("json", json.dumps(value, ensure_ascii=False)) is None


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.sampled_from(list(VALID)))
def test_never_crashes(text, language):
    first_error(language, text)


def test_deep_and_long():
    assert first_error("json", "[" * 3000 + "]" * 3000) is None
    assert first_error("json", "[" * 3000) is not None
    assert first_error("python", "x = " + "(" * 60 + "1" + ")" * 60 + "\n") is None
    assert first_error("javascript", "x = [" + "1," * 200_000 + "];\n") is None


def test_operator(spark):
    df = spark.createDataFrame([(1, "p", "a.PY", "x = 1", "c"), (2, "p", "b.py", "x = (", "c"), (2, "p", "b.py", "x = (", "c"), (3, None, "c.txt", "(", "c"), (4, "p", None, "(", "c"), (5, "p", "d.js", None, "c"), (None, "q", "e.json", "{", "c")], "payload_id bigint, project_root string, path string, content string, language string")
    out = checked_files(df)
    assert rows(out.where("error_line IS NOT NULL").select("payload_id", "language")) == [(None, "json"), (2, "python"), (2, "python")]
    assert rows(error_rates(out)) == [("p", "python", 3, 2, 2 / 3), ("q", "json", 1, 1, 1.0)]
    assert checked_files(df.limit(0)).count() == 0


def test_deep_nesting_is_read_to_its_end():
    deep = "[" * 5_000
    assert first_error("json", deep + "]" * 5_000) is None
    assert first_error("javascript", "x = " + deep + "]" * 5_000 + ";\n") is None
    assert first_error("javascript", "x = " + deep + "]" * 4_999 + ";\n") is not None
