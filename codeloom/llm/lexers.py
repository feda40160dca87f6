"""Token streams for the bundled grammars.

Every lexer reads the whole text and returns three lists of equal length: token classes,
whether a line break stands before the token, and line numbers from 1. The last token is
``EOF``. A text that has no token stream raises ``LexError`` with the line of the first
character that can't be read.
"""

from __future__ import annotations

import re


class LexError(Exception):
    def __init__(self, line: int, what: str) -> None:
        super().__init__(what)
        self.line, self.what = line, what


Stream = tuple[list[str], list[bool], list[int]]


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _unix(text: str) -> str:
    if text.startswith("﻿"):
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


# --- JSON ---------------------------------------------------------------------------------
_JSON = re.compile(r'[ \t\n\r]+|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(?P<NUMBER>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<WORD>true|false|null)\b|(?P<P>[{}\[\],:])')


def lex_json(text: str) -> Stream:
    if text.startswith("﻿"):
        text = text[1:]
    kinds, lines, at, line = [], [], 0, 1
    match = _JSON.match
    n = len(text)
    while at < n:
        m = match(text, at)
        if not m:
            raise LexError(_line(text, at), "character")
        kind = m.lastgroup
        if kind is None:
            line += m[0].count("\n")
        else:
            kinds.append(m[0] if kind in ("P", "WORD") else kind)
            lines.append(line)
        at = m.end()
    kinds.append("EOF")
    lines.append(line)
    return kinds, [False] * len(kinds), lines


# --- Python -------------------------------------------------------------------------------
_PY_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY = re.compile(
    r"(?P<WS>[ \t\f]+|\\\n|#[^\n]*)|(?P<NL>\n)"
    r"|(?P<STRING>[rRbBuUfFtT]{0,3}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*'))"
    r"|(?P<NAME>[^\W\d]\w*)"
    r"|(?P<NUMBER>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<AUG>(?:\*\*|//|>>|<<|[-+*/%@&|^])=)|(?P<OP>->|:=|\.\.\.|[=!<>]=|<>|(?P<BIN>//|<<|>>|[%^])|\*\*|[-+*/@&|~<>()\[\]{},:;.=])",
    re.S,
)


def lex_python(text: str) -> Stream:
    text = _unix(text)
    kinds: list[str] = []
    lines: list[int] = []
    words: list[str] = []
    indents = [0]
    at, line, depth, n = 0, 1, 0, len(text)
    fresh = True  # at the start of a logical line
    start = 0  # its first token
    match = _PY.match

    def end_line() -> None:
        if kinds and start < len(kinds):
            if kinds[start] == "NAME":
                w = words[start]
                if w in ("match", "case") and kinds[-1] == ":" and len(kinds) - start > 2 or w == "type" and len(kinds) - start > 3 and kinds[start + 1] == "NAME" and kinds[start + 2] in ("=", "["):
                    kinds[start] = w
            add("NEWLINE", "")

    def add(kind: str, word: str) -> None:
        kinds.append(kind)
        words.append(word)
        lines.append(line)

    while at < n:
        if fresh and not depth:
            col, k = 0, at
            while k < n and text[k] in " \t\f":
                col = col + 1 if text[k] == " " else (col // 8 + 1) * 8 if text[k] == "\t" else 0
                k += 1
            if k >= n:
                break
            if text[k] == "\n" or text[k] == "#":
                k = text.find("\n", k)
                if k < 0:
                    break
                at, line = k + 1, line + 1
                continue
            at = k
            if col > indents[-1]:
                indents.append(col)
                add("INDENT", "")
            else:
                while col < indents[-1]:
                    indents.pop()
                    add("DEDENT", "")
                if col != indents[-1]:
                    raise LexError(line, "indentation")
            fresh, start = False, len(kinds)
        m = match(text, at)
        if not m:
            raise LexError(line, "character or string")
        kind, word = m.lastgroup, m[0]
        at = m.end()
        if kind == "WS":
            line += word.count("\n")
        elif kind == "NL":
            if not depth:
                end_line()
                fresh = True
            line += 1
        elif kind == "STRING":
            add("STRING", "")
            line += word.count("\n")
        elif kind == "NAME":
            add(word if word in _PY_KEYWORDS else "NAME", word)
        elif kind == "NUMBER":
            if at < n and (text[at].isalnum() or text[at] == "_") and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(text, at):
                raise LexError(line, "number")
            add("NUMBER", "")
        elif kind == "AUG":
            add("AUG", "")
        elif m["BIN"]:
            add("BINOP", "")
        else:
            if word in "([{":
                depth += 1
            elif word in ")]}":
                depth -= 1
                if depth < 0:
                    raise LexError(line, "bracket")
            add(word, "")
    if depth:
        raise LexError(line, "bracket never closed")
    if not fresh:
        end_line()
    for _ in indents[1:]:
        add("DEDENT", "")
    add("EOF", "")
    return kinds, [False] * len(kinds), lines


# --- JavaScript and TypeScript ------------------------------------------------------------
_JS_WORDS = frozenset(
    "function class import export default var const if else for while do return break continue throw try catch finally switch case debugger with in instanceof typeof void delete new this super null true false extends"
    " async of get set from as static let yield type interface namespace declare abstract readonly private public protected implements keyof is enum module assert satisfies infer unique asserts override accessor await global require out".split()
)
_JS = re.compile(
    r"(?P<WS>[ \t\f\v ﻿]+|//[^\n  ]*)|(?P<NL>[\n  ])|(?P<COMMENT>/\*.*?\*/)"
    r"|(?P<NAME>(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*)|(?P<PRIVATE>\#[^\W\d][\w$]*)"
    r"|(?P<NUMBER>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<STRING>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<TICK>`)"
    r"|(?P<ASSIGN>(?:\*\*|<<|>>>|>>|&&|\|\||\?\?|[-+*/%&|^])=(?!=))|(?P<OP>=>|\.\.\.|\?\.(?!\d)|\+\+|--|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\*\*|<<|[-+*/%&|^~!<>()\[\]{},:;.=?@])",
    re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_JS_CLASS = {"=>": "=>", "++": "INCR", "--": "INCR", "+": "SIGN", "-": "SIGN", "~": "PREFIX", **dict.fromkeys(["===", "!==", "==", "!=", "<=", ">=", "&&", "||", "??", "**", "<<", "/", "%", "^"], "OP")}
_JS_VALUE = frozenset(["NAME", "NUMBER", "STRING", "REGEX", "TEMPLATE", "TEMPLATE_TAIL", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "INCR", "of_", "get", "set", "from", "as", "type", "static", "async", "let", "module", "namespace", "global", "require"])
_TPL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)


def lex_javascript(text: str) -> Stream:
    text = _unix(text)
    kinds: list[str] = []
    breaks: list[bool] = []
    lines: list[int] = []
    at, line, n, nl = 0, 1, len(text), False
    braces: list[bool] = []  # open braces; True for the one of a template's ${
    if text.startswith("#!"):
        at = max(text.find("\n"), 0) or n
    match = _JS.match

    def add(kind: str) -> None:
        nonlocal nl
        kinds.append(kind)
        breaks.append(nl)
        lines.append(line)
        nl = False

    def template(first: bool) -> None:
        nonlocal at, line
        m = _TPL.match(text, at)
        if not m:
            raise LexError(line, "template never closed")
        if m[1] == "`":
            add("TEMPLATE" if first else "TEMPLATE_TAIL")
        else:
            add("TEMPLATE_HEAD" if first else "TEMPLATE_MIDDLE")
            braces.append(True)
        line += m[0].count("\n")
        at = m.end()

    while at < n:
        if text[at] == "/" and not (kinds and kinds[-1] in _JS_VALUE):
            m = _JS_REGEX.match(text, at)
            if m:
                add("REGEX")
                at = m.end()
                continue
        m = match(text, at)
        if not m:
            raise LexError(line, "character or string")
        kind, word = m.lastgroup, m[0]
        at = m.end()
        if kind == "WS":
            continue
        if kind == "NL":
            line += 1
            nl = True
        elif kind == "COMMENT":
            k = word.count("\n")
            line += k
            nl = nl or k > 0
        elif kind == "NAME":
            add(word if word in _JS_WORDS else "NAME")
        elif kind == "TICK":
            template(True)
        elif kind == "STRING":
            add("STRING")
            line += word.count("\n")
        elif kind == "NUMBER":
            if at < n and (text[at].isalnum() or text[at] in "_$"):
                raise LexError(line, "number")
            add("NUMBER")
        elif kind != "OP":
            add(kind)
        elif word == "{":
            braces.append(False)
            add("{")
        elif word == "}":
            if not braces:
                raise LexError(line, "bracket")
            if braces.pop():
                template(False)
            else:
                add("}")
        else:
            if word == "/" and text.startswith("/*", at - 1):
                raise LexError(line, "comment never closed")
            add(_JS_CLASS.get(word, word))
    if braces:
        raise LexError(line, "bracket never closed")
    add("EOF")
    return kinds, breaks, lines


# --- Java ---------------------------------------------------------------------------------
_JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
    " record sealed permits yield module open requires exports opens uses provides transitive to with when var".split()
)
_JAVA = re.compile(
    r"(?P<WS>[ \t\f]+|//[^\n]*)|(?P<NL>\n)|(?P<COMMENT>/\*.*?\*/)|(?P<NAME>(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<NUMBER>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?)"
    r"|(?P<TEXT>\"\"\"[ \t]*\n(?:[^\\]|\\.)*?\"\"\")|(?P<STRING>\"(?:[^\"\\\n]|\\.)*\")|(?P<CHAR>'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))')"
    r"|(?P<ASSIGN>(?:<<|>>>|>>|[-+*/%&|^])=)|(?P<OP>->|::|\.\.\.|\+\+|--|==|!=|<=|>=|&&|\|\||<<|[-+*/%&|^~!<>()\[\]{},:;.=?@])",
    re.S,
)
_JAVA_CLASS = {"++": "INCR", "--": "INCR", "+": "SIGN", "-": "SIGN", "~": "PREFIX", "!": "PREFIX", **dict.fromkeys(["==", "!=", "<=", ">=", "&&", "||", "<<", "/", "%", "^"], "OP")}


def lex_java(text: str) -> Stream:
    return _plain(_unix(text), _JAVA, _JAVA_WORDS, _JAVA_CLASS)


def _plain(text: str, rx: re.Pattern, words: frozenset, classes: dict[str, str]) -> Stream:
    kinds: list[str] = []
    lines: list[int] = []
    at, line, n = 0, 1, len(text)
    match = rx.match
    while at < n:
        m = match(text, at)
        if not m:
            raise LexError(line, "character or string")
        kind, word = m.lastgroup, m[0]
        at = m.end()
        if kind == "WS":
            continue
        if kind == "NL":
            line += 1
        elif kind == "COMMENT":
            line += word.count("\n")
        elif kind == "NAME":
            kinds.append(word if word in words else "NAME")
            lines.append(line)
        elif kind == "OP":
            if word == "/" and text.startswith("/*", at - 1):
                raise LexError(line, "comment never closed")
            kinds.append(classes.get(word, word))
            lines.append(line)
        else:
            if kind == "NUMBER" and at < n and (text[at].isalnum() or text[at] == "_"):
                raise LexError(line, "number")
            kinds.append(kind)
            lines.append(line)
            line += word.count("\n")
    kinds.append("EOF")
    lines.append(line)
    return kinds, [False] * len(kinds), lines


# --- Go -----------------------------------------------------------------------------------
_GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO = re.compile(
    r"(?P<WS>[ \t\r]+|//[^\n]*)|(?P<NL>\n)|(?P<COMMENT>/\*.*?\*/)|(?P<NAME>[^\W\d]\w*)"
    r"|(?P<NUMBER>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)"
    r"|(?P<STRING>\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`)|(?P<CHAR>'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))')"
    r"|(?P<ASSIGN>(?:<<|>>|&\^|[-+*/%&|^])=)|(?P<OP>:=|\.\.\.|\+\+|--|<-|&\^|&&|\|\||==|!=|<=|>=|<<|>>|[-+*/%&|^~!<>()\[\]{},:;.=])",
    re.S,
)
_GO_CLASS = {"++": "INCR", "--": "INCR", "!": "PREFIX", **dict.fromkeys("+-^&", "SIGN"), **dict.fromkeys(["/", "%", "&^", "&&", "||", "==", "!=", "<", "<=", ">", ">=", "<<", ">>"], "OP")}
_GO_ENDS = frozenset(["NAME", "NUMBER", "STRING", "CHAR", "break", "continue", "fallthrough", "return", "INCR", ")", "]", "}"])


def lex_go(text: str) -> Stream:
    text = _unix(text)
    kinds: list[str] = []
    lines: list[int] = []
    at, line, n = 0, 1, len(text)
    match = _GO.match

    def add(kind: str) -> None:
        kinds.append(kind)
        lines.append(line)

    while at < n:
        m = match(text, at)
        if not m:
            raise LexError(line, "character or string")
        kind, word = m.lastgroup, m[0]
        at = m.end()
        if kind == "WS":
            continue
        if kind == "NL" or kind == "COMMENT" and "\n" in word:
            if kinds and kinds[-1] in _GO_ENDS:
                add(";")
            line += word.count("\n")
        elif kind == "COMMENT":
            continue
        elif kind == "NAME":
            add(word if word in _GO_WORDS else "NAME")
        elif kind == "OP":
            if word == "/" and text.startswith("/*", at - 1):
                raise LexError(line, "comment never closed")
            add(_GO_CLASS.get(word, word))
        else:
            if kind == "NUMBER" and at < n and (text[at].isalnum() or text[at] == "_"):
                raise LexError(line, "number")
            add(kind)
            line += word.count("\n")
    if kinds and kinds[-1] in _GO_ENDS:
        add(";")
    add("EOF")
    return kinds, [False] * len(kinds), lines


# --- YAML ---------------------------------------------------------------------------------
_DQ = re.compile(r'"(?:[^"\\]|\\(?:[0abtnvfre "/\\N_LP\n]|\t|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"', re.S)
_SQ = re.compile(r"'(?:[^']|'')*'", re.S)
_PROP = re.compile(r"(?:&[^\s,\[\]{}]+|!(?:<[^>\s]*>|[^\s,\[\]{}]*))(?=\s|$|[,\]}])")
_ALIAS = re.compile(r"\*[^\s,\[\]{}]+")
_HEAD = re.compile(r"[|>](?:[1-9]?[-+]?|[-+][1-9])[ \t]*(?:[ \t]\#[^\n]*)?(?:\n|$)")
_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#]))*")
_FPLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|\s+(?=[^\s#,\[\]{}:]|:(?=[^\s,\[\]{}])))*")
_AFTER = re.compile(r"[ \t]*(?:(?<=[ \t])\#[^\n]*)?(?:\n|$)")
_COLON = re.compile(r"[ \t]*:(?=\s|$)")


def lex_yaml(text: str) -> Stream:
    text = _unix(text)
    kinds: list[str] = []
    lines: list[int] = []
    stack: list[list] = []  # [indent, "map" | "list" | "scalar"]
    at, n = 0, len(text)

    def line_no() -> int:
        return text.count("\n", 0, min(at, n)) + 1

    def add(kind: str) -> None:
        kinds.append(kind)
        lines.append(line_no())

    def fail(what: str) -> None:
        raise LexError(line_no(), what)

    def close(indent: int) -> None:
        while stack and stack[-1][0] > indent:
            stack.pop()
            add("OUT")

    def flow() -> None:
        nonlocal at
        depth = 0
        while True:
            while at < n and text[at] in " \t\n":
                at += 1
            if at >= n:
                fail("flow never closed")
            c = text[at]
            if c == "#" and text[at - 1] in " \t\n":
                at = text.find("\n", at)
                if at < 0:
                    at = n
                continue
            if c in "[{":
                depth += 1
                add(c)
                at += 1
            elif c in "]}":
                depth -= 1
                add(c)
                at += 1
                if not depth:
                    return
            elif c == ",":
                add(",")
                at += 1
            elif c == ":" and (at + 1 >= n or text[at + 1] in " \t\n,[]{}" or kinds[-1] in ("QUOTED", "]", "}")):
                add(":")
                at += 1
            elif c == "?" and text[at + 1 : at + 2] in (" ", "\n"):
                add("?")
                at += 1
            else:
                for rx, kind in ((_DQ, "QUOTED"), (_SQ, "QUOTED"), (_PROP, "PROP"), (_ALIAS, "ALIAS"), (_FPLAIN, "PLAIN")):
                    m = rx.match(text, at)
                    if m:
                        add(kind)
                        at = m.end()
                        break
                else:
                    fail("flow")

    def parent() -> int:
        """Indent of the innermost collection."""
        for indent, kind in reversed(stack):
            if kind != "scalar":
                return indent
        return -1

    def plain_tail() -> None:
        """Further lines of a plain scalar."""
        nonlocal at
        base = parent()
        while at < n:
            m = re.compile(r"(?:[ \t]*\n)*( *)(?=\S)").match(text, at)
            if not m or len(m[1]) <= base or (not m[1] and re.compile(r"(?:---|\.\.\.)(?:\s|$)").match(text, m.end())):
                return
            k = m.end()
            if text[k] == "#":
                return
            m = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#]))+").match(text, k)
            if not m:
                at = k
                fail("text after a scalar")
            at = m.end()
            m = _AFTER.match(text, at)
            if not m:
                fail("a mapping isn't allowed here")
            at = m.end()
            if "#" in m[0]:
                return

    def node(col: int, inline: bool) -> None:
        """What stands at ``at`` in column ``col``; ``inline``: after a key on its line."""
        nonlocal at
        props = 0
        while True:
            rest = text[at : at + 2]
            if rest[0] == "-" and (len(rest) == 1 or rest[1] in " \t\n"):
                if inline or props:
                    fail("a list isn't allowed here")
                enter(col, "list")
                add("DASH")
                at += 1
                gap = re.compile(r"[ \t]*").match(text, at)[0]
                if "\t" in gap and not _AFTER.match(text, at):
                    gap = gap.replace("\t", " ")
                col += 1 + len(gap)
                at += len(gap)
                if at >= n or text[at] == "\n" or text[at] == "#" and gap:
                    end()
                    return
                inline = False
                continue
            if rest[0] == "?" and (len(rest) == 1 or rest[1] in " \t\n") and not inline:
                enter(col, "map")
                add("ASK")
                at += 1
                gap = re.compile(r"[ \t]*").match(text, at)[0]
                at += len(gap)
                col += 1 + len(gap)
                if at >= n or text[at] == "\n":
                    end()
                    return
                continue
            if rest[0] == ":" and (len(rest) == 1 or rest[1] in " \t\n") and not inline:
                enter(col, "map")
                add("KEY")
                at += 1
                after_key()
                return
            m = _PROP.match(text, at)
            if m:
                pending = m.end()
                gap = re.compile(r"[ \t]*").match(text, pending)[0]
                if _AFTER.match(text, pending):
                    if not inline:
                        enter(col, "scalar")
                    add("PROP")
                    at = pending
                    end()
                    return
                if not inline and not props:
                    k = pending + len(gap)
                    if _key_at(k):
                        enter(col, "map")
                        inline_key = True
                    else:
                        enter(col, "scalar")
                        inline_key = False
                    add("PROP")
                    at = k
                    props += 1
                    if inline_key:
                        scalar_or_key(col, False, True)
                        return
                    inline = True
                    continue
                add("PROP")
                at = pending + len(gap)
                props += 1
                continue
            break
        scalar_or_key(col, inline, False)

    def _key_at(k: int) -> bool:
        for rx in (_DQ, _SQ, _ALIAS, _PLAIN):
            m = rx.match(text, k)
            if m:
                return "\n" not in m[0] and bool(_COLON.match(text, m.end()))
        return False

    def scalar_or_key(col: int, inline: bool, entered: bool) -> None:
        nonlocal at
        c = text[at]
        if c in "[{":
            mark = len(kinds)
            flow()
            if _COLON.match(text, at):
                if inline:
                    fail("a mapping isn't allowed here")
                tail_k, tail_l = kinds[mark:], lines[mark:]
                del kinds[mark:], lines[mark:]
                enter(col, "map")
                kinds.extend(tail_k)
                lines.extend(tail_l)
                add(":")
                at = _COLON.match(text, at).end()
                after_key()
                return
            if not inline and not entered:
                tail_k, tail_l = kinds[mark:], lines[mark:]
                del kinds[mark:], lines[mark:]
                enter(col, "scalar")
                kinds.extend(tail_k)
                lines.extend(tail_l)
            end()
            return
        if c in "|>":
            m = _HEAD.match(text, at)
            if not m:
                fail("block scalar")
            if not inline and not entered:
                enter(col, "scalar")
            add("BLOCK")
            base = parent()
            at = m.end()
            first = re.compile(r"(?: *\n)*( *)\S").match(text, at)
            need = max(base + 1, 0)
            if first and len(first[1]) >= need:
                need = len(first[1]) if need <= len(first[1]) else need
                indent = first[1]
                m = re.compile(rf"(?:{indent}[^\n]*(?:\n|$)| *(?:\n|$))*").match(text, at)
                if indent == "" and base < 0:
                    m = re.compile(r"(?:(?!---\s|\.\.\.\s)[^\n]*(?:\n|$))*?(?=---\s|\.\.\.\s|\Z)").match(text, at)
                at = m.end() if m.end() > at else at
            return
        for rx, kind in ((_DQ, "QUOTED"), (_SQ, "QUOTED"), (_ALIAS, "ALIAS"), (_PLAIN, "PLAIN")):
            m = rx.match(text, at)
            if m:
                break
        else:
            fail("character")
        colon = _COLON.match(text, m.end()) if "\n" not in m[0] else None
        if colon:
            if inline:
                at = m.end()
                fail("a mapping isn't allowed here")
            if not entered:
                enter(col, "map")
            add("KEY")
            at = colon.end()
            after_key()
            return
        if not inline and not entered:
            enter(col, "scalar")
        add(kind)
        at = m.end()
        tail = _AFTER.match(text, at)
        if not tail:
            fail("text after a scalar")
        at = tail.end()
        if kind == "PLAIN" and "#" not in tail[0]:
            plain_tail()

    def after_key() -> None:
        nonlocal at
        gap = re.compile(r"[ \t]*").match(text, at)[0]
        if at + len(gap) >= n or text[at + len(gap)] == "\n" or text[at + len(gap)] == "#" and gap:
            end()
            return
        at += len(gap)
        node(-1, True)

    def end() -> None:
        nonlocal at
        m = _AFTER.match(text, at)
        if not m:
            fail("text after a value")
        at = m.end()

    def enter(col: int, kind: str) -> None:
        """Begins an entry of the block at ``col``; opens the block if it is new."""
        top = stack[-1] if stack else None
        if top and top[0] == col and top[1] == kind == "list" or top and top[0] == col and top[1] == kind == "map":
            add("NEXT")
            return
        if top and top[0] == col and kind == "list" and top[1] == "map" and kinds[-1] in ("KEY", "PROP", ":"):
            stack.append([col, "list"])
            add("IN")
            return
        if top and top[0] == col and top[1] == "list" and kind != "list":
            stack.pop()
            add("OUT")
            if stack and stack[-1] == [col, kind]:
                add("NEXT")
                return
            fail("indentation")
        if top and top[0] >= col:
            fail("indentation")
        stack.append([col, kind])
        add("IN")

    bom = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*")
    while at < n:
        at = bom.match(text, at).end()
        if at >= n:
            break
        m = re.compile(r"( *)(\t*)").match(text, at)
        k = m.end()
        if k >= n or text[k] == "#":
            break
        if m[2] and text[k] not in "[]{}":
            fail("tab in indentation")
        col = len(m[1])
        if not col:
            mark = re.compile(r"(---|\.\.\.)(?=\s|$)").match(text, k)
            if mark:
                close(-2)
                add("SEP" if mark[1] == "---" else "END")
                at = mark.end()
                gap = re.compile(r"[ \t]*").match(text, at)[0]
                if _AFTER.match(text, at):
                    end()
                else:
                    at += len(gap)
                    node(3 + len(gap), False)
                    if stack and stack[-1][1] == "scalar":
                        close(-2)
                continue
            if text[k] == "%" and not stack:
                add("DIRECTIVE")
                at = text.find("\n", k) + 1 or n
                continue
        at = k
        close(col)
        if stack and stack[-1][1] == "scalar":
            fail("text after a scalar")
        node(col, False)
        if stack and stack[-1][1] == "scalar":
            stack.pop()
            add("OUT")
    close(-2)
    add("EOF")
    return kinds, [False] * len(kinds), lines
