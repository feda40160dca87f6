"""Credentials in source code and settings.

Literals are taken from contexts that assign them to a name, pass them to a command or a
header, or hold them in a URL; literals of a published token format count anywhere. Each
literal is segmented into dictionary words by a Viterbi search; what no word explains is
its residual. A literal whose residual is long enough for its context is a secret. Stand-ins,
references, names, labels and limits are explained by words, so they have none; digests in
known formats are left out.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

TOKENIZER_DIR = os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers")

# Short words and stand-ins that a word list of longer words lacks.
SHORT_WORDS = frozenset(
    "a an as at be by do for has he if in is it me my no not of on or our so the to up us use was we you your key api app aws bot csv db dev dns dsn env etc get git id ini io ip iam jwt log max min net new old org pem pin prod pub pw pwd py raw ref run sdk set sha sig sms sql src ssh ssl std sub sys tls tmp tok ttl uri url usr val var web xml yml api auth bool cfg char conf config cred creds data dist file hash head hint host http https href info init item json lang len lib list local login mail main mock name none null opt pass passwd path port post prev proc redis root rsa salt sign smtp stub sudo temp test text todo token type user uuid val value vault foo bar baz qux changeme placeholder redacted fixme tbd lorem ipsum secret secrets password passphrase username example sample dummy fake foobar passwort kennwort contrasena clave motdepasse geheim".split()
)
# Words in the name of a thing that is a credential.
_SECRET = r"(?:pass(?:word|wd|phrase|code|wort|_?key)?|pwd|pw|secret|token|api[_\-.]?key|access[_\-.]?key|private[_\-.]?key|signing[_\-.]?key|encryption[_\-.]?key|master[_\-.]?key|account[_\-.]?key|shared[_\-.]?key|auth[_\-.]?key|secret[_\-.]?key|license[_\-.]?key|service[_\-.]?key|deploy[_\-.]?key|client[_\-.]?key|credentials?|creds?|kennwort|passwort|contrase(?:n|ñ)a|clave|mot[_\-.]?de[_\-.]?passe|webhook|sas|bearer|authorization)"
_NAME = re.compile(rf"(?:^|[_\-.]|(?<=[a-z0-9])(?=[A-Z]))(?i:{_SECRET})(?=$|[_\-.\d]|[A-Z]|s\b)")
# Last parts of names that hold something about a credential, not the credential.
_ABOUT = re.compile(
    r"(?i)(?:^|[_\-.]|(?<=[a-z]))(?:file|path|dir|url|uri|endpoint|host|name|names|field|input|header|ttl|type|kind|rules?|policy|min_?length|max_?length|length|max_?age|age|days|ref|refs|reference|id|ids|label|labels|hint|help|usage|regex|re|rx|pattern|patterns|env|var|variable|count|counts|limit|limits|budget|expiry|expires|expiration|expires_?(?:in|at)|timeout|store|provider|sha1|sha256|sha512|md5|hash|hashes|digest|checksum|fingerprint|public|pub|format|prefix|suffix|scope|scopes|issuer|title|text|message|error|prompt|placeholder|example|status|enabled|required|strength|size|version|location|manager|service|class|column|index|rotation|interval|attempts|retries|template|form|page|reset|link|alias|source|from)$"
)
_COUNT = re.compile(r"(?i)token[_\-.]?counts?(?![a-z])")
_SAMPLE = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|change[_\- ]?(?:me|this|it)|your[_\-]|redacted|fixme|todo|<[^>]*>|^(?:x+|\*+|\.+|-+|0+|_+|#+|\?+)$|hunter2|s3cr3t|p[a4]ssw[o0]rd\d{0,3}!?$|^secret\d{0,3}$|^(?:test|foo|bar|admin|root|guest|letmein|qwerty|abc|none|null|true|false|nil|undefined)\d{0,3}$|correct.?horse|abcdef|0123456789|123456|deadbeef|xxxx|fake|mock|insert|replace")
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|\}\}|%\(|%\w+%|<%|^\$[A-Za-z_]|^%|^@|\{\w*\}|^env[:.(]|os\.environ|getenv|process\.env|^vault[:/]|^(?:arn|ssm|secretsmanager|gcp|azure|keyring|op|file|ref|sops|doppler|kms)[:/]|^/(?:[\w.\-]+/)*[\w.\-]*$|^\./|^~/|^ENC\[|^!|secretref", re.I)
_HASH = re.compile(r"(?i)^(?:sha\d+|md5|blake\w*)[-:=]|^\$(?:1|2[abxy]?|5|6|apr1|y|argon2\w*|pbkdf2\S*|scrypt)\$|^\{(?:SSHA|SHA|MD5|CRYPT)\w*\}|^pbkdf2[_:]|^argon2|^bcrypt|^scrypt")
_HEX = re.compile(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
# Published token formats.
TOKEN_FORMATS = (
    r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{40,}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"xox[abeoprs]-[A-Za-z0-9\-]{20,}",
    r"(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}",
    r"whsec_[A-Za-z0-9+/=]{20,}",
    r"sk-(?:[a-z]+-)*[A-Za-z0-9]{20,}",
    r"AIza[A-Za-z0-9_\-]{35}",
    r"ya29\.[A-Za-z0-9_\-]{20,}",
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{30,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_\-]{40,}",
    r"dop_v1_[a-f0-9]{40,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    r"\d{8,10}:[A-Za-z0-9_\-]{33,40}",
)
_FORMAT = re.compile(r"(?<![A-Za-z0-9_\-])(?:" + "|".join(TOKEN_FORMATS) + r")(?![A-Za-z0-9_\-])")
_FORMAT_FULL = re.compile("(?:" + "|".join(TOKEN_FORMATS) + ")$")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\n|\\r|\s|[\"'`+,]|Proc-Type:[^\n\\]*|DEK-Info:[^\n\\]*|Version:[^\n\\]*)*[A-Za-z0-9+/=]{16,}")

# name, separator, optional opening bracket and string prefix, then a quoted or bare value.
_ASSIGN = re.compile(
    r"(?P<name>[A-Za-z_\u00c0-\u017f][\w.\-\u00c0-\u017f]*)(?P<close>[\"'\]]{0,2})[ \t]*(?P<type>:[ \t]*(?:str|string|String|&str)[ \t]*(?==))?(?P<sep>:=|=>|==|!=|[:=])[ \t]*(?P<open>[(\[]?\s*(?:[bBrRuUfF@](?=[\"'`]))?)"
    r"(?:\"(?P<dq>(?:[^\"\\\n]|\\.)*)\"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|`(?P<bq>[^`\n]*)`|(?P<bare>[^\s\"'`#,;(){}\[\]][^\s\"'`,;(){}\[\]]*))"
)
_SPOKEN = re.compile(r"(?i)\b(?P<name>(?:password|passwd|passphrase|secret|token|api key|access key|signing key|encryption key|credentials?|pwd|kennwort|pw|pass))(?: is| was| used to be)?[ \t]*(?:[:=]|\bis\b|\bwas\b)[ \t]*[\"'`]?(?P<bare>[^\s\"'`,;()]{6,})")
_PAIR = re.compile(r"(?i)\bname:[ \t]*[\"']?(?P<name>[\w.\-]+)[\"']?[ \t]*\n[ \t]*value:[ \t]*(?:\"(?P<dq>[^\"\n]*)\"|'(?P<sq>[^'\n]*)'|(?P<bare>[^\s#]+))")
_URL = re.compile(r"(?<=[\w+.\-])://(?P<user>[^\s/:@\"'`<>]*):(?P<bare>[^\s/@\"'`<>]+)@[\w.\-\[{$]")
_PARAM = re.compile(r"[?&](?:sig|signature|token|access_token|api_?key|key|secret|password|pwd|auth|code)=(?P<bare>[^\s&\"'`<>#)]+)", re.I)
_BEARER = re.compile(r"(?i)(?:\b(?:Bearer|Token|Basic|ApiKey)[ \t]+|x-[\w\-]*(?:key|token|secret)[\"']?[ \t]*[:=,][ \t]*[\"']?)(?P<bare>[A-Za-z0-9+/=_.:\-~]{8,})")
_FLAG = re.compile(r"(?<![\w\-])--?(?P<name>[\w\-]*(?:pass|password|passwd|pwd|secret|token|api-?key|access-?key|passphrase|auth-key)[\w\-]*)(?:=|[ \t]+)(?:\"(?P<dq>[^\"\n]*)\"|'(?P<sq>[^'\n]*)'|(?P<bare>[^\s\"'`]+))", re.I)
_LOGIN = re.compile(r"(?<![\w\-])(?:-u|--user|--proxy-user)[ \t=]+[\"']?(?P<user>[\w.@$\-]+):[\"']?(?P<bare>[^\s\"'`@]+)")
_CALL = re.compile(r"(?:set\w*|put\w*|define|add\w*|append|insert|env|header|export\w*|with\w*|getOrDefault|getenv|get|getProperty|withDefault|default)\([ \t]*[\"'`](?P<name>[\w.\-]+)[\"'`][ \t]*,[ \t]*(?:\"(?P<dq>(?:[^\"\\\n]|\\.)*)\"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|`(?P<bq>[^`\n]*)`)")
_MYSQL = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass|psql|redis-cli)\b[^\n|;]*?[ \t](?:-p|-a[ \t]+)[\"']?(?P<bare>[^\s\"'`\-][^\s\"'`]{5,})")
# Every name of a credential has one of these in it, so only words with one are read as names.
_HINT = re.compile(r"pass|pwd|pw|secret|token|key|cred|kennwort|contrase|clave|mot|webhook|sas|bearer|authorization", re.I)
_IN_NAME = re.compile(r"[\w.\-]*")
_DIGEST_WORD = re.compile(r"(?i)(?:sha[-_]?\d+|md5|blake\d|digest|checksum|fingerprint|commit|revision|integrity|etag)[\w\-]*[\"'\])]*[ \t]*(?:=>|[:=(,])?[ \t]*[\"'`]?$")
# The one threshold: characters that the cheapest segmentation into words must leave over.
RESIDUAL = 3
_QUOTED_ONLY = frozenset([".py", ".js", ".ts", ".java", ".go", ".json", ".jsx", ".tsx"])
_COMMENTED = re.compile(r"(?m:^)\s*(?:\*|/\*|--|;|<!--|[rR][eE][mM] )|#|//")
_COMMENT = re.compile(r"\s*(?:#|//|\*|/\*|--)")
_PIECE = re.compile(r"[a-z]+|[^a-z]+")


class Dictionary:
    """Words with costs, from the word entries of a public vocabulary in the order of their frequency."""

    def __init__(self, words: dict[str, float], longest: int = 18) -> None:
        self.cost, self.longest = words, longest

    @classmethod
    def load(cls, folder: str = TOKENIZER_DIR, least: int = 4) -> Dictionary:
        """Whole words of at least ``least`` letters from ``word_bpe_49k.json``, and the short words above."""
        words: dict[str, float] = {}
        with open(os.path.join(folder, "word_bpe_49k.json"), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for w, i in vocabulary.items():
            if w.endswith("</w>") and len(w) >= 4 + least and w[:-4].isalpha() and w.isascii():
                words[w[:-4]] = math.log(i + 10)
        for w in SHORT_WORDS:
            words.setdefault(w, 6.0)
        return cls(words)

    def residual(self, text: str) -> int:
        """Characters of ``text`` that the cheapest segmentation leaves to no word.

        Letters outside words cost 5 each, so that chance matches of short words inside random text don't pay
        unless they explain more than they cost; runs of one repeated character and separators are free.
        """
        left = 0
        for run in re.split(r"[\s_\-./\\:,;@=?&+~|]+", re.sub(r"(.)\1{3,}", "", text)):
            run = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", run)
            for piece in run.split():
                for part in _PIECE.findall(piece.lower()):
                    left += self._letters(part) if part[0].isalpha() and part.isascii() else len(part)
        return left

    def _letters(self, s: str) -> int:
        n, cost, longest = len(s), self.cost, self.longest
        best = [(0.0, 0)] + [(1e9, 0)] * n
        for i in range(1, n + 1):
            b, r = best[i - 1]
            here = (b + 5.0, r + 1)
            for j in range(max(0, i - longest), i):
                c = cost.get(s[j:i])
                if c is not None:
                    b, r = best[j]
                    if b + c < here[0]:
                        here = (b + c, r)
            best[i] = here
        return best[n][1]


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str


def _name_is_secret(name: str) -> bool:
    base = re.sub(r"[_\-]?\d+$", "", name)
    return bool(_NAME.search(base)) and not _ABOUT.search(base) and not _COUNT.search(base)


def _names(text: str, hints: list[tuple[int, int]]) -> Iterator[int]:
    """Where the words around ``hints`` that may name a credential begin."""
    end = 0
    for at, stop in hints:
        if at < end:
            continue
        while at and (text[at - 1].isalnum() or text[at - 1] in "_.-"):
            at -= 1
        end = _IN_NAME.match(text, stop).end()
        while at < end and not (text[at] == "_" or text[at].isascii() and text[at].isalpha() or "\u00c0" <= text[at] <= "\u017f"):
            at += 1
        yield at


def _is_value(value: str, dictionary: Dictionary) -> bool:
    """Whether a literal in the place of a credential is one."""
    v = value.strip()
    if len(v) < 6 or _REFERENCE.search(v) or _HASH.search(v):
        return False
    if _FORMAT_FULL.match(v):
        return not re.search(r"(?i)example|0{6}|x{6}|1234567", v) and dictionary.residual(v) >= RESIDUAL
    if _SAMPLE.search(v) and not (len(v) > 20 and dictionary.residual(v) > 16 and not re.search(r"(?i)example|sample|dummy|your|placeholder|changeme|redacted|<", v)):
        return False
    if re.match(r"[a-zA-Z][\w+.\-]*://", v) or len(re.findall(r"\s", v)) > 2:
        return False
    if v.isdigit() and len(v) < 8:
        return False
    return dictionary.residual(v) >= RESIDUAL


def find_secrets(text: str, path: str, dictionary: Dictionary) -> list[Span]:
    """Spans of the values of credentials in a text, not overlapping, in order."""
    found: list[Span] = []
    suffix = os.path.splitext(path.lower())[1]
    code = suffix in _QUOTED_ONLY

    def value(m: re.Match) -> tuple[str, int, int, bool]:
        for g in ("dq", "sq", "bq", "bare"):
            if g in m.re.groupindex and m[g] is not None:
                return m[g], m.start(g), m.end(g), g == "bare"
        return "", 0, 0, True

    def line_of(at: int) -> str:
        a = text.rfind("\n", 0, at) + 1
        b = text.find("\n", at)
        return text[a : b if b >= 0 else len(text)]

    def secret(v: str, a: int) -> bool:
        """Whether a value is one; bare digests behind a word for a digest are not."""
        if not _is_value(v, dictionary):
            return False
        return not (_HEX.match(v) and _DIGEST_WORD.search(text[text.rfind("\n", 0, a) + 1 : a]))

    # What each expression can't do without is looked for first: it is quicker and leaves nothing out.
    low = text.casefold()
    hints = [m.span() for m in _HINT.finditer(text)]
    for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
        if not _PEM_BODY.match(text, m.end()):
            continue
        end = _PEM_END.search(text, m.end())
        nxt = _PEM.search(text, m.end())
        stop = end.end() if end and (not nxt or end.start() < nxt.start()) else m.end() + len(_PEM_BODY.match(text, m.end())[0])
        body = _PEM_END.sub("", text[m.end() : stop])
        if re.search(r"(?i)example|dummy|placeholder|redacted", body) or len(set(re.findall(r"\w", re.sub(r"\\[nr]", "", body)))) < 4 or dictionary.residual(body) < RESIDUAL:
            continue  # a stand-in, or masked
        found.append(Span(m.start(), stop, "private key"))
    for m in _FORMAT.finditer(text):
        v = m[0]
        if re.search(r"(?i)example|0{6}|x{6}|1234567", v) or dictionary.residual(v) < RESIDUAL:
            continue
        if v.startswith("eyJ") or not v[0].isdigit() or re.search(r"(?i)token|bot|key|secret|pass|auth|bearer|kennwort|pw", line_of(m.start())):
            found.append(Span(m.start(), m.end(), "token"))
    for m in _URL.finditer(text) if "://" in text and "@" in text else ():
        v, a, b, _ = value(m)
        user = m["user"]
        if (v.isupper() and v.isalpha()) or _REFERENCE.search(v) or v.lower() == user.lower():
            continue
        if secret(v, a):
            found.append(Span(a, b, "url"))
    for rx, there in ((_BEARER, any(w in low for w in ("bearer", "token", "basic", "apikey", "x-"))), (_PARAM, "?" in text or "&" in text)):
        for m in rx.finditer(text) if there else ():
            v, a, b, _ = value(m)
            if secret(v, a) and not _UUID.match(v):
                found.append(Span(a, b, "header" if rx is _BEARER else "url"))
    for m in _FLAG.finditer(text) if hints and "-" in text else ():
        v, a, b, _ = value(m)
        if _name_is_secret(m["name"].lstrip("-")) and secret(v, a):
            found.append(Span(a, b, "command"))
    for rx, there in ((_LOGIN, "-u" in text or "--proxy-user" in text), (_MYSQL, any(w in text for w in ("mysql", "mariadb", "sshpass", "psql", "redis-cli")))):
        for m in rx.finditer(text) if there else ():
            v, a, b, _ = value(m)
            if secret(v, a):
                found.append(Span(a, b, "command"))
    for rx, there in ((_PAIR, "value:" in low), (_CALL, "(" in text)):
        for m in rx.finditer(text) if hints and there else ():
            v, a, b, _ = value(m)
            if _name_is_secret(m["name"]) and secret(v, a):
                found.append(Span(a, b, "setting"))
    at = 0
    for begin in _names(text, hints):
        m = _ASSIGN.match(text, begin) if begin >= at else None
        if m is None or m["sep"] in ("==", "!=") or not _name_is_secret(m["name"].rsplit(".", 1)[-1]):
            continue
        v, a, b, bare = value(m)
        if bare and ("\n" in m["open"] or m["open"].strip()):
            continue
        if bare and code and not _COMMENT.match(line_of(m.start())):
            continue
        if m["open"].lstrip().startswith(("(", "[")) and not bare:
            # a literal in pieces: the value is what the pieces make
            more = re.compile(r"(?:[\"'`]\s*(?:\+|\\)?\s*[\"'`]([^\"'`\n]*))+").match(text, b)
            whole = v + "".join(re.findall(r"[\"'`]\s*[+\\]?\s*[\"'`]([^\"'`\n]*)", more[0])) if more else v
            if secret(whole, a):
                found.append(Span(a, more.end() if more else b, "assignment"))
                at = b
            continue
        more = re.compile(r"[\"'`](?:\s*(?:\+|\\)\s*[\"'`][^\"'`\n]*[\"'`]|\s*[\"'`][^\"'`\n]+[\"'`](?=\s*[);\n]))+").match(text, b) if not bare else None
        whole = v + "".join(re.findall(r"[\"'`]([^\"'`\n]+)[\"'`]", more[0][1:])) if more else v
        if secret(whole, a):
            found.append(Span(a, more.end() - 1 if more else b, "assignment"))
            at = b
    done = -1
    for at, _ in hints:  # comments that speak of one
        if at < done:
            continue
        first, done = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        done = len(text) if done < 0 else done
        marked = _COMMENTED.search(text, first, done)
        for m in _SPOKEN.finditer(text, first, done) if marked else ():
            if marked.start() < m.start() or marked.start() == first:
                v, a, b, _ = value(m)
                v = v.rstrip(".)")
                if secret(v, a):
                    found.append(Span(a, a + len(v), "comment"))
    found.sort(key=lambda s: (s.start, -s.end))
    out: list[Span] = []
    for s in found:
        if out and s.start < out[-1].end:
            if s.end > out[-1].end:
                out[-1] = Span(out[-1].start, s.end, out[-1].kind)
        else:
            out.append(s)
    return out


def redact(text: str, spans: list[Span]) -> str:
    """The text with every letter and digit of the spans replaced by X; marks of keys, quotes, line breaks and escapes stay."""
    parts, at = [], 0
    for s in spans:
        parts.append(text[at : s.start])
        value = text[s.start : s.end]
        if s.kind == "private key":
            head = _PEM.match(value)
            tail = _PEM_END.search(value)
            a, b = head.end(), tail.start() if tail else len(value)
            body = re.sub(r"\\[nr]|[A-Za-z0-9+/=]", lambda m: m[0] if len(m[0]) > 1 else "X", value[a:b])
            parts.append(value[:a] + body + value[b:])
        else:
            parts.append(re.sub(r"([\"'`]\s*[+\\]?\s*[\"'`])|[^\s\"'`]", lambda m: m[0] if m[1] else "X", value))
        at = s.end
    parts.append(text[at:])
    return "".join(parts)


FOUND = "payload_id bigint, line_number bigint, kind string"
REDACTED = "payload_id bigint, n_secrets int, content string"
_NARROW = ("payload_id", "path", "content")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("payload_id").cast("bigint").alias("payload_id"), F.coalesce(F.col("path"), F.lit("")).alias("path"), F.col("content").cast("string").alias("content"))


def secret_lines(df: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``FOUND``: one row per line of a file on which a credential's value starts, lines split at ``\\n`` from 1.

    Null and empty contents and an empty table give no rows; every row counts for itself,
    also repeated ones; a null path is a file without suffix. Whole texts are read, one
    batch at a time; nothing is shuffled. The dictionary (at most 50,000 words) is read
    from ``folder`` once a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary.load(folder)
        for b in batches:
            ids, lines, kinds = [], [], []
            for i, path, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seen: dict[int, str] = {}
                for s in find_secrets(text, path, dictionary):
                    seen.setdefault(text.count("\n", 0, s.start) + 1, s.kind)
                for line, kind in seen.items():
                    ids.append(i)
                    lines.append(line)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(kinds, pa.string())], ["payload_id", "line_number", "kind"])

    return spread(_rows(df).where("content IS NOT NULL"), "payload_id").mapInArrow(run, FOUND)


def redacted_files(df: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``REDACTED``: every file with its number of secrets and its text, secrets masked and all else unchanged.

    Null contents stay null with 0 secrets. Lengths and line numbers don't change.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary.load(folder)
        for b in batches:
            counts, texts = [], []
            for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = find_secrets(text, path, dictionary) if text else []
                counts.append(len(spans))
                texts.append(redact(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], ["payload_id", "n_secrets", "content"])

    return spread(_rows(df), "payload_id").mapInArrow(run, REDACTED)
