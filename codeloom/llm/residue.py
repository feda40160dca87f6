"""Template residue, filler, error pages and requests to allow scripts.

Texts are cut into messages (sentences of lines). Messages are mined into templates with a
prefix tree of fixed depth: the path to a leaf is the number of tokens and the first two
tokens; within a leaf, messages that agree in enough positions share a template, in which
the other positions are wildcards. Each template gets one verdict, which goes to every
message of it, so to every document. Placeholders in otherwise ordinary messages are
detected separately, and the template decides about them: where other messages have an
ordinary value in that place, the placeholder was left unfilled; where the placeholder
belongs to the wording itself, the sentence may be about placeholders.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import kept, shuffle_partitions, spread

# Openings of messages that stand where content should be, in lower case,
# with <*> for numbers, ids and paths. A message has to begin with one.
ERROR_OPENINGS = (
    r"(?:http |error )?(?:<\*> )?(?:[-:] )?(?:bad gateway|not found|internal server error|forbidden|service unavailable|gateway time-?out|unauthori[sz]ed|too many requests|access denied|permission denied|page not found|bad request|request time-?out|payment required|method not allowed)\W*$",
    r"the page you(?:'re| are| have)? (?:requested|looking for|are looking for)",
    r"(?:the|this) (?:requested )?(?:page|url|resource|file) (?:could not be|cannot be|can't be|was not|does not|doesn't|no longer)",
    r"that page can'?t be found",
    r"it may have been (?:moved|deleted|removed)",
    r"(?:oops|whoops|uh-?oh|sorry)(?:[!.,:]|$)",
    r"try searching instead",
    r"(?:something|an error|an unexpected error) (?:went wrong|occurred|has occurred|happened)",
    r"please try again (?:later|in a)",
    r"slow down and retry",
    r"(?:this |the )?(?:service|site|server|page|application|website) (?:is )?(?:currently |temporarily )?(?:unavailable|down|offline)",
    r"(?:we are|we're) (?:currently )?down for maintenance",
    r"your (?:session|login|token|account) (?:has|have|is) (?:expired|been)",
    r"please (?:sign|log) ?in (?:again|to)",
    r"you (?:do not|don't|are not|aren't) (?:have |authori[sz]ed|allowed|permitted)(?:.*(?:permission|access|resource|page)|$)",
    r"this account has been suspended",
    r"contact the site administrator",
    r"gateway time-?out",
    r"the (?:upstream )?server (?:sent|did not|didn't|encountered|is temporarily|returned|cannot|could not)",
    r"(?:warning|fatal error|notice|parse error): .*(?:failed|refused|undefined|denied|unexpected)",
    r"traceback \(most recent call last\)",
    r"\w*(?:error|exception|missing): ?\S+$",
    r"<error>",
    r"too many requests",
    r"seite nicht gefunden\W*$", r"die angeforderte seite", r"zugriff verweigert\W*$", r"sie haben keine berechtigung", r"interner serverfehler", r"bitte versuchen sie es", r"ihre sitzung ist", r"bitte melden sie sich", r"(?:der dienst|diese seite) ist (?:derzeit|momentan|vorübergehend)", r"zu viele anfragen",
    r"page (?:introuvable|non trouvée)\W*$", r"la page (?:demandée|que vous)", r"accès (?:refusé|interdit)\W*$", r"vous n'avez pas (?:l'autorisation|la permission|le droit|accès)", r"erreur interne", r"veuillez (?:réessayer|vous reconnecter|vous connecter)", r"votre \S+ (?:a expiré|est expirée?)", r"(?:le )?service (?:temporairement )?indisponible", r"trop de requêtes",
    r"página no encontrada\W*$", r"la página (?:solicitada|que busca)", r"acceso denegado\W*$", r"(?:usted )?no tiene permiso", r"error interno del servidor", r"(?:por favor, )?int[ée]ntelo de nuevo", r"su sesión ha", r"inicie sesión", r"(?:el )?servicio (?:temporalmente )?no disponible", r"demasiadas (?:solicitudes|peticiones)",
)
SCRIPT_OPENINGS = (
    r"(?:please |you need to |you must |you have to )?(?:enable|activate|turn on|switch on|allow) (?:javascript|scripts|cookies)",
    r"javascript (?:is|must be|has been|needs to be|seems to be) ",
    r"this (?:site|app|page|application|website) (?:requires|needs|works best with|uses) (?:scripts|javascript|cookies)",
    r"your browser (?:does not|doesn't) support",
    r"scripts (?:and cookies )?(?:must|have to|need to|are) (?:be )?(?:allowed|enabled|disabled|blocked)",
    r"turn it on and reload",
    r"checking your browser",
    r"loading ?(?:\.\.\.|…)(?: \(|\W*$)",
    r"(?:bitte )?(?:aktivieren|schalten) sie (?:bitte )?(?:javascript|skripte)", r"diese (?:anwendung|seite|website) (?:benötigt|erfordert) (?:javascript|skripte)", r"(?:skripte|javascript) (?:sind|ist) in ihrem browser", r"ohne sie wird nichts",
    r"(?:veuillez |merci d')?activer? javascript", r"(?:cette|ce) (?:application|page|site) (?:nécessite|requiert|a besoin de) javascript", r"les scripts sont (?:bloqués|désactivés)",
    r"(?:por favor, )?active javascript", r"(?:esta|este) (?:aplicación|página|sitio) (?:necesita|requiere) javascript", r"los scripts están",
)
FILLER_OPENINGS = (
    r"lorem ipsum",
    r"sample (?:paragraph|text)\b", r"replace this (?:with|by|text)", r"your (?:text|description|title|content|name) (?:goes )?here\W*$", r"(?:text|description|content|title) goes here\W*$", r"(?:this is )?(?:a )?placeholder\b(?: text)?(?: for| goes|\W*$)", r"insert (?:your )?(?:text|content) here", r"coming soon\W*$",
    r"platzhaltertext", r"hier steht (?:später|bald)", r"hier (?:könnte|kommt) (?:ihr|der) text", r"beispieltext\W*$", r"blindtext",
    r"texte (?:provisoire|d'exemple|à remplacer)", r"votre texte ici", r"exemple de paragraphe", r"paragraphe d'exemple",
    r"texto (?:provisional|de ejemplo|de relleno|de muestra)", r"(?:su|tu) texto aquí", r"párrafo de ejemplo", r"aquí (?:va|irá) el texto", r"ejemplo de párrafo",
)
# Words by which a sentence speaks about placeholders.
META = re.compile(
    r"\b(?:templates?|placeholders?|markers?|rows marked|format|the form|accepts dates|dates (?:as|in)|variables?|settings file|stands? for|settings|write|command|usage|syntax|served under|--\w+|[a-z]+ scan|commande|modèles?|fichier|désigne|plantillas?|variable|apunta|significa|archivo|vorlagen?|schreibt|datei|platzhalter|befehl|meint|ruta|route|never|instead of)\b",
    re.I,
)
# Names every system sets; a reference to one isn't an unfilled slot.
_ENV = r"(?:HOME|PATH|USER|TEMP|TMP|TMPDIR|PWD|SHELL|LANG|APPDATA|USERPROFILE|FILES)"
# How slots look.
SLOT = re.compile(
    r"\{\{\{?\s*[\w.\-]+\s*\}?\}\}|\{%-?\s*[\w. ]+?\s*-?%\}|<%=?\s*[\w. ]+?\s*%>"
    rf"|[$#]\{{(?!{_ENV}\}})\s*[\w.\-]+\s*\}}|\$\[[\w.]+\]|(?<![\w/$#{{])\{{[a-z_]\w*\}}(?![/}}])|%(?!{_ENV}%)[A-Z][A-Z_]+%|%\(\w+\)[sdif]|@@[A-Z_]+@@|(?<!\w)__[A-Z][A-Z_]*__(?!\w)"
    r"|\[\[\w+\]\]|\[[A-Z][A-Z_]{2,}\](?![(\[])|<[A-Z][A-Z_]*>|<\.\.\.>|\[\.\.\.\](?=\s*$)"
    r"|<(?:insert|enter|add|your|put|fill|type|name|nom|nombre|votre|su|ihr)\s[^<>\n]{1,40}>|<[^<>\n]{2,30}\s(?:here|eintragen|einfügen|einsetzen|ici|aquí|name)>"
    r"|\[(?i:insert|enter|add|your|put|fill|type|name|date|hier|insérer|saisir|ajouter|votre|insertar|introducir|añadir|su|ihr)\s[^\[\]\n]{1,40}\](?!\()|\[(?i:à compléter|à remplir|por completar|por rellenar|pendiente|beschreibung folgt|folgt|wird ergänzt|tbd|todo|to be completed|to do|placeholder)\]"
    r"|\((?:add|insert|enter|fill in|your)\s\w+(?: here)?\)|(?<![\w_])_{3,}(?![\w_])|\b(?:TODO|TBD|FIXME): ?(?:describe|add|fill|write|insert|explain|complete|replace)\b(?: the \w+)?"
    r"|\b(?:yyyy-mm-dd|dd\.mm\.yyyy|mm/dd/yyyy|jj/mm/aaaa|tt\.mm\.jjjj|dd/mm/aaaa)\b"
)
VALUE = r"(?:None|null|undefined|NaN|\[object Object\]|Invalid Date)"
_VALUE = re.compile(rf"^{VALUE}(?=$|[,:.]|\s(?!of\b))|(?<=\w:\s){VALUE}(?=$|[,.;])|\b(?:for|by|on|from) {VALUE}(?=[:,]|\.?$)|(?<!\w)Invalid Date\.?$")
_EMPTY = re.compile(r"^(?:Dear|Hello|Hi|Hallo|Liebe[r]?|Bonjour|Cher|Chère|Hola|Estimad[oa])\s+,|\b(?:for|in|by)\s{2,}\S")
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|(?<!\w)'[^'\n]{2,}'(?!\w)|‘[^’\n]*’")
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)|\[[^\]\n]*\]\[[^\]\n]*\]|\[\[[^\]\n]*\s[^\]\n]*\]\]|\[[xX ]\](?=\s)|\[\^?\d+\]|https?://\S+|(?<!\S)/[\w{}<>:.\-]+(?:/[\w{}<>:.\-]*)+|\b\w+<\w+(?:, ?\w+)*>")
_PREFIX = re.compile(r"^(?:\s{0,3}(?:[-*+>]|#{1,6}|\d{1,3}[.)]|@[\w-]+)\s+)+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-ÝŒ¿¡„“\"«<\[{(@%$_#])")
# A member of a JSON object, up to the end of a plain value or the opening of a nested one.
_MEMBER = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"?|\[\s*\]|\{\s*\}|[^,{}\[\]"]*)')
_NOTHING = frozenset(["null", "false", "0", '""', "[]", "{}"])
# Keys of bodies whose value says what happened, and keys that only errors have.
_SAYING = frozenset("message msg detail details title description reason error error_description errormessage error_message".split())
_ERROR_KEY = re.compile(r'"(?:errors?|error_?(?:code|message|description|type)|fault(?:string|code)?|exception|stack_?trace|traceback)": (?!nothing(?: |$))')
_SAID = re.compile(rf'"(?:{"|".join(sorted(_SAYING))})": ([^"]+)')
_OPAQUE = re.compile(r"[\d/\\]")
# What a match of the expressions above can't do without; looked for first, since most sentences have none of it.
_SLOT_SIGN = re.compile(r"[{%<$#@\[(_]|TODO|TBD|FIXME|yyyy|dd[./]|mm/|jj/|tt\.")
_QUOTE_SIGN = re.compile(r"[`\"“„«'‘]")
_LINK_SIGN = re.compile(r"[\[/<]")
_VALUE_SIGN = re.compile(r"None|null|undefined|NaN|Object\]|Invalid Date")
_EMPTY_SIGN = re.compile(r"^(?:Dear|H|Lieb|Bonjour|Ch|Estimad)|\s{2}")
_JSON = re.compile(r'\{\s*"')
_WORD = re.compile(r"[^\W\d_]+")
# Words of the usual Latin filler that English, German, French and Spanish don't use as ordinary words.
LATIN = frozenset("lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum nec porta vestra".split())

WILD = "<*>"
# The depth of the tree below the length, and the share of positions in which a message agrees with its template.
DEPTH, ALIKE = 2, 0.7
# kind: 0 plain, 1 with a placeholder, 2 filler
MESSAGES = "doc_id bigint, kind int, message string"


def _filler(line: str) -> bool:
    """One word again and again, or mostly Latin filler."""
    words = _WORD.findall(line.lower())
    if len(words) >= 4 and len(set(words)) == 1:
        return True
    if len(words) < 5:
        return False
    latin = [w for w in words if w in LATIN]
    return len(set(latin)) >= 3 and len(latin) >= 0.2 * len(words)


def _body(s: str) -> tuple[int, str]:
    """(kind, message) of a JSON body: its keys in order; values are masked, except the words of those that tell what happened."""
    slots: list[str] = []

    def put(m: re.Match) -> str:
        slots.append("<slot>" + re.sub(r"\s+", "_", m[0]))
        return f"\0{len(slots) - 1}\0"

    tokens = ["<json>"]
    for m in _MEMBER.finditer(SLOT.sub(put, s)):
        key, value = re.sub(r"\s+", "_", m[1].lower()), m[2].strip()
        tokens.append(f'"{key}":')
        held = [slots[int(i)] for i in re.findall(r"\0(\d+)\0", value)]
        words = re.sub(r"\0\d+\0", " ", value).strip('"').replace('"', "").split()
        if value.lower() in _NOTHING:
            tokens.append("nothing")
        elif key in _SAYING and words:
            tokens += ["<*>" if _OPAQUE.search(w) else w for w in words]
        elif not held:
            tokens.append("<*>")
        tokens += held
    tokens += [x for x in slots if x not in tokens]  # in keys and lists
    return int(bool(slots)), " ".join(re.sub(r"\0\d+\0", "<*>", t) for t in tokens)


def _mask(s: str) -> tuple[int, str] | None:
    """(kind, masked message) of one sentence."""
    if s.startswith("{") and _JSON.match(s):
        return _body(s)
    if s.startswith("<Error>"):
        s = "<Error> " + s[7:]
    plain = _QUOTED.sub("<q>", s) if _QUOTE_SIGN.search(s) else s
    plain = _LINK.sub("<*>", plain) if _LINK_SIGN.search(plain) else plain
    slots: list[str] = []

    def put(m: re.Match) -> str:
        slots.append(m[0])
        return " <slot>" + re.sub(r"\s+", "_", m[0]) + " "

    masked = SLOT.sub(put, plain) if _SLOT_SIGN.search(plain) else plain
    if not slots and _VALUE_SIGN.search(s) and _VALUE.search(s):
        masked = "<slot>value " + masked
        slots.append("value")
    tokens = masked.split()
    if slots or _OPAQUE.search(masked):
        tokens = [t if t.startswith("<slot>") else "<*>" if not t.isalpha() and _OPAQUE.search(t) else t for t in tokens]
    return (int(bool(slots)), " ".join(tokens)) if tokens else None


def _line(body: str) -> tuple[tuple[int, str], ...]:
    """The messages of one line without its list or heading mark."""
    out = []
    if _filler(body):
        out.append((2, "filler"))  # random words have no template
    if _EMPTY_SIGN.search(body) and _EMPTY.search(body) and not body.lstrip().startswith(("|", "-")):
        out.append((1, "<slot>empty"))
    out += [m for s in _SENTENCE.split(body.strip()) if (m := _mask(s.strip()))]
    return tuple(out)


# Lines repeat a lot between documents; the memory of them is bounded, and forgetting changes nothing.
_remembered = functools.lru_cache(maxsize=100_000)(_line)


def messages(text: str | None) -> Iterator[tuple[int, str]]:
    """(kind, masked message) of a text, outside code blocks. Numbers, ids and paths are ``<*>``, quotations ``<q>``, a placeholder is one token ``<slot>...``."""
    if not text or not text.strip():
        return
    fence = False
    before = ""
    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = raw.rstrip()
        body = _PREFIX.sub("", line)
        if body.lstrip().startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence or not body.strip():
            continue
        if line.startswith(("    ", "\t")) and before.endswith(":"):
            continue  # an indented sample
        if not line.startswith((" ", "\t")):
            before = line
        yield from _remembered(body) if len(body) <= 1000 else _line(body)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "kind", "message"]
    for b in batches:
        ids, kinds, texts = [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for kind, m in set(messages(t)):
                ids.append(d)
                kinds.append(kind)
                texts.append(m)
            if len(ids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], names)
                ids, kinds, texts = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], names)


class Leaf:
    """Templates of messages of one length, in the order in which the messages come.

    A message joins the template with which it agrees in most positions, wildcards included,
    if they are at least ``alike`` of all; the earlier template wins a tie. With at most k
    positions in which they may differ, a message and its template agree in at least one of
    any k + 1 groups of positions as a whole. So templates are listed under the constants of
    each group, by the group's pattern of wildcards, and only those listed are compared.
    """

    def __init__(self, n: int, alike: float) -> None:
        self.need = max(1, math.ceil(alike * n))
        k = n - self.need + 1
        self.groups = [tuple(range(i, n, k)) for i in range(k)]
        self.templates: list[list[str]] = []
        self.listed: list[dict[tuple[int, ...], dict[tuple[str, ...], list[int]]]] = [{} for _ in self.groups]

    def _list(self, c: int, g: int) -> None:
        t = self.templates[c]
        fixed = tuple(i for i in self.groups[g] if t[i] != WILD)
        self.listed[g].setdefault(fixed, {}).setdefault(tuple(t[i] for i in fixed), []).append(c)

    def add(self, t: list[str]) -> int:
        near = {c for by_pattern in self.listed for fixed, found in by_pattern.items() for c in found.get(tuple(t[i] for i in fixed), ())}
        best, score = -1, self.need - 1
        for c in sorted(near):
            same = sum(a == b or a == WILD for a, b in zip(self.templates[c], t, strict=True))
            if same > score:
                best, score = c, same
                if same == len(t):
                    break
        if best < 0:
            best = len(self.templates)
            self.templates.append(list(t))
            for g in range(len(self.groups)):
                self._list(best, g)
            return best
        own = self.templates[best]
        changed = [i for i, (a, b) in enumerate(zip(own, t, strict=True)) if a != b and a != WILD]
        for i in changed:
            own[i] = WILD
        for g in {i % len(self.groups) for i in changed}:
            self._list(best, g)
        return best


def mine(tokens: list[list[str]], alike: float = ALIKE) -> list[list[str]]:
    """Template of each message of one leaf; messages come in a fixed order."""
    if not tokens:
        return []
    leaf = Leaf(len(tokens[0]), alike)
    of = [leaf.add(t) for t in tokens]
    return [leaf.templates[c] for c in of]


_RESIDUE = [("error", re.compile("|".join(f"(?:{p})" for p in ERROR_OPENINGS))), ("scripts", re.compile("|".join(f"(?:{p})" for p in SCRIPT_OPENINGS))), ("filler", re.compile("|".join(f"(?:{p})" for p in FILLER_OPENINGS)))]


def classify(template: list[str]) -> str:
    """Verdict on a template: error, scripts, filler or ordinary."""
    text = " ".join(template).lower()
    if text.startswith("<json> "):
        if _ERROR_KEY.search(text):
            return "error"
        return next((v for said in _SAID.findall(text) for v, rx in _RESIDUE if rx.match(said.strip())), "ordinary")
    for verdict, rx in _RESIDUE:
        if rx.match(text):
            return verdict
    return "ordinary"


def slot_verdict(template: list[str], message: list[str]) -> str:
    """Verdict on the placeholders of a message, given its template."""
    at = [i for i, t in enumerate(message) if t.startswith("<slot>")]
    if any(template[i] == "<*>" for i in at):
        return "slot"  # others have an ordinary value there
    rest = " ".join(t for i, t in enumerate(message) if i not in at)
    return "ordinary" if META.search(rest) else "slot"


def _grouped(batches: Iterator[pa.RecordBatch], alike: float) -> Iterator[tuple[list[tuple], list[list[str]]]]:
    """(rows, template of each) of each group of rows, which come sorted by their first column; the second is the text."""
    group, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[0] != group:
                if rows:
                    yield rows, mine([x[1].split(" ") for x in rows], alike)
                group, rows = r[0], []
            rows.append(r)
    if rows:
        yield rows, mine([x[1].split(" ") for x in rows], alike)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, message, leaf, kind) sorted by part -> (leaf, part's template, message, kind)."""
    for rows, templates in _grouped(batches, ALIKE):
        yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array([" ".join(t) for t in templates], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())], ["leaf", "part_template", "message", "kind"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, part's template) sorted by leaf -> (leaf, part's template, leaf's template, its verdict)."""
    for rows, templates in _grouped(batches, ALIKE):
        verdict: dict[str, str] = {}
        names = [" ".join(t) for t in templates]
        for name, t in zip(names, templates, strict=True):
            if name not in verdict:
                verdict[name] = classify(t)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(names, pa.string()), pa.array([verdict[x] for x in names], pa.string())], ["leaf", "part_template", "template", "verdict"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (message, template, verdict): ordinary ones have a placeholder, about which the template decides."""
    for b in batches:
        m, t, v = (b.column(i).to_pylist() for i in range(3))
        out = [slot_verdict(y.split(" "), x.split(" ")) if z == "ordinary" else z for x, y, z in zip(m, t, v, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(1)], ["message", "verdict", "template"])


def template_verdicts(found: DataFrame, parts: int = 64) -> DataFrame:
    """``message, verdict, template`` of every distinct message whose verdict isn't ordinary.

    ``found`` has the columns of ``MESSAGES``. Equal messages are folded before the shuffle.
    Every leaf, of whatever size, is mined in ``parts`` parts by the messages' hash, and the
    templates of its parts are then mined once more into those of the leaf; so no task holds
    the messages of a hot leaf, and templates and verdicts don't depend on the corpus' size.
    """
    n = shuffle_partitions(found.sparkSession)
    words = F.split("message", " ")
    first = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    free = lambda c: F.when(c.startswith("<slot>"), F.lit(WILD)).otherwise(c)
    distinct = found.where("kind < 2").groupBy("message").agg(F.max("kind").alias("kind"))
    leaves = distinct.withColumn("leaf", F.xxhash64(F.size(words), *[free(first(i)) for i in range(DEPTH)]))
    keyed = leaves.select(F.xxhash64("leaf", F.pmod(F.xxhash64("message"), F.lit(parts))).alias("part"), "message", "leaf", "kind")
    mined = kept(keyed.repartition(n, "part").sortWithinPartitions("part", "message").mapInArrow(_parts, "leaf bigint, part_template string, message string, kind int"))
    whole = mined.select("leaf", "part_template").distinct().repartition(n, "leaf").sortWithinPartitions("leaf", "part_template").mapInArrow(_merge, "leaf bigint, part_template string, template string, verdict string")
    told = mined.join(whole, ["leaf", "part_template"]).where("verdict <> 'ordinary' OR kind = 1").select("message", "template", "verdict")
    return told.mapInArrow(_slots, "message string, verdict string, template string").where("verdict <> 'ordinary'")


def residue_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", salt: int = 16) -> DataFrame:
    """``doc_id, verdict``: documents with residue, one row for each kind of verdict.

    Verdicts: ``slot``, ``error``, ``scripts``, ``filler``. Null, empty and blank texts and
    an empty table give no rows; repeated documents count each for itself; rows with the
    same id are one document. Whole texts are read. A message that a third of all documents
    share is joined in ``salt`` parts.
    """
    # A table in the shared folder: messages are used twice, texts are cut once.
    found = kept(spread(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL"), "doc_id").mapInArrow(_explode, MESSAGES))
    lines = df.sparkSession.createDataFrame([("filler", "filler")], "message string, verdict string")
    verdicts = template_verdicts(found).select("message", "verdict").unionByName(lines).select(F.xxhash64("message").alias("_m"), "message", "verdict").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    rows = found.select("doc_id", "message", F.xxhash64("message").alias("_m"), F.pmod(F.xxhash64("doc_id"), F.lit(salt)).cast("int").alias("_salt"))
    return rows.join(verdicts, ["_m", "_salt", "message"]).select("doc_id", "verdict").distinct()
