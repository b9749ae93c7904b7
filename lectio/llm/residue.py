"""Template residue, filler, error pages and demands for scripts in place of content (problem 5).

Unfilled placeholders are found by one grammar per delimiter, wherever they stand, and are discounted where the text
shows them on purpose: inside quotation marks or back ticks, in a code block (fenced, indented below a line that ends
with a colon, or between code or pre tags), or sparsely beside words of a tutorial. Filler is a run of Lorem-ipsum words,
or a short line that says it is filler. Error messages and demands for scripts must fill a line of their own: in the
running sentence of an article they are its subject, unless such sentences hold most of the words of the text. A note that one part of a page (comments, a player) needs scripts
is no demand.

Null, empty and blank texts are never residue. The test of a text depends on the text alone: one map, no shuffle;
repeated rows are judged each, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

_NAME = r"[A-Za-z_][\w.\-/ ]{0,60}"
#: One grammar per delimiter.
GRAMMARS = (
    rf"\{{\{{[#/^&>!]?\s*{_NAME}\}}\}}",  # {{name}}
    rf"\{{%-?\s*[a-z]\w*[^%{{}}\n]{{0,60}}%\}}",  # {% block %}
    rf"<%[=\-#]?\s*{_NAME}[^%<>\n]{{0,40}}%>",  # <%= name %>
    r"\$\{\s*[A-Za-z_][\w.]{0,60}\s*\}",  # ${name}
    r"#\{\s*[A-Za-z_][\w.]{0,60}\s*\}",  # #{name}
    r"%%[A-Z][A-Z0-9_]{2,40}%%",  # %%NAME%%
    r"__[A-Z][A-Z0-9_]{2,40}__",  # __NAME__
    r"@@[A-Z][A-Z0-9_]{2,40}@@",  # @@NAME@@
    r"\[\[\s*[A-Z][A-Z0-9 _]{2,40}\]\]",  # [[NAME]]
    r"\$[a-z][a-z_]{2,30}\$",  # $name$
    r"%\([a-z][a-z_]{1,30}\)[sdif]\b",  # %(name)s
    r"\{\d\}(?: [\w:,]+){1,5} \{\d\}",  # {0} of {1}
    r"\[(?i:your|insert|enter|add|type|paste|replace|put)\b[^\]\[\n]{2,60}\]",  # [Insert text here]
    r"(?:<|&lt;)(?i:enter|insert|your|add|type|paste|put)\b[^<>&\n]{2,60}(?:>|&gt;)",  # <enter text>
    r"<!--\s*[^<>\n]{0,60}\b(?i:here|content|placeholder|todo|insert)\b[^<>\n]{0,60}-->",  # <!-- text goes here -->
    r"\bTODO:\s",
    r"\bXXX [^X\n]{2,60} XXX\b",
)
PLACEHOLDER = re.compile("|".join(f"(?:{g})" for g in GRAMMARS))
#: In a message field, also printf fields, single braces, <NAME> and a bracketed stand-in for the whole value.
ERROR_TEMPLATE = re.compile(
    PLACEHOLDER.pattern + r"|%[dsif]\b|\{\w+\}|<[A-Z][A-Z_]{2,}>|\{\w+\.\w+\}|^\s*\[[a-z]+ (?:text|message|name|code)\]\s*$|^\s*(?:TODO|FIXME|TBD)\b"
)
_SHOWN = re.compile(r"[\"'`“‘«„]\s*$")
_TUTORIAL = re.compile(r"(?i)\b(?:templates?|placeholders?|syntax|snippets?|tutorials?|delimiters?|curly|braces|template engine|variables?|<code|```)\b")

#: The words of the Lorem-ipsum text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit "
    "voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt "
    "mollit anim id est laborum".split()
)
_X = r"[^\x00-\x7f?]{1,6}"  # an accented letter, also when garbled
_FILLER = re.compile(
    r"(?i)\b(?:your|the|main|body)? ?(?:text|copy|content|heading|title|article|description)s? (?:goes|go|comes) here\b|\basdf\b|\bqwert|"
    r"\b(?:placeholder|dummy|sample|filler) (?:entry|text|copy|content|article|page)\b|\bcoming soon\b|\bblindtext\b|\bplatzhalter|"
    r"\btexte de remplissage|\btexto de (?:ejemplo|relleno|prueba)|\bfaux texte\b|\bf" + _X + r"lltext\b|^lorem ipsum"
)
_ERROR = re.compile(
    r"(?i)^\W*(?:http |error |erreur |fehler |status )?\W?(?:40[0-9]|410|429|50[0-9])\b\W*(?:[:–—-]|not|page|forbidden|service|internal|bad|gateway|error|$)|"
    r"^\W*(?:error|erreur|fehler) (?:40[0-9]|410|429|50[0-9])\b|"
    r"\bpages? (?:\w+ ){0,4}(?:not|cannot|could not|can't) (?:be )?found\b|\bnot be found on this server|\bp" + _X + r"?a?gina no (?:encontrada|existe)|"
    r"\bseite (?:wurde )?nicht gefunden|\bpage (?:demand" + _X + r"e )?(?:n'existe pas|introuvable|non trouv)|"
    r"\baccess denied|\bdo not have permission|\bacceso denegado|\bzugriff verweigert|\bacc" + _X + r"s refus|"
    r"\bsession (?:has )?expired|\bservice (?:is )?(?:temporarily )?unavailable|\bsomething went wrong|\btoo many requests|"
    r"\baddress has been blocked|\bdown for maintenance|\bwartungsarbeiten\b|\bunhandled exception|\bobject reference not set|"
    r"\b(?:warning|notice|fatal error|parse error): \w+(?:\(\))?.* on line \d|\bconnection refused\b|\bstack trace\b|\btraceback \(most|"
    r"\bdatabase error\b|\bmarked as crashed\b|\bbad gateway\b|\bgateway time-?out|\bdid not (?:answer|respond) in time|"
    r"\bsite can.{1,6}t be reached|\binternal server error|^\W*forbidden\W*$|\bnullpointerexception|\bcaptcha\b|"
    r"\bnothing (?:was )?(?:found )?here\b|\byou (?:are|were) looking for (?:has|is|was|cannot|could)\b"
)
_SCRIPTS = r"(?:java ?scripts?|scripts?|scripting)"
_DEMAND = re.compile(
    rf"(?i)\b(?:enable|activate|allow|turn on|switch on|unblock|activ[ea]z?|activar|habilit[ae]r?|aktivieren|einschalten|erlauben)\b.{{0,40}}\b{_SCRIPTS}\b|"
    rf"\b{_SCRIPTS}\b.{{0,40}}\b(?:is|are|to be)? ?(?:required|enabled|disabled|needed|blocked|switched on|turned on|turned off|aktivieren|aktiviert|activ)|"
    rf"\b(?:requires?|needs?|besoin de|necesita|requiere|ben.{{1,4}}tigt|braucht|erfordert)\b.{{0,40}}\b{_SCRIPTS}\b|\bchecking your browser\b"
)
#: A part of a page may need scripts without the page being a demand for them.
_PART = re.compile(r"(?i)^\W*(?:the |our |les? |la |die |der |das |el |los )?(?:comments?|kommentare?|commentaires?|comentarios?|player|videos?|audio|maps?|forms?|ratings?|slides?|gallery|notes?)\b")
_ODD = re.compile(r"[^\x00-\x7f]+|\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Words of a line that a message or a note of filler may have at most: a longer line is running text, whose sentences are
#: judged each (see :func:`running_residue`).
LINE_WORDS = 22
#: Share of the words of a text that messages within its long lines must hold.
MOSTLY = 0.5

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_TAGGED = re.compile(r"(?is)<(pre|code)\b[^>]*>.*?</\1\s*>")
_INDENTED = re.compile(r"(?m)(?<=:)[ \t]*\r?\n(?:[ \t]*\r?\n)?((?:(?: {4,}|\t)\S.*(?:\r?\n|\Z))+)")


def code_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks of ``text`` that show code."""
    out = []
    if "```" in text or "~~~" in text:
        out += [m.span() for m in _FENCE.finditer(text)]
    if "</" in text:
        out += [m.span() for m in _TAGGED.finditer(text)]
    if "    " in text or "\t" in text:
        out += [m.span(1) for m in _INDENTED.finditer(text)]
    return out


def placeholders(text: str) -> Iterator[re.Match]:
    """Unfilled placeholders of ``text`` that are not shown on purpose."""
    if not _MAY.search(text):
        return
    found = list(PLACEHOLDER.finditer(text))
    if not found:
        return
    share = sum(len(m.group()) for m in found) / len(text)
    shown = code_blocks(text)
    for m in found:
        if any(a <= m.start() < b for a, b in shown):
            continue
        if _SHOWN.search(text[max(0, m.start() - 2) : m.start()]):
            continue
        if share < 0.2 and _TUTORIAL.search(text[max(0, m.start() - 150) : m.start()] + " " + text[m.end() : m.end() + 150]):
            continue
        yield m


_MAY = re.compile(r"\{\{|\{%|<%|\$\{|#\{|%%|__|@@|\[|\$[a-z]|%\(|\{\d|<|&lt;|TODO:|XXX")


_LOREM_SIGNS = ("dolor", "tempor ", "tempor,", "tempor.", "labore", "labori", "laborum", "aliqu", "veniam", "elit ", "elit,", "elit.")


def lorem_run(low: str, least: int = 6) -> bool:
    """Whether ``least`` words of Lorem ipsum follow each other in a text of small letters, three of them longer than
    four letters."""
    if not any(x in low for x in _LOREM_SIGNS):
        return False
    run = long = 0
    for w in _WORD.findall(low):
        if w in LOREM:
            run += 1
            long += len(w) > 4
            if run >= least and long >= 3:
                return True
        else:
            run = long = 0
    return False


#: A line without any of these (in small letters) is no message, demand or filler: a cheap test before the grammars.
_HINTS = (
    *"script browser asdf qwert soon blindtext platzhalter remplissage ejemplo relleno prueba placeholder dummy sample filler lltext".split(),
    *"lorem found encontrada existe gefunden introuvable trouv denied permission denegado verweigert refus expired".split(),
    *"unavailable wrong requests blocked maintenance wartung exception reference database crashed gateway reached error forbidden captcha".split(),
    *("goes here", "go here", "come here", "comes here", "nothing", "faux texte", "on line", "trace", "in time", "connection refused", "looking for"),
)


_CODE = re.compile(r"\b(?:40\d|410|429|50\d)\b")


@lru_cache(maxsize=200_000)
def residue_line(line: str) -> str | None:
    """``filler``, ``error`` or ``scripts`` where a whole line is such; a longer line is prose and never is."""
    if len(_WORD.findall(line)) > LINE_WORDS:
        return None
    if _FILLER.search(line):
        return "filler"
    if _DEMAND.search(line) and not _PART.search(_ODD.sub(" ", line)):
        return "scripts"
    if _ERROR.search(line):
        return "error"
    return None


def residue(text: str | None) -> str | None:
    """The kind of residue that ``text`` is or holds, or null."""
    if not text or text.isspace():
        return None
    for _ in placeholders(text):
        return "placeholder"
    low = text.lower()
    if lorem_run(low):
        return "filler"
    hints = [h for h in _HINTS if h in low]
    code = ("40" in low or "50" in low or "410" in low or "429" in low) and _CODE.search(low) is not None
    if not hints and not code:
        return None
    held: dict[str, int] = {}
    total = 0
    for line in text.split("\n"):
        low = line.lower()
        n = low.count(" ") + 1
        total += n
        if not any(h in low for h in hints) and not (code and _CODE.search(low)):
            continue
        if kind := residue_line(line.strip()):
            return kind
        if n > LINE_WORDS:
            for kind, n in running_residue(line, hints, code).items():
                held[kind] = held.get(kind, 0) + n
    return max(held, key=held.get) if held and sum(held.values()) >= MOSTLY * total else None


_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def running_residue(line: str, hints: list[str], code: bool) -> dict[str, int]:
    """Words of the sentences of a long line that are messages, demands or filler, by kind. Only sentences with one of
    ``hints``, or with an error code, can be."""
    held: dict[str, int] = {}
    for sentence in _SENTENCES.split(line):
        low = sentence.lower()
        if (any(h in low for h in hints) or code and _CODE.search(low)) and (kind := residue_line(sentence.strip())):
            held[kind] = held.get(kind, 0) + low.count(" ") + 1
    return held


def error_template(value: str | None) -> bool:
    """Whether a message is an unfilled template."""
    return bool(value) and ERROR_TEMPLATE.search(value) is not None


def find_residue(df: DataFrame, key: str = "page_id", text: str = "text_content", error: str = "error") -> DataFrame:
    """(key, field, kind): records whose text is or holds residue, and records whose error is an unfilled template."""
    slim = df.select(key, text, error)
    kind = slim.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            hits = [(i, text, k) for i, t in enumerate(batch.column(1).to_pylist()) if (k := residue(t))]
            hits += [(i, error, "template") for i, e in enumerate(batch.column(2).to_pylist()) if error_template(e)]
            if hits:
                rows, fields, kinds = zip(*hits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(fields), pa.array(kinds)], [key, "field", "kind"])

    return slim.mapInArrow(run, f"`{key}` {kind}, field string, kind string")
