"""Lines of crawled pages: site, normal form, kind and signature, shared by the page problems (1, 4 and 7)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months in en, fr, de, es, without accents.
MONTHS = (
    "january february march april may june july august september october november december "
    "janvier fevrier fvrier mars avril mai juin juillet aout aot septembre octobre novembre decembre dcembre "
    "januar februar marz mrz maerz juni juli oktober dezember "
    "enero febrero marzo mayo junio julio agosto septiembre setiembre octubre noviembre diciembre "
    "abril jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
#: Function words of en, fr, de, es.
FUNCTION_WORDS = frozenset(
    (
        "the of in and to a an is are was were be been that this these those with by on at for as it its or not from which who whom what when where "
        "while if then than so but nor neither either no does do did has have had our your their his her my we you they he she i me us them into upon "
        "under over after before without within between among against because since although unless whether there here all any some each every only "
        "der die das den dem des ein eine einer einem einen und oder aber nicht von vom zu zum zur im in mit auf fur bei nach uber unter aus an am als "
        "wie wenn denn doch dass es er sie ihr ihre sein seine ist sind war wird "
        "le la les l un une des du de d et ou mais ne pas que qui quoi dont ou dans par pour sur avec sans sous chez ce cet cette ces son sa ses leur "
        "est sont etait il elle on nous vous ils elles au aux en y se s qu n si car puisque tandis lorsque "
        "el la los las lo un una unos unas y o pero no que quien cuyo en por para sobre con sin bajo ante este esta estos su sus es son era se del al "
        "mi tu nos ya pues aunque cuando mientras segun como mas muy"
    ).split()
)
_MONTH = "|".join(sorted(set(MONTHS), key=len, reverse=True))
_DATE = re.compile(rf"\b(?:{_MONTH})\b(?= (?:de )?#)|(?<=# )(?:de )?\b(?:{_MONTH})\b")
_NUMBERS = re.compile(r"#+(?: (?:(?:st|nd|rd|th|er|de|of|at|um|a|h|am|pm|uhr) )*#+)*")
_JOINED = re.compile(rf"#(?:(?:st|nd|rd|th|er|de|of)?(?:{_MONTH})(?:de)?#|(?:at|um|a|h|am|pm|uhr)?#)+")


class _Table(dict):
    """Character table for ``str.translate``: small letters without accents, digits as ``#``, line ends kept, all else a
    space. On ASCII text, which nearly all lines are made first, ``translate`` needs no look-up a character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isdigit():
            out = "#"
        elif c == "\n":
            out = c
        elif code < 128:
            out = c.lower() if c.isalnum() else " "
        elif unicodedata.combining(c):
            out = ""
        else:
            out = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if x.isalnum()) if c.isalnum() else " "
        self[code] = out
        return out


_TABLE = _Table()
#: Letters that no ASCII form keeps: text with them takes the slower table.
_ASCII_RUN = re.compile(r"[\x00-\x7f]+")
_OTHER_SCRIPT = re.compile(r"[\u0250-\u02af\u0370-\u1eff\u1f00-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufaff\U00010000-\U0010ffff]")
_MARKS = {m: " " for m in "’‘“”„«»‹›—–·•…►▶§¶©®°"} | {"ß": "ss", "œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ø": "o", "Ø": "o", "ł": "l", "đ": "d"}


def site_of(url: Column) -> Column:
    """The host of ``url`` in small letters without a leading ``www.``; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def _plain(text: str) -> str:
    if text.isascii():
        return text.translate(_TABLE)
    if _OTHER_SCRIPT.search(_ASCII_RUN.sub("", text)):
        return text.translate(_TABLE)
    for mark, to in _MARKS.items():
        if mark in text:
            text = text.replace(mark, to)
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().translate(_TABLE)


def normals(text: str) -> list[str]:
    """The words of each line of ``text``: small letters without accents, digits as ``#``, single spaces."""
    return [" ".join(line.split()) for line in _plain(text).split("\n")]


def normal(line: str) -> str:
    return normals(line.replace("\n", " "))[0]


@lru_cache(maxsize=100_000)
def _masked(words: str) -> str:
    spaced = _NUMBERS.sub("#", _DATE.sub("#", _NUMBERS.sub("#", words)))
    return _JOINED.sub("#", spaced.replace(" ", ""))


def skeletons(text: str) -> list[str]:
    """For each line the form that lines differing only in passing details share: ASCII letters, small and without
    spaces, with numbers and dates as one ``#``. Accented letters and marks drop out, so a copy that lost them to a
    wrong decoding keeps its skeleton. A line with fewer than three ASCII letters keeps its own characters."""
    return [skeleton(line) for line in text.split("\n")]


def skeleton(line: str, norm: str | None = None) -> str:
    """The same for one line; ``norm``, its normal form, saves work where the line is ASCII."""
    if norm is None or not line.isascii():
        norm = " ".join(line.replace("\xa0", " ").encode("ascii", "ignore").decode().translate(_TABLE).split())
    k = _masked(norm) if "#" in norm else norm.replace(" ", "")
    return k if len(k) > 2 else line.strip().casefold()


#: Marks that open or close a link to another page.
_ARROW = re.compile(r"^\s*(?:[«‹←►▶→➜»›•▸]|>>|<<|&[lr]aquo;)\s*\S|^\s*�+\s+[A-Z\d]|\S\s*(?:[»›→►▶]|>>)\s*$")
_LABEL = re.compile(
    r"^(?:previous|next|tags?|related|read also|see also|more|more from|categories|category|keywords?|share|posted in|"
    r"precedent|suivant|etiquettes|mots cles|voir aussi|lire aussi|a lire|vorige|nachste|weiter|zuruck|schlagworte|siehe auch|lesen sie auch|"
    r"anterior|siguiente|etiquetas|relacionado|ver tambien|lea tambien|vease)\b"
)
_FILED = re.compile(r"^(?:filed under|posted in|class[ee]e? dans|abgelegt unter|archivado en)\b")
_LABELLED = re.compile(r"^\s*[^\W\d_]+(?: [^\W\d_]+){0,2} ?(?:: ?\S| [—–|/-] ?\S)")
_COUNTED = re.compile(r"\(\d{1,6}\)\s*$")
_ORDERED = re.compile(r"^\s*\d{1,3}(?:\s{2,}|\t)\S")
_LIST = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*–—•]|[a-zA-Z][.)]|\([a-zA-Z0-9]{1,3}\))\s+\S")
_SEPARATED = re.compile(r"\s+(?:[»>›/|·•—–-]|::)\s+|\s{3,}")
_MARK = re.compile(r"[»>›/|·•—–:-]\s")
_LEGAL = re.compile(
    r"\ball rights reserved|\btous droits reserves|\balle rechte vorbehalten|\btodos los derechos|^powered by\b|^terms (?:and conditions|of use)|"
    r"^privacy\b|^mentions legales|^datenschutz\b|^aviso legal|^impressum\b"
)
_COOKIE = re.compile(r"\bcookies?\b|\btemoins de connexion")
_NAV = re.compile(
    r"^(?:(?:menu|home|accueil|inicio|startseite|start|contact(?: us)?|kontakt|contacto|nous contacter|about(?: us)?|log ?in|sign in|register|follow us|search|"
    r"subscribe|newsletter|site ?map|plan du site|mapa del sitio|seitenubersicht|shop|archive|donate|print|share)$|back to (?:top|home)|skip to|return to|"
    r"retour|volver|nach oben|zum inhalt|aller au|ir al)\b"
)
_END = re.compile(r"[.!?…:;][\"'”’»)\]]*\s*$|[”»\"]\s*$")

#: Kinds of lines; the number is what the tables hold.
PROSE, LIST, SHORT, TITLE, LINK, PATH, LEGAL, COOKIE, NAV = range(9)
#: Kinds that are furniture of a page by their form alone.
FURNITURE = (LINK, PATH, LEGAL, COOKIE, NAV)


def kind(line: str, norm: str, title: str = "") -> int:
    """What a line looks like by itself, given its normal form and that of the page's title.

    ``LINK`` (a marked link, tags, a counted or ordered entry), ``PATH`` (segments parted by marks), ``LEGAL``,
    ``COOKIE``, ``NAV`` (the name of a page's tool), ``LIST`` (an item of a list), ``PROSE`` (a sentence), ``TITLE``,
    else ``SHORT``.
    """
    if title and norm == title:
        return TITLE
    n = norm.count(" ") + 1
    if n > 40:
        return PROSE
    s = line.strip()
    if s[0] in "“«„" and s[1:2].isalpha() and ("”" in s or "»" in s[1:]):
        return PROSE
    if (not s.isascii() or ">>" in s or "<<" in s or "&" in s) and _ARROW.search(s):
        return LINK
    if _FILED.search(norm) or _LABEL.search(norm) and _LABELLED.search(s):
        return LINK
    if n <= 24:
        if n <= 18 and ("cookie" in norm or "temoins" in norm) and _COOKIE.search(norm) and not norm.startswith("read also what"):
            return COOKIE
        if n <= 16 and ("©" in s or _LEGAL.search(norm)) and not (n > 8 and s[-1] in ".;" and "," in s):
            return LEGAL
        counted = _COUNTED.search(s) if s[-1] == ")" else None
        if (counted or s[0].isdigit() and _ORDERED.search(line)) and not _END.search(s[: counted.start()].rstrip() if counted else s):
            return LINK
        if n <= 8 and _NAV.search(norm):
            return NAV
    ended = _END.search(s) is not None
    if n <= 30 and not ended and ("   " in s or _MARK.search(s)):
        parts = [x for x in _SEPARATED.split(s) if x.strip()]
        if len(parts) >= 3 and len(parts[0].split()) <= 3 and len(parts[1].split()) <= 3:
            return PATH
    if n > 1 and _LIST.search(s):
        return LIST
    return PROSE if n >= 24 or n >= 5 and ended else SHORT


def site_lines(text: str) -> list[tuple[int, str]]:
    """(number, line) of the non-blank lines; a carriage return before a line end belongs to the separator."""
    return [(i, line.rstrip("\r")) for i, line in enumerate(text.split("\n")) if line and not line.isspace()]
