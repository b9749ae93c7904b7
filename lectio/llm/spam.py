"""Keyword-stuffed and link-list pages (problem 4).

Each line of a page is judged by its words and by the page's recurrences. Two signs make a line spam:

* *unnaturally regular recurrence*: the positional autocorrelation of the page's pairs of neighbouring content words, as a
  profile over the lags up to a window, holds much of the page; and a pair of the line comes back at gaps that are short
  and even, again and again;
* *lists without function words*: nearly all words are common nouns, verbs and adjectives in small letters, hash tags,
  product codes or addresses, with no function words between them.

A page is spam where spam lines hold most of the words that are not standing lines of its site, or where lines that are
no sentences do and its ``out_links`` are as many as these lines. Litanies repeat function words and single nouns but no
pairs of content words; lists of works are names and titles without as many links; glossaries and essays on one word are
sentences.
"""

from __future__ import annotations

import re

from .lines import FUNCTION_WORDS, normal

#: The largest lag, in words, of the autocorrelation.
WINDOW = 48
#: Sum of the profile from which a page counts as regular; running text stays under a third of it.
REGULAR = 0.10
#: Gaps of a pair are regular where so many of them are within the window, at least three, and their deviation is at most
#: so many times their mean (1 for places at random).
WITHIN, EVEN = 0.6, 1.5

_LINK = re.compile(r"https?://\S+|www\.\S+|(?<!\w)#\w+")
_PRODUCT = re.compile(
    r"(?i)\b(?:sku|add to cart|(?:in|out of) stock|(?:order|buy) now|auf lager|in den warenkorb|en stock|ajouter au panier|en existencia|anadir al carrito|a.adir al carrito)\b"
)
_PAUSE = re.compile(r"[.,;:!?…()]+\s|[“”\[\]]")
_PARTS = re.compile(r"\s*[/;|,·•>]\s+")
_SENTENCE = re.compile(r"[.!?;:][\"'”’»)\]]*$|[“”«»;—]|, ")


def _content(line: str) -> list[str]:
    """Content words of a line in order, with "" for function words, numbers and marks that part sentences."""
    out = []
    for piece in _PAUSE.split(line):
        out += ["" if w in FUNCTION_WORDS or w[0] == "#" else w for w in normal(piece).split()]
        out.append("")
    return out


def autocorrelation(content: list[str]) -> tuple[list[float], set[tuple[str, str]]]:
    """For content words in order ("" where another word or a line end stands between): the autocorrelation of neighbouring
    pairs at lags 1 to WINDOW (the share of places whose pair came last so many words before), and the pairs whose gaps
    are short and even."""
    last: dict[tuple[str, str], int] = {}
    gaps: dict[tuple[str, str], list[int]] = {}
    n = 0
    for i in range(len(content) - 1):
        a, b = content[i], content[i + 1]
        if not a:
            continue
        n += 1
        if not b or a == b:
            continue
        pair = (a, b)
        if pair in last:
            gaps.setdefault(pair, []).append(i - last[pair])
        last[pair] = i
    profile = [0] * (WINDOW + 1)
    regular = set()
    for pair, g in gaps.items():
        near = [x for x in g if x <= WINDOW]
        for x in near:
            profile[x] += 1
        if len(near) >= 3 and len(near) >= WITHIN * len(g):
            mean = sum(near) / len(near)
            if sum((x - mean) ** 2 for x in near) <= (EVEN * mean) ** 2 * len(near):
                regular.add(pair)
    return [x / n for x in profile[1:]] if n else [0.0] * WINDOW, regular


def spam_words(lines: list[str], norms: list[str]) -> list[tuple[int, int]]:
    """(words, spam words) of each line of a page, given the lines and their normal forms."""
    words = [n.split() for n in norms]
    is_function = FUNCTION_WORDS.__contains__
    functions = [sum(map(is_function, ws)) for ws in words]
    total = sum(map(len, words))
    strong: set[tuple[str, str]] = set()
    content: list[list[str]] = []
    if total >= 12:
        rough = [w for ws in words for w in (*("" if w in FUNCTION_WORDS or w[0] == "#" else w for w in ws), "")]
        held = [p for p in zip(rough, rough[1:]) if p[0] and p[1]]
        # no more places of a pair can follow another than there are repeats of pairs, so few repeats settle it
        may = len(held) - len(set(held)) >= REGULAR * (len(rough) - rough.count(""))
        profile, pairs = autocorrelation(rough) if may else ([], set())
        if pairs and sum(profile) >= REGULAR:  # marks only take pairs away, so they are looked at for such pages alone
            content = [_content(line) for line in lines]
            profile, pairs = autocorrelation([w for cs in content for w in cs])
        if pairs and sum(profile) >= REGULAR:
            text = " ".join(lines)
            low = text.lower()
            named = lambda a, b: text.count(f"{a.capitalize()} {b.capitalize()}") > 0.6 * max(1, low.count(f"{a} {b}"))
            strong = {p for p in pairs if not named(*p)}  # one person's name in each line of a list is no keyword
    if not strong and all(f > 0.34 * len(ws) for f, ws in zip(functions, words)):
        return [(len(ws), 0) for ws in words]
    out = []
    for i, (line, ws, function) in enumerate(zip(lines, words, functions)):
        n = len(ws)
        if n < 2:
            out.append((n, 0))
            continue
        s = line.strip()
        spam = False
        if function <= 0.34 * n:
            raw = s.split()
            links = len(_LINK.findall(s)) if "#" in s or "http" in s or "www." in s else 0
            if links and links >= 0.3 * len(raw):
                spam = True
            elif _PRODUCT.search(s):
                spam = s[-1] not in ".!?"
            elif function <= 0.2 * n:
                small = sum(w[0].islower() or w[0] in "([{" and w[1:2].islower() for w in raw)
                sentence = s[-1] in ".!?…”»" and s.count(",") < 0.25 * n
                parts = len(_PARTS.split(s)) if n >= 12 else 0
                if parts >= 8 and 1.5 * parts <= n <= 5 * parts and function <= 0.1 * n:
                    spam = True
                elif not sentence:
                    spam = small >= 0.5 * len(raw) or n >= 10 and len(set(ws)) <= 0.75 * n and not _SENTENCE.search(s)
        if not spam and strong:
            cs = content[i]
            inside = [False] * len(cs)
            for j in range(len(cs) - 1):
                if (cs[j], cs[j + 1]) in strong:
                    inside[j] = inside[j + 1] = True
            covered = sum(inside)
            spam = covered >= 2 and covered >= 0.22 * n
        out.append((n, n if spam else 0))
    return out
