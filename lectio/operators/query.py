"""The query language: words, exact phrases in quotation marks, AND (implied) and OR.

``a OR b`` makes b optional and leaves a required: OR marks the token after it, and a stop word passes the mark on.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.twin import tokenize

_PHRASE = re.compile(r'"([^"]+)"')


@dataclass(frozen=True)
class ParsedQuery:
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)

    @property
    def is_empty(self) -> bool:
        return not (self.required or self.optional or self.phrases)

    @property
    def terms(self) -> list[str]:
        """All terms in order, with repeats: a term given twice scores twice."""
        return [*self.required, *self.optional, *(t for p in self.phrases for t in p)]


def parse(text: str | None, tokenize: Callable[[str], list[str]] = tokenize) -> ParsedQuery:
    """The parsed form of a query text; blank texts give an empty query."""
    if not text or text.isspace():
        return ParsedQuery()
    quoted = _PHRASE.findall(text)
    phrases = [t for t in map(tokenize, quoted) if t]
    rest = text
    for q in quoted:
        rest = rest.replace(f'"{q}"', " ")
    required: list[str] = []
    optional: list[str] = []
    either = False
    for word in rest.split(" "):
        operator = word.strip().upper()
        if operator == "OR":
            either = True
        elif operator and operator != "AND":
            for token in tokenize(word):
                (optional if either else required).append(token)
                either = False
    return ParsedQuery(required, optional, phrases)
