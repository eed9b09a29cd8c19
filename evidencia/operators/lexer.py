"""Text as tokens with places: what the claim readers look at instead of characters."""

from __future__ import annotations

import re
from dataclasses import dataclass

# fixed values: abbreviations whose full stop ends no sentence
ABBREVIATIONS = frozenset("rs pvt ltd no co inc corp mr ms mrs dr st approx etc vs e.g i.e".split())

_TOKEN = re.compile(r"(?P<line>\n)|(?P<number>\d+(?:,\d+)*(?:\.\d+)?)|(?P<word>[^\W\d_]+(?:['’][^\W\d_]+)*)|(?P<sign>[^\w\s]|_)")


@dataclass(slots=True)
class Token:
    kind: str  # line, number, word, sign
    text: str
    begin: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


def tokens(text: str) -> list[Token]:
    """All tokens in order; white space other than line feeds is what lies between them."""
    return [Token(m.lastgroup, m[0], *m.span()) for m in _TOKEN.finditer(text)]


def _stops(found: list[Token], k: int) -> bool:
    """Whether the sentence is over behind token ``k``."""
    one, after = found[k], found[k + 1] if k + 1 < len(found) else None
    if one.kind == "line" or one.text in "!?":
        return True
    if one.text != "." or after is not None and after.begin == one.end and after.kind != "line":
        return False
    # words with full stops between, right before this one: `e.g` is one abbreviation
    first = k
    while first and found[first - 1].end == found[first].begin and (found[first - 1].kind in ("word", "number") or found[first - 1].text == "."):
        first -= 1
    return "".join(t.text for t in found[first:k]).lower() not in ABBREVIATIONS


def sentences(text: str) -> list[tuple[int, int]]:
    """[begin, end) of the sentences: they end at a line, at ! and ?, and at a full stop before white space that follows
    no abbreviation.  A sentence has a token besides the line feed that ends it."""
    out: list[tuple[int, int]] = []
    found, start = tokens(text), None
    for k, t in enumerate(found):
        if t.kind != "line" and start is None:
            start = t.begin
            if t.text in "!?" and out and out[-1][1] == t.begin:  # a run of signs belongs to what it ends
                start = out.pop()[0]
        if start is not None and (_stops(found, k) or k + 1 == len(found)):
            out.append((start, found[k - 1].end if t.kind == "line" else t.end))
            start = None
    return out


def clauses(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """[begin, end) of the clauses within a sentence, parted by `;`, `but`, `however`, and by a comma before `and`."""
    out, at = [], begin
    found = tokens(text[begin:end])
    for k, t in enumerate(found):
        after = found[k + 1] if k + 1 < len(found) else None
        if t.text == ";" or t.low in ("but", "however"):
            edge = (t.begin, t.end)
        elif t.text == "," and after is not None and after.low == "and":
            edge = (t.begin, after.end)
        else:
            continue
        first = edge[0] - 1 if t.kind == "word" and k and found[k - 1].text == "," and text[begin + found[k - 1].end : begin + t.begin].strip() == "" else edge[0]
        if begin + first < at:
            continue
        out.append((at, begin + (found[k - 1].begin if first != edge[0] else edge[0])))
        at = begin + edge[1]
    return [*out, (at, end)]


def holding(spans: list[tuple[int, int]], place: int) -> tuple[int, int] | None:
    """The span that a place lies in."""
    return next(((a, b) for a, b in spans if a <= place < b), None)


def sentence_at(text: str, place: int) -> tuple[int, int] | None:
    return holding(sentences(text), place)


def clause_at(text: str, place: int) -> tuple[int, int] | None:
    own = sentence_at(text, place)
    return own and holding(clauses(text, *own), place)


def first_sentence(text: str, test) -> tuple[int, int] | None:
    """The first sentence whose text passes ``test``."""
    return next(((a, b) for a, b in sentences(text) if test(text[a:b])), None)


def line_before(text: str, place: int, width: int) -> str:
    """Up to ``width`` characters before a place, in its line."""
    return text[max(place - width, text.rfind("\n", 0, place) + 1) : place]


def clause_before(text: str, place: int, width: int) -> str:
    """Up to ``width`` characters before a place, in its clause."""
    own = clause_at(text, place)
    return text[max(place - width, own[0]) : place] if own else ""


def overlaps(span: tuple[int, int], taken: list[tuple[int, int]]) -> bool:
    return any(a < span[1] and span[0] < b for a, b in taken)
