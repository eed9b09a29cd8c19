"""Labelled spans for the privacy tagger: a sample of sentences labelled from what surely surrounds a detail.

Used for fitting only.  Kinds with a shape of their own are found by it; names are first found where the words around
them leave no doubt, and the first and last names met there then mark names anywhere else in the sample.
"""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id", "address", "name")
_D = "[0-9०-९௦-௯]"
_M = "[6-9६-९௬-௯]"
EMAIL = re.compile(r"[A-Za-z0-9][\w.+-]*\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:(?:\.|\[dot\]|\(dot\)| dot )[A-Za-z0-9-]+)*(?:\.|\[dot\]|\(dot\)| dot )[A-Za-z]{2,}")
SPELT = re.compile(r"[A-Za-z0-9][\w.+-]* at [A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)* dot [A-Za-z]{2,}")
ID = re.compile(rf"(?<![\w-])(?:[01]{_D}{{3}}([ -]?){_D}{{4}}\1{_D}{{4}}|[A-Z]{{5}}\d{{4}}[A-Z]|[A-Z]{{3}}\d{{7}})(?!\w)")
PHONE = re.compile(
    rf"(?<![\w/.-])(?:\(?\+\s?91\)?[ -]?|91(?=[6-9०-९]{_D}{{9}}(?!{_D})))?(?:{_M}{_D}{{4}}[ .-]?{_D}{{5}}|{_M}{_D}{{2}}[ -]{_D}{{3}}[ -]{_D}{{4}}|{_D}{{4}}[ -]{_D}{{3}}[ -]{_D}{{3}}|0{_D}{{2,4}}-{_D}{{6,8}}|0{_D}{{10}})(?!{_D})"
)
ADDRESS = re.compile(
    r"(?:(?:Flat|Plot|Shop|H\.? ?No|House)(?: no)?\.? ?\d[\d/A-Z-]*|(?<![\w/,.-])\d{1,4}), (?:(?!by\b|and\b)[^,\n]{3,40}, ){1,3}(?:Navi |Greater |New )?[A-Z][A-Za-z]+(?:(?: ?[-–] ?| )\d{3} ?\d{3}(?!\d))?"
)
_N = r"((?:[A-Z]\.? )?[A-Z][A-Za-z'-]+(?: [A-Z][A-Za-z.'-]*)*)"
_SURE = [
    re.compile(p)
    for p in (
        rf"Regards, {_N},",
        rf"Speak to {_N} of the",
        rf"by M[rs]+\.? {_N} who looks",
        rf"ho to {_N} ji ko",
        rf"phir {_N} letter denge",
        rf"wahan {_N} madam milengi",
        rf"के लिए {_N} से ",
        rf"தகவலுக்கு {_N} அவர்களை",
        rf"meet M[rs]+\.? {_N}(?:[.\s]*$| on the)",
        rf"ask for M[rs]+\.? {_N}[.\s]*$",
        rf"held by {_N}, staff",
        rf"used by {_N} for the",
        rf"by one {_N} who",
        rf"[,;] {_N} will verify",
        rf"Contact {_N} (?:at|on)",
        rf"HR {_N}, ",
        rf", - {_N}$",
    )
]
_TITLE = re.compile(r"^(?:Mrs?|Ms|Dr|Shri|Smt|Kumari)\.? ")


_NAME = re.compile(r"([A-Za-z]+)\.?( [A-Z]\.?)? ([A-Za-z]+(?:-[A-Za-z]+)?)\b")


def sure_names(sentence: str) -> list[tuple[int, int]]:
    out = []
    for p in _SURE:
        for m in p.finditer(sentence):
            a, b = m.span(1)
            title = _TITLE.match(m[1])
            a += title.end() if title else 0
            out.append((a, a + len(sentence[a:b].rstrip("."))))
    return out


class Labeller:
    """names: the first and last names of the sample, learnt from the sure places."""

    def __init__(self, sentences: list[str]):
        self.first: set[str] = set()
        self.last: set[str] = set()
        for s in sentences:
            for a, b in sure_names(s):
                words = s[a:b].rstrip(".").split()
                if len(words) >= 2 and len(words[0].rstrip(".")) > 2:
                    self.first.add(words[0].lower())
                    self.last.update(words[-1].lower().split("-"))
        self.last -= {"desk", "team"}
        self.first -= self.last

    def names(self, sentence: str) -> list[tuple[int, int]]:
        out = sure_names(sentence)
        for m in map(_NAME.match, [sentence] * len(sentence), [w.start() for w in re.finditer(r"\b[A-Z]", sentence)]):
            if not m:
                continue
            first, last = m[1].lower(), m[3].lower().split("-")
            initial = len(first) == 1 and m[1].isupper()
            if m[1][0].isupper() and m[3][0].isupper() and all(x in self.last for x in last) and (first in self.first or initial) and not any(a < m.end() and m.start() < b for a, b in out):
                out.append(m.span())
        return out

    def spans(self, sentence: str) -> list[tuple[int, int, int]]:
        """(begin, end, number of kind), none overlapping; the kinds in order of how sure their shape is."""
        found: list[tuple[int, int, int]] = []

        def add(a: int, b: int, kind: int) -> None:
            if not any(x < b and a < y for x, y, _ in found):
                found.append((a, b, kind))

        for kind, pattern in ((0, EMAIL), (0, SPELT), (3, ADDRESS), (2, ID), (1, PHONE)):
            for m in pattern.finditer(sentence):
                add(*m.span(), kind)
        for a, b in self.names(sentence):
            add(a, b, 4)
        return sorted(found)
