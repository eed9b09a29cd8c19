"""Amounts and pay in running text, read token by token."""

from __future__ import annotations

import math
from dataclasses import dataclass

from evidencia.operators.lexer import Token, tokens

# fixed values: signs and words of money, scales, and the words that name a period
CURRENCY = frozenset("₹ rs inr rupee rupees rupaye".split())
SCALE = {"k": 1e3, "thousand": 1e3, "thousands": 1e3, "hazar": 1e3, "hazaar": 1e3, "l": 1e5, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "lpa": 1e5, "cr": 1e7, "crore": 1e7, "crores": 1e7}
UNITS = {
    "month": "month mo mahina mahine mahinae mensem", "year": "year yr annum saal", "week": "week wk hafta hafte", "day": "day diem din", "hour": "hour hr ghanta",
}
ALONE = {"month": "monthly pm mahina mahine", "year": "yearly annually annual pa salana saalana", "week": "weekly", "day": "daily roz rozana", "hour": "hourly"}
LINKS = frozenset("per a an each every har".split())
TO = frozenset("- – — to se".split())
PER_MONTH = {"month": 1.0, "year": 1 / 12, "week": 52 / 12, "day": 30.0}
#: An unmarked number from here on is a code or a telephone number.
CODE = 10_000_000

_UNIT = {w: k for k, words in UNITS.items() for w in words.split()}
_ALONE = {w: k for k, words in ALONE.items() for w in words.split()}


@dataclass
class Amount:
    """Tokens [first, last] of ``found``; rupees of both ends; the period and the tokens it adds, if it is stated."""

    first: int
    last: int
    low: float
    high: float
    marked: bool
    scaled: bool
    lpa: bool = False
    period: str | None = None
    begin: int = 0
    end: int = 0


def _figure(found: list[Token], k: int) -> tuple[int, float, float | None, bool, bool] | None:
    """(last token, number, scale, marked, lpa) of a figure that begins at token ``k``."""
    at, marked = k, False
    if found[at].low in CURRENCY:
        marked, at = True, at + 1
        if at < len(found) and found[at].text == "." and found[k].low == "rs":
            at += 1
    if at >= len(found) or found[at].kind != "number":
        return None
    own, last = found[at], at
    value, scale, lpa = float(own.text.replace(",", "")), None, False
    if "," in own.text.rstrip(","):
        marked = True
    if last + 1 < len(found) and found[last + 1].low in SCALE:
        last += 1
        scale, lpa, marked = SCALE[found[last].low], found[last].low == "lpa", True
    if last + 2 < len(found) and found[last + 1].text == "/" and found[last + 2].text == "-" and found[last + 2].begin == found[last + 1].end:
        last, marked = last + 2, True
    if last + 1 < len(found) and found[last + 1].low in CURRENCY and found[last + 1].kind == "word" and not (last + 2 < len(found) and found[last + 2].kind == "number"):
        last, marked = last + 1, True
    return last, value, scale, marked, lpa


def amounts(text: str, found: list[Token] | None = None) -> list[Amount]:
    """Marked amounts, and unmarked ones with a period; a range is one amount with two ends.

    A range is two figures joined by a dash, `to` or `se`, one of them marked, the second from one to ten times the first.
    """
    found = tokens(text) if found is None else found
    out, k = [], 0
    while k < len(found):
        one = _figure(found, k)
        if one is None or k and found[k - 1].kind == "word" and found[k - 1].end == found[k].begin and found[k - 1].low not in CURRENCY:
            k += 1
            continue
        last, low, scale, marked, lpa = one
        high, scaled = low, scale is not None
        two = _figure(found, last + 2) if last + 2 < len(found) and found[last + 1].low in TO else None
        own = low * (scale or 1)
        if two and (marked or two[3]):
            shared = scale or two[2] or 1
            a, b = low * shared, two[1] * (two[2] or scale or 1)
            if a <= b <= 10 * a:
                last, own, high, marked, scaled, lpa = two[0], a, b, True, scaled or two[2] is not None, lpa or two[4]
            else:
                high = own
        else:
            high = own
        a = Amount(k, last, own, high, marked, scaled, lpa, begin=found[k].begin, end=found[last].end)
        _period(found, a)
        if a.marked or a.period and own < CODE:
            out.append(a)
        k = last + 1
    return out


def _period(found: list[Token], a: Amount) -> None:
    """The period that is stated right behind an amount, or right before it, becomes part of it."""
    if a.lpa:
        a.period = "year"
    at = a.last + 1
    rest = found[at : at + 5]
    if rest and rest[0].low == "tak":
        rest, at = rest[1:], at + 1
    if len(rest) > 1 and rest[0].low == "in" and (rest[1].low == "hand" or len(rest) > 2 and rest[1].text == "-" and rest[2].low == "hand"):
        rest, at = rest[2 + (rest[1].text == "-") :], at + 2 + (rest[1].text == "-")
    words = [t.low for t in rest]
    kind, used = None, 0
    if words[:1] and words[0] in _ALONE:
        kind, used = _ALONE[words[0]], 1
    elif len(words) > 2 and words[0] == "p" and words[1] == "." and words[2] in ("m", "a"):
        kind, used = {"m": "month", "a": "year"}[words[2]], 4 if words[3:4] == ["."] else 3
    elif len(words) > 1 and (words[0] in LINKS or words[0] == "/") and words[1] in _UNIT:
        kind, used = _UNIT[words[1]], 2
    elif len(words) > 2 and words[0] == "in" and words[1] == "a" and words[2] in _UNIT:
        kind, used = _UNIT[words[2]], 3
    elif len(words) > 1 and words[0] == "saal" and words[1] == "ka":
        kind, used = "year", 2
    if kind and not any(t.kind == "line" for t in rest[:used]) and not (rest[0].kind == "line"):
        a.period = a.period or kind
        a.end = rest[used - 1].end
        return
    before = a.first
    while before and found[before - 1].kind != "line" and a.first - before < 3:
        before -= 1
        word = found[before].low
        kind = _ALONE.get(word) or ("month" if word in ("mahine", "mahina") else None)
        between = [t.low for t in found[before + 1 : a.first]]
        if kind and word not in ("pm", "pa") and all(w in LABEL or w in (":", "ke", "ka", "earn", "get") for w in between):
            a.period = a.period or kind
            a.begin = found[before].begin
            return


# fixed values: words that say an amount is pay, and words that say it is not
LABEL = frozenset("salary salaries pay ctc stipend wage wages package remuneration income earning earnings earn".split())
NO_PAY = frozenset("incentive incentives bonus bonuses allowance allowances target targets fee fees charge charges deposit insurance cover turnover commission cashback reward refund prize elsewhere openings".split())
TASKS = frozenset("like likes review reviews rating ratings video videos channel channels task tasks subscribe star hotel".split())


def _before(found: list[Token], a: Amount, width: int = 40) -> list[str]:
    """The words before an amount in its line and sentence, nearest first."""
    out = []
    for k in range(a.first - 1, -1, -1):
        t = found[k]
        if t.kind == "line" or t.text in "!?;" or found[a.first].begin - t.end > width or t.text == "." and t.end < found[a.first].begin and (not out or out[-1] not in ("rs",)):
            break
        if t.kind == "word" and not (k and found[k - 1].text == "-" and found[k - 1].end == t.begin):  # no second half of a compound
            out.append(t.low)
    return out


def is_pay(found: list[Token], a: Amount) -> tuple[bool, bool]:
    """(not ruled out, labelled): the nearest label before an amount decides; a rate per task is no pay."""
    before = _before(found, a)
    after = [t.low for t in found[a.last + 1 : a.last + 4]]
    label = next((w for w in before if w in LABEL or w in NO_PAY), None)
    if label in NO_PAY or any(w in NO_PAY for w in after[:1]) or len(after) > 2 and after[0] in TO and after[1].isdigit() and after[2] in NO_PAY:
        return False, False
    if after[:1] in (["per"], ["/"], ["each"], ["pe"]) and not a.period:
        return False, False
    if label == "pay" and not a.period and (not before or before[0] == "pay") and not any(t.text == ":" for t in found[max(0, a.first - 2) : a.first]):
        return False, False  # an order to pay
    in_hand = after[:2] == ["in", "hand"] or after[:3] == ["in", "-", "hand"]
    return True, label is not None and label not in ("earn", "pay") or in_hand or label == "pay" and any(t.text == ":" for t in found[max(0, a.first - 2) : a.first])


def monthly(a: Amount) -> int | None:
    """Whole rupees per month of the low end: a year where it is stated or the figure is a lakh or more; days and weeks count."""
    period = a.period or ("year" if a.low >= 1e5 else "month")
    if period not in PER_MONTH:
        return None
    value = math.floor(a.low * PER_MONTH[period] + 0.5 + 1e-9)
    return value if value >= 1000 else None


def offered(text: str, taken: list[tuple[int, int]] = ()) -> tuple[int, int, int] | None:
    """(begin, end, rupees per month) of the pay a message offers: the first figure with a stated period, else the first
    marked one behind a word for pay.  ``taken`` are spans of fees and contacts, which are no pay."""
    found = tokens(text)
    usable = []
    for a in amounts(text, found):
        ok, labelled = is_pay(found, a)
        if ok and not any(x < a.end and a.begin < y for x, y in taken) and monthly(a) is not None:
            usable.append((a, labelled))
    for a, _ in usable:
        if a.period:
            return a.begin, a.end, monthly(a)
    return next(((a.begin, a.end, monthly(a)) for a, labelled in usable if labelled and a.marked), None)


def listed(text: str | None, ranges_only: bool = False) -> tuple[str, int] | None:
    """(phrase, rupees per month) of a listing's pay: the middle of its ends, the first with a stated period, else the first.

    Pay by the day, hour or week is none; of figures without a period, those of which the high end is a lakh or more are
    for a year.  Less than 1,000 a month is none.  With ``ranges_only`` a single figure is none, as in descriptions.
    """
    if not text:
        return None
    found = tokens(text)
    unstated = None
    for a in amounts(text, found):
        if not is_pay(found, a)[0] or ranges_only and a.low == a.high or a.period not in (None, "month", "year"):
            continue
        year = a.period == "year" or a.period is None and a.high >= 1e5
        value = math.floor((a.low + a.high) / 2 * (1 / 12 if year else 1) + 0.5 + 1e-9)
        if value < 1000:
            continue
        if a.period:
            return text[a.begin : a.end], value
        unstated = unstated or (text[a.begin : a.end], value)
    return unstated


def listing_pay(salary: str | None, extensions, description: str | None) -> tuple[str, str, int] | None:
    """(source, phrase, rupees per month): the salary field first, then each extension, then ranges of the description."""
    sources = [("salary", salary, False), *(("extensions", x, False) for x in (extensions if extensions is not None else ())), ("description", description, True)]
    for source, text, only in sources:
        got = listed(text, only)
        if got:
            return source, *got
    return None
