"""One quantity recorded in different units: pay in rupees per month (problem 2).

Each statement of a record gives figures and, as far as it names them, a scale (rupees, thousands, lakhs, crores) and
a period (day, week, month, year).  What a statement leaves out is first taken from the sentence beside it.  What is
then still open is solved by identities: statements of one record mean one amount, and amount = figure x scale x
period factor, so the combination of units with the least sum of squared log residuals is chosen, of low and high ends
alike, the residual against the usual level standing in where a record has one statement only.  That level and its
spread are those of the statements that leave nothing open.  Solutions that are not unique are flagged.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

# fixed values: year = 12 months = 52 weeks, month = 30 days
PER_MONTH = {"month": 1.0, "year": 1 / 12, "day": 30.0, "week": 52 / 12}
SCALES = {"": 1.0, "k": 1e3, "l": 1e5, "cr": 1e7}
#: The usual level, log of rupees per month, and its spread, where no record states a pay in full.
LEVEL, SPREAD = math.log(28_000), 0.75
#: Spread of the logs of statements that mean the same amount: rounding.
SAME = 1e-2
#: A second solution whose residual is no more than this above the best makes the best one not unique.
MARGIN = 1.0

_DIGITS = str.maketrans("०१२३४५६७८९௦௧௨௩௪௫௬௭௮௯", "01234567890123456789")
# fixed values: numbers in words
_ONES = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(1, 20)))
_TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))

_WORD = "|".join(sorted([*_ONES, *_TENS], key=len, reverse=True))
NUM = rf"(?:\d[\d,]*(?:\.\d+)?|(?:{_WORD})(?:[ -](?:{_WORD}))?\b)"
CUR = r"(?:₹|rs\b\.?|inr\b|rupees\b|rupaye\b|रु\.?|रुपये|ரூ\.?)"
SCALE = r"(?:k\b|thousands?\b|hazaa?r\b|हज़ार|हजार|ஆயிரம்|lpa\b|lakhs?\b|lacs?\b|l\b|लाख|லட்சம்|crores?\b|cr\b)"
PERIOD = (
    r"(?:(?:per|a|an|each|every|har|/|in a|प्रति|हर|दर)\s*(?:month|mensem|mahin[ae]|mo|year|annum|yr|saal|day|diem|din|week|wk|haft[ae]|माह|महीने|महिना|वर्ष|साल|दिन|दिवस|सप्ताह|हफ्ते|आठवड्याला)"
    r"|p\.?\s?m\b|p\.?\s?a\b|monthly|yearly|annually|annual|daily|weekly|mahin[ae]|mahinewar|saal(?:\s+ka)?|saalana|roz(?:ana)?|haft[ae]|mo\b|yr\b|wk\b|மாதம்|ஆண்டு|நாள்|வாரம்)"
)
_BEFORE = rf"(?:(?:up\s?to|around|about|approx\.?|flat|starting(?:\s+from)?|from|fixed|nearly|minimum|max(?:imum)?|~)\s+)*"
_MONEY = rf"{CUR}?\s*(?P<n{{0}}>{NUM})\s*(?P<s{{0}}>{SCALE})?(?:\s*/-)?\s*{CUR}?(?:\s*/-)?"
_RANGE = rf"(?P<c>{_BEFORE}{_MONEY.format(1)}(?:\s*(?:-|–|—|to\b|se\b|से)\s*{_MONEY.format(2)})?\s*(?P<p>{PERIOD})?\.?)"
WHOLE = re.compile(rf"\s*{_RANGE}\s*", re.I)
FIGURE = re.compile(_RANGE, re.I)
#: Where a figure may begin in running text.
BEGIN = re.compile(rf"(?<![\w.,])(?:{CUR}\s*)?(?:\d|(?:{_WORD})\b)", re.I)
LABEL = re.compile(r"(?i)\b(?:pay|salary|ctc|stipend|wages?|remuneration|compensation|package|role offers|in[- ]hand|tankhwah)\b|वेतन|पगार|சம்பளம்")
OTHER = re.compile(r"(?i)bonus|incentive|fee\b|charge|deposit|turnover|worth|report anyone|asks? for|refund|commission|allowance|task\b|wallet|trial|mein se|में से")
_OF = re.compile(r"(?i)\b(?:pay|salary|salaries|ctc|stipend|wages?|remuneration|figures?|amounts?)\b")
_SENTENCE = re.compile(r"\n|(?<=[.!?।])(?<!\b[Rr]s\.)(?<!\bno\.)\s+(?=[^\d\s₹])")
_LINE = re.compile(r"(?im)^\W*(?:pay|salary|ctc|stipend|wages?|remuneration|वेतन|पगार|சம்பளம்)\b[^:\n]{0,40}:[^\n]*")
_MARKED = re.compile(rf"(?i){CUR}|{SCALE}|{PERIOD}")


@dataclass(frozen=True)
class Stated:
    """Figures as written and the units that are known; None where a unit is not stated."""

    low: float
    high: float
    scale: str | None
    period: str | None


def number(text: str) -> float:
    if text[0].isdigit():
        return float(text.replace(",", "").rstrip("."))
    return float(sum(_TENS.get(w, _ONES.get(w, 0)) for w in re.split(r"[ -]", text.lower())))


def scale_of(text: str | None) -> str | None:
    if not text:
        return None
    t = text.lower()
    if t[0] in "kthहஆ" and not t.startswith("लाख"):
        return "k"
    return "cr" if t.startswith("cr") else "l"


def period_of(text: str | None) -> str | None:
    """The period a phrase names."""
    if not text:
        return None
    t = re.sub(r"\s", "", text.lower())
    if re.search(r"year|annu|yr|saal|p\.?a$|p\.?a\.|lpa|वर्ष|साल|ஆண்டு", t) or t == "pa":
        return "year"
    if re.search(r"week|wk|haft|सप्ताह|हफ्ते|आठवड|வாரம்", t):
        return "week"
    if re.search(r"day|daily|diem|har?din|din$|roz|दिन|दिवस|நாள்", t):
        return "day"
    return "month"


def _read(m: re.Match) -> Stated:
    a = number(m["n1"])
    b = number(m["n2"]) if m["n2"] else a
    s1, s2 = scale_of(m["s1"]), scale_of(m["s2"])
    period = period_of(m["p"])
    if "lpa" in ((m["s1"] or "") + (m["s2"] or "")).lower():
        period = "year"
    if s1 and s2 and s1 != s2:  # each figure has its own
        return Stated(a * SCALES[s1], b * SCALES[s2], "", period)
    return Stated(min(a, b), max(a, b), s1 or s2, period)


@functools.lru_cache(maxsize=100_000)
def whole(text: str | None) -> Stated | None:
    """The pay a field states, if the field states nothing else."""
    if not text:
        return None
    m = WHOLE.fullmatch(text.translate(_DIGITS))
    return _read(m) if m else None


def beside(text: str | None) -> tuple[str | None, str | None]:
    """(scale, period) that a sentence about pay figures names without a figure of its own."""
    for sentence in _SENTENCE.split(text or ""):
        s = sentence.replace("'000", " thousand ").replace("’000", " thousand ")
        if not _OF.search(s) or OTHER.search(s) or re.search(r"\d", s):
            continue
        low = s.lower()
        scale = "k" if "thousand" in low else "l" if re.search(r"lakh|lacs?\b", low) else None
        period = "year" if re.search(r"year|annu", low) else "week" if re.search(r"week", low) else "day" if re.search(r"\bday|daily|working day", low) else "month" if "month" in low else None
        if period or scale:
            return scale, period
    return None, None


def labelled(text: str | None) -> Stated | None:
    """The first pay in running text: a figure with a sign or unit of its own behind a word for pay, in one sentence."""
    if not text or not LABEL.search(text):
        return None
    for sentence in _SENTENCE.split(text.translate(_DIGITS)):
        word = LABEL.search(sentence)
        if not word:
            continue
        at = word.end()
        while begin := BEGIN.search(sentence, at):
            m = FIGURE.match(sentence, begin.start())
            if m and _MARKED.search(m["c"]) and number(m["n1"]) > 0 and not OTHER.search(sentence, 0, m.start()):
                return _read(m)
            at = m.end() if m else begin.end()
    return None


def fill(one: Stated | None, scale: str | None, period: str | None) -> Stated | None:
    if one is None:
        return None
    return Stated(one.low, one.high, one.scale if one.scale is not None else scale, one.period or period)


def amounts(one: Stated) -> list[tuple[str, str, float, float]]:
    """(scale, period, log of the low end, of the high end) for all units that a statement may have."""
    scales = [one.scale] if one.scale is not None else ["", "k", "l"]
    periods = [one.period] if one.period else list(PER_MONTH)
    logs = [math.log(max(x, 1e-9)) for x in (one.low, one.high)]
    units = [(c, p, math.log(SCALES[c] * PER_MONTH[p])) for c in scales for p in periods]
    return [(c, p, logs[0] + u, logs[1] + u) for c, p, u in units]


def solve(stated: list[Stated], level: float = LEVEL, spread: float = SPREAD) -> tuple[int, int, bool] | None:
    """(low, high, unique) in whole rupees per month for the statements of one record, or None without any.

    Residuals: of each statement's log amounts, low and high, against the means of all, and of the mean low end against
    the usual level, in units of its spread.  A scale that is not stated is none, so long as the amount is thinkable
    that way: a stated figure is not multiplied without need.  Equal statements count once, and all statements count:
    each amount that one of them may mean is taken as the record's in turn, every statement takes the units that bring
    it nearest, and the combinations so met are ranked by their residuals.
    """
    stated = list(dict.fromkeys(stated))
    if not stated:
        return None
    choices = [amounts(s) for s in stated]
    if len(stated) == 1 and len(choices[0]) == 1:  # nothing is open
        factor = SCALES[stated[0].scale] * PER_MONTH[stated[0].period]
        return *(math.floor(v * factor + 0.5 + 1e-9) for v in (stated[0].low, stated[0].high)), True
    more = [[0.5 if s.scale is None and u[0] else 0.0 for u in own] for s, own in zip(stated, choices)]
    ranked: dict[tuple[int, ...], float] = {}
    for _, _, low, high in {u for own in choices for u in own}:
        picked = tuple(min(range(len(own)), key=lambda k: ((own[k][2] - low) ** 2 + (own[k][3] - high) ** 2) / SAME**2 + extra[k]) for own, extra in zip(choices, more))
        if picked in ranked:
            continue
        ends = [[own[k][e] for own, k in zip(choices, picked)] for e in (2, 3)]
        means = [sum(x) / len(x) for x in ends]
        apart = sum((x - m) ** 2 for xs, m in zip(ends, means) for x in xs) / SAME**2
        ranked[picked] = apart + ((means[0] - level) / spread) ** 2 + sum(extra[k] for extra, k in zip(more, picked))
    order = sorted(ranked, key=lambda p: (ranked[p], p))
    units = [own[k] for own, k in zip(choices, order[0])]
    known = next((k for k, s in enumerate(stated) if s.scale is not None and s.period), 0)
    factor = SCALES[units[known][0]] * PER_MONTH[units[known][1]]
    low, high = (math.floor(v * factor + 0.5 + 1e-9) for v in (stated[known].low, stated[known].high))
    total = lambda p: sum(own[k][2] for own, k in zip(choices, p))
    other = next((p for p in order[1:] if abs(total(p) - total(order[0])) > 1e-6), None)
    return low, high, other is None or ranked[other] - ranked[order[0]] > MARGIN


def log_amount(stated: list[Stated]) -> float | None:
    """Log of the low end in rupees per month of the first statement that leaves nothing open, if there is one."""
    one = next((s for s in stated if s.scale is not None and s.period and s.low > 0), None)
    return None if one is None else amounts(one)[0][2]


def offer(pay: str | None, text: str | None) -> list[Stated]:
    """What a message says of its pay: its pay field, with what that leaves out from the line it stands in; else a labelled line."""
    one = whole(pay)
    if one is None:
        line = _LINE.search(text or "")
        found = labelled(line[0]) if line else None
        return [fill(found, *beside(line[0]))] if found else []
    if one.scale is None or one.period is None:
        line = next((x for x in (text or "").split("\n") if pay in x and LABEL.search(x)), "")
        scale, period = beside(line.replace(pay, " "))
        one = fill(one, scale, period)
    return [one]


def listing(salary: str | None, extensions, description: str | None) -> list[Stated]:
    """What a listing says of its pay: in its salary, its extensions, and its description, completed from the description."""
    found = [whole(salary)]
    for x in extensions if extensions is not None else ():
        one = whole(x)
        if one and (one.period or one.scale or re.search(CUR, x, re.I)):
            found.append(one)
    found.append(labelled(description))
    found = [x for x in found if x is not None]
    if any(x.scale is None or x.period is None for x in found):
        scale, period = beside(description)
        found = [fill(x, scale, period) if x.period is None else x for x in found]
    return found
