"""Typed claims with exact character spans from free text, in one Arrow pass per message.

Every reader looks at the tokens of ``lexer``: contacts at runs of tokens without white space between them, amounts and
fees at figures and the words around them, names at runs of capitalised words and the words before and behind them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.functions.cities import CITIES
from evidencia.operators.lexer import Token, clauses, holding, overlaps, sentences, tokens
from evidencia.operators.money import amounts, offered
from evidencia.runtime import spread

# fixed values: endings of bare hosts, names that nobody can register, and names of techniques that look like a host
TLDS = frozenset("com in org net info xyz online site jobs work careers example test invalid io ly gle me app co biz live top store club tech link ai dev cc to gl gd shop vip icu cloud pro".split())
RESERVED = frozenset("example test invalid localhost example.com example.net example.org".split())
TECHNIQUES = frozenset("asp vb ado b m".split())
_PIECE = re.compile(r"[^\s<>\"'`]+")
_LOCAL, _LABEL = re.compile(r"[\w.%+*-]+\Z"), re.compile(r"[^\W_](?:[\w-]*[^\W_])?\Z")


def reserved(host: str) -> bool:
    """Nobody can be reached there: the name, or one above it, is set aside."""
    labels = host.split(".")
    return any(".".join(labels[k:]) in RESERVED for k in range(len(labels)))


def _host_end(text: str) -> int:
    """How far a host reaches from the start of ``text``: labels and full stops, without a next sentence glued to it."""
    at, labels = 0, []
    for part in re.match(r"[\w.-]*", text)[0].split("."):
        own = part.rstrip("-_") if part.rstrip("-_") != part else part
        if not own or not _LABEL.match(own) or len(labels) > 1 and own[:1].isupper() and not labels[-1][:1].isupper():
            break
        labels.append(own)
        at += len(own) + 1
        if own != part:
            break
    while labels and not (len(labels[-1]) > 1 and labels[-1].isalpha()):
        at -= len(labels.pop()) + 1
    return at - 1 if len(labels) > 1 else 0


def emails(text: str) -> list[tuple[str, int, int, bool]]:
    """(address, begin, end, synthetic): around every at-sign, the local part before and the host behind it."""
    out = []
    for at in (k for k, c in enumerate(text) if c == "@"):
        local = _LOCAL.search(text[max(0, at - 64) : at])
        size = _host_end(text[at + 1 : at + 260])
        if local and size and not text[max(0, at - 64) : at].endswith("."):
            begin, end = at - len(local[0].lstrip(".")), at + 1 + size
            value = text[begin:end].lower()
            if begin < at:
                out.append((value, begin, end, "*" in value.split("@")[0] or reserved(value.split("@")[1])))
    return out


def mobiles(text: str) -> list[tuple[str, int, int, bool]]:
    """(+91 ddddd ddddd, begin, end, masked): ten digits from 6 to 9 on, all but the first of which may be X or *.

    A run of digits, masks and single signs between them is taken apart from its end: ten of its places are the number,
    what stands before must be nothing, 0, or 91 with or without a plus and brackets.
    """
    out = []
    for m in re.finditer(r"[+(]{0,2}\d[\dXx*]*(?:\)?[ .\t-]{0,2}\(?[\dXx*]+)*", text):
        run = m[0]
        places = [k for k, c in enumerate(run) if c.isdigit() or c in "Xx*"]
        before, after = text[: m.start()][-1:], text[m.end() :][:1]
        if before.isalnum() or before == "_" or after.isalnum() or after == "_":
            continue
        groups: list[list[int]] = []
        for k in places:  # numbers one after the other are told apart by where ten places end at a gap
            if groups and len(groups[-1]) < 13 and not _full(run, groups[-1], k):
                groups[-1].append(k)
            else:
                groups.append([k])
        for own in groups:
            digits = "".join(run[k] for k in own).upper().replace("*", "X")
            prefix = digits[:-10]
            if len(digits) < 10 or prefix not in ("", "0", "91") or digits[-10] not in "6789":
                continue
            ten = own[-10:]
            if any(run[x + 1 : y].strip(" .-") or y - x > 2 for x, y in zip(ten, ten[1:])):
                continue
            first = own[0]
            while first and run[first - 1] in "+(" :
                first -= 1
            out.append((f"+91 {digits[-10:-5]} {digits[-5:]}", m.start() + first, m.start() + own[-1] + 1, "X" in digits[-10:]))
    return out


def _full(run: str, own: list[int], k: int) -> bool:
    """Whether the places read so far are a whole number and the next one is apart from them."""
    digits = "".join(run[j] for j in own)
    whole = len(digits) == 10 and digits[0] in "6789" or len(digits) == 11 and digits[0] == "0" or len(digits) == 12 and digits[:2] == "91"
    return whole and k - own[-1] > 1


def links(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, str, int, int, bool]]:
    """(link, host, begin, end, synthetic): with a scheme, with www, or a bare host on a known ending."""
    out = []
    for m in _PIECE.finditer(text):
        piece, at = m[0], m.start()
        low = piece.lower()
        start = next((k for k in (low.find("http://"), low.find("https://"), low.find("www.")) if k >= 0), None)
        if start is None:
            start = next((k for k, c in enumerate(piece) if c.isalnum()), len(piece))
        value = piece[start:].rstrip(".,;:!?)]}*'\"")
        span = (at + start, at + start + len(value))
        plain = "://" in value or value.lower().startswith("www.")
        host = re.split(r"[/?#:]", re.sub(r"^[a-z]+://", "", value.lower()))[0]
        labels = host.split(".")
        if len(labels) < 2 or not all(map(_LABEL.match, labels)) or overlaps(span, taken):
            continue
        if plain or labels[-1] in TLDS and host.isascii() and not labels[0].isdigit() and len(labels[0]) > 1 and labels[0] not in TECHNIQUES:
            out.append((value, host, *span, reserved(host)))
    return out


def contacts(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(kind, value, begin, end, synthetic) of addresses, mobile numbers and links by place, each value once a kind.

    Masked numbers and names that nobody can register are synthetic: nobody can be reached through them.
    """
    mail = emails(text)
    every = [("email", v, v, a, b, s) for v, a, b, s in mail]
    every += [("phone", v, v, a, b, s) for v, a, b, s in mobiles(text) if not overlaps((a, b), [(x, y) for _, x, y, _ in mail])]
    every += [("link", v, v.lower(), a, b, s) for v, _, a, b, s in links(text, [(x, y) for _, x, y, _ in mail])]
    out: dict[tuple[str, str], tuple] = {}
    for kind, value, same, a, b, s in sorted(every, key=lambda x: x[3]):
        out.setdefault((kind, same), (kind, value, a, b, s))
    return list(out.values())


# ---- fees

# fixed values: what a fee is for, what it is called, and words that deny one
FOR = frozenset("registration joining processing training security kit laptop file verification uniform document documentation application enrolment enrollment caution courier background medical".split())
CALLED = frozenset("fee fees charge charges deposit".split())
DENIAL = frozenset("no not never without nahi nahin zero nil".split())
FILLING = frozenset("any a an the such kind of charge charges charged ask asks asked take takes pay for koi is are hai hain".split())
ASIDE = frozenset("only today now abhi".split())


def _denied(found: list[Token], first: int, last: int) -> bool:
    """A word of denial before the phrase with nothing but filling between, or behind it."""
    k = first - 1
    while k >= 0 and found[k].low in FILLING:
        k -= 1
    if k >= 0 and found[k].low in DENIAL:
        return True
    k = last + 1
    while k < len(found) and found[k].low in ("is", "are", "hai", "will", "be"):
        k += 1
    return k < len(found) and found[k].low in DENIAL


def _paid_for(found: list[Token], first: int, last: int, end: int) -> bool:
    """The employer bears it: `reimburse` before, or `paid by` behind it in the sentence."""
    words = [t.low for t in found[:first] if t.begin >= end - 400][-8:]
    behind = [t.low for t in found[last + 1 :] if t.begin < end]
    return any(w.startswith("reimburse") for w in words) or any(x == "by" and y in ("paid", "borne", "covered") for y, x in zip(behind, behind[1:]))


def fee(text: str) -> tuple[str, int | None, int, int] | None:
    """(phrase, rupees or None, begin, end) of the fee a message asks for; a denied one and one the employer bears are none.

    Named fees first, in their order; those with an amount before those without.  An amount counts up to 40 characters
    behind the name or 30 before it in the sentence, an unmarked number only right behind it.  Then orders to pay.
    """
    found, whole = tokens(text), sentences(text)
    money = {a.first: a for a in amounts(text, found)}
    asked = None
    k = 0
    while k < len(found):
        t = found[k]
        own = holding(whole, t.begin)
        span = _named(found, k, own)
        if span is None:
            k += 1
            continue
        first, last = span
        k = last + 1
        if own is None or _denied(found, first, last) or _paid_for(found, first, last, own[1]):
            continue
        got = _amount_of(text, found, money, first, last, own)
        if got:
            return got
        asked = asked or (text[found[first].begin : found[last].end], None, found[first].begin, found[last].end)
        if last == first and found[first].low in ("deposit", "fee"):
            asked = asked if asked[2] != found[first].begin else None  # these alone need an amount
    return asked or _ordered(text, found, money, whole)


def _named(found: list[Token], k: int, own: tuple[int, int] | None) -> tuple[int, int] | None:
    """(first, last) token of a fee's name that begins at ``k``."""
    if own is None:
        return None
    words = [t.low for t in found[k : k + 4]]
    plus = 1 if words[0] == "refundable" else 0
    if words[plus : plus + 1] and words[plus] in FOR:
        if words[plus + 1 : plus + 2] and words[plus + 1] in CALLED:
            return k, k + plus + 1
        if words[plus + 1 : plus + 3] == ["ke", "liye"]:
            return k, k + plus + 2
        return (k, k) if not plus and words[0] == "registration" else None
    if words[0] in ("deposit", "fee") and not (k and found[k - 1].low in FOR):
        return k, k
    return None


def _amount_of(text, found, money, first, last, own) -> tuple[str, int, int, int] | None:
    low = found[last].low
    begin, end = found[first].begin, found[last].end
    nxt = last + 1
    if nxt < len(found) and found[nxt].low in ("of", ":", "is"):
        nxt += 1
    bare = first == last
    for at in sorted(money):
        a = money[at]
        if not (end <= a.begin <= min(end + 40, own[1])) or bare and at != nxt:
            continue
        between = [t.low for t in found[last + 1 : at]]
        if any(w in ("salary", "pay", "stipend", "ctc", "earn") for w in between) or a.period:
            break
        if a.marked:
            return text[begin : a.end], round(a.low), begin, a.end
    if not bare and nxt < len(found) and found[nxt].kind == "number" and nxt not in money:
        after = found[nxt + 1].low if nxt + 1 < len(found) else ""
        value = float(found[nxt].text.replace(",", "").rstrip("."))
        if after not in ("%", "days", "day", "months", "month", "weeks", "hours") and 50 <= value < 10_000_000:
            return text[begin : found[nxt].end], round(value), begin, found[nxt].end
    if low in ("registration", "liye", *CALLED) and (low != "deposit" or not bare):
        for at in sorted(money, reverse=True):  # `999 for registration`
            a = money[at]
            between = [t.low for t in found[a.last + 1 : first]]
            if own[0] <= a.begin and begin - 30 <= a.end <= begin and between in (["for"], ["as"], ["for", "the"], ["as", "a"], ["ke"]) and a.marked and not a.period:
                return text[a.begin : end], round(a.low), a.begin, end
    return None


def _ordered(text, found, money, whole) -> tuple[str, int, int, int] | None:
    """`pay` and an amount `to` or `for` something."""
    for at, a in sorted(money.items()):
        if not a.marked or a.period or not at or found[at - 1].low != "pay" or found[at - 1].kind != "word":
            continue
        after = found[a.last + 1].low if a.last + 1 < len(found) else ""
        if after in ("to", "for", "and") and not _denied(found, at - 1, a.last):
            return text[found[at - 1].begin : a.end], round(a.low), found[at - 1].begin, a.end
    return None


# ---- names

# fixed values: the words that lead to a name, what ends one, and words that are no part of one
COMPANY_LABEL = frozenset("company employer organisation organization firm".split())
ROLE_LABEL = frozenset("post role position designation profile vacancy".split())
CITY_LABEL = frozenset("location city place address venue".split())
JOB = frozenset("job role position post opening openings selected shortlisted applying apply interview desk vacancy joining".split())
TEAM = frozenset("hr team desk onboarding hiring recruitment recruiting talent acquisition careers manager department dept staffing helpdesk regards".split())
LEGAL = frozenset("pvt private ltd limited llp inc corp".split())
STOP = frozenset("i we you your our dear hello hi greetings congratulations thank thanks please call email whatsapp like earn pay regards the this salary location from post role".split())
ROLE_NOUN = frozenset("role position post job opening openings vacancy profile".split())


def _labelled(found: list[Token], labels: frozenset) -> tuple[int, int] | None:
    """(first, last) token of what stands behind a label and a colon at the start of a line."""
    start = True
    for k, t in enumerate(found):
        if t.kind == "line":
            start = True
            continue
        if start and t.kind == "word" and t.low in labels:
            at = k + 1
            while at < len(found) and (found[at].text in "*_" or found[at].low in ("name", "title")):
                at += 1
            if at < len(found) and found[at].text in ":-":
                at += 1
                while at < len(found) and found[at].text in "*_":
                    at += 1
                end = at
                while end < len(found) and found[end].kind != "line" and found[end].text not in "|*":
                    end += 1
                while end > at and found[end - 1].text in ".,;!*_":
                    end -= 1
                if end > at:
                    return at, end - 1
        start = start and t.kind == "sign"
    return None


def _capital(t: Token) -> bool:
    return t.kind == "word" and t.text[:1].isupper()


def _run(found: list[Token], k: int, most: int = 8) -> int:
    """The last token of the run of capitalised words from ``k`` on, in one line; before ``k`` if there is none."""
    last, at, words = k - 1, k, 0
    while at < len(found) and words < most:
        t = found[at]
        if _capital(t) and not (words == 0 and t.low in STOP):
            last, words = at, words + 1
        elif not (words and t.text in "&-." and at + 1 < len(found) and _joined(found, at)):
            break
        at += 1
    if last + 1 < len(found) and found[last].low in LEGAL and found[last + 1].text == "." and last >= k:
        pass
    return last


def _joined(found: list[Token], k: int) -> bool:
    """A sign that belongs to a name: `&` before a capital, a hyphen within a word, the full stop of a legal word."""
    before, t, after = found[k - 1], found[k], found[k + 1]
    if t.text == "&":
        return _capital(after)
    if t.text == "-":
        return before.end == t.begin and t.end == after.begin and after.kind == "word"
    return before.low in LEGAL and _capital(after)


def _hyphened(found: list[Token], last: int) -> int:
    """A word that a hyphen ties to the run's last one, small letters or not."""
    if last + 2 < len(found) and found[last + 1].text == "-" and found[last].end == found[last + 1].begin and found[last + 1].end == found[last + 2].begin and found[last + 2].kind == "word":
        return last + 2
    return last


def _without_team(found: list[Token], first: int, last: int) -> int:
    while last >= first and (found[last].low in TEAM or found[last].kind != "word"):
        last -= 1
    return last


def company(text: str) -> tuple[int, int] | None:
    """[begin, end) of the organisation's name: label, greeting, what it does, a job at it, legal words, a team's name."""
    found = tokens(text)
    low = [t.low for t in found]
    span = _labelled(found, COMPANY_LABEL)
    if span:
        return found[span[0]].begin, found[span[1]].end

    def named(first: int) -> tuple[int, int] | None:
        last = _without_team(found, first, _run(found, first)) if first < len(found) else first - 1
        own = [t.low for t in found[first : last + 1]]
        return (found[first].begin, found[last].end) if last >= first and not all(w in STOP or w in CITIES for w in own) else None

    for k in range(len(found)):
        if low[k : k + 2] == ["greetings", "from"] or low[k : k + 2] in (["applying", "to"], ["behalf", "of"]):
            got = named(k + 2)
            if got:
                return got
    for k in range(len(found)):  # a run of capitals and then what the organisation does
        if _capital(found[k]) and not (k and _capital(found[k - 1])) and found[k].low not in STOP:
            last = _run(found, k)
            behind = low[last + 1 : last + 4]
            if last >= k and (behind[:2] in (["is", "hiring"], ["has", "shortlisted"], ["has", "selected"], ["ko", "chahiye"], ["is", "looking"]) or behind[:1] in (["mein"], ["invites"], ["welcomes"])):
                got = named(k)
                if got:
                    return got
    for k in range(len(found)):
        if low[k] in JOB and found[k].kind == "word":
            for at in range(k + 1, len(found)):
                if found[at].kind == "line" or found[at].begin - found[k].end > 45 or found[at].text in ".!?":
                    break
                if low[at] in ("at", "with", "join"):
                    got = named(at + 1)
                    if got:
                        return got
    for k in range(len(found)):
        if low[k] in LEGAL and _capital(found[k]) and k and _capital(found[k - 1]):
            first = k
            while first and (_capital(found[first - 1]) and found[first - 1].low not in STOP or found[first - 1].text in "&." and _joined(found, first - 1)):
                first -= 1
            last = k
            while last + 1 < len(found) and (low[last + 1] in LEGAL or found[last + 1].text == "." and last + 2 < len(found) and low[last + 2] in LEGAL):
                last += 1
            if found[first].low not in LEGAL:
                return found[first].begin, found[last].end
    for k in range(len(found)):
        if _capital(found[k]) and low[k] not in TEAM and low[k] not in STOP and not (k and _capital(found[k - 1]) and found[k - 1].low not in STOP):
            last = _run(found, k)
            own = _without_team(found, k, last)
            if k <= own < last and any(low[j] in ("hr", "team", "desk", "recruitment", "careers") for j in range(own + 1, last + 1)):
                return found[k].begin, found[own].end
    return None


def role(text: str) -> tuple[int, int] | None:
    """[begin, end) of the role: label, `post of`, `for ... role`, hiring and wanted, `as a`."""
    found = tokens(text)
    low = [t.low for t in found]
    span = _labelled(found, ROLE_LABEL)
    if span:
        return found[span[0]].begin, found[span[1]].end

    def named(first: int) -> tuple[int, int] | None:
        while first < len(found) and low[first] in ("a", "an", "the"):
            first += 1
        last = _hyphened(found, _run(found, first, 8)) if first < len(found) else first - 1
        if last < first or found[first].low in CITIES:
            return None
        if last + 1 < len(found) and found[last + 1].text == "(":  # how the work is done, in brackets
            close = next((j for j in range(last + 2, min(last + 6, len(found))) if found[j].text == ")"), None)
            last = close if close is not None and found[last + 1].begin == found[last].end + 1 else last
        return found[first].begin, found[last].end

    for k in range(len(found)):
        if low[k] in ("post", "role", "position") and low[k + 1 : k + 2] == ["of"]:
            got = named(k + 2)
            if got:
                return got
    for k in range(len(found)):
        if low[k] == "for":
            got = named(k + 1)
            after = next((t.low for t in found if got and t.begin >= got[1]), "")
            if got and after in ROLE_NOUN:
                return got
    for k in range(len(found)):
        if low[k] in ("hiring", "chahiye", "wanted", "required"):
            got = named(k + 1 + (low[k + 1 : k + 2] == ["for"]))
            if got:
                return got
    for k in range(len(found)):
        if low[k] == "as" and low[k + 1 : k + 2] in (["a"], ["an"]):
            got = named(k + 2)
            if got:
                return got
    return None


def city(text: str, taken: list[tuple[int, int]] = ()) -> tuple[str, int, int] | None:
    """(city as written today, begin, end): in a labelled line first, else anywhere but in contacts; of two, the longer name."""
    found = tokens(text)

    def within(first: int, last: int) -> tuple[str, int, int] | None:
        for k in range(first, last + 1):
            for size in (2, 1):
                own = found[k : k + size]
                if len(own) == size and k + size - 1 <= last and all(t.kind == "word" and t.text.isascii() for t in own):
                    name = CITIES.get(" ".join(t.low for t in own))
                    if name and not overlaps((own[0].begin, own[-1].end), list(taken)):
                        return name, own[0].begin, own[-1].end
        return None

    span = _labelled(found, CITY_LABEL)
    return (within(*span) if span else None) or within(0, len(found) - 1)


def claim_spans(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, begin, end) of company, role, city, pay and fee, each at most once.

    The value of pay is rupees per month, that of a fee rupees; a fee that is asked for without an amount has an empty
    value, which is not the same as no fee; a denied fee is none.
    """
    out = []
    places = [(a, b) for _, _, a, b, _ in contacts(text)]
    for kind, span in (("company", company(text)), ("role", role(text))):
        if span:
            out.append((kind, text[slice(*span)], *span))
    place = city(text, places)
    if place:
        out.append(("city", *place))
    asked = fee(text)
    pay = offered(text, [*places, *([asked[2:]] if asked else [])])
    if pay:
        out.append(("pay", str(pay[2]), pay[0], pay[1]))
    if asked:
        out.append(("fee", "" if asked[1] is None else str(asked[1]), asked[2], asked[3]))
    return out


SPANS = "kind string, value string, begin int, end int, synthetic boolean"


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value, begin, end, synthetic): sentences, contacts, amounts and claims with code-point spans.

    text[begin:end] is what was read.  Null and empty texts have no rows; whole texts are read, however long.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f["key"], f["text"]):
                out += [(k, "sentence", None, a, b, False) for a, b in sentences(t)]
                out += [(k, *c) for c in contacts(t)]
                out += [(k, "money", f"{a.low:.2f}", a.begin, a.end, False) for a in amounts(t) if a.marked]
                out += [(k, *c, False) for c in claim_spans(t)]
            yield pd.DataFrame(out, columns=["key", "kind", "value", "begin", "end", "synthetic"])

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0))
    return rows.mapInPandas(run, f"key {kind}, {SPANS}").withColumnRenamed("key", key)
