"""Variant spellings of organisations' names, linked over canonical rewritings (problem 3).

Every distinct spelling is brought to its core (case, decoration, legal form and line of business taken off) and
rewritten in each canonical way: token order and joined words by the least rotation of its letters, typing errors by
deletions, initials and abbreviated words by prefixes of a full name's words.  Rewritings are exploded and met by an
equi-join.  A link is scored by what its rewriting costs and by how rare it is: a rewriting that several
organisations share decides nothing.

A name needs the best partner of each rewriting only, not all of them, so the partners' side of every join is
aggregated to a few rows a rewriting first, and a rewriting that very many names share costs no more than its rows.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.llm.bits import known_rows
from evidencia.operators.components import components
from evidencia.runtime import dealt, stored, table

# fixed values: words that say nothing about which organisation is meant
LEGAL = frozenset("pvt private ltd limited llp p inc incorporated co company corp corporation plc opc".split())
DECORATION = frozenset("the team m s ms messrs careers career hr group grp india jobs hiring recruitment".split())
# fixed values: lines of business and how they are commonly shortened; shortenings that only leave vowels out are a rule
LINES = {
    "technologies": "technologies technology tech techno",
    "finance": "finance fin finances financial",
    "pharma": "pharma pharmaceuticals pharmaceutical",
    "textiles": "textiles textile",
    "infra projects": "infra",
    "manufacturing": "manufacturing mfg manufacturers",
    "motors": "motors motor",
    "solutions": "solutions solution solns soln",
    "logistics": "logistics logistic",
    "retail services": "retail",
    "foods": "foods food",
    "international": "international intl int'l",
    "industries": "industries industry inds",
    "enterprises": "enterprises enterprise entp",
    "consultancy": "consultancy consulting consultants",
    "engineering": "engineering engg",
    "services": "services svcs service",
    "projects": "projects proj project",
}
# fixed values: given names and common words as they are called and written for short
NICKNAMES = {
    "bob": "robert", "bill": "william", "dick": "richard", "jim": "james", "mike": "michael", "dave": "david", "tom": "thomas",
    "bros": "brothers", "natl": "national", "mktg": "marketing", "univ": "university", "hosp": "hospital", "assoc": "associates",
    "mgmt": "management", "dept": "department", "govt": "government", "elec": "electricals", "auto": "automobiles",
}
#: Second words of a line of two words; alone they are a line of their own.
SECOND = {"infra projects": "projects", "retail services": "services"}
ALIAS = {w: line for line, words in LINES.items() for w in words.split()}
LONG = [w for w in ALIAS if len(w) >= 6]
#: Letters up to which errors are letters left out; in longer names whole words are.
LETTERS = 40
#: An abbreviated word has so many letters.
PREFIX = (3, 4, 5)
#: A core with more distinct spellings than this is a name of its own, unless the other has so many times more.
#: Spellings are counted, not records: a misspelt name may stand in many records, but seldom in many forms.
RARE, TIMES = 2, 5


def near(a: str, b: str) -> bool:
    """One letter put in, left out, changed, or swapped with the next."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:] or (a[:2] == b[1::-1] and a[2:] == b[2:])


def _vowels_off(word: str) -> str:
    return word[:1] + re.sub("[aeiou]", "", word[1:])


def within(short: str, long: str) -> bool:
    """The letters of one stand in the other in their order."""
    letters = iter(long)
    return all(c in letters for c in short)


@functools.lru_cache(maxsize=50_000)
def line_of(word: str) -> str | None:
    """The line of business a word names, also with vowels left out, and with one typing error in a long word."""
    if word in ALIAS:
        return ALIAS[word]
    bare = _vowels_off(word)
    if len(word) >= 3:
        for known in ALIAS:
            if len(word) < len(known) and _vowels_off(known) == bare and within(word, known):
                return ALIAS[known]
    if len(word) >= 6:
        for known in LONG:
            if near(word, known):
                return ALIAS[known]
    return None


def core(name: str) -> tuple[list[str], str, bool]:
    """(words, line, abbreviated) of a spelling: what is left without decoration, the line or '', a word cut short."""
    text = unicodedata.normalize("NFKD", name).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c) or ord(c) > 0x370)
    text = re.sub(r"\bm/s\b", " ", text).replace("int'l", "intl")
    parts = re.findall(r"([^\W_]+(?:['’][^\W_]+)*)(\.?)", text)
    words, cut = [], []
    for word, dot in parts:
        if word in LEGAL or word in DECORATION:
            continue
        words.append(NICKNAMES.get(word, word))
        cut.append(bool(dot) and word not in NICKNAMES and line_of(word) is None)
    line = ""

    def take(at: int, to: int) -> None:
        del words[at:to], cut[at:to]

    for ends in (range(len(words) - 1, max(-1, len(words) - 3), -1), range(0, min(2, len(words)))):
        for at in ends:
            found = line_of(words[at])
            if not found or line:
                continue
            if found in ("projects", "services"):
                first = next((x for x, y in SECOND.items() if y == found and at and line_of(words[at - 1]) == x), None)
                line = first or {"projects": "infra projects", "services": "retail services"}[found]
                take(at - (first is not None), at + 1)
            else:
                line = found
                second = SECOND.get(found)
                take(at, at + 1 + (second is not None and at + 1 < len(words) and line_of(words[at + 1]) == second))
            break
        if line:
            break
    return words, line, any(cut)


def least_rotation(s: str) -> str:
    twice = s + s
    return min(twice[k : k + len(s)] for k in range(len(s))) if s else s


def shorter(s: str, n: int) -> set[str]:
    """``s`` without ``n`` of its letters, as least rotations."""
    if len(s) - n < 4:
        return set()
    return {least_rotation("".join(x)) for x in itertools.combinations(s, len(s) - n)}


def edits(s: str) -> int:
    """Typing errors that are believed in a core of this length."""
    return 2 if len(s) >= 9 else 1 if len(s) >= 5 else 0


def is_short(words: list[str], cut: bool) -> bool:
    """A word cut short, with its stop or without: two errors would make many names of what is left."""
    return cut or len(words) > 1 and min(map(len, words)) <= 4


def own_forms(key: str, words: list[str]) -> Iterator[tuple[str, int]]:
    """(form, errors) of a core: of its letters, and of three words and more in any order.

    Of a core of more than LETTERS letters up to two words are left out instead of two letters, since letters left out
    of a name of any length would be too many to try.
    """
    yield key, 0
    if len(key) <= LETTERS:
        for n in range(1, edits(key) + 1):
            for f in shorter(key, n):
                yield f, n
    if len(words) > 2:
        ordered = sorted(words)
        yield "\x01" + " ".join(ordered), 0
        if len(key) > LETTERS:
            for n in range(1, 3 if len(words) <= 60 else 2):
                for some in set(itertools.combinations(ordered, len(words) - n)):
                    yield "\x01" + " ".join(some), n


def cut_forms(words: list[str]) -> Iterator[tuple[str, int]]:
    """(form, cost) of a full name with words cut short.

    Of two words one or both are cut, with one typing error in the former; of three to six words every word is cut to
    as many letters, and all to their initials.
    """
    if 3 <= len(words) <= 6:
        for k in (1, *PREFIX):
            yield least_rotation("".join(w[:k] for w in words)), 5 + (k == 1)
    if len(words) != 2:
        return
    a, b = words
    for x, y in [(a[:k], b) for k in PREFIX if len(a) > k] + [(a, b[:k]) for k in PREFIX if len(b) > k]:
        yield least_rotation(x + y), 3
        for f in shorter(x + y, 1):
            yield f, 4
    for k, m in itertools.product(PREFIX, PREFIX):
        if len(a) > k and len(b) > m:
            yield least_rotation(a[:k] + b[:m]), 5
    for x, y in ((a[:1], b), (a, b[:1])):
        if min(len(a), len(b)) > 1:
            yield least_rotation(x + y), 6


def _normal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for name, n in zip(f["name"], f["n"]):
            words, line, cut = core(name)
            joined = "".join(words)
            if joined:
                out.append((name, n, least_rotation(joined), line, words, cut))
        yield pd.DataFrame(out, columns=["name", "n", "key", "line", "words", "cut"])


def _forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for node, key, line, n, words, cut in zip(f["node"], f["key"], f["line"], f["n"], f["words"], f["cut"]):
            short = is_short(list(words), cut)
            out += [(form, node, line, n, False, cost, short) for form, cost in own_forms(key, list(words)) if cost < 2 or not short]
            if not cut:
                best: dict[str, int] = {}
                for form, cost in cut_forms(list(words)):
                    best[form] = min(cost, best.get(form, cost))
                out += [(form, node, line, n, True, cost, short) for form, cost in best.items()]
        yield pd.DataFrame(out, columns=["form", "node", "line", "n", "full", "cost", "short"])


def organisations(names: DataFrame) -> DataFrame:
    """(name, org) for every distinct spelling in ``names`` (name, n), n the records that have it.

    ``org`` is the same for spellings of one organisation.  Names without a letter or digit are left out; names that
    differ in a known line of business never meet.
    """
    distinct = stored(dealt(names).mapInPandas(_normal, "name string, n bigint, key string, line string, words array<string>, cut boolean"))
    best = F.max_by("words", F.struct((F.size("words") == 2).cast("int").alias("two"), F.col("n"), F.col("name")))
    nodes = distinct.groupBy("key", "line").agg(F.count("*").alias("n"), best.alias("words"), F.min("cut").alias("cut"))
    nodes = stored(nodes.orderBy("key", "line").withColumn("node", F.monotonically_increasing_id()))  # numbered in order, as written
    # what is moved are 64-bit names of rewritings and numbers of cores
    forms = dealt(nodes).mapInPandas(_forms, "form string, node bigint, line string, n bigint, full boolean, cost int, short boolean")
    forms = stored(forms.withColumn("form", F.xxhash64("form")))
    shared = forms.groupBy("form").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    forms = stored(known_rows(forms, "form", shared))

    # typing errors: the core with fewer spellings joins the one with more, of the same line.  Of the partners that a
    # rewriting has at one cost the one with the most spellings, of equal ones the least, is the best for every core.
    own = forms.filter(~F.col("full"))
    best = F.min_by(F.struct(F.col("node").alias("u"), F.col("n").alias("n_u")), F.struct((-F.col("n")).alias("n"), "node"))
    top = own.groupBy("form", "line", F.col("cost").alias("cost_u"), F.col("short").alias("short_u")).agg(best.alias("top")).select("form", "line", "cost_u", "short_u", "top.u", "top.n_u")
    v = own.select("form", "line", F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("cost").alias("cost_v"), F.col("short").alias("short_v"))
    errors = F.greatest("cost_u", "cost_v")
    rarer = (F.col("n_v") < F.col("n_u")) | ((F.col("n_v") == F.col("n_u")) & (F.col("v") > F.col("u")))
    near_ = (errors < 2) | ~(F.col("short_u") | F.col("short_v"))
    believed = (F.col("n_v") <= RARE) | (F.col("n_v") * TIMES <= F.col("n_u"))
    typo = v.join(top, ["form", "line"]).filter(rarer & believed & near_)
    parent = typo.groupBy("v").agg(F.min_by("u", F.struct(errors.alias("cost"), (-F.col("n_u")).alias("n"), "u")).alias("u"))
    comp = stored(components(stored(parent.select(F.col("v").alias("a"), F.col("u").alias("b")))))
    entity = stored(nodes.select("node", "line", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))

    # words cut short, and a line left out: only where one organisation alone has the rewriting.  Of the organisations
    # that a rewriting has at one cost, two besides the core's own are as many as any number.
    of = forms.join(entity.select("node", "comp"), "node")
    held = of.select("form", F.col("line").alias("line_u"), "full", F.col("cost").alias("cost_u"), "comp").distinct()
    held = held.groupBy("form", "line_u", "full", "cost_u").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("orgs"))
    v = of.filter(~F.col("full")).select("form", F.col("node").alias("v"), F.col("line").alias("line_v"), F.col("cost").alias("cost_v"), F.col("comp").alias("comp_v"))
    fits = F.col("full") & (F.col("line_u") == F.col("line_v")) | (F.col("line_v") == "") & (F.col("line_u") != "")
    loose = v.join(held, "form").filter(fits).filter((F.col("orgs") > 1) | (F.col("lo") != F.col("comp_v")))
    one, two = F.when(F.col("lo") == F.col("comp_v"), F.col("hi")).otherwise(F.col("lo")), F.when(F.col("hi") == F.col("comp_v"), F.col("lo")).otherwise(F.col("hi"))
    cost = F.when(F.col("full"), F.col("cost_u") + F.col("cost_v")).otherwise(F.greatest("cost_u", "cost_v"))
    least = loose.groupBy("v", "comp_v", cost.alias("cost")).agg(F.min(one).alias("lo"), F.max(two).alias("hi"), F.max("orgs").alias("orgs"))
    rare = least.groupBy("v", "comp_v").agg(F.min_by(F.struct("lo", "hi", "orgs", "cost"), "cost").alias("x")).filter("x.lo = x.hi and x.orgs < 3").select("v", "comp_v", F.col("x.lo").alias("comp_u"), F.col("x.cost").alias("cost"))
    # spellings already held together join one organisation, that of their cheapest rewriting
    more = stored(rare.groupBy(F.col("comp_v").alias("a")).agg(F.min_by("comp_u", F.struct("cost", "comp_u")).alias("b")))
    last = components(more).withColumnRenamed("comp", "org").withColumnRenamed("node", "comp")
    org = entity.join(last, "comp", "left").select("node", F.coalesce("org", "comp").alias("org"))
    named = distinct.select("name", "key", "line").join(nodes.select("key", "line", "node"), ["key", "line"])
    return named.join(org, "node").select("name", "org")


def spellings(spark, sf_dir: str) -> DataFrame:
    """(name, n): every distinct company of listings and offers."""
    a = table(spark, sf_dir, "job_listings", "company_name").select(F.col("company_name").alias("name"))
    b = table(spark, sf_dir, "offers", "company").select(F.col("company").alias("name"))
    return a.unionByName(b).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """(name_a, name_b), name_a < name_b: two spellings of one organisation, all pairs of a group."""
    g = stored(organisations(spellings(spark, sf_dir)))
    a, b = g.select("org", F.col("name").alias("name_a")), g.select("org", F.col("name").alias("name_b"))
    return a.join(b, "org").filter("name_a < name_b").select("name_a", "name_b")


def p3_organisations(spark, sf_dir: str) -> DataFrame:
    """(name, org): every spelling and its organisation."""
    return organisations(spellings(spark, sf_dir))
