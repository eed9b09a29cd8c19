"""Record linkage predicates as columns over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidencia.functions.cities import CITIES
from evidencia.functions.domains import host_of, registrable_domain
from evidencia.functions.text import LEGAL_TAIL, folded, tokens

# fixed values: words that name no role, no organisation of their own, and no place
ROLE_FILLER = "a an the and of for in at wfh remote work from home fresher freshers urgent hiring".split()
OFFICE = "india office offices branch head headquarters hq corporate regional zonal campus centre center plant unit".split()
KIND = "technologies solutions services infotech consultancy consultants enterprises industries systems llc pte corporation".split()
#: Every name of a city, in small letters, with the one it has today; and today's names with all others.
NAMES = {k: v.lower() for k, v in CITIES.items()}
ALIASES: dict[str, list[str]] = {}
for _k, _v in NAMES.items():
    ALIASES.setdefault(_v, []).append(_k)
CITY = sorted({w for name in NAMES for w in name.split()})
REMOTE = r"(?i)\b(?:anywhere|remote|work\s+from\s+home)\b"


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def name_tokens(name: Column) -> Column:
    """Tokens without the legal words at the end."""
    own = tokens(name)
    legal = _words(LEGAL_TAIL)
    # the number of legal words at the end: where the reversed array first has another word
    other = F.array_position(F.transform(F.reverse(own), lambda t: F.array_contains(legal, t)), F.lit(False))
    keep = F.when(other == 0, 0).otherwise(F.size(own) - other.cast("int") + 1)
    return F.slice(own, F.lit(1), keep)


def names_match(a: Column, b: Column, where: Column | None = None) -> Column:
    """One name begins the other word for word, and the longer adds only legal, office or city words or words of ``where``."""
    x, y = name_tokens(a), name_tokens(b)
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    extra = _words([*OFFICE, *LEGAL_TAIL, *KIND, *CITY])
    if where is not None:
        extra = F.concat(extra, F.coalesce(tokens(where), F.array().cast("array<string>")))
    rest = F.slice(long, F.size(short) + 1, F.size(long))
    return (F.size(short) > 0) & (F.slice(long, F.lit(1), F.size(short)) == short) & F.forall(rest, lambda t: F.array_contains(extra, t))


def mentions(text: Column, name: Column) -> Column:
    """The text has the name's tokens one after the other."""
    own = F.array_join(name_tokens(name), " ")
    return (own != "") & F.concat(F.lit(" "), folded(text), F.lit(" ")).contains(F.concat(F.lit(" "), own, F.lit(" ")))


def role_matches(title: Column, role: Column) -> Column:
    """More than half of the role's distinct words, filler and brackets aside, stand in the title."""
    wanted = F.array_except(F.array_distinct(tokens(F.regexp_replace(role, r"\([^)]*\)", " "))), _words(ROLE_FILLER))
    return (F.size(wanted) > 0) & (2 * F.size(F.array_intersect(wanted, tokens(title))) > F.size(wanted))


def in_place(location: Column, place: Column) -> Column:
    """The location has the place's name as whole words."""
    own = folded(place)
    return (own != "") & F.concat(F.lit(" "), folded(location), F.lit(" ")).contains(F.concat(F.lit(" "), own, F.lit(" ")))


def in_city(location: Column, place: Column) -> Column:
    """The location has the city under any of its names as whole words; a city off the list under its own name."""
    spaced = F.concat(F.lit(" "), folded(location), F.lit(" "))
    own = folded(place)
    now = F.coalesce(F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)])[own], own)
    known = F.create_map(*[x for name, every in ALIASES.items() for x in (F.lit(name), _words(every))])[now]
    every = F.array_union(F.array(own, now), F.coalesce(known, F.array().cast("array<string>")))
    return (own != "") & F.exists(every, lambda n: spaced.contains(F.concat(F.lit(" "), n, F.lit(" "))))


def names_a_city(location: Column) -> Column:
    spaced = F.concat(F.lit(" "), folded(location), F.lit(" "))
    return F.exists(_words(NAMES), lambda n: spaced.contains(F.concat(F.lit(" "), n, F.lit(" "))))


def near(location: Column, place: Column) -> Column:
    """In the city, or at a place that is neither remote nor in another city of the list, such as a suburb."""
    return in_city(location, place) | (~is_remote(location) & ~names_a_city(location))


def official_domain(results: Column, company: Column) -> Column:
    """The domain of the first result (link, title) whose label is the whole name run together; failing that, of the first
    whose label of four letters or more begins the name with whole words and whose title mentions it."""
    own = name_tokens(company)
    whole = F.array_join(own, "")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - 1, F.lit(1))), lambda n: F.array_join(F.slice(own, F.lit(1), n), ""))

    def judged(r: Column) -> Column:
        domain = registrable_domain(host_of(r["link"]))
        label = F.replace(F.substring_index(domain, ".", 1), F.lit("-"), F.lit(""))
        part = (F.size(own) > 1) & (F.length(label) >= 4) & F.array_contains(starts, label) & mentions(r["title"], company)
        return F.struct(domain.alias("domain"), F.when(label == whole, 0).when(part, 1).alias("rank"))

    fitting = F.filter(F.transform(results, judged), lambda x: x["rank"].isNotNull() & (whole != ""))
    first = F.filter(fitting, lambda x: x["rank"] == F.array_min(F.transform(fitting, lambda y: y["rank"])))
    return F.get(first, F.lit(0))["domain"]


def is_remote(location: Column) -> Column:
    return location.rlike(REMOTE)


def carries_phone(text: Column, phone: Column) -> Column:
    """The last ten digits of ``phone`` stand in the text, whatever separates them."""
    digits = F.right(F.regexp_replace(phone, r"\D", ""), F.lit(10))
    return (F.length(digits) == 10) & F.regexp_replace(text, r"[\s().+-]", "").contains(digits)


def carries_contact(text: Column, contact: Column) -> Column:
    """A number as ``carries_phone`` finds it, or a whole address, no part of a longer one."""
    known = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_.%+-]+@[a-z0-9.-]+)"), F.lit(1)), lambda x: F.rtrim(x, F.lit(".-")))
    return F.when(contact.contains("@"), F.array_contains(known, F.lower(contact))).otherwise(carries_phone(text, contact))
