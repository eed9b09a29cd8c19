"""Text primitives as columns: everything here stays in the JVM.

A null text gives null (predicates: null), an empty one the empty result.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that end a company's name in law, and words that warn of fraud
LEGAL_TAIL = ("pvt", "private", "ltd", "limited", "llp", "inc", "corp", "co")
FRAUD_TERMS = ("fraud", "fake", "beware", "scam", "not affiliated")

FRAUD = r"(?i)\b(?:" + "|".join(t.replace(" ", r"\s+") for t in FRAUD_TERMS) + ")"
LEGAL = r"(?i)(?:[\s,]+(?:" + "|".join(LEGAL_TAIL) + r")\.?)+[.,\s]*$"
SENTENCE_END = r"[!?]+|\n|\.(?:\s|$)"
EMAIL = r"[A-Za-z0-9_.%+*-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
MOBILE = r"(?:\+?91[ -]?)?[6-9][0-9]{4}[ .-]?[0-9]{5}"
WORDS = r"[\p{L}\p{M}\p{N}_@.+-]+"
LONG_HEX = r"[0-9a-fA-F]{64,}"
# fixed value: a key in an address or a line, up to what ends its value
KEY_VALUE = r"(api_key=)[^&\s\"'<>]+"


def _letters() -> tuple[str, str]:
    """Characters outside ASCII that are one ASCII character with marks or in another width, and that character."""
    found = {chr(c): a[0] for c in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)) if len(a := [x for x in unicodedata.normalize("NFKD", chr(c)) if x.isascii()]) == 1}
    return "".join(found), "".join(found.values())


LETTERS, PLAIN = _letters()


def plain(text: Column) -> Column:
    """Letters without their marks and in the usual width; what is no ASCII then is dropped."""
    return F.regexp_replace(F.translate(text, LETTERS, PLAIN), r"[^\x00-\x7F]", "")


def tokens(text: Column) -> Column:
    """Lower-case words and numbers of the plain text, `&` read as `and`."""
    return F.regexp_extract_all(F.lower(F.replace(plain(text), F.lit("&"), F.lit(" and "))), F.lit("([a-z0-9]+)"), F.lit(1))


def folded(text: Column) -> Column:
    """The tokens joined by single spaces."""
    return F.array_join(tokens(text), " ")


def normalised(text: Column) -> Column:
    """Case folded, with only words of any script and the signs of addresses kept, single spaces between."""
    return F.array_join(F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(f"({WORDS})"), F.lit(1)), " ")


def search_name(company: Column) -> Column:
    """A company's name without the legal words at its end; the first word always stays."""
    return F.regexp_replace(F.regexp_replace(company, LEGAL, ""), r"[.,]+$", "")


def sentence_count(text: Column) -> Column:
    """Sentences with anything but white space in them."""
    return F.size(F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(r"\S")))


def warns_of_fraud(text: Column) -> Column:
    return text.rlike(FRAUD)


def emails(text: Column) -> Column:
    """Addresses in order of appearance, lower case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1)), lambda x: F.lower(x)))


def mobiles(text: Column) -> Column:
    """Indian mobile numbers as +91 ddddd ddddd in order of appearance, each once."""
    digits = lambda x: F.right(F.regexp_replace(x, r"\D", ""), F.lit(10))
    form = lambda x: F.concat(F.lit("+91 "), F.substring(digits(x), 1, 5), F.lit(" "), F.substring(digits(x), 6, 5))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({MOBILE})"), F.lit(1)), form))


def mask_emails(text: Column) -> Column:
    """Local parts written as ***; `%40` counts as an at-sign."""
    return F.regexp_replace(text, r"[A-Za-z0-9_.%+-]+(@|%40)((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", "***$1$2")


def drop_keys(text: Column) -> Column:
    """Without runs of 64 or more hexadecimal digits and values of api_key."""
    return F.regexp_replace(F.regexp_replace(text, LONG_HEX, ""), KEY_VALUE, "$1")


def redact_long(text: Column, most: int = 200) -> Column:
    """A longer text than ``most`` characters as a note of its length."""
    return F.when(F.length(text) > most, F.concat(F.lit("["), F.length(text).cast("string"), F.lit(" characters]"))).otherwise(text)


def redacted(text: Column, most: int = 200) -> Column:
    """For logs: a long text as a note of its length, a short one without the local parts of addresses and without keys."""
    return F.when(F.length(text) > most, redact_long(text, most)).otherwise(drop_keys(mask_emails(text)))


def well_formed(value: Column) -> Column:
    """A number that JSON can hold: NaN and infinities become null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
