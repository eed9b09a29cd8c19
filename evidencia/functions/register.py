"""Names under which the Arrow functions can be used in SQL, and a check of named arguments."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from evidencia.functions.domains import lookalike, to_ascii
from evidencia.functions.edits import distance
from evidencia.operators.scrub import count_phones_column, mask_phones_column, pay_sentences_column


def _pairs(f, kind):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, kind)


def register(spark: SparkSession) -> list[str]:
    """Registers all of them; returns their names.  A null argument gives null, for the count 0."""
    found = {
        "ev_mask_phones": mask_phones_column,
        "ev_count_phones": count_phones_column,
        "ev_pay_sentences": pay_sentences_column,
        "ev_to_ascii": to_ascii,
        "ev_edit_distance": _pairs(distance, IntegerType()),
        "ev_lookalike": _pairs(lookalike, StringType()),
    }
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)


def _is(value, kind: str) -> bool:
    kinds = {"string": str, "integer": int, "boolean": bool, "object": dict, "array": list, "number": int | float}
    return isinstance(value, kinds[kind]) and (kind == "boolean" or not isinstance(value, bool))


#: Each keyword of a schema with what it applies to, when it is broken, and how that is said.
KEYWORDS = {
    "type": (object, lambda v, want: not _is(v, want), "must be of type {}"),
    "enum": (object, lambda v, want: v not in want, "must be one of {}"),
    "minLength": (str, lambda v, want: len(v) < want, "is too short"),
    "maxLength": (str, lambda v, want: len(v) > want, "is too long"),
    "pattern": (str, lambda v, want: re.search(want, v) is None, "has another form"),
    "minimum": (int | float, lambda v, want: v < want, "is too small"),
    "required": (dict, lambda v, want: not v.keys() >= set(want), "lacks {}"),
    "minProperties": (dict, lambda v, want: len(v) < want, "has too few members"),
}


def refusal(value, schema: dict, name: str = "arguments") -> str | None:
    """Why ``value`` does not fit a schema of the KEYWORDS, properties and additionalProperties; None if it does."""
    for word, (applies, broken, said) in KEYWORDS.items():
        if word in schema and isinstance(value, applies) and broken(value, schema[word]):
            want = schema[word]
            shown = next(k for k in want if k not in value) if word == "required" else ", ".join(map(str, want)) if word == "enum" else want
            return f"{name} {said.format(shown)}"
    members = value if isinstance(value, dict) else {}
    known = schema.get("properties", {})
    strange = [] if schema.get("additionalProperties", True) else [k for k in members if k not in known]
    if strange:
        return f"{name} has no member {strange[0]}"
    return next(filter(None, (refusal(v, known[k], k) for k, v in members.items() if k in known)), None)


def checked(calls: DataFrame, schemas: dict[str, dict], tool: str = "tool", arguments: str = "arguments") -> DataFrame:
    """Calls with why each is refused, null for those that may run: an unknown tool, arguments that are no JSON object, or
    that do not fit the tool's schema.  A refusal is a value, so that one bad call stops no other."""

    @F.pandas_udf(StringType())
    def why(tools: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([_refused(t, g, schemas) for t, g in zip(tools, given)], dtype=object)

    return calls.withColumn("refusal", why(tool, arguments))


def _refused(tool, given, schemas: dict[str, dict]) -> str | None:
    if tool not in schemas:
        return f"there is no tool {tool}"
    try:
        value = json.loads(given) if given is not None else {}
    except (ValueError, RecursionError):
        return "arguments are no JSON"
    return refusal(value, {"type": "object"} | schemas[tool])
