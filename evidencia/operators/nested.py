"""Deeply nested JSON records as related flat tables, by shared inlining (problem 7).

The schema graph has a node for each member name and an edge for each name seen inside another.  A node is kept
inside its parent's table while it occurs at most once there; it gets a table of its own where it is an array's
entry, is reached from two or more parents, or contains itself.  Each row keeps its record, its parent's row, and its
place in the parent's list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencia.runtime import spread

ROOT = ""
#: Distinct edges of a schema graph; beyond, member names are data and not a schema, which is an error and not a cut.
EDGES = 200_000
#: SQL types of scalars, from the narrowest; two of them in one column make it a string, save for the two of numbers.
TYPES = {"boolean": "boolean", "integer": "bigint", "number": "double", "string": "string"}

_NEXT = re.compile(r'[ \t\n\r]*(?:(?P<sign>[{}\[\]:,])|(?P<word>true|false|null)|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<string>"))')
_WORDS = {"true": True, "false": False, "null": None}


def reject(name: str):
    raise ValueError(f"{name} is no JSON")


def loads(text: str):
    """The value of a complete JSON text of any depth; ValueError if it is none."""
    try:
        return json.loads(text, parse_constant=reject)
    except RecursionError:
        return deep_loads(text)


def deep_loads(text: str):
    """The same without a stack of calls: open containers are kept in a list."""
    open_: list = []  # (container, key that waits for its value)
    at, value, state = 0, None, "value"  # what may come next: value, first (or an end), key, colon, after
    while True:
        m = _NEXT.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at, sign, done = m.end(), m["sign"], False
        if sign in ("}", "]"):
            if not open_ or (sign == "}") != isinstance(open_[-1][0], dict) or state not in ("first", "after"):
                raise ValueError(f"no JSON at {at}")
            value, done = open_.pop()[0], True
        elif sign == ",":
            if state != "after":
                raise ValueError(f"no JSON at {at}")
            state = "key" if isinstance(open_[-1][0], dict) else "value"
        elif sign == ":":
            if state != "colon":
                raise ValueError(f"no JSON at {at}")
            state = "value"
        elif state == "key" or state == "first" and isinstance(open_[-1][0], dict):
            if not m["string"]:
                raise ValueError(f"no JSON at {at}")
            key, at = scanstring(text, at, True)
            open_[-1][1], state = key, "colon"
        elif state not in ("value", "first"):
            raise ValueError(f"no JSON at {at}")
        elif sign:
            open_.append([{} if sign == "{" else [], None])
            state = "first"
        else:
            if m["string"]:
                value, at = scanstring(text, at, True)
            elif m["word"]:
                value = _WORDS[m["word"]]
            else:
                value = float(m["number"]) if re.search("[.eE]", m["number"]) else int(m["number"])
            done = True
        if done:
            if not open_:
                if text[at:].strip(" \t\n\r"):
                    raise ValueError(f"more behind {at}")
                return value
            inside, key = open_[-1]
            if isinstance(inside, dict):
                inside[key] = value
            else:
                inside.append(value)
            state = "after"


def dumps(value) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out, todo = [], [value]
        while todo:
            v = todo.pop()
            if isinstance(v, _Text):
                out.append(v)
            elif isinstance(v, dict):
                parts = [x for k, y in v.items() for x in (_Text(", "), _Text(json.dumps(k, ensure_ascii=False) + ": "), y)]
                todo += [_Text("}"), *reversed(parts[1:]), _Text("{")]
            elif isinstance(v, list):
                parts = [x for y in v for x in (_Text(", "), y)]
                todo += [_Text("]"), *reversed(parts[1:]), _Text("[")]
            else:
                out.append(json.dumps(v, ensure_ascii=False))
        return "".join(out)


class _Text(str):
    """A piece of JSON text among values."""


def parse(body: str | None):
    """The value of a complete JSON text, or None; also of a text held in a JSON string."""
    if body is None:
        return None
    try:
        return opened(loads(body))
    except ValueError:
        return None


def opened(value):
    """``value``, or what it holds if it is a string that is itself a JSON object or list, however often wrapped."""
    inner = value
    while isinstance(inner, str) and inner.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = loads(inner)
        except ValueError:
            break
    return inner if isinstance(inner, dict | list) else value


def kind_of(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    for kind, of in (("null", type(None)), ("list", list), ("object", dict), ("integer", int), ("number", float)):
        if isinstance(value, of):
            return "number" if kind == "integer" and abs(value) >> 63 else kind
    return "string"


def edges(value) -> set[tuple[str, str, str]]:
    """(parent, child, kind) of every member below ``value``, at any depth."""
    found, todo = set(), [(ROOT, opened(value))]
    while todo:
        name, v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                x = opened(x)
                found.add((name, k, kind_of(x)))
                if isinstance(x, dict | list):
                    todo.append((k, x))
        elif isinstance(v, list):
            todo += [(name, x) for x in map(opened, v) if isinstance(x, dict | list)]
    return found


@dataclass
class Schema:
    """What the graph says: the names that have tables, and those that are inlined."""

    tables: set[str] = field(default_factory=set)
    lists: set[str] = field(default_factory=set)
    parents: dict[str, set[str]] = field(default_factory=dict)
    kinds: dict[tuple[str, str], set[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, seen: list[tuple[str, str, str]]) -> Schema:
        parents: dict[str, set[str]] = {}
        kinds: dict[tuple[str, str], set[str]] = {}
        inner, lists = set(), set()
        for parent, child, kind in seen:
            if kind == "null":
                continue
            parents.setdefault(child, set()).add(parent)
            kinds.setdefault((parent, child), set()).add(kind)
            if kind == "list":
                lists.add(child)
            elif kind == "object":
                inner.add(child)
        shared = {c for c, p in parents.items() if len(p) > 1 and c in inner}
        recursive = {c for c in inner | lists if c in cls._above(c, parents)}
        return cls({ROOT} | lists | shared | recursive, lists, parents, kinds)

    def columns(self, table: str) -> dict[str, str]:
        """The columns inlined in a table, by dotted name, with the narrowest SQL type that holds all values seen."""
        out, todo = {}, [(table, "")]
        while todo:
            name, prefix = todo.pop()
            for (parent, child), kinds in sorted(self.kinds.items()):
                if parent != name or child in self.lists:
                    continue
                scalar = kinds & TYPES.keys()
                if scalar:
                    out[prefix + child] = "double" if scalar == {"integer", "number"} else TYPES[next(iter(scalar))] if len(scalar) == 1 else "string"
                if "object" in kinds and child not in self.tables:
                    todo.append((child, f"{prefix}{child}."))
        return out

    @staticmethod
    def _above(name: str, parents: dict[str, set[str]]) -> set[str]:
        found: set[str] = set()
        todo = list(parents.get(name, ()))
        while todo:
            p = todo.pop()
            if p not in found:
                found.add(p)
                todo += parents.get(p, ())
        return found


def analyse(df: DataFrame, body: str) -> Schema:
    """The schema graph of all bodies; what reaches the driver is one row for each distinct edge, EDGES at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = set()
            for b in f["body"]:
                found |= edges(parse(b))
            yield pd.DataFrame(sorted(found), columns=["parent", "child", "kind"])

    seen = spread(df.select(F.col(body).alias("body"))).mapInPandas(run, "parent string, child string, kind string").distinct()
    got = [tuple(r) for r in seen.limit(EDGES + 1).collect()]
    if len(got) > EDGES:
        raise ValueError(f"more than {EDGES} distinct members: names that are data must be made values first")
    return Schema.of(got)


def rows(value, schema: Schema) -> list[tuple[str, int, int | None, str | None, str | None, int, str | None, dict]]:
    """(table, row, parent row, parent table, via, pos, value, columns) of one record, the root first.

    ``via`` is the member of the parent's row that holds it, dotted where objects between them were inlined.

    A single value where other records have a list is a list of one; null entries keep their place and have no
    value.  Columns of inlined objects have dotted names.  Records of any depth are walked without a stack of calls.
    """
    out: list = []
    walks: list = []  # (iterator of members or of entries, what they belong to), the innermost last

    def text(v) -> str | None:
        return v if isinstance(v, str) else None if v is None else dumps(v)

    def add(table: str, v, parent: int | None, parent_table: str | None, via: str | None, pos: int) -> None:
        row, columns = len(out), {}
        out.append((table, row, parent, parent_table, via, pos, None if isinstance(v, dict) else text(v), columns))
        if isinstance(v, dict):
            walks.append((iter(v.items()), None, (row, table, columns), ()))

    if isinstance(value, dict):
        add(ROOT, value, None, None, None, 0)
    while walks:
        items, name, own, prefix = walks[-1]
        row, table, columns = own
        depth = len(walks)
        for k, x in items:
            x = opened(x)
            if name is not None:  # an entry of the list of that name, k its place
                add(name, x, row, table, _path(prefix, name), k)
            elif k in schema.lists:
                if x is not None:
                    walks.append((enumerate(x if isinstance(x, list) else [x]), k, own, prefix))
            elif isinstance(x, dict):
                if k in schema.tables:
                    add(k, x, row, table, _path(prefix, k), 0)
                else:
                    walks.append((iter(x.items()), None, own, (prefix, k)))
            elif x is not None:
                columns[_path(prefix, k)] = text(x)
            if len(walks) > depth:
                break
        else:
            walks.pop()
    return out


def _path(prefix: tuple, name: str) -> str:
    parts = [name]
    while prefix:
        prefix, own = prefix
        parts.append(own)
    return ".".join(reversed(parts))


ROWS = "tab string, row_no bigint, parent_row bigint, parent_tab string, via string, pos bigint, value string, cols map<string,string>"


def shred(df: DataFrame, key: str, body: str, schema: Schema | None = None) -> DataFrame:
    """All rows of all tables: (key, tab, row_no, parent_row, parent_tab, via, pos, value, cols).

    ``tab`` is the member name, '' for the record itself; (key, row_no) is a row's key, (key, parent_row) that of its
    parent.  Scalar list entries have ``value``, objects have ``cols``; ``tables`` makes typed tables of them.  A null body, one that is no complete JSON and
    one that is no object give no row.  Records of equal key and body give their rows once.  No shuffle is needed
    beyond that: parent and child leave the same task.
    """
    schema = schema or analyse(df, body)
    kind = df.schema[key].dataType.simpleString()
    once = df.select(F.col(key).alias("key"), F.col(body).alias("body")).filter(F.col("body").isNotNull()).dropDuplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, *r) for k, b in zip(f["key"], f["body"]) for r in rows(parse(b), schema)]
            yield pd.DataFrame(out, columns=["key", "tab", "row_no", "parent_row", "parent_tab", "via", "pos", "value", "cols"]).astype({"parent_row": "Int64"})

    return once.mapInPandas(run, f"key {kind}, {ROWS}").withColumnRenamed("key", key)


def flat(shredded: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """One table: its rows' keys, the parent's, ``pos``, ``value``, and the named columns, null where missing.

    A column is a dotted name, or one with a type behind it; a value that its type does not hold is null.
    """

    def member(column: str) -> Column:
        of, _, kind = column.partition(" ")
        return F.col("cols")[of].try_cast(kind or "string").alias(of.replace(".", "_"))

    return shredded.filter(F.col("tab") == name).select(key, "row_no", "parent_row", "parent_tab", "via", "pos", "value", *map(member, columns))


def tables(shredded: DataFrame, key: str, schema: Schema) -> dict[str, DataFrame]:
    """Every table of the schema with all its columns, typed."""
    return {name: flat(shredded, key, name, [f"{c} {t}" for c, t in schema.columns(name).items()]) for name in sorted(schema.tables)}


def children(shredded: DataFrame, key: str, name: str, of: str, via: str) -> DataFrame:
    """Entries of table ``name`` with the place of their parent in table ``of``, itself held in member ``via``:
    (key, parent_pos, pos, value)."""
    parent = shredded.filter((F.col("tab") == of) & (F.col("via") == via)).select(F.col(key).alias("pk"), F.col("row_no").alias("pr"), F.col("pos").alias("parent_pos"))
    child = shredded.filter((F.col("tab") == name) & (F.col("parent_tab") == of))
    met: Column = (child[key] == parent["pk"]) & (child["parent_row"] == parent["pr"])
    return child.join(parent, met).select(key, "parent_pos", "pos", "value")
