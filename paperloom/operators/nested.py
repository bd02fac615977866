"""Nested JSON records as flat related tables (problem 7).

The method: infer a merged schema over all records, then expand one array level after another, each
into its child relation, a child carrying its parent's surrogate key and its own array ordinal.

The merged schema says which of the declared levels occur at all; the recursion of a level into itself is
folded in it. A record is then read once and expanded inside one task by a stack of its open nodes, so the
plan is the same for records of depth one and of depth ten thousand, and nothing is shuffled but the few
records that were delivered more than once, which are made one before they are expanded.

Defined results: null, blank, cut-off and non-object payloads give no rows; a payload wrapped any number
of times in a byte order mark, in white space, in a JSON string or in an array of one is unwrapped; a
depth at which the JSON reader gives up is read by a reader of our own, which has no such depth; null
entries take an ordinal but give no row; one object in place of an array has ordinal 1; repeated
deliveries of one record give its rows once, and different payloads of one record give the nodes of all,
each path once (as do two tables in one cell); further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.runtime import BROADCAST_ROWS


@dataclass(frozen=True)
class Level:
    """One child relation: `via` are the JSON paths of the arrays that lead from the parent to it.

    `grid` levels are arrays of arrays and are addressed by row and column.
    """

    parent: str
    child: str
    via: tuple[str, ...]
    grid: bool = False

    def keys(self) -> tuple[tuple[str, ...], ...]:
        return tuple(tuple(v[2:].split(".")) for v in self.via)


@dataclass(frozen=True)
class NestedSpec:
    root: str
    levels: tuple[Level, ...]
    fields: dict[str, str] = field(default_factory=dict)

    def below(self, kind: str) -> list[Level]:
        return [x for x in self.levels if x.parent == kind]


#: A canonical document: units, their elements, the elements' children, table cells, tables in cells.
CANONICAL = NestedSpec(
    "record",
    (
        Level("record", "unit", ("$.units",)),
        Level("unit", "element", ("$.elements",)),
        Level("element", "element", ("$.children",)),
        Level("element", "cell", ("$.data.rows",), grid=True),
        Level("cell", "cell", ("$.content", "$.table", "$.rows"), grid=True),
    ),
    {"node_id": "$.element_id", "node_type": "$.element_type", "text": "$.text", "kind": "$.kind", "name": "$.name"},
)

# --- reading -----------------------------------------------------------------------------------------

_SPACE = " \t\r\n"
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def deep_json(text: str) -> object:
    """A JSON value of any depth, read without recursion."""
    at, size = 0, len(text)
    stack: list[list | dict] = []
    keys: list[str] = []
    value: object = None

    def skip(i: int) -> int:
        while i < size and text[i] in _SPACE:
            i += 1
        return i

    def key(i: int) -> int:
        """Reads `"name":` and remembers the name."""
        i = skip(i)
        if text[i : i + 1] != '"':
            raise ValueError("a key is missing")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        keys.append(name)
        return i + 1

    while True:
        at = skip(at)
        c = text[at : at + 1]
        if c in ("{", "["):
            opened: list | dict = {} if c == "{" else []
            inside = skip(at + 1)
            if text[inside : inside + 1] != ("}" if c == "{" else "]"):
                stack.append(opened)
                at = key(inside) if c == "{" else inside
                continue
            value, at = opened, inside + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            word = m.group()
            value, at = _WORDS[word] if word in _WORDS else float(word) if any(x in word for x in ".eE") else int(word), m.end()
        else:
            raise ValueError("a value is missing")
        while stack:  # a value ends: it goes into what is open, which may end with it
            top = stack[-1]
            if isinstance(top, dict):
                top[keys.pop()] = value
            else:
                top.append(value)
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = key(at + 1) if isinstance(top, dict) else at + 1
                break
            if c != ("}" if isinstance(top, dict) else "]"):
                raise ValueError("an end is missing")
            value, at = stack.pop(), at + 1
        else:
            if skip(at) != size:
                raise ValueError("more than one value")
            return value


def read_json(text: str) -> object:
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return deep_json(text)


def unwrap(payload: str | None) -> dict | None:
    """The object of a payload, out of all strings and arrays of one around it; null where there is none."""
    v: object = payload
    while not isinstance(v, dict):
        if isinstance(v, str):
            try:
                v = read_json(v.lstrip("﻿" + _SPACE))
            except ValueError:
                return None
        elif isinstance(v, list) and len(v) == 1:
            v = v[0]
        else:
            return None
    return v


# --- merged schema -----------------------------------------------------------------------------------

_SCHEMA = T.StructType(
    [
        T.StructField("node_path", T.StringType()),
        T.StructField("json_type", T.StringType()),
        T.StructField("occurrences", T.LongType()),
    ]
)
_JSON_TYPES = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
#: Paths that a task holds before it passes their counts on.
_FLUSH = 200_000


def _catalogue(doc: dict, seen: dict) -> None:
    """Field paths; the recursion of a key into itself is folded, so that the catalogue is finite."""
    stack: list[tuple[object, tuple[str, ...]]] = [(doc, ())]
    pop, push = stack.pop, stack.append
    while stack:
        v, path = pop()
        kind = type(v)
        key = (path, kind)
        seen[key] = seen.get(key, 0) + 1
        if kind is dict:
            for k, x in v.items():
                if k in path and (type(x) is dict or type(x) is list):
                    push((x, path[: path.index(k) + 1]))
                else:
                    push((x, (*path, k)))
        elif kind is list:
            for x in v:
                if x is not None:
                    push((x, path))


def merged_schema(df: DataFrame, json_col: str) -> DataFrame:
    """Every field path of all rows with its JSON types and how often each occurs; recursion is folded."""

    def batch(seen: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([".".join(p) for p, _ in seen], pa.string()), pa.array([_JSON_TYPES.get(t, "null") for _, t in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=_SCHEMA.names
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[tuple[str, ...], type], int] = {}
        for b in batches:
            for payload in b.column(0).to_pylist():
                if (doc := unwrap(payload)) is not None:
                    _catalogue(doc, seen)
            if len(seen) > _FLUSH:
                yield batch(seen)
                seen = {}
        yield batch(seen)

    found = df.select(F.col(json_col).alias("payload")).mapInArrow(scan, _SCHEMA)
    return found.groupBy("node_path", "json_type").agg(F.sum("occurrences").alias("occurrences"))


def occurring(schema: DataFrame, spec: NestedSpec) -> NestedSpec:
    """`spec` with the levels whose arrays occur in the merged schema; what is collected is bounded by the spec."""
    last = {lv: lv.keys()[-1][-1] for lv in spec.levels}
    name = F.substring_index("node_path", ".", -1)
    here = schema.where(F.col("json_type").isin("array", "object") & name.isin(*set(last.values()))).select(name.alias("n")).distinct().collect()
    names = {r.n for r in here}
    return NestedSpec(spec.root, tuple(lv for lv in spec.levels if last[lv] in names), spec.fields)


# --- expansion ---------------------------------------------------------------------------------------


def _at(v: object, keys: tuple[str, ...]) -> object:
    for k in keys:
        if type(v) is not dict:
            return None
        v = v.get(k)
    return v


def _list(v: object) -> list:
    """An array; a single object in its place counts as an array of one."""
    return v if type(v) is list else [v] if type(v) is dict else []


def _text(v: object) -> str | None:
    return v if v is None or type(v) is str else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


class Walk:
    """The nodes of records, level by level."""

    def __init__(self, spec: NestedSpec):
        self.root = spec.root
        self.below = {k: [(lv.child, lv.keys(), lv.grid) for lv in spec.below(k)] for k in {lv.parent for lv in spec.levels}}

    def nodes(self, doc: dict) -> Iterator[tuple[str, str, str, int, object]]:
        """(relation, node_path, parent_path, ordinal, node) of every node below the root, parents first."""
        stack: list[tuple[str, str, object]] = [(self.root, "", doc)]
        seen: set[str] = set()
        while stack:
            kind, path, v = stack.pop()
            prefix = f"{path}." if path else ""
            for child, via, grid in self.below.get(kind, ()):
                if not grid:
                    for i, x in enumerate(_list(_at(v, via[0])), 1):
                        if type(x) is dict:
                            here = f"{prefix}{i}"
                            yield child, here, path, i, x
                            stack.append((child, here, x))
                    continue
                holders = [v]
                for keys in via[:-1]:
                    holders = [x for h in holders for x in _list(_at(h, keys))]
                for h in holders:
                    for i, row in enumerate(_list(_at(h, via[-1])), 1):
                        for j, x in enumerate(_list(row), 1):
                            if x is not None:
                                here = f"{prefix}r{i}c{j}"
                                if here not in seen:
                                    seen.add(here)
                                    yield child, here, path, j, x
                                if type(x) is dict:
                                    stack.append((child, here, x))


def expand(df: DataFrame, id_col: str, json_col: str, spec: NestedSpec = CANONICAL, fields: bool = True, rows_at_once: int = 50_000) -> DataFrame:
    """rec_id, relation, node_path, parent_path, ordinal and the spec's fields of every node of every level."""
    names = list(spec.fields) if fields else []
    keys = [tuple(spec.fields[n][2:].split(".")) for n in names]
    source = df.select(F.col(id_col).alias("rec_id"), F.col(json_col).alias("payload"))
    head = [("relation", T.StringType(), pa.string()), ("node_path", T.StringType(), pa.string()), ("parent_path", T.StringType(), pa.string()), ("ordinal", T.IntegerType(), pa.int32())]
    head += [(n, T.StringType(), pa.string()) for n in names]
    schema = T.StructType([source.schema["rec_id"], *(T.StructField(n, k) for n, k, _ in head)])
    walk = Walk(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.column(0).type
            ids: list = []
            columns: list[list] = [[] for _ in head]

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, k) for c, (_, _, k) in zip(columns, head, strict=True))], names=schema.names)  # noqa: B023

            for rec, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc = unwrap(payload)
                if doc is None:
                    continue
                for kind, path, parent, ordinal, node in walk.nodes(doc):
                    ids.append(rec)
                    for c, x in zip(columns, (kind, path, parent, ordinal), strict=False):
                        c.append(x)
                    for c, k in zip(columns[4:], keys, strict=True):
                        c.append(_text(_at(node, k)))
                    if len(ids) >= rows_at_once:
                        yield batch()
                        ids, columns = [], [[] for _ in head]
            yield batch()

    return source.mapInArrow(run, schema)


def flatten_records(df: DataFrame, id_col: str = "rec_id", json_col: str = "payload", spec: NestedSpec = CANONICAL, fields: bool = True, at_most: int = BROADCAST_ROWS) -> DataFrame:
    """All relations of `spec` in one table, a relation being `where relation = name`.

    rec_id and node_path are the surrogate key, rec_id and parent_path the parent's. Only the ids are grouped to
    find the records that came more than once; up to `at_most` of these ids are broadcast, beyond that all
    payloads are shuffled by their id.
    """
    spec = occurring(merged_schema(df, json_col), spec)
    rows = df.select(F.col(id_col).alias("rec_id"), F.col(json_col).alias("payload"))
    again = rows.groupBy("rec_id").count().where("count > 1").select(F.col("rec_id").alias("again")).cache()
    few = again.count() <= at_most
    once, several = rows.limit(0), rows
    if few:
        same = F.col("rec_id").eqNullSafe(F.col("again"))
        once, several = rows.join(F.broadcast(again), same, "left_anti"), rows.join(F.broadcast(again), same, "left_semi")
    key = ["rec_id", "relation", "node_path"]
    merged = expand(several.dropDuplicates(["rec_id", "payload"]), "rec_id", "payload", spec, fields).dropDuplicates(key)
    return expand(once, "rec_id", "payload", spec, fields).unionByName(merged) if few else merged


def nodes_found(df: DataFrame, id_col: str = "rec_id", json_col: str = "payload", spec: NestedSpec = CANONICAL) -> DataFrame:
    """rec_id, node_path and parent_path of every element and table cell."""
    flat = flatten_records(df, id_col, json_col, spec, fields=False)
    return flat.where(F.col("relation").isin("element", "cell")).select("rec_id", "node_path", "parent_path")
