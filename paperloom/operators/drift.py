"""Fields that drift between schema versions of one producer (problem 2).

The method is a column lifespan catalogue. Every element's `data` is reduced to its schema inside the
JVM (`schema_of_variant`), equal schemas are counted before anything is shuffled, and the few distinct
schemas are exploded into (producer, version, field, JSON type). `lag`/`lead` over the versions a
producer has turn the catalogue into islands of presence, whose starts and ends are the log of changes.
A field that ends where a sibling of the same JSON type starts is a rename candidate; the values on both
sides decide (histograms of the shapes of whole values, computed in one pass for the candidates only). The
renames form the alias table from which the casts of the unified table are generated.

Inside, a field is the keys that lead to it joined by U+001F, so that a key may hold a dot or a quote; the
results join them by a dot.

Defined results: null, unreadable or non-object data has no fields; an empty object has none either;
null values don't make a field present; documents without a version take no part in the changes, but
their elements are in the unified table, with a null version; versions are compared by their numeric
components; repeated deliveries change nothing; further columns are ignored. Names of fields reach the
driver, so a report over more than `MOST_FIELDS` changes or fields (ids used as keys) is refused with an error.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from paperloom.runtime import cut, once_each

CHANGES = "extractor string, schema_version string, change_kind string, field_path string, new_path string"
#: Least similarity (0 to 1) of the value profiles of the two sides of a rename.
RENAME_LEAST = 0.4
#: Joins the keys of a field's path inside this module.
SEP = "\x1f"
#: Most rows of the change log, and most fields, that the driver takes.
MOST_FIELDS = 100_000


class TooManyFields(ValueError):
    """There are more fields than a table of fields can have; ids may have been used as keys."""


def bounded(df: DataFrame, most: int) -> list:
    """The rows of `df`, of which there may be at most `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooManyFields(f"more than {most} rows of field names")
    return rows


def shown(path: str) -> str:
    return path.replace(SEP, ".")


def version_key(version: Column) -> Column:
    """array<int> of a version's numeric components, null where there are none; 'v1.10 ' is [1, 10]."""
    clean = F.regexp_replace(F.trim(version), r"^[vV]?\s*", "")
    clean = F.when(clean.rlike(r"^\d+(\.\d+)*$"), clean)
    return F.transform(F.split(clean, r"\."), lambda x: x.try_cast("int"))


def origins(docs: DataFrame) -> DataFrame:
    """doc_id, extractor and normalised version (null where there is none), once per document."""
    key = version_key(F.col("schema_version"))
    best = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(key.alias("version_key"), "extractor")).alias("o"))
    version = F.array_join(F.col("o.version_key").cast("array<string>"), ".")
    return best.select("doc_id", "o.extractor", F.when(version != "", version).alias("schema_version"), "o.version_key")


def versioned(df: DataFrame) -> DataFrame:
    return df.where("extractor is not null and schema_version is not null")


# --- schemas of single values ------------------------------------------------------------------------

_NAME = re.compile(r"[A-Z_]+(\(\d+,\s*\d+\))?")
_TYPES = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "ARRAY": "array", "OBJECT": "object"}


def leaves(schema: str) -> list[tuple[str, str]]:
    """(path, JSON type) of every non-null leaf of a `schema_of_variant` string."""
    pos, out = 0, []

    def kind(path: str) -> None:
        nonlocal pos
        m = _NAME.match(schema, pos)
        name = m.group().split("(")[0] if m else "VOID"
        pos = m.end() if m else len(schema)
        if name == "OBJECT" and schema[pos : pos + 1] == "<":
            pos += 1
            while pos < len(schema) and schema[pos] != ">":
                key = field()
                kind(f"{path}{SEP}{key}" if path else key)
                if schema[pos : pos + 2] == ", ":
                    pos += 2
            pos += 1
        elif name == "ARRAY" and schema[pos : pos + 1] == "<":
            depth, quoted = 0, False
            while pos < len(schema):
                c = schema[pos]
                quoted ^= c == "`"
                depth += 0 if quoted else (c == "<") - (c == ">")
                pos += 1
                if not depth:
                    break
            out.append((path, "array"))
        elif name not in ("OBJECT", "VOID"):
            out.append((path, _TYPES.get(name, "number")))

    def field() -> str:
        nonlocal pos
        if schema[pos] == "`":
            key = ""
            pos += 1
            while pos < len(schema):
                if schema[pos] == "`":
                    if schema[pos + 1 : pos + 2] != "`":
                        break
                    pos += 1
                key += schema[pos]
                pos += 1
            pos += 3  # the closing quote and ": "
            return key
        end = schema.index(": ", pos)
        key, pos = schema[pos:end], end + 2
        return key

    kind("")
    return [x for x in out if x[0]]


def catalogue(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """extractor, schema_version, version_key, field, json_type, elements: which field has which type where.

    extractor and version are null for documents without them.
    """
    shape = F.schema_of_variant(F.try_parse_json("data"))
    shapes = elements.select("doc_id", shape.alias("shape")).where(F.col("shape").startswith("OBJECT<")).groupBy("doc_id", "shape").agg(F.count("*").alias("n"))
    of = shapes.join(origins(docs), "doc_id", "left")
    per = of.groupBy("extractor", "schema_version", "version_key", "shape").agg(F.sum("n").alias("n"))

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.extractor, r.schema_version, r.version_key, p, t, r.n) for r in b.itertuples() for p, t in leaves(r.shape)]
            yield pd.DataFrame(rows, columns=["extractor", "schema_version", "version_key", "field", "json_type", "n"])

    found = per.mapInPandas(fields, "extractor string, schema_version string, version_key array<int>, field string, json_type string, n long")
    return found.groupBy("extractor", "schema_version", "version_key", "field", "json_type").agg(F.sum("n").alias("elements"))


def versions(docs: DataFrame) -> DataFrame:
    """The versions of each extractor, numbered from 1 in their numeric order."""
    per = W.partitionBy("extractor").orderBy("version_key")
    return versioned(origins(docs)).select("extractor", "schema_version", "version_key").distinct().withColumn("version_no", F.row_number().over(per))


def islands(cat: DataFrame, vers: DataFrame) -> DataFrame:
    """Lifespans: extractor, field, first_no and last_no of each unbroken run of versions, with its type sets."""
    present = (
        versioned(cat).groupBy("extractor", "schema_version", "field")
        .agg(F.array_sort(F.collect_set("json_type")).alias("types"))
        .join(vers.select("extractor", "schema_version", "version_no"), ["extractor", "schema_version"])
    )
    of = W.partitionBy("extractor", "field").orderBy("version_no")
    starts = (F.lag("version_no").over(of).isNull()) | (F.col("version_no") - F.lag("version_no").over(of) > 1)
    marked = present.withColumn("island", F.sum(starts.cast("int")).over(of))
    return marked.groupBy("extractor", "field", "island").agg(
        F.min("version_no").alias("first_no"), F.max("version_no").alias("last_no"),
        F.array_sort(F.collect_list(F.struct("version_no", "types"))).alias("by_version"),
    )


def change_log(life: DataFrame, vers: DataFrame) -> DataFrame:
    """added, removed and retyped between neighbouring versions, renames not yet paired.

    types is the type set where a field starts or ends, for pairing.
    """
    last = vers.groupBy("extractor").agg(F.max("version_no").alias("newest"))
    life = life.join(last, "extractor")
    size = F.size("by_version")
    added = life.where("first_no > 1").select("extractor", F.col("first_no").alias("version_no"), F.lit("added").alias("change_kind"), "field", F.col("by_version")[0]["types"].alias("types"))
    removed = life.where("last_no < newest").select("extractor", (F.col("last_no") + 1).alias("version_no"), F.lit("removed").alias("change_kind"), "field", F.element_at("by_version", -1)["types"].alias("types"))
    steps = F.filter(F.sequence(F.lit(1), size - 1), lambda i: F.get("by_version", i)["types"] != F.get("by_version", i - 1)["types"])
    retyped = life.where(size > 1).select("extractor", F.explode(F.transform(steps, lambda i: F.get("by_version", i)["version_no"])).alias("version_no"), F.lit("retyped").alias("change_kind"), "field", F.lit(None).cast("array<string>").alias("types"))
    return added.unionByName(removed).unionByName(retyped)


# --- renames -----------------------------------------------------------------------------------------


def parent(field: str) -> str:
    return field.rpartition(SEP)[0]


def candidates(log: list) -> list[tuple[str, int, str, str]]:
    """(extractor, version_no, old, new) of every end and start with the same parent and types."""
    by: dict = defaultdict(lambda: ([], []))
    for r in log:
        if r.change_kind in ("added", "removed"):
            by[r.extractor, r.version_no, parent(r.field), tuple(r.types)][r.change_kind == "added"].append(r.field)
    return [(e, v, old, new) for (e, v, _, _), (gone, come) in by.items() for old in gone for new in come]


def value_shapes(v: Column) -> Column:
    """Two views of a whole value, fine and coarse.

    Of a number its quarter octave and its octaves; of a text its form with digits folded, and its length's
    octave with the kinds of characters in it; of an array its schema.
    """
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    text = F.try_variant_get(v, "$", "string")

    def size(per: float) -> Column:
        return F.coalesce(F.concat_ws("e", F.signum(number).cast("int"), F.floor(F.log2(F.abs(number)) * per)), F.lit("0"))

    fine = F.regexp_replace(F.regexp_replace(text, r"\d+", "9"), r"\s+", " ")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(fine, r"\p{Lu}+\p{Ll}*", "A"), r"\p{Ll}+", "a"), r"\p{Lo}+", "o")
    coarse = F.concat_ws("/", F.floor(F.log2(F.length(text) + F.lit(1))), F.substring(classes, 1, 1), F.array_join(F.array_sort(F.array_distinct(F.split(classes, ""))), ""))
    return (
        F.when(kind == "STRING", F.array(F.concat(F.lit("0s"), fine), F.concat(F.lit("1s"), coarse)))
        .when((kind == "BOOLEAN") | kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.array(F.concat(F.lit("0o"), text), F.concat(F.lit("1o"), kind)))
        .when(kind != "VOID", F.array(F.concat(F.lit("0n"), size(4)), F.concat(F.lit("1n"), size(0.5))))
    )


def value_at(doc: Column, field: str, kind: str = "variant") -> Column:
    """The value of a field, whatever characters its keys hold; null where it is absent or of another kind."""
    keys = field.split(SEP)
    if not any(c in k for k in keys for c in "'\"[]\\"):
        return F.try_variant_get(doc, "$" + "".join(f"['{k}']" for k in keys), kind)
    for k in keys:
        doc = F.element_at(F.try_variant_get(doc, "$", "map<string,variant>"), F.lit(k))
    return F.try_variant_get(doc, "$", kind)


def profiles(docs: DataFrame, elements: DataFrame, fields: list[str], bins: int = 1024) -> DataFrame:
    """extractor, schema_version, field, bin, n: histograms of the value shapes of the named fields.

    Field "" counts the elements. There are at most 2 * bins rows per document and field before the join
    and per version and field after it, whatever the data; a shape's bin is a hash of all of it.
    """
    doc = elements.select("doc_id", F.try_parse_json("data").alias("doc"))
    values = F.array(*(F.struct(F.lit(p).alias("field"), value_at(F.col("doc"), p).alias("v")) for p in fields))
    one = F.array(F.struct(F.lit("").alias("field"), F.parse_json(F.lit("1")).alias("v")))
    found = doc.select("doc_id", F.explode_outer(F.concat(one, F.filter(values, lambda x: x["v"].isNotNull()))).alias("x")).select("doc_id", "x.*")
    binned = found.select("doc_id", "field", F.explode_outer(value_shapes(F.col("v"))).alias("shape")).where("shape is not null")
    binned = binned.select("doc_id", "field", (F.substring("shape", 1, 1).cast("long") * bins + F.pmod(F.xxhash64("shape"), F.lit(bins))).alias("bin"))
    counted = binned.groupBy("doc_id", "field", "bin").agg(F.count("*").alias("n"))
    return counted.join(versioned(origins(docs)), "doc_id").groupBy("extractor", "schema_version", "field", "bin").agg(F.sum("n").alias("n"))


def likeness(a: dict[int, float], b: dict[int, float], total_a: float = 1.0, total_b: float = 1.0, bins: int = 1024) -> float:
    """Mean overlap of the fine and coarse histograms, each as shares of its field's own values.

    How often the field occurs among all elements is a weaker sign: it takes away a quarter at most.
    """
    score, of = 0.0, []
    for view in (0, 1):
        p, q = ({k: x for k, x in h.items() if k // bins == view} for h in (a, b))
        n, m = sum(p.values()), sum(q.values())
        if not n or not m:
            return 0.0
        score += sum(min(x / n, q.get(k, 0.0) / m) for k, x in p.items())
        of.append((n / (total_a or 1.0), m / (total_b or 1.0)))
    share = min(of[0]) / max(of[0])
    return score / 2 * (0.75 + 0.25 * share)


def pair_renames(pairs: list[tuple[str, int, str, str]], hist: dict, number: dict, least: float = RENAME_LEAST) -> set[tuple[str, int, str, str]]:
    """The best one-to-one pairing of `pairs` with likeness of at least `least`, best first, ties by name."""
    scored = []
    for e, v, old, new in pairs:
        sides, totals = [], []
        for path, at in ((old, v - 1), (new, v)):
            version = number[e, at]
            totals.append(sum(hist.get((e, version, ""), {}).values()) / 2)
            sides.append(hist.get((e, version, path), {}))
        scored.append((-likeness(*sides, *totals), e, v, old, new))
    taken: set = set()
    out = set()
    for score, e, v, old, new in sorted(scored):
        if -score >= least and (e, v, 0, old) not in taken and (e, v, 1, new) not in taken:
            taken |= {(e, v, 0, old), (e, v, 1, new)}
            out.add((e, v, old, new))
    return out


def changes_of(docs: DataFrame, elements: DataFrame, cat: DataFrame, least: float = RENAME_LEAST, most: int = MOST_FIELDS) -> list[tuple[str, str, str, str, str]]:
    """(extractor, later version, change_kind, field, new field) of every change, in order.

    What reaches the driver is the catalogue's change log and the candidates' histograms: sizes set by
    the number of fields and versions, not by the number of rows.
    """
    vers = versions(docs)
    number = {(r.extractor, r.version_no): r.schema_version for r in bounded(vers, most)}
    log = bounded(change_log(islands(cat, vers), vers), most)
    pairs = candidates(log)
    hist: dict = defaultdict(dict)
    if pairs:
        for r in profiles(docs, elements, sorted({p for x in pairs for p in x[2:]})).collect():
            hist[r.extractor, r.schema_version, r.field][r.bin] = float(r.n)
    renames = pair_renames(pairs, hist, number, least)
    gone = {(e, v, "removed", old) for e, v, old, _ in renames} | {(e, v, "added", new) for e, v, _, new in renames}
    rows = [(e, number[e, v], "renamed", old, new) for e, v, old, new in renames]
    rows += [(r.extractor, number[r.extractor, r.version_no], r.change_kind, r.field, "") for r in log if (r.extractor, r.version_no, r.change_kind, r.field) not in gone]
    return sorted(rows)


def drift_report(docs: DataFrame, elements: DataFrame, least: float = RENAME_LEAST) -> DataFrame:
    """extractor, schema_version, change_kind, field_path, new_path of every change between neighbouring versions."""
    rows = changes_of(docs, elements, catalogue(docs, elements), least)
    return docs.sparkSession.createDataFrame([(e, v, kind, shown(old), shown(new)) for e, v, kind, old, new in rows], CHANGES).distinct()


# --- one consistent table ----------------------------------------------------------------------------


def alias_table(changes: list[tuple[str, str, str, str, str]]) -> dict[tuple[str, str], str]:
    """(extractor, old field) -> its newest name, chains of renames followed to their end."""
    step = {(e, old): new for e, _, kind, old, new in changes if kind == "renamed"}
    out = {}
    for e, old in step:
        new, seen = step[e, old], {old}
        while (e, new) in step and new not in seen:
            seen.add(new)
            new = step[e, new]
        out[e, old] = new
    return out


_OWN = ("elem_no", "doc_id", "extractor", "schema_version")


def column_names(fields: list[str]) -> dict[str, str]:
    """A column for each field: its keys joined by `_`, with a number behind where that is taken; upper and lower case are one."""
    out, taken = {}, {n.lower() for n in _OWN} | {"__doc"}
    for f in fields:
        base = "_".join(k.replace(".", "_").replace("`", "_") for k in f.split(SEP)) or "_"
        name, n = base, 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out[f] = name
    return out


def unify(docs: DataFrame, elements: DataFrame, least: float = RENAME_LEAST, most: int = MOST_FIELDS) -> DataFrame:
    """One table of all elements: elem_no, doc_id, extractor, schema_version and a column per field.

    extractor and schema_version are null where the document has none that can be read. Columns are
    named by the newest name of a field, in documents without an extractor by any that reads it; two fields
    whose names differ only in signs or case get columns of their own. A field whose JSON type changed is cast to the
    wider of its types (a text unless all are numbers or all booleans), never dropped.
    """
    cat = cut(catalogue(docs, elements))
    newest = alias_table(changes_of(docs, elements, cat, least, most))
    sources: dict = defaultdict(set)
    types: dict = defaultdict(set)
    fields = bounded(cat.select("extractor", "field", "json_type").distinct(), most)
    for r in sorted(fields, key=lambda r: r.extractor is None):
        names = [newest.get((r.extractor, r.field), r.field)]
        if r.extractor is None:
            names = [n for n in sources if r.field in sources[n]] or names
        for name in names:
            sources[name].add(r.field)
            types[name].add(r.json_type)
    sql = {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}
    named = column_names(sorted(sources))
    columns = []
    for name in sorted(sources):
        kind = sql.get(frozenset(types[name]), "string")
        paths = sorted(sources[name], key=lambda p: (p != name, p))
        columns.append(F.coalesce(*(value_at(F.col("__doc"), p, kind) for p in paths)).alias(named[name]))
    once = once_each(elements.select("elem_no", "doc_id", "data"), "elem_no")
    parsed = once.join(origins(docs).drop("version_key"), "doc_id", "left").withColumn("__doc", F.try_parse_json("data"))
    return parsed.select("elem_no", "doc_id", "extractor", "schema_version", *columns)
