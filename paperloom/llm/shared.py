"""Long exact spans that records share (problem 10).

The method is unit hashing: texts are cut into units, unit digests are grouped globally, and a unit counts
as first where its record comes first by rank (the smallest doc_id); elsewhere it can be removed, with its
offsets in the original text kept. Two kinds of unit are used.

* `shared_lines` takes lines as units: what a line-wise deduplication removes, and what it keeps.
* A stretch of 240 characters need not hold a whole line, so all else takes units that every such
  stretch must hold: `UNIT` characters starting where a hash of the text at that place is least among
  its neighbours (winnowing). Such a place depends on the text around it alone, and any stretch of
  `least` characters contains one, so no pair is lost. A digest's group then holds all candidates; the
  stretch around each unit, as stored, decides exactly.

From the verified stretches come the pairs (`shared_pairs`), the classes of equal texts with their number of
links (`class_links`), and for every record what it shares and what goes if only first occurrences stay
(`shared_spans`).

Copies of one text are one record until the end; a record's identity is a 128-bit digest of its text. Groups
of many records are not paired: their members are keyed by 128-bit digests of all stretches of `least`
characters around the unit and grouped again, so that every pair made is a true one.

Defined results: null texts and texts under `least` characters have no pairs; repeated rows of one doc_id
give each pair once; a record shares nothing with itself; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from paperloom.runtime import cut, small

LEAST = 240
#: Length of a unit; LEAST - UNIT + 1 is the number of neighbouring places of which one is chosen.
UNIT = 128
#: Largest group whose members are paired by their characters; larger ones are keyed by whole stretches.
SMALL_GROUP = 64

#: Odd multipliers of the two rolling digests.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Places of a text that are digested at once.
_BLOCK = 1 << 18


def _mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(31))
    a = a * np.uint64(0x7FB5D329728EA185)
    a = a ^ (a >> np.uint64(27))
    a = a * np.uint64(0x81DADEF4BC2DD44D)
    return a ^ (a >> np.uint64(33))


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length())  # texts come in blocks, so there are few sizes
    if (size, base) not in _POWERS:
        _POWERS[size, base] = tuple(np.cumprod(np.full(size, np.uint64(x))) for x in (base, pow(base, -1, 1 << 64)))
    up, down = _POWERS[size, base]
    return up[:n], down[:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(code: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """64-bit digests of all stretches of `size` characters."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(code), base)
    a = _mix(code.astype(np.uint64) + np.uint64(1))
    s = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(a * up)])
    return _mix((s[size:] - s[:-size]) * down[:n])


def places(digest: np.ndarray, among: int) -> np.ndarray:
    """Places whose digest is the least of some `among` places in a row; the last of equals."""
    n = len(digest)
    if n < among:
        return np.zeros(0, dtype=np.int64)
    # least over windows by doubling: the place of the least is carried along
    best = np.arange(n)
    span = 1

    def lesser(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(digest[y] <= digest[x], y, x)

    while span * 2 <= among:
        best = lesser(best[:-span], best[span:])
        span *= 2
    if span < among:
        best = lesser(best[: n - among + 1], best[among - span : among - span + n - among + 1])
    return np.unique(best)


def chosen(text: str, least: int, unit: int, block: int = _BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(digests, places) of the chosen units of a text of any length, block by block.

    Blocks overlap by one stretch, so each row of neighbouring places lies in one of them whole, and the
    union of the blocks' choices is the whole text's choice.
    """
    code = codes(text)
    digests, at = [], []
    for start in range(0, max(1, len(code) - least + 1), block):
        d = grams(code[start : start + block + least - 1], unit)
        p = places(d, least - unit + 1)
        digests.append(d[p])
        at.append(p + start)
    p, first = np.unique(np.concatenate(at), return_index=True)
    return np.concatenate(digests)[first], p


_UNITS = T.StructType([T.StructField("digest", T.LongType()), T.StructField("record", T.BinaryType()), T.StructField("pos", T.IntegerType())])


def units(docs: DataFrame, least: int = LEAST, unit: int = UNIT) -> DataFrame:
    """digest, record and pos of every chosen unit of `docs` (record, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, positions, counts = [], [], []
            for text in b.column(1).to_pylist():
                d, p = chosen(text, least, unit)
                digests.append(d)
                positions.append(p)
                counts.append(len(p))
            if digests:
                of = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digests).view(np.int64)), b.column(0).take(of), pa.array(np.concatenate(positions).astype(np.int32))], names=_UNITS.names)

    return docs.select("record", "text").mapInArrow(run, _UNITS)


_AROUND = T.StructType(
    [
        T.StructField("digest", T.LongType()), T.StructField("record", T.BinaryType()), T.StructField("rank", T.LongType()), T.StructField("pos", T.IntegerType()),
        T.StructField("before", T.StringType()), T.StructField("after", T.StringType()),
        T.StructField("stretches", T.ArrayType(T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))),
    ]
)
_ARROW = pa.schema([("digest", pa.int64()), ("record", pa.binary()), ("rank", pa.int64()), ("pos", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("stretches", pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())])))])


def _around(docs: DataFrame, members: DataFrame, wanted: DataFrame, least: int, unit: int) -> DataFrame:
    """The text on both sides of each wanted unit, the left one reversed; for large groups the digests of the stretches instead.

    Of all copies of a text only the first by rank is read.
    """
    per = wanted.groupBy("record").agg(F.collect_list(F.struct("digest", "pos", "large")).alias("at"))  # bounded by the text's length
    first = members.where("doc_id = rank").join(per, "record").select("doc_id", "record", "rank", "at")
    joined = docs.select("doc_id", "text").join(first, "doc_id").select("record", "rank", "text", "at")
    side = least - unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for record, rank, text, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for x in at:
                    p = x["pos"]
                    if x["large"]:
                        code = codes(text[max(0, p - side) : p + least])
                        pairs = zip(*(grams(code, least, base).view(np.int64).tolist() for base in _BASES), strict=True)
                        rows.append((x["digest"], record, rank, p, None, None, [{"h1": u, "h2": v} for u, v in pairs]))
                    else:
                        rows.append((x["digest"], record, rank, p, text[max(0, p - side) : p][::-1], text[p + unit : p + unit + side], None))
            yield pa.RecordBatch.from_pylist([dict(zip(_AROUND.names, r, strict=True)) for r in rows], schema=_ARROW)

    return joined.mapInArrow(run, _AROUND)


@F.pandas_udf(T.IntegerType())
def _alike(a, b):  # noqa: ANN001, ANN202
    """Characters that two texts share from their start."""
    import os

    import pandas as pd

    return pd.Series([len(os.path.commonprefix([x, y])) for x, y in zip(a, b, strict=True)], dtype="int32")


def record_key(text: str = "text"):  # noqa: ANN201
    return F.unhex(F.md5(text))


@dataclass(frozen=True)
class Shared:
    """What stands around each unit that several records hold, and doc_id, record and rank (the least doc_id of a record) of the long documents."""

    around: DataFrame
    members: DataFrame
    least: int
    unit: int

    def few(self, *more: str) -> DataFrame:
        """The members of groups that are paired."""
        return self.around.where("stretches is null").select("digest", "record", "rank", "before", "after", *more)

    def many(self) -> DataFrame:
        """record, rank, start, h1 and h2 of all stretches around the units of large groups."""
        first = F.greatest(F.col("pos") - (self.least - self.unit), F.lit(0))
        rows = self.around.where("stretches is not null").select("record", "rank", first.alias("first"), F.posexplode("stretches").alias("k", "s"))
        return rows.select("record", "rank", (F.col("first") + F.col("k")).alias("start"), "s.h1", "s.h2").dropDuplicates()

    def near(self, rows: DataFrame) -> DataFrame:
        """Pairs of `rows` of one digest, rank_a < rank_b, whose stretch is long enough; left and right are what they share on each side."""
        a, b = (rows.select("digest", *(F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "digest")) for x in "ab")
        pairs = a.join(b, "digest").where("rank_a < rank_b").withColumn("left", _alike("before_a", "before_b")).withColumn("right", _alike("after_a", "after_b"))
        return pairs.where(F.col("left") + F.col("right") + self.unit >= self.least)


def candidates(documents: DataFrame, least: int = LEAST, unit: int = UNIT, most: int = SMALL_GROUP) -> Shared:
    long_enough = documents.where((F.length("text") >= least) & F.col("doc_id").isNotNull())
    docs = long_enough.select("doc_id", record_key().alias("record"), "text")
    found = cut(units(docs, least, unit))  # read twice, made once
    # counted with map-side combining and joined back, so that a digest of very many records is no one task's
    groups = found.groupBy("digest").agg(F.count("*").alias("n"), F.min("record").alias("lo"), F.max("record").alias("hi")).where("lo <> hi")
    wanted = found.join(small(groups.select("digest", (F.col("n") > most).alias("large"))), "digest").dropDuplicates(["digest", "record", "pos"])
    members = docs.select("doc_id", "record").dropDuplicates()
    ranks = members.groupBy("record").agg(F.min("doc_id").alias("rank"))
    members = cut(members.join(ranks, "record"))
    return Shared(cut(_around(docs, members, wanted, least, unit)), members, least, unit)


def _class_pairs(found: Shared) -> DataFrame:
    """rank_a < rank_b of all classes of equal texts that share a stretch."""
    near = found.near(found.few().dropDuplicates()).select("rank_a", "rank_b")
    a, b = (found.many().select("h1", "h2", F.col("rank").alias(f"rank_{x}")).dropDuplicates() for x in "ab")
    far = a.join(b, ["h1", "h2"]).where("rank_a < rank_b").select("rank_a", "rank_b")
    return near.unionByName(far).dropDuplicates()


def shared_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id_a < doc_id_b of all pairs of documents that share a stretch of `least` characters; copies are expanded at the end."""
    found = candidates(documents, least)
    pairs = cut(_class_pairs(found))
    a, b = (found.members.select(F.col("doc_id").alias(f"doc_{x}"), F.col("rank").alias(f"rank_{x}")) for x in "ab")
    between = pairs.join(a, "rank_a").join(b, "rank_b").select("doc_a", "doc_b")
    within = a.join(b, F.col("rank_a") == F.col("rank_b")).where("doc_a < doc_b").select("doc_a", "doc_b")
    both = between.unionByName(within).where("doc_a <> doc_b")
    return both.select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b")).dropDuplicates()


def class_links(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, class_id, copies and links of every document of `least` characters or more.

    A class is the documents of one text, named by its least doc_id; copies counts them, links the other
    classes that share a stretch with it. The form for any size: nothing is expanded into pairs of copies.
    """
    found = candidates(documents, least)
    pairs = cut(_class_pairs(found))
    links = pairs.select(F.explode(F.array("rank_a", "rank_b")).alias("rank")).groupBy("rank").agg(F.count("*").alias("links"))
    copies = found.members.groupBy("rank").agg(F.countDistinct("doc_id").alias("copies"))
    out = found.members.join(copies, "rank").join(links, "rank", "left")
    return out.select("doc_id", F.col("rank").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links")).dropDuplicates(["doc_id"])


def _islands(spans: DataFrame) -> DataFrame:
    """record, start and end of the spans of each record, overlapping and touching ones made one."""
    of = W.partitionBy("record").orderBy("start", "end")
    reached = F.max("end").over(of.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", (reached.isNull() | (F.col("start") > reached)).cast("int")).withColumn("island", F.sum("fresh").over(of))
    return marked.groupBy("record", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _spans(rows: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """`rows` (record, ...) with `<name>_chars` and the merged spans of `spans` in `<name>_spans`."""
    merged = _islands(spans.dropDuplicates())
    span = F.array(F.col("start").cast("long"), F.col("end").cast("long"))
    per = merged.groupBy("record").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias(f"{name}_chars"), F.array_sort(F.collect_list(span)).alias(f"{name}_spans"))
    none = F.array().cast("array<array<bigint>>")
    return rows.join(per, "record", "left").withColumn(f"{name}_chars", F.coalesce(f"{name}_chars", F.lit(0).cast("long"))).withColumn(f"{name}_spans", F.coalesce(f"{name}_spans", none))


def shared_spans(documents: DataFrame, least: int = LEAST, unit: int = UNIT, most: int = SMALL_GROUP) -> DataFrame:
    """What every document shares with others: doc_id, chars, shared_chars, shared_share, spans, later_chars and later_spans.

    `spans` are the stretches of `least` characters that another document holds too, [start, end) in characters
    of the text as stored; `later_spans` those of them that a document of a smaller doc_id holds, which go if
    only first occurrences stay. One row per document, 0 and no spans where nothing is shared. What a document
    repeats only within itself is not shared.
    """
    found = candidates(documents, least, unit, most)
    few = found.few("pos").groupBy("digest", "record", "rank", "before", "after").agg(F.collect_set("pos").alias("at"))  # bounded by the text's length
    near = cut(found.near(few))
    side = {x: F.struct(F.col(f"record_{x}").alias("record"), F.col(f"at_{x}").alias("at"), F.lit(x == "b").alias("later")) for x in "ab"}
    sides = near.select("left", "right", F.explode(F.array(side["a"], side["b"])).alias("s")).select("s.*", "left", "right").dropDuplicates()
    close = sides.select("record", "later", F.explode("at").alias("pos"), "left", "right").select("record", "later", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + unit + F.col("right")).alias("end"))
    stretch = found.many()
    several = stretch.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first <> last")
    far = stretch.join(several, ["h1", "h2"]).select("record", (F.col("rank") > F.col("first")).alias("later"), "start", (F.col("start") + least).alias("end"))
    every = cut(close.unionByName(far).dropDuplicates())
    rows = documents.where("doc_id is not null").select("doc_id", F.when(F.col("text").isNotNull(), record_key()).alias("record"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("record", "chars")).alias("r")).select("doc_id", "r.*")
    out = _spans(rows, every.select("record", "start", "end"), "shared")
    out = _spans(out, every.where("later").select("record", "start", "end"), "later")
    # a text that several documents have is shared as a whole, and goes in all but the first
    copied = found.members.groupBy("record").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("record", "lo")
    out = out.join(copied, "record", "left")
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("chars").cast("long")))
    for name, condition in (("shared", F.col("lo").isNotNull()), ("later", F.col("lo") < F.col("doc_id"))):
        out = out.withColumn(f"{name}_chars", F.when(condition, F.col("chars").cast("long")).otherwise(F.col(f"{name}_chars"))).withColumn(f"{name}_spans", F.when(condition, whole).otherwise(F.col(f"{name}_spans")))
    share = F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0))
    return out.select("doc_id", F.col("chars").cast("long").alias("chars"), "shared_chars", share.alias("shared_share"), F.col("shared_spans").alias("spans"), "later_chars", "later_spans")


def without(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, kept_spans and text of `documents` without the `later_spans` of `spans`, offsets being those of the text as stored."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").dropDuplicates(["doc_id"]).join(spans.select("doc_id", "later_spans"), "doc_id", "left")
    gone = F.coalesce("later_spans", F.array().cast("array<array<bigint>>"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda s: s[1]))
    ends = F.concat(F.transform(gone, lambda s: s[0]), F.array(F.length("text").cast("long")))
    kept = F.filter(F.zip_with(starts, ends, lambda a, z: F.array(a, z)), lambda s: s[0] < s[1])
    out = rows.withColumn("kept_spans", kept)
    return out.select("doc_id", "kept_spans", F.array_join(F.transform("kept_spans", lambda s: F.substr(F.col("text"), (s[0] + 1).cast("int"), (s[1] - s[0]).cast("int"))), "").alias("text"))


def shared_lines(documents: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, chars, shared_chars and the spans [start, end) of lines of `least` characters that an earlier document holds too.

    The earliest occurrence by doc_id and offset is kept, all later ones are shared; offsets count
    characters of the text as stored. One row per document with text.
    """
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").dropDuplicates(["doc_id"])
    line = F.split("text", "\n", -1)
    sizes = F.transform(line, F.length)
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 1)))
    parts = rows.select("doc_id", F.explode(F.arrays_zip(F.transform(line, lambda x: F.struct(F.unhex(F.md5(x)).alias("h"), F.length(x).alias("n"))).alias("u"), F.slice(ends, 1, F.size(line)).alias("start"))).alias("x"))
    long = parts.select("doc_id", F.col("x.u.h").alias("digest"), F.col("x.u.n").alias("n"), F.col("x.start").alias("start")).where(F.col("n") >= least)
    first = long.groupBy("digest", "n").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = long.join(first.drop("times"), ["digest", "n"]).where(F.struct("doc_id", "start") != F.col("first"))
    spans = later.groupBy("doc_id").agg(F.sum("n").cast("long").alias("shared_chars"), F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    return rows.select("doc_id", F.length("text").cast("long").alias("chars")).join(spans, "doc_id", "left").select("doc_id", "chars", F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"), "spans")
