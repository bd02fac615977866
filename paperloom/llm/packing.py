"""Items of varying length in containers of fixed capacity (problem 8).

The method is best-two-fit: a bin is filled greedily with the largest item that fits, then its smallest
item is replaced with two unpacked ones that fill the expanded gap more tightly. Sizes are whole numbers up
to the capacity, so bins are planned on the histogram of sizes: a bin's make-up is used as often as the
counts allow before the next one is made. The plan has some thousands of rows whatever the number of items,
and every step uses up a size, so planning costs the same for a thousand and for 10^12 items. Items find
their bin by their rank within their size; ranks are counted in salted buckets, so that a size which a third
of all items have is no one task's.

Items larger than the capacity are cut into full pieces of it and one rest, all others stay whole.

Defined results: null and empty texts take no space and get no row; repeated rows of one doc_id count once;
equal sizes are interchangeable and are ranked by bucket and doc_id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from paperloom.llm import tokens
from paperloom.runtime import cut, small

#: Items ranked by one task at most, about.
BUCKET = 200_000


def sizes(documents: DataFrame, tokenizer: str = tokens.DEFAULT, folder: str = tokens.FOLDER) -> DataFrame:
    """doc_id and tokens of every text with a token."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.byte_encoding(tokenizer, folder).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64())], names=schema.names)

    few = documents.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return few.mapInArrow(run, schema).dropDuplicates(["doc_id"])


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(size, how many)]) of every make-up of a bin, in order; sizes are 1 to `capacity`."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        left[s] += n
    out = []

    def largest(most: int) -> int:
        """The largest size up to `most` that is left, 0 if none."""
        if most <= 0:
            return 0
        here = np.flatnonzero(left[1 : most + 1])
        return int(here[-1]) + 1 if len(here) else 0

    while (first := largest(capacity)) > 0:
        content: dict[int, int] = {}
        gap = capacity

        def take(size: int, n: int = 1) -> None:
            nonlocal gap
            content[size] = content.get(size, 0) + n
            left[size] -= n
            gap -= size * n

        take(first)
        while gap and (s := largest(gap)):
            take(s, int(min(left[s], gap // s)))
        if gap:  # the smallest item of a bin of one is that one
            least = min(content)
            room = gap + least
            # two unpacked items of together more than the one they replace, closest to the room
            here = np.flatnonzero(left[1 : room]) + 1
            if len(here):
                partner = here[np.searchsorted(here, room - here, side="right") - 1]
                valid = (here + partner <= room) & ((here != partner) | (left[here] > 1))
                total = np.where(valid, here + partner, 0)
                best = int(total.argmax())
                if total[best] > least:
                    take(least, -1)
                    if not content[least]:
                        del content[least]
                    take(int(here[best]))
                    take(int(partner[best]))
        times = 1 + min(int(left[s]) // n for s, n in content.items())
        for s, n in content.items():
            left[s] -= n * (times - 1)
        out.append((times, sorted(content.items(), reverse=True)))
    return out


def fit_pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece_no, n_pieces, token_start and size: whole items, and full pieces and the rest of too large ones."""
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    cut = sized.withColumn("n_pieces", n).select("doc_id", "tokens", "n_pieces", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece_no"))
    start = (F.col("piece_no") - 1).cast("long") * capacity
    return cut.select("doc_id", "piece_no", "n_pieces", start.alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - start).cast("int").alias("size"))


def pack(sized: DataFrame, capacity: int, bucket: int = BUCKET) -> DataFrame:
    """bin_no, doc_id, piece_no, n_pieces, token_start and size; `sized` should be cheap to read or persisted."""
    spark = sized.sparkSession
    items = fit_pieces(sized, capacity)
    counts = {r.size: r.n for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    made = plan(counts, capacity)
    # the ranks of each size that a make-up takes: from rank `lo`, `per` of them in each of its bins
    taken: dict[int, int] = {}
    rows, first_bin = [], 0
    for times, content in made:
        for size, per in content:
            lo = taken.get(size, 0)
            taken[size] = lo + per * times
            rows.append((size, lo, lo + per * times, per, first_bin))
        first_bin += times
    table = spark.createDataFrame(rows, "size int, lo long, hi long, per int, first_bin long")
    # a size has as many buckets as its own number of items needs; the table has at most `capacity` rows
    salts = spark.createDataFrame([(s, -(-n // bucket)) for s, n in counts.items()], "size int, salts long")
    salted = items.join(small(salts), "size").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), "salts").cast("int")).drop("salts")
    before = W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "salt").agg(F.count("*").alias("n")).select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = salted.withColumn("in_bucket", rank).join(offsets, ["size", "salt"]).withColumn("rank", F.col("offset") + F.col("in_bucket"))
    # a size's make-ups as a sorted array beside its items: the last `lo` up to the rank is the item's
    spans = table.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("lo", "per", "first_bin"))).alias("spans"))
    found = ranked.join(small(spans), "size").withColumn("span", F.element_at(F.filter("spans", lambda x: x["lo"] <= F.col("rank")), -1))
    bin_no = F.col("span.first_bin") + F.floor((F.col("rank") - F.col("span.lo")) / F.col("span.per"))
    return found.select(bin_no.cast("long").alias("bin_no"), "doc_id", "piece_no", "n_pieces", "token_start", "size")


def pack_all(documents: DataFrame, containers: DataFrame, tokenizer: str = tokens.DEFAULT, folder: str = tokens.FOLDER) -> DataFrame:
    """The packing of all documents into containers of each size; the table of sizes is fixed and small."""
    sized = cut(sizes(documents, tokenizer, folder))
    out = None
    for r in containers.where("capacity_tokens > 0").select("container_id", "capacity_tokens").distinct().orderBy("container_id").collect():
        one = pack(sized, r.capacity_tokens).withColumn("container_id", F.lit(r.container_id)).withColumn("capacity_tokens", F.lit(r.capacity_tokens))
        out = one if out is None else out.unionByName(one)
    return out


def packing_report(packed: DataFrame) -> DataFrame:
    """container_id, capacity_tokens, bins, tokens, fewest (the bins that all tokens fill to the brim) and filled (share of the space used)."""
    per = packed.groupBy("container_id", "capacity_tokens").agg((F.max("bin_no") + 1).alias("bins"), F.sum("size").cast("long").alias("tokens"))
    return per.withColumn("fewest", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("filled", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
