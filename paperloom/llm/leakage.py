"""Evaluation texts inside a training corpus (problem 9).

The method is pigeonhole edit matching. A passage is a window of `window` consecutive words of a test item.
With an error budget of k characters it is split into k + 1 pieces of whole words; at least one of them
must occur unchanged in any text within k edits. One Aho-Corasick automaton of all pieces runs over each
document once; around every hit the passages that hold the piece are verified by Myers' bit-parallel
distance, and a document and an item are a pair only where the distance is within the budget. An exact
check follows: the longest run of equal words through the hits.

Items are the stated query set. They are held in blocks of bounded size, and each block is held against
all documents; one block takes some hundred thousand items, and each further one reads the documents once
more. Documents are never shuffled and never collected.

Defined results: null or empty texts match nothing; items shorter than `window` words are no query; a word
is a maximal run of letters and digits after removing invisible characters, composing accents and folding
case; repeated item ids and documents give each pair once; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.lookalike import INVISIBLE

#: Bytes of items' texts held at once by every task.
BLOCK = 16 << 20

_INVISIBLE = re.compile("[" + re.escape(INVISIBLE) + "]")
_BREAK = re.compile(r"[\W_]+")


def words_of(text: str) -> str:
    """The words of a text, each with one space before and after it."""
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return " " + _BREAK.sub(" ", text.casefold()).strip() + " "


def distance(pattern: str, text: str, most: int) -> int:
    """Least edits between `pattern` and any stretch of `text` by Myers' bit-parallel recurrence, or most + 1."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & mask
        pv = (mh << 1 | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best = score
    return min(best, most + 1)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], window: int, budget: int):
        self.window, self.budget = window, budget
        self.items = [(i, words_of(t).split()) for i, t in items]
        size = window // (budget + 1)
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, words) in enumerate(self.items):
            if len(words) >= window:
                # every passage starts with a piece each `size` words, so pieces at all offsets serve all passages
                for at in range(len(words) - size + 1):
                    pieces[" " + " ".join(words[at : at + size]) + " "].append((n, at))
        self.size = size
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def match(self, text: str) -> dict[int, tuple[int, int]]:
        """item number -> (least distance of a passage, most words of it in a row)."""
        found: dict[int, tuple[int, int]] = {}
        if self.empty:
            return found
        plain = words_of(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(plain):
            for n, at in where:
                hits[n].append((end - size + 1, at))
        if not hits:
            return found
        for n, places in hits.items():
            words = self.items[n][1]
            least = self.budget + 1
            for start, at in places:
                least = self._verify(plain, start, words, at, least - 1)
                if not least:
                    break
            if least > self.budget:
                continue
            most, done_to = 0, -1
            for start, at in places:
                if start > done_to:
                    run, end = self._run(plain, start, words, at)
                    if run >= most:
                        most, done_to = run, end if run >= self.window else done_to
            found[n] = (least, most)
        return found

    def _run(self, plain: str, start: int, words: list[str], at: int) -> tuple[int, int]:
        """Words in a row that document and item share through the hit, and where they end."""
        first, left = at, start
        while first > 0 and plain.endswith(" " + words[first - 1] + " ", 0, left + 1):
            first -= 1
            left -= len(words[first]) + 1
        last, right = at, start
        while last < len(words) and plain.startswith(" " + words[last] + " ", right):
            right += len(words[last]) + 1
            last += 1
        return last - first, right

    def _verify(self, plain: str, start: int, words: list[str], at: int, most: int) -> int:
        """Least distance, up to `most`, of the passages that hold the piece at `at`, from the text around the hit."""
        best = most + 1
        # a passage that starts with the piece comes first: the first hit is mostly the start of what both share
        for first in range(min(at, len(words) - self.window), max(0, at + self.size - self.window) - 1, -1):
            pattern = " " + " ".join(words[first : first + self.window]) + " "
            before = sum(len(w) + 1 for w in words[first:at])
            lo = max(0, start - before - self.budget)
            best = min(best, distance(pattern, plain[lo : start + len(pattern) - before + self.budget], best - 1))
            if not best:
                break
        return best


_LEAKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("words_in_a_row", T.IntegerType())])


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `size` bytes; which block an item is in is a hash of it, so none is lost or split."""
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").dropDuplicates(["item_id", "text"])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // size)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) if n else F.lit(0)
    for k in range(n):
        yield [(r.item_id, r.text) for r in items.where(block == k).orderBy("item_id", "text").collect()]


def leaks(documents: DataFrame, items: DataFrame, window: int = 12, budget: int = 1, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance and words_in_a_row of every document that holds a passage of an item within the budget."""
    if not 0 <= budget < window:
        raise ValueError("a passage has at most one piece for each of its words")
    spark = documents.sparkSession
    text = documents.where(F.length("text") > 0).select("doc_id", "text")
    out = spark.createDataFrame([], _LEAKS)
    for rows in _blocks(items, block):
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, window, budget)
            for b in batches:
                found = [(d, matcher.items[n][0], *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, x in matcher.match(t).items()]
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=_LEAKS.names)

        out = out.unionByName(text.mapInArrow(run, _LEAKS))
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("words_in_a_row").alias("words_in_a_row"))


def leaked_pairs(documents: DataFrame, items: DataFrame, window: int = 12) -> DataFrame:
    """doc_id and item_id of the leaks whose exact check finds `window` words in a row."""
    return leaks(documents, items, window).where(F.col("words_in_a_row") >= window).select("doc_id", "item_id")
