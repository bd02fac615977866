"""Oversized items as pieces within a limit, cut at natural boundaries (problem 1).

The method: prefix sums of token offsets give the size of any stretch in constant time, boundaries are kept
in one sorted array for each strength (paragraph, line, sentence, clause, word), and each cut is a binary
search for the last boundary under the limit, the strongest kind first. The next piece starts about
`overlap` units before the cut, at a word where there is one. Where there is no boundary the cut is hard.
Units are code points, or tokens of a public tokenizer.

Only texts that are too long leave the JVM. Defined results: null, empty and short texts are one piece of
their own in `split_items` and no piece in `long_pieces`; repeated deliveries of an element count once;
a piece never ends between a letter and its combining mark unless the limit forces it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import tokens

LIMIT, OVERLAP = 2000, 200

#: What ends a stretch, strongest first; a boundary is the place after the match.
_KINDS = (
    ("paragraph", re.compile(r"\n[ \t]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…؟。！？]+[\"'”’»)\]]*\s+")),
    ("clause", re.compile(r"[,;:،؛–—]\s+|\|\s*")),
    ("word", re.compile(r"\s+")),
)
_MARK = re.compile("[̀-ͯؐ-ًؚ-ٰٟ‌‍︎️]")


class Cutter:
    """Boundaries and sizes of one text."""

    def __init__(self, text: str, token_starts: list[int] | None = None):
        self.text = text
        # prefix sums: units before each place; for code points that is the place itself
        self.prefix = token_starts
        self.kinds = [(name, [m.end() for m in rx.finditer(text)]) for name, rx in _KINDS]

    def units(self, place: int) -> int:
        return place if self.prefix is None else bisect_left(self.prefix, place)

    def place(self, units: int) -> int:
        """The last place with at most `units` units before it."""
        if self.prefix is None:
            return min(units, len(self.text))
        return self.prefix[units] if units < len(self.prefix) else len(self.text)

    def cut(self, start: int, limit: int) -> tuple[int, str]:
        """Where the piece from `start` ends, and at what kind of boundary."""
        end = self.place(self.units(start) + limit)
        if end >= len(self.text):
            return len(self.text), "end"
        floor = start + (end - start) // 2  # a stronger boundary isn't worth half an empty piece
        for name, at in self.kinds:
            i = bisect_right(at, end) - 1
            if i >= 0 and at[i] > floor:
                return at[i], name
        hard = end
        while hard > floor and _MARK.match(self.text, hard):
            hard -= 1
        return max(hard if hard > floor else end, start + 1), "hard"

    def back(self, start: int, end: int, overlap: int) -> int:
        """Where the next piece starts: the word at or after `overlap` units before `end`."""
        least = self.place(max(self.units(end) - overlap, 0))
        if least <= start:
            least = start + 1
        words = self.kinds[-1][1]
        i = bisect_left(words, least)
        if i < len(words) and words[i] < end and self.units(words[i]) <= self.units(least) + overlap // 2:
            return words[i]
        return min(least, end)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, token_starts: list[int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces of `text`; each is within `limit`, all of it is covered."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    cutter = Cutter(text, token_starts)
    out, start = [], 0
    while True:
        end, kind = cutter.cut(start, limit)
        out.append((start, end, kind))
        if end >= len(text):
            return out
        start = max(cutter.back(start, end, overlap), start + 1)


_PIECE = [("piece_no", T.IntegerType(), pa.int32()), ("start", T.IntegerType(), pa.int32()), ("end", T.IntegerType(), pa.int32()), ("boundary", T.StringType(), pa.string()), ("piece", T.StringType(), pa.string())]


def long_pieces(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str | None = None, folder: str = tokens.FOLDER) -> DataFrame:
    """keys, piece_no from 1, start, end, boundary and piece of every text of more than `limit` units."""
    # a token of a byte vocabulary holds a byte at least, so a text of no more bytes than the limit is never too long
    size = F.octet_length(text) if tokenizer else F.length(text)
    few = df.where(size > limit).select(*keys, F.col(text).alias("__text"))
    schema = T.StructType([*(few.schema[k] for k in keys), *(T.StructField(n, k) for n, k, _ in _PIECE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: list[int] = []
            columns: list[list] = [[] for _ in _PIECE]
            for row, t in enumerate(b.column(len(keys)).to_pylist()):
                at = tokens.starts(t, tokenizer, folder) if tokenizer else None
                if at is not None and len(at) <= limit:
                    continue
                for n, (s, e, kind) in enumerate(pieces(t, limit, overlap, at), 1):
                    of.append(row)
                    for c, x in zip(columns, (n, s, e, kind, t[s:e]), strict=True):
                        c.append(x)
            rows = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(len(keys))), *(pa.array(c, k) for c, (_, _, k) in zip(columns, _PIECE, strict=True))], names=schema.names)

    return few.mapInArrow(run, schema)


def split_elements(elements: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str | None = None, folder: str = tokens.FOLDER) -> DataFrame:
    """The pieces of all too long elements with their place in the document, each element once."""
    return long_pieces(elements, ["elem_no", "doc_id", "unit_index", "element_order"], "text", limit, overlap, tokenizer, folder).dropDuplicates(["elem_no", "piece_no"])


def split_found(elements: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """elem_no of every element that the split had to cut."""
    return long_pieces(elements, ["elem_no"], "text", limit, overlap).where("piece_no = 2").select("elem_no").dropDuplicates()
