"""Noise in text from scanned pages (problem 4).

The method: skip-gram vectors are learned from the pages, rare words are linked to frequent neighbours by
plausible glyph edits, corrected in context, and then furniture is removed and the text reflowed.

* Furniture is found from the page edges: a document's page numbers lie on one offset from the page index,
  and a header or footer is a line whose glyph class key recurs at the edge of other pages.
* A word of the corpus is counted over all elements (combined before the shuffle). A line-end mark is a
  break if the joined word is better attested than the hyphenated one.
* Words have skip-gram vectors: counts of the words one to the left and right over all pages, hashed to a fixed
  width, each word by its surprise. Words that a scanner mixes up share a glyph class key (`fold`: rn and
  m, cl and d, ii and u, c and e, ...), so the plausible edits of a rare word are one equi-join. A rare word is linked
  to the frequent word among them whose vector is closest; how close it must be falls with how much more often
  the frequent word occurs, and a word that is as usual in the same contexts needs no frequency of twenty to one.

Nothing is collected; tables that grow with the vocabulary are joined, and broadcast only when counted small.

Defined results: null or empty pages have no lines and no noise; documents that aren't PDF or have more
than one element on a page aren't scans; repeated deliveries of a page count once; a document of one page
has no running line unless it holds the page number too; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from paperloom.runtime import cut, small

#: A page of a scan has so many line breaks on average.
LEAST_BREAKS = 8
#: A correction that is so many times as frequent as the word it replaces needs no likeness of contexts; another
#: needs a vector as close as CLOSE, and is at least LEAST_TIMES as frequent.
TIMES, LEAST_TIMES, CLOSE = 20, 2, 0.35
#: A correction occurs at least so often, in sound text at least once.
LEAST_COUNT = 5
#: Lines looked at on either edge of a page at a time; where all of them are furniture, the next ones are.
EDGE = 2
BUCKETS = 64

# --- glyph classes -----------------------------------------------------------------------------------

#: What a scanner may confuse, as parts that both readings share (fixed values).
GLYPHS = {
    "d": "ei", "m": "rri", "n": "ri", "u": "ii", "ü": "ii", "ú": "ii", "ù": "ii", "h": "ii", "b": "ii", "6": "ii", "w": "vi",
    "c": "e", "é": "e", "è": "e", "ê": "e", "ç": "e", "f": "t", "l": "i", "1": "i", "|": "i", "!": "i", "í": "i", "î": "i", "ï": "i", "j": "i",
    "q": "g", "9": "g", "0": "o", "ó": "o", "ö": "o", "ô": "o", "5": "s", "ä": "a", "á": "a", "à": "a", "â": "a", "8": "ii", "ß": "ii", "2": "z", "ñ": "ri",
}
_FOLD = str.maketrans(GLYPHS)
_DIGITS = str.maketrans("OoIl|SZB", "00111528")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


_TOKEN = re.compile(r"[^\W_]+(?:[-‐‑][^\W\d_]+)*")
_WORD = re.compile(r"[^\W_]+")
MARKS = "-‐‑¬\xad"
_BROKEN = re.compile(rf"([^\W\d_]+)([{re.escape(MARKS)}])\s*$")
_STARTS = re.compile(r"\s*([^\W_]+)")


def words_of(text: str) -> list[str]:
    """Words, and hyphenated compounds beside their parts; pure numbers left out."""
    out = []
    for t in _TOKEN.findall(text):
        if t.isalpha():
            out.append(t)
        else:
            parts = _WORD.findall(t)
            out += [p for p in parts if not p.isdigit()]
            if len(parts) > 1:
                out.append("-".join(parts))
    return out


_COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def word_counts(texts: DataFrame, flush: int = 300_000) -> DataFrame:
    """word and n over the single text column of `texts`, combined within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(words_of(t))
            if len(seen) > flush:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=_COUNTS.names)
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=_COUNTS.names)

    return texts.mapInArrow(run, _COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


# --- pages -------------------------------------------------------------------------------------------


def scanned_pages(docs: DataFrame, elements: DataFrame, least_breaks: int = LEAST_BREAKS) -> DataFrame:
    """doc_id, unit_index, elem_no and text of every delivery of every page of the scanned documents."""
    pdf = docs.where(F.lower("document_type") == "pdf").select("doc_id").distinct()
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    per_page = elements.groupBy("doc_id", "unit_index").agg(
        (F.min("elem_no") == F.max("elem_no")).alias("single"),
        F.bool_and(F.col("element_type") == "paragraph").alias("paragraph"),
        F.max(F.coalesce(breaks, F.lit(0))).alias("breaks"),
    )
    scans = per_page.groupBy("doc_id").agg(F.bool_and("single").alias("single"), F.bool_and("paragraph").alias("paragraph"), F.avg("breaks").alias("breaks"))
    ids = scans.where(F.col("single") & F.col("paragraph") & (F.col("breaks") >= least_breaks)).join(pdf, "doc_id", "left_semi").select("doc_id")
    pages = elements.where((F.col("element_type") == "paragraph") & F.col("text").isNotNull()).select("doc_id", "unit_index", "elem_no", "text")
    return pages.join(ids, "doc_id", "left_semi")


_EDGE_LINES = T.ArrayType(T.StructType([
    T.StructField("line_no", T.IntegerType()), T.StructField("zone", T.StringType()), T.StructField("line", T.StringType()),
    T.StructField("numbers", T.ArrayType(T.LongType())),
]))
_NUMBER = re.compile(r"(?<![^\W_])[0-9OoIl|SZB]{1,6}(?![^\W_])")


_ROMAN = re.compile(r"[\W_]*([ivxlc1I|]{1,8})[\W_]*")
_ROMAN_VALUE = re.compile(r"(x{0,3}|xl|lx{0,3})(i{0,3}|iv|vi{0,3}|ix)")
_UNITS = {x: i for i, x in enumerate(("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))}
_TENS = {x: 10 * i for i, x in enumerate(("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx"))}


def roman(line: str) -> list[int]:
    """The values that a line may have which is only a small Roman numeral; a stroke may be an i as well as an l."""
    m = _ROMAN.fullmatch(line)
    out = []
    for text in (m.group(1).replace("1", "i").replace("I", "i").replace("|", "i"), m.group(1).translate(str.maketrans("1I|l", "iiii"))) if m else ():
        if (v := _ROMAN_VALUE.fullmatch(text)) and (n := _TENS[v.group(1)] + _UNITS[v.group(2)]) and n not in out:
            out.append(n)
    return out


def numbers_in(line: str) -> list[int]:
    """Numbers of a line, misread digits put right where another is sound or the line holds nothing else."""
    if (r := roman(line)) and not any(c.isdigit() for c in line):
        return r
    bare = not re.search(r"[^\W\d_]{3,}", line)
    found = [m.group() for m in _NUMBER.finditer(line)]
    return [int(x.translate(_DIGITS)) for x in found if any(c.isdigit() for c in x) or bare and x not in ("S", "Z", "B")]


def edge_lines(text: str, known: list[int], edge: int = EDGE) -> list[tuple[int, str, str, list[int]]]:
    """(line_no, zone, line, numbers) of the `edge` full lines on either side that follow the lines `known` for furniture."""
    full = [(i, x.strip()) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    gone = set(known)
    lo, hi = 0, len(full)
    while lo < hi and full[lo][0] in gone:
        lo += 1
    while hi > lo and full[hi - 1][0] in gone:
        hi -= 1
    if gone:  # only a side where all lines before were furniture goes on
        top = full[lo : lo + edge] if lo >= edge else []
        bottom = full[max(lo, hi - edge) : hi] if len(full) - hi >= edge else []
    else:
        top, bottom = full[:edge], full[-edge:]
    seen = {i for i, _ in top}
    found = [(i, "top", x) for i, x in top] + [(i, "bottom", x) for i, x in bottom if i not in seen]
    return [(i, z, x, numbers_in(x)) for i, z, x in found]


@F.pandas_udf(_EDGE_LINES)
def _edges(texts: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("line_no", "zone", "line", "numbers"), r, strict=True)) for r in edge_lines(t, k)] for t, k in zip(texts, known, strict=True)], dtype=object)


_PAGE_WORDS = {"page", "seite", "página", "pagina", "pág", "pag", "p", "s", "seit", "стр", "страница", "صفحة"}
_PAGE_LINE = re.compile(r"[\W_]*([^\W\d_]{3,8})\.? +[0-9OoIl|SZB]{1,5}[\W_]*")
_LINE_KIND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType())])


def line_kind(line: str, number: int | None) -> tuple[str | None, str | None]:
    """(kind, key): page_number, or a key under which running lines of a document agree.

    Kind `numbered` is a running line for certain: the page number stands beside it, set apart.
    """
    plain, found, apart = line, False, False
    if _PAGE_LINE.fullmatch(line) and fold(_PAGE_LINE.fullmatch(line).group(1)) in _PAGE_FOLDS:
        return "page_number", None
    if number is not None and number in roman(line):
        return "page_number", None
    if number is not None:
        for m in _NUMBER.finditer(line):
            if m.group().translate(_DIGITS).isdigit() and int(m.group().translate(_DIGITS)) == number:
                apart = bool(re.match(r"\s{2,}", line[m.end() :])) if m.start() == 0 else bool(re.search(r"\s{2,}$", line[: m.start()]))
                plain, found = line[: m.start()] + " " + line[m.end() :], True
                break
    rest = re.sub(r"[\W_]+", " ", plain).strip()
    if found:
        words = rest.lower().split()
        if not words or all(w.isdigit() or fold(w) in _PAGE_FOLDS for w in words):
            return "page_number", None
    if not re.search(r"[^\W\d_]{3,}", rest):
        return None, None
    return ("numbered" if found and apart else None), fold(rest)


_PAGE_FOLDS = {fold(w) for w in _PAGE_WORDS} | {fold(w) for w in ("of", "von", "de", "sur")}


@F.pandas_udf(_LINE_KIND)
def _line_kind(lines: pd.Series, numbers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_kind(x, None if pd.isna(n) else int(n)) for x, n in zip(lines, numbers, strict=True)], columns=["kind", "key"])


def furniture(pages: DataFrame) -> DataFrame:
    """elem_no, line_no and noise_kind (running_line, page_number) of the lines at the pages' edges.

    Lines are taken `EDGE` at a time from either side; pages whose lines of a side are all furniture are looked at
    again further inside, until there are none, so a header may have any number of lines.
    """
    total = cut(pages.groupBy("doc_id").agg(F.countDistinct("unit_index").alias("pages")))
    offset, found = None, None
    left = pages.withColumn("known", F.array().cast("array<int>"))
    while True:
        lines = left.select("doc_id", "unit_index", "elem_no", F.explode(_edges("text", "known")).alias("x")).select("doc_id", "unit_index", "elem_no", "x.*")
        if offset is None:  # page numbers stand in the outermost lines
            lines = cut(lines)
            votes = lines.select("doc_id", "unit_index", F.explode("numbers").alias("v")).groupBy("doc_id", (F.col("v") - F.col("unit_index")).alias("offset")).agg(F.countDistinct("unit_index").alias("votes"))
            offset = votes.groupBy("doc_id").agg(F.max_by("offset", F.struct("votes", -F.abs("offset"))).alias("offset"), F.max("votes").alias("votes")).join(total, "doc_id")
            offset = cut(offset.where((F.col("votes") >= 2) & (F.col("votes") * 2 >= F.col("pages"))).select("doc_id", "offset"))
        known = lines.join(offset, "doc_id", "left").join(total, "doc_id")
        kinds = known.withColumn("k", _line_kind("line", F.col("unit_index") + F.col("offset"))).select("doc_id", "unit_index", "elem_no", "line_no", "zone", "line", "pages", "k.*")
        kinds = cut(kinds)
        recurs = kinds.where("key is not null").groupBy("doc_id", "zone", "key").agg(F.countDistinct("unit_index").alias("on_pages"))
        more = kinds.join(recurs, ["doc_id", "zone", "key"], "left")
        # a sentence's end or a broken line recurs by chance, and so does a line further inside
        sentence = F.col("line").rlike(r"[.,;:)\]”»\-‐¬\x{ad}]$") | F.lit(found is not None)
        often = (F.col("on_pages") >= 2) & (~sentence | ((F.col("on_pages") >= 3) & (F.col("on_pages") * 5 >= F.col("pages") * 3)))
        kind = F.when(F.col("kind") == "page_number", "page_number").when((F.col("kind") == "numbered") | often, "running_line")
        more = cut(more.select("elem_no", "line_no", "zone", kind.alias("noise_kind")).where("noise_kind is not null"))
        found = more if found is None else found.unionByName(more)
        inner = more.groupBy("elem_no", "zone").agg(F.count("*").alias("n")).where(F.col("n") >= EDGE).select("elem_no").distinct()
        if inner.isEmpty():
            return found.select("elem_no", "line_no", "noise_kind")
        gone = found.join(inner, "elem_no", "left_semi").groupBy("elem_no").agg(F.collect_list("line_no").alias("known"))  # bounded by the page
        left = pages.join(small(gone), "elem_no")


# --- bodies ------------------------------------------------------------------------------------------


def bodies(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with the numbers of their furniture lines and the first body line of the page after them."""
    gone = found.groupBy("elem_no").agg(F.collect_list("line_no").alias("gone"))
    known = pages.join(gone, "elem_no", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    line = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    body = F.filter(line, lambda x: ~F.array_contains("gone", x["no"]) & (F.trim(x["line"]) != ""))
    first = known.withColumn("first", F.get(body, F.lit(0)))
    after = F.lead(F.struct("elem_no", F.col("first.no").alias("line_no"), F.col("first.line").alias("line"))).over(W.partitionBy("doc_id").orderBy("unit_index", "elem_no"))
    return first.withColumn("after", after).drop("first")


_FRAGMENT = re.compile(r"\s*(?:[^\W\d_]+ ){0,3}\d+\s*")
_SOFT_END = re.compile(rf"[^\W\d_][a-zß-ÿ]*[^\W\d_A-Z][{re.escape(MARKS)}]\s*$")


class Page:
    """Body lines of a page and the line that goes on from each."""

    def __init__(self, text: str, gone: list[int], after: dict | None):
        lines = text.split("\n")
        hidden = set(gone)
        self.body = [(i, x) for i, x in enumerate(lines, 1) if i not in hidden]
        full = [k for k, (_, x) in enumerate(self.body) if x.strip()]
        self.next: dict[int, tuple[int, int | None, str]] = {}  # line_no -> (line_no, elem_no or None for this page, line)
        for k, (a, b) in enumerate(zip(full, full[1:], strict=False)):
            if _SOFT_END.search(self.body[a][1]):  # a table's rest between two halves of a word isn't the word's
                while k + 2 < len(full) and _FRAGMENT.fullmatch(self.body[b][1]):
                    k, b = k + 1, full[k + 2]
            if b == a + 1 or b > full[full.index(a) + 1] or all(i in hidden for i in range(self.body[a][0] + 1, self.body[b][0])):
                self.next[self.body[a][0]] = (self.body[b][0], None, self.body[b][1])
        if full and after and after["line"]:
            self.next[self.body[full[-1]][0]] = (after["line_no"], after["elem_no"], after["line"])

    def breaks(self) -> Iterator[tuple[int, str, str, str, int, int | None]]:
        """(line_no, left, mark, right, next line_no, next elem_no) of lines that end in a mark inside letters."""
        for i, line in self.body:
            m = _BROKEN.search(line)
            if m and i in self.next:
                n = _STARTS.match(self.next[i][2])
                if n:
                    yield i, m.group(1), m.group(2), n.group(1), self.next[i][0], self.next[i][1]

    def tokens(self, joined: dict[int, str], first_is_rest: bool) -> Iterator[tuple[int, str, str | None, int, int, int | None]]:
        """(line_no, word, rest, length of the left part, next line_no, next elem_no): the body's words, broken ones whole."""
        skip_first = set()
        if first_is_rest:
            full = [i for i, x in self.body if x.strip()]
            skip_first |= set(full[:1])
        for i in joined:
            if self.next[i][1] is None:
                skip_first.add(self.next[i][0])
        for i, line in self.body:
            words = _WORD.findall(line)
            if i in skip_first:
                words = words[1:]
            if i in joined and words:
                words = words[:-1]
            for w in words:
                yield i, w, len(w), 0, None
            if i in joined:
                left = _BROKEN.search(line).group(1)
                yield i, left + joined[i], len(left), self.next[i][0], self.next[i][1]


_BREAKS = T.StructType([
    T.StructField("elem_no", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("joined", T.StringType()), T.StructField("hyphenated", T.StringType()),
    T.StructField("mark", T.StringType()), T.StructField("rest", T.StringType()), T.StructField("next_elem", T.LongType()),
])


def _rows(schema: T.StructType, types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)


def hyphen_breaks(pages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The line-end marks that aren't part of their word: elem_no, line_no, joined, rest, next_elem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for e, text, gone, after in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows += [(e, i, left + right, f"{left}-{right}", mark, right, ne) for i, left, mark, right, _, ne in Page(text, gone, after).breaks()]
            yield _rows(_BREAKS, [pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int64()], rows)

    found = pages.select("elem_no", "text", "gone", "after").mapInArrow(run, _BREAKS)
    whole = vocabulary.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    apart = vocabulary.select(F.col("word").alias("hyphenated"), F.col("n").alias("n_apart"))
    known = found.join(whole, "joined", "left").join(apart, "hyphenated", "left")
    n_joined, n_apart = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_apart", F.lit(0))
    # a compound that stands only at line ends is counted by its hyphenated form there; one of them is this line itself
    lower = F.col("rest").rlike(r"^\p{Ll}")
    good = F.col("mark").isin("¬", "\xad") & lower | (n_joined > n_apart) | ((n_joined == 0) & (n_apart == 0) & lower)
    return known.where(good).select("elem_no", "line_no", "joined", "rest", "next_elem")


_TOKENS = T.StructType([
    T.StructField("elem_no", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("left_len", T.IntegerType()),
    T.StructField("next_line", T.IntegerType()), T.StructField("next_elem", T.LongType()), T.StructField("before", T.StringType()), T.StructField("behind", T.StringType()),
])


def with_breaks(pages: DataFrame, breaks: DataFrame) -> DataFrame:
    own = breaks.groupBy("elem_no").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "rest"))).alias("joined"))
    into = breaks.where("next_elem is not null").select(F.col("next_elem").alias("elem_no"), F.lit(True).alias("rest_first")).dropDuplicates(["elem_no"])
    out = pages.join(own, "elem_no", "left").join(into, "elem_no", "left")
    return out.withColumn("rest_first", F.coalesce("rest_first", F.lit(False)))


def page_tokens(pages: DataFrame) -> DataFrame:
    """The body's words with their neighbours; `pages` as with_breaks gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for e, text, gone, after, joined, rest_first in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                t = list(Page(text, gone, after).tokens(dict(joined or ()), rest_first))
                rows += [(e, *x, t[k - 1][1] if k else None, t[k + 1][1] if k + 1 < len(t) else None) for k, x in enumerate(t)]
            yield _rows(_TOKENS, [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()], rows)

    return pages.select("elem_no", "text", "gone", "after", "joined", "rest_first").mapInArrow(run, _TOKENS)


@F.pandas_udf(T.StringType())
def _fold(words: pd.Series) -> pd.Series:
    return words.map(fold)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(words: pd.Series) -> pd.Series:
    """The glyph class keys of rare words: 6 may stand for b as well as for ó."""
    return words.map(lambda w: sorted({fold(w), fold(w.replace("6", "o"))}))


def vectors(tokens: DataFrame, words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """word, bucket and x: the unit skip-gram vectors of `words`, counts of the words beside them over all pages."""
    near = tokens.join(words, "word", "left_semi").select("word", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("other")), F.struct(F.lit(1).alias("side"), F.col("behind").alias("other")))).alias("c")).where("c.other is not null")
    vector = near.groupBy("word", (F.col("c.side") * buckets + F.pmod(F.xxhash64(F.lower("c.other")), F.lit(buckets))).alias("bucket")).agg(F.log1p(F.count("*")).alias("x"))
    norm = vector.groupBy("word").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return vector.join(norm, "word").select("word", "bucket", (F.col("x") / F.col("norm")).alias("x"))


def corrections(tokens: DataFrame, vocabulary: DataFrame, naive: DataFrame, times: float = TIMES, least_times: float = LEAST_TIMES, close: float = CLOSE, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and fix: rare words of the pages, each with the frequent word of its glyph class that fits its contexts best.

    `vocabulary` counts all elements and `naive` the scanned pages the same way, so that their difference
    is what sound text holds. `close` over 1 leaves the vectors without a say in what is linked.
    """
    counts = vocabulary.join(naive.withColumnRenamed("n", "n_scan"), "word", "left").select("word", "n", (F.col("n") - F.coalesce("n_scan", F.lit(0))).alias("n_clean"))
    words = tokens.groupBy("word").agg(F.count("*").alias("here"))
    rare = words.join(counts, "word", "left").select("word", "here", F.greatest(F.coalesce("n_clean", F.lit(0)), F.lit(0)).alias("n_clean"))
    rare = rare.where(F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2)).withColumn("key", F.explode(_keys("word")))
    frequent = counts.where(F.col("word").rlike(r"^\p{L}+$") & (F.col("n") >= least_count)).select(F.col("word").alias("fix"), F.col("n").alias("fix_n"), F.col("n_clean").alias("fix_clean")).withColumn("key", _fold("fix"))
    linked = rare.join(frequent, "key").where(
        (F.col("word") != F.col("fix"))
        & ((F.col("fix_n") >= times * F.col("here")) | (F.col("n_clean") == 0) & (F.col("fix_n") >= least_times * F.col("here")))
        & (F.col("fix_clean") >= times * F.col("n_clean"))
        & (F.col("fix_clean") >= 1)
        & (F.substring("word", 1, 1).rlike(r"^\p{Lu}") == F.substring("fix", 1, 1).rlike(r"^\p{Lu}") | F.substring("word", 1, 1).rlike(r"^\d"))
        & ((F.upper("word") != F.col("word")) | (F.upper("fix") == F.col("fix")))
        & (F.levenshtein("word", "fix") <= F.greatest(F.lit(1), F.ceil(F.length("word") / 3)))
        & ((F.length("word") > 2) | (F.length("word") == F.length("fix")))
    )
    pairs = cut(linked.select("word", "fix", "here", "fix_n"))
    needed = pairs.select("word").union(pairs.select("fix")).dropDuplicates()
    unit = cut(vectors(tokens, needed))
    a = unit.select("word", "bucket", F.col("x").alias("xa"))
    b = unit.select(F.col("word").alias("fix"), "bucket", F.col("x").alias("xb"))
    near = pairs.select("word", "fix").join(a, "word").join(b, ["fix", "bucket"]).groupBy("word", "fix").agg(F.sum(F.col("xa") * F.col("xb")).alias("close"))
    scored = pairs.join(near, ["word", "fix"], "left").withColumn("close", F.coalesce("close", F.lit(0.0)))
    scored = scored.where((F.col("fix_n") >= times * F.col("here")) | (F.col("close") >= close))
    rank = F.struct(F.col("close") - 0.2 * F.levenshtein("word", "fix"), "fix_n", "fix")
    return scored.groupBy("word").agg(F.max_by("fix", rank).alias("fix"))


_MIXED = r"^[0-9OoIl]*[0-9][0-9OoIl]*$"


def corrected(word: str, fixes: dict[str, str]) -> str:
    """A word as it should read: its fix, or a number's misread digits put right where misread_lines reports them."""
    if word not in fixes and len(word) >= 2 and re.search("[OoIl]", word) and re.search(_MIXED, word):
        return word.translate(_DIGITS)
    return fixes.get(word, word)


def misread_lines(tokens: DataFrame, fixes: DataFrame) -> DataFrame:
    """elem_no and line_no of body lines with a misread character; a broken word counts where its wrong character is."""
    fixed = tokens.join(small(fixes), "word", "left")
    odd = F.col("word").rlike(_MIXED) & F.col("word").rlike("[OoIl]") & (F.length("word") >= 2)
    bad = fixed.where(F.col("fix").isNotNull() | odd)
    same = F.length(F.regexp_extract(F.concat_ws("\x00", "word", "fix"), "^(.*).*\x00\\1", 1))
    broken = F.col("next_line") > 0
    on_next = broken & F.col("fix").isNotNull() & (same >= F.col("left_len"))
    here = bad.select(F.when(on_next, F.coalesce("next_elem", "elem_no")).otherwise(F.col("elem_no")).alias("elem_no"), F.when(on_next, F.col("next_line")).otherwise(F.col("line_no")).alias("line_no"))
    return here.dropDuplicates()


# --- results -----------------------------------------------------------------------------------------


class Scan:
    """The steps of one corpus, each made once."""

    def __init__(self, docs: DataFrame, elements: DataFrame, close: float = CLOSE):
        self.delivered = cut(scanned_pages(docs, elements))
        self.pages = self.delivered.dropDuplicates(["elem_no"])
        self.vocabulary = cut(word_counts(elements.select("text")))
        self.furniture = cut(furniture(self.pages))
        self.bodies = bodies(self.pages, self.furniture)
        self.breaks = cut(hyphen_breaks(self.bodies, self.vocabulary))
        self.whole = with_breaks(self.bodies, self.breaks)
        self.tokens = cut(page_tokens(self.whole))
        self.fixes = corrections(self.tokens, self.vocabulary, word_counts(self.delivered.select("text")), close=close)

    def noise(self) -> DataFrame:
        hyphens = self.breaks.select("elem_no", "line_no", F.lit("hyphen_break").alias("noise_kind"))
        misread = misread_lines(self.tokens, self.fixes).withColumn("noise_kind", F.lit("misread"))
        return self.furniture.unionByName(hyphens).unionByName(misread)

    def repaired(self) -> DataFrame:
        """doc_id, unit_index, elem_no and text of every page: no furniture, words whole and corrected, paragraphs on one line."""
        bad = self.tokens.select("elem_no", "word").dropDuplicates().join(small(self.fixes), "word")
        per = bad.groupBy("elem_no").agg(F.map_from_entries(F.collect_list(F.struct("word", "fix"))).alias("fixes"))
        rows = self.whole.join(per, "elem_no", "left").select("doc_id", "unit_index", "elem_no", "text", "gone", "after", "joined", "rest_first", "fixes")
        return rows.mapInArrow(_reflowed, _PAGES)


def reflow(text: str, gone: list[int], after: dict | None, joined: dict[int, str], rest_first: bool, fixes: dict[str, str]) -> str:
    """A page as paragraphs; a word broken over the page's end stays whole on the page where it starts."""
    page = Page(text, gone, after)
    paragraphs: list[str] = []
    current, glue = "", False
    full = [i for i, x in page.body if x.strip()]
    behind = dict(zip(full, full[1:], strict=False))
    drop = set(full[:1]) if rest_first else set()  # lines whose first word is the rest of a word before
    for i, line in page.body:
        x = line.strip()
        if not x:
            if current and not glue:
                paragraphs.append(current)
                current = ""
            continue
        if i in drop:
            x = _STARTS.sub("", x, count=1).lstrip()
        current = current + x if glue or not current else f"{current} {x}"
        glue = False
        if i in joined:
            current = current.rstrip(MARKS)
            line_no, elem_no, _ = page.next[i]
            if elem_no is None and behind.get(i) == line_no:
                glue = True
            else:  # the rest stands on the next page or behind a table's rest
                current += joined[i]
                if elem_no is None:
                    drop.add(line_no)
        elif current[-1:] in MARKS and i in page.next:
            glue = True
    if current:
        paragraphs.append(current)
    out = "\n\n".join(paragraphs)
    return _WORD.sub(lambda m: corrected(m.group(), fixes), out)


_PAGES = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("unit_index", T.IntegerType()), T.StructField("elem_no", T.LongType()), T.StructField("text", T.StringType())])


def _reflowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b.column(i).to_pylist() for i in range(3, 9)), strict=True)
        texts = [reflow(text, gone, after, dict(joined or ()), rest_first, dict(fixes or ())) for text, gone, after, joined, rest_first, fixes in rows]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(texts, pa.string())], names=_PAGES.names)


def scan_noise(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """elem_no, line_no, noise_kind of every noisy line of the scanned pages."""
    return Scan(docs, elements).noise()
