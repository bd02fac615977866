"""Text that looks the same but is written with different characters (problem 5).

The method is segment-wise normalization by quick-check properties. ASCII texts never leave the JVM. In the
rest the normalization quick check decides: a text that passes it is left as it is, and of one that fails
only the segments around unstable characters (those that NFC changes, that combine with what is before them or
that composition may take up) are normalized, with the starter before them as context, and spliced back into
the unchanged text. The property is derived from the Unicode tables for all characters. On top of NFC, widths,
kinds of single space, kinds of hyphen, ligatures, contextual letter forms and invisible characters are folded,
and letters drawn alike in several scripts are written in the script of their word: that of its letters with
no double in another script, else that of the text's other words. Case, punctuation, doubled spaces and
signs drawn differently (raised, circled, fractions, joined abbreviations) are kept.

Defined results: null stays null; empty text is its own form; texts of any length are treated whole;
repeated deliveries of an element count once; further columns are kept by `canonical`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import encoding
from paperloom.runtime import cut, small

#: Letters drawn alike: Cyrillic and Greek with their Latin doubles (fixed values).
CYRILLIC = "аеорсхуіјѕԁԛһАВЕКМНОРСТХУІЈЅ"
CYRILLIC_AS = "aeopcxyijsdqhABEKMHOPCTXYIJS"
GREEK = "οναΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ovaABEZHIKMNOPTYX"
#: Characters with no width of their own (fixed values).
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe0e\ufe0f\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\uff0d"

_TO_LATIN = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)
_TO_CYRILLIC = str.maketrans(CYRILLIC_AS + GREEK, CYRILLIC + "".join(CYRILLIC[CYRILLIC_AS.index(c)] if c in CYRILLIC_AS else c for c in GREEK_AS))
_TO_GREEK = str.maketrans(GREEK_AS.replace("a", "", 1) + CYRILLIC, GREEK.replace("α", "", 1) + "".join(GREEK[GREEK_AS.index(c)] if c in GREEK_AS else c for c in CYRILLIC_AS))
#: Doubles so rare that they tell of a Latin word.
_RARE = frozenset("ԁԛһ")
_LATIN_DOUBLES = frozenset(CYRILLIC_AS + GREEK_AS) - frozenset("dqh")
_DOUBLES = frozenset(CYRILLIC + GREEK)


def _fold_table() -> dict[int, str]:
    """Width forms, ligatures of letters and contextual letter forms by their compatibility decompositions."""
    table = {ord(c): "" for c in INVISIBLE} | {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
    for o in (*range(0xFB00, 0xFB07), *range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFFEF)):
        kind = unicodedata.decomposition(chr(o)).split(" ")[0]
        if kind in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>") or kind == "<compat>" and o < 0xFB07:
            table.setdefault(o, unicodedata.normalize("NFKC", chr(o)))
    return table


def ranges(codes: list[int]) -> str:
    """A character class of the given code points, without its brackets."""
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}" + (f"-\\U{codes[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


#: All characters but ideographs, Hangul syllables, surrogates and private use, which are stable.
_ASSIGNED = ((0x80, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))


@lru_cache(maxsize=1)
def unstable_segments() -> re.Pattern[str]:
    """A segment that NFC may change: unstable characters with the starter before them.

    Unstable is what has no quick check of yes, or a combining class: characters that NFC changes, marks, and
    those that a composition takes up after its first character, jamo of Hangul among them.
    """
    found = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for o in (o for lo, hi in _ASSIGNED for o in range(lo, hi)):
        c = chr(o)
        if not unicodedata.is_normalized("NFC", c) or unicodedata.combining(c):
            found.add(o)
        pair = unicodedata.decomposition(c)
        if pair and pair[0] != "<" and " " in pair:
            found.add(int(pair.split()[1], 16))
    inside = ranges(sorted(found))
    return re.compile(f"[^{inside}]?[{inside}]+", re.DOTALL)


def composed(text: str) -> str:
    """NFC of a text, of which only the segments that fail the quick check are normalized."""
    if unicodedata.is_normalized("NFC", text):
        return text
    return unstable_segments().sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


_FOLD = _fold_table()
_OTHER = re.compile("[\u0370-\u052f]")
_WORD = re.compile("[A-Za-z\u00c0-\u024f\u0300-\u052f]+")

#: Quick check for folding: any character that it changes.
_FOLDED = re.compile("[" + ranges(sorted(_FOLD)) + "]")
_LATIN_LETTER = re.compile("[A-Za-z\u00c0-\u024f]")
_OWN_CYRILLIC = re.compile("[бгджзийклмнптфц-яБГДЖЗИЙЛПУФЦ-Я]")


@lru_cache(maxsize=100_000)
def _word(word: str) -> tuple[str, str]:
    """(script, word in it) of a word with letters of several scripts; script "" where none of its letters tells."""
    plain = unicodedata.normalize("NFD", word)
    latin = cyrillic = greek = 0
    for c in plain:
        if c < "\u0250":
            latin += c.isalpha() and c not in _LATIN_DOUBLES
        elif c < "\u0370":
            continue
        elif c in _RARE:
            latin += 1
        elif c not in _DOUBLES:
            cyrillic += c >= "\u0400"
            greek += c < "\u0400"
    script = "L" if latin else "C" if cyrillic else "G" if greek else ""
    table = {"C": _TO_CYRILLIC, "G": _TO_GREEK}.get(script, _TO_LATIN)
    return script, unicodedata.normalize("NFC", plain.translate(table))


def canonical_text(text: str) -> str:
    """The one form of all texts that look like `text`."""
    if _FOLDED.search(text):
        text = text.translate(_FOLD)
    text = composed(text)
    if _OTHER.search(text) and (_LATIN_LETTER.search(text) or not _OWN_CYRILLIC.search(text)):
        parts = [(m.start(), m.end(), *_word(m.group())) for m in _WORD.finditer(text)]
        count = {s: sum(p[2] == s for p in parts) for s in "CGL"}
        top = max("LCG", key=lambda s: count[s])  # the first of equals
        table = {"C": _TO_CYRILLIC, "G": _TO_GREEK}.get(top)
        out, at = [], 0
        for s, e, script, word in parts:
            if not script and table:
                other = unicodedata.normalize("NFD", word).translate(table)
                if not _LATIN_LETTER.search(other):  # all of its letters have doubles there
                    word = unicodedata.normalize("NFC", other)
            out += [text[at:s], word]
            at = e
        text = "".join([*out, text[at:]])
    return text


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else canonical_text(t) for t in texts], dtype=object)


def unstable(text: Column) -> Column:
    """Quick check inside the JVM: pure ASCII is its own canonical form."""
    return F.length(text) != F.octet_length(text)


def canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """`df` with the canonical form of `text` in `out`; a column of that name is replaced."""
    return df.withColumn(out, F.coalesce(_canonical(F.when(unstable(F.col(text)), F.col(text))), F.col(text)))


def same_look_pairs(elements: DataFrame) -> DataFrame:
    """elem_no_a, elem_no_b of elements of one document whose texts differ but look the same, smaller first.

    Elements with decoding damage take no part. Only 128-bit digests travel; texts that are the only spelling of
    their look in their document are done with then, and only the others are read again and searched for damage.
    Pairs are made of spellings first and of their elements after that, so every pair that is made is a result,
    however many elements of a document have one text.
    """
    text = F.col("text")
    base = elements.where(text.isNotNull() & F.col("doc_id").isNotNull()).select("elem_no", "doc_id", "text")
    rows = cut(canonical(base).select("elem_no", "doc_id", F.unhex(F.md5("canonical")).alias("look"), F.unhex(F.md5("text")).alias("spelling"), encoding.suspicious(text).alias("suspicious")))
    same = ["doc_id", "look"]

    def several(df: DataFrame) -> DataFrame:
        """The rows of looks with more than one spelling; spellings are counted with map-side combining."""
        found = df.groupBy(*same).agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select(*same)
        return df.join(small(found), same, "left_semi")

    mixed = cut(several(rows).dropDuplicates(["elem_no"]))
    asked = small(mixed.where("suspicious").select("elem_no"))
    damaged = encoding.repair(base.join(asked, "elem_no", "left_semi").where(encoding.suspicious(text))).where("damaged").select("elem_no").dropDuplicates()
    sound = cut(mixed.join(damaged, "elem_no", "left_anti").select("elem_no", *same, "spelling"))
    spellings = sound.select(*same, "spelling").dropDuplicates()
    a, b = (spellings.withColumnRenamed("spelling", f"spelling_{x}") for x in "ab")
    kinds = a.join(b, same).where("spelling_a < spelling_b")
    of = {x: sound.select(*same, F.col("spelling").alias(f"spelling_{x}"), F.col("elem_no").alias(f"elem_{x}")) for x in "ab"}
    pairs = kinds.join(of["a"], [*same, "spelling_a"]).join(of["b"], [*same, "spelling_b"])
    return pairs.select(F.least("elem_a", "elem_b").alias("elem_no_a"), F.greatest("elem_a", "elem_b").alias("elem_no_b"))
