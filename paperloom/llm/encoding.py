"""Text decoded with the wrong character encoding (problem 3).

The method is a best-first search. A state is a token's text; an edge re-encodes it with the encoding it
was seen in and decodes the bytes with the encoding it may have been written in, or unescapes it. A cost
of character plausibility orders the queue, hashes of visited states stop repeats, and the cheapest
reachable text wins. A token counts as damaged when the search finds a text that is cheaper by a margin,
which is small for decodings to UTF-8 (valid multi-byte sequences hardly arise by chance) and larger for
one single-byte table against another. U+FFFD and C1 controls are damage that can't be restored.

Pure ASCII never leaves the JVM. A token whose characters cost less than the least gain can't be damaged and is
not searched; all others are, once per distinct token and task.

Defined results: null and empty text is not damaged and stays as it is; text of any length is treated
whole; repeated deliveries of an element give one row; further columns are kept by `repair`.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings that a text may have been shown in, and that its bytes may really have been in.
SEEN = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1256", "cp437", "mac_roman", "koi8_r", "cp866", "cp850")
WRITTEN = ("utf-8", "cp1252", "cp1251", "cp1256", "koi8_r", "cp866")
#: Least gain in cost for a decoding to UTF-8 and for one between single-byte tables.
GAIN_UTF8, GAIN_BYTES = 0.6, 2.4
#: Single-byte tables that are commonly taken for one another, as seen by written; other pairs cost UNUSUAL more.
USUAL = {"cp1252": ("cp437", "cp1251", "cp850", "cp1250", "mac_roman"), "cp1251": ("cp1252", "latin-1", "koi8_r", "cp866"), "cp1256": ("cp1252", "latin-1"), "koi8_r": ("cp1251", "cp1252"), "cp866": ("cp1251", "cp1252")}
UNUSUAL = 1.0

# --- candidates ----------------------------------------------------------------------


def suspicious(text: Column) -> Column:
    """What leaves the JVM: text that isn't pure ASCII or holds an entity."""
    return (F.length(text) != F.octet_length(text)) | text.contains("&")


# --- tables ------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def byte_table(encoding: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for the control of that number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def char_table(encoding: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def recode(text: str, seen: str, written: str) -> str | None:
    """`text` as bytes of `seen` read as `written`; null where that isn't possible or changes nothing."""
    table = byte_table(seen)
    try:
        raw = bytes([table[c] for c in text])
    except KeyError:
        return None
    if written == "utf-8":
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    else:
        chars = char_table(written)
        out = "".join([chars[b] for b in raw])
    return out if out != text else None


# --- plausibility ------------------------------------------------------------------------------------

#: Letters of Russian by falling frequency (fixed values).
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ"
#: Letters of Arabic by falling frequency (fixed values).
ARABIC = "اليمنورتبةعدسفهكقأحجشطصىخإءذضثزغئؤظآ"
_COST: dict[str, float] = {c: 0.2 + 0.055 * i for i, c in enumerate(RUSSIAN)}
_COST |= {c.upper(): x + 0.3 for c, x in list(_COST.items())}
_COST |= {c: 0.2 + 0.05 * i for i, c in enumerate(ARABIC)}
_COST |= dict.fromkeys("àâáãäçéèêëíîïñóôõöùûúüßœ", 0.45)
_COST |= dict.fromkeys("ÀÂÁÃÄÇÉÈÊËÍÎÏÑÓÔÕÖÙÛÚÜŒ", 1.0)
_COST |= dict.fromkeys("°€’‘“”„«»–—…•½²³¹·−º¿¡ ", 0.5) | dict.fromkeys("§№™©®\xa0", 1.0)
_COST |= dict.fromkeys("،؛؟", 0.4)
_COST |= {chr(c): 8.0 for c in range(0x80, 0xA0)} | {"�": 8.0}
_COST |= {chr(c): 4.0 for c in range(0x2500, 0x25A0)}
_COST |= {chr(c): 4.0 for c in (*range(0x402, 0x410), *range(0x452, 0x460), 0x490, 0x491)}
#: Letters drawn alike in Latin, Cyrillic and Greek; written for one another they are no decoding damage.
ALIKE = frozenset("aceopxsijyABCEHKMOPTXSIJYvnNZ" + "асеорхуѕіјАВСЕНКМОРТХЅІЈУ" + "οναΑΒΕΖΗΙΚΜΝΟΡΤΥΧ") - {"α"}
_COST |= dict.fromkeys("ѕіјЅІЈ" + "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", 0.6)
_COST |= dict.fromkeys("​‌‍⁠﻿\xad", 0.5) | {chr(c): 3.0 for c in range(0x300, 0x370)}
_COST |= dict.fromkeys("\u0300\u0301\u0302\u0303\u0306\u0308\u0327\u0653\u0654\u0655", 0.6)
_COST |= {chr(c): 0.2 for c in (*range(0xFF00, 0xFFF0), *range(0xFB00, 0xFB07))}
#: Signs that may stand between two letters.
JOINING = frozenset("’‐‑\xad·​‌‍⁠\ufeff\u0300\u0301\u0302\u0303\u0306\u0308\u0327\u0653\u0654\u0655")
#: Accented letters that are words of their own (fixed values), and the cost of another that stands alone.
WORDS_OF_ONE, NO_WORD = frozenset("àâáéêèíóòôú"), 2.8
#: First bytes of two-byte sequences as they are mostly shown, and the cost of a sign behind one.
LEADS, LEAD_AND_SIGN = frozenset("ÂÃРС"), 0.5
#: Signs before and behind a fixed space.
CLOSING, BEHIND = frozenset("€°«»”"), frozenset("»:;?!%€°$#/&-([|")
#: Cost of a letter of another script inside a word, and of a sign between two letters.
FOREIGN, SIGN_INSIDE = 2.5, 1.5


@lru_cache(maxsize=4096)
def char_cost(c: str) -> float:
    if c < "\x80":
        return 0.0 if c >= " " or c in "\n\t\r" else 8.0
    return _COST.get(c, 3.0)


def _script(c: str) -> str:
    if c < "\x80":
        return "L" if c.isalpha() else ""
    o = ord(c)
    if 0xC0 <= o < 0x250 and o not in (0xD7, 0xF7):
        return "l"
    if not c.isalpha():
        return ""
    return "C" if 0x400 <= o < 0x530 else "A" if 0x600 <= o < 0x700 else "G" if 0x370 <= o < 0x400 else ""


_AS_CYRILLIC = str.maketrans("aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ")
#: у is drawn like y, but y hardly stands here; ó of cp1252 read as cp1251 does.
_NO_Y = re.compile("iу|lу(?=[a-z])|cуp")
_CYRILLIC_WORD = re.compile("[А-Яа-яЁё]{3,}")
_RUSSIAN_NEVER = re.compile("(?<![бвгджзйклмнпрстфхцчшщ])[ъьЪЬ]|ъ(?![еёюя])|(?<![аеёиоуыэюя])й|^ы|[бвгджзйклмнпрстфхцчшщьъ]{5}|ыы|[аеёиоуыэюя]{4}")
_RUSSIAN_VOWEL = re.compile("[аеёиоуыэюя]")


def russian_oddness(text: str) -> float:
    """What Russian spelling rules out: words without a vowel, hard signs before consonants, long runs and the like."""
    total = 0.0
    for m in _CYRILLIC_WORD.finditer(text.translate(_AS_CYRILLIC)):
        w = m.group().lower()
        total += 2.0 * len(_RUSSIAN_NEVER.findall(w)) + (0.0 if _RUSSIAN_VOWEL.search(w) else 2.5)
    return total


def cost(text: str) -> float:
    """Implausibility of a token: its characters, runs of accented letters, odd case, signs and scripts mixed inside a word."""
    total, run, before, lower = 0.0, 0, False, False
    own: dict[str, int] = {}
    capitals = text.isupper() and sum(map(str.isalpha, text)) > 1
    for i, c in enumerate(text):
        s = _script(c)
        if c == "\xa0" and i and (text[i - 1] < "\x80" or "à" <= text[i - 1] <= "ÿ" or text[i - 1] in CLOSING) and (not text[i + 1 : i + 2] or text[i + 1].isalnum() or text[i + 1] in BEHIND):
            continue  # it stands where a space may
        total += char_cost(c) - (0.25 if capitals and s == "C" else 0.0)
        if s == "l":
            run += 1
            if run > 1:
                total += 1.2
        else:
            run = 0
        if s and lower and c.isupper():
            total += 2.2 if s == "l" else 0.6
        if not s and c >= "\x80" and i and text[i - 1] in LEADS:
            total += LEAD_AND_SIGN
        if s:
            if c not in ALIKE:
                kind = "L" if s == "l" else s
                own[kind] = own.get(kind, 0) + 1
            lower = c.islower()
        elif c >= "\x80" and c not in JOINING:
            lower = False
            if before and text[i + 1 : i + 2].isalpha():
                total += SIGN_INSIDE
        elif c < "\x80":
            lower = False
        before = bool(s)
    if "C" in own:
        total += russian_oddness(text)
    if len(text) == 1 and _script(text) == "l" and text.lower() not in WORDS_OF_ONE:
        total += NO_WORD
    if _NO_Y.search(text):
        total += FOREIGN
    if len(own) > 1:
        total += FOREIGN * (sum(own.values()) - max(own.values()))
    return total


# --- search ------------------------------------------------------------------------------------------


def edges(text: str, c: float, written_in: tuple[str, ...] = WRITTEN) -> Iterator[tuple[str, str, float]]:
    """(operation, text, least gain) of every step from `text` of cost `c` that can gain enough."""
    for seen in SEEN if c >= GAIN_UTF8 else ():
        for written in written_in:
            gain = GAIN_UTF8 if written == "utf-8" else GAIN_BYTES
            if seen != written and c >= gain and (out := recode(text, seen, written)) is not None:
                yield f"{seen}>{written}", out, gain
    if "&" in text and (out := html.unescape(text)) != text:
        yield "unescape", out, GAIN_UTF8


@lru_cache(maxsize=200_000)
def search(token: str, written_in: tuple[str, ...] = WRITTEN) -> tuple[str, tuple[str, ...]]:
    """The cheapest text reachable from `token` and the steps to it; no steps where nothing is gained.

    No cost is below 0, so a token that costs less than the least gain is sound. Each step lowers the cost by a
    gain, which bounds the depth of the search, and a state that was seen is not entered again.
    """
    best, best_cost, best_path = token, cost(token), ()
    queue: list[tuple[float, int, str, tuple[str, ...], float]] = [(best_cost, 0, token, (), best_cost)]
    seen, n = {hash(token)}, 0
    while queue:
        priced, _, text, path, c = heapq.heappop(queue)
        if priced < best_cost:
            best, best_cost, best_path = text, priced, path
            if not priced:
                break
        for op, out, gain in edges(text, c, written_in):
            if (h := hash(out)) not in seen and c - (x := cost(out)) >= gain:
                shown, _, real = op.partition(">")
                odd = UNUSUAL if gain == GAIN_BYTES and shown not in USUAL.get(real, ()) else 0.0
                if not odd:
                    seen.add(h)
                n += 1
                heapq.heappush(queue, (priced - c + x + odd, n, out, (*path, op), x))
    if not best_path and len(written_in) > 1 and not token.isascii():  # damage beside sound characters: each run of its own
        parts, steps = [], ()
        for m in _RUNS.finditer(token):
            part = m.group()
            if len(part) > 1 and part != token and not part.isascii():
                part, path = search(part, ("utf-8",))
                steps = steps or path
            parts.append(part)
        if steps:
            return "".join(parts), steps
    return best, best_path


#: Characters of a token that are searched at once; a longer one is searched in blocks.
BLOCK = 600


def search_long(token: str, block: int = BLOCK) -> tuple[str, tuple[str, ...]]:
    """The same for a token of any length, in time proportional to it.

    Each block is searched, without up to three characters on either side where a sequence of bytes may be cut
    through. The steps that a block took are then tried on the whole token, and the cheapest text wins.
    """
    parts, paths = [], {}
    for at in range(0, len(token), block):
        part = token[at : at + block]
        for a, z in _TRIMS if cost(part) >= GAIN_UTF8 else ():
            inner, path = search(part[a : len(part) - z])
            if path:
                paths[path] = None
                part = part[:a] + inner + part[len(part) - z :]
                break
        parts.append(part)
    best, least = "".join(parts), ()
    if paths:
        least, low = next(iter(paths)), cost(best)
        for path in paths:
            if (x := apply(token, path)) is not None and (c := cost(x)) < low:
                best, low, least = x, c, path
    return best, least


_TRIMS = sorted(((a, z) for a in range(4) for z in range(4)), key=sum)
_RUNS = re.compile("[^\x00-\x7f]+|[\x00-\x7f]+")
_LOST = re.compile("[\x80-\x9f�]")
#: A token; a scanner's broken hyphen at a line's end isn't part of it.
_TOKEN = re.compile("[^ \n\t\r]+?(?=(?<=[a-zß-öø-ÿ])¬(?![^ \n\t\r])|[ \n\t\r]|$)|[^ \n\t\r]+")


def repair_text(text: str) -> tuple[str, bool, str]:
    """(restored text, damaged, steps used) of a text; what can't be restored stays as it is."""
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text) if not m.group().isascii() or "&" in m.group()]
    found = {i: r for i, (_, _, t) in enumerate(tokens) if (r := search(t) if len(t) <= BLOCK else search_long(t))[1]}
    damaged = bool(found) or bool(_LOST.search(text))
    if not damaged or not found:
        return text, damaged, ""
    # one stretch is mostly damaged one way: the steps that are best for all its tokens go before each token's own
    paths = {p for _, p in found.values()}
    main, by_main, least = (), {}, 0.0
    for path in sorted(paths):
        tried = {i: apply(tokens[i][2], path) for i in found}
        total = sum(cost(x if x is not None else tokens[i][2]) for i, x in tried.items())
        if not main or total < least:
            main, by_main, least = path, tried, total
    first, last = min(found), max(found)
    scripts = [c for i in found for c in map(_script, by_main[i] or "") if c in ("C", "A")]
    script = max(set(scripts), key=scripts.count) if scripts else ""
    out, at = [], 0
    for i, (s, e, t) in enumerate(tokens):
        new = t
        x = by_main[i] if i in found else apply(t, main)
        if i in found:
            new = found[i][0]
            if x is not None and (cost(x) <= cost(new) + 1.5 or first < i < last and fits(x, script)):
                new = x
        elif x is not None:
            if cost(x) <= cost(t) if first < i < last else cost(x) < cost(t) - (0.0 if main[-1].endswith(">utf-8") else 0.8):
                new = x
            elif first < i < last and fits(x, script):  # it stands inside the damaged stretch
                new = x
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), damaged, " ".join(sorted({"|".join(main)}))


def fits(token: str, script: str) -> bool:
    """Whether a token is a usual word of `script`, with signs around it at most."""
    letters = [c for c in token if c.isalpha()]
    word = "".join(letters)
    return bool(script) and bool(letters) and all(_script(c) == script for c in letters) and word in token and (word.islower() or word.istitle() or word.isupper() or script == "A") and not (script == "C" and russian_oddness(word))


def apply(text: str, path: tuple[str, ...]) -> str | None:
    """`text` after the steps of `path`; null where one of them isn't possible."""
    x: str | None = text
    for op in path:
        x = html.unescape(x) if op == "unescape" else recode(x, *op.split(">"))
        if x is None:
            return None
    return x


_RESULT = T.StructType([T.StructField("restored", T.StringType()), T.StructField("damaged", T.BooleanType()), T.StructField("steps", T.StringType())])


@F.pandas_udf(_RESULT)
def _repair(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, False, "") if t is None else repair_text(t) for t in texts]
    return pd.DataFrame(rows, columns=["restored", "damaged", "steps"])


def repair(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows of `df` with `restored`, `damaged` and `steps`; a clash with those names replaces them."""
    out = df.drop("restored", "damaged", "steps").withColumn("__r", _repair(F.when(suspicious(F.col(text)), F.col(text))))
    return out.select(
        *[c for c in out.columns if c != "__r"], F.coalesce("__r.restored", text).alias("restored"),
        F.coalesce("__r.damaged", F.lit(False)).alias("damaged"), F.col("__r.steps").alias("steps"),
    )


def damaged_elements(elements: DataFrame) -> DataFrame:
    """elem_no, restored and steps of every element with damage, once each."""
    few = elements.where(suspicious(F.col("text"))).select("elem_no", "text")
    return repair(few).where("damaged").select("elem_no", "text", "restored", "steps").dropDuplicates(["elem_no"])
