"""How often text that is damaged on purpose is noticed and comes back; sound lines of the test table."""

import os
import random

import pytest

from paperloom.llm import encoding

DATA = "/root/testdata/sf0.001/documents.parquet"
#: Encodings that text of a language was written in, and those it was then taken for.
PAIRS = {
    "latin": [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "mac_roman")],
    "ru": [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8_r")],
    "ar": [("utf-8", "cp1252"), ("utf-8", "cp1256"), ("cp1256", "cp1252")],
}


def measured(path, most, seed=1):
    """{kind: (lines, noticed, restored)} and (sound lines, false alarms)."""
    import pyarrow.parquet as pq

    r = random.Random(seed)
    lines = []
    for lang, text in zip(*(pq.read_table(path, columns=["lang", "text"]).column(i).to_pylist() for i in range(2)), strict=True):
        lines += [("ru" if lang == "ru" else "ar" if lang == "ar" else "latin", x.strip()) for x in (text or "").split("\n") if not x.isascii() and len(x.split()) >= 4]
    r.shuffle(lines)
    out, sound = {}, [0, 0]
    for kind, line in lines[:most]:
        if encoding.repair_text(line)[1]:  # the table holds damaged lines and odd characters of its own
            sound[1] += 1
        sound[0] += 1
        written, seen = r.choice(PAIRS[kind])
        try:
            raw = line.encode(written)
        except UnicodeEncodeError:
            continue
        wrong = "".join(encoding.char_table(seen)[b] for b in raw)
        if wrong == line:
            continue
        restored, damaged, _ = encoding.repair_text(wrong)
        n = out.setdefault(kind, [0, 0, 0])
        n[0] += 1
        n[1] += damaged
        n[2] += restored == line
    return out, sound


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_damage_is_noticed_and_restored():
    out, sound = measured(DATA, 600)
    for kind, (n, noticed, restored) in out.items():
        assert noticed >= 0.95 * n and restored >= 0.85 * n, (kind, n, noticed, restored)
    assert sound[1] <= 0.05 * sound[0], sound


if __name__ == "__main__":
    print(measured(DATA.replace("0.001", "0.01"), 6000))
