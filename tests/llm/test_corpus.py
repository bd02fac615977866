"""Packing, leakage, shared spans and scans."""

import random

import pytest

from paperloom.llm import leakage, packing, scans, shared

# --- packing


def best_known(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        for b in bins:
            if b[0] >= s:
                b[0] -= s
                break
        else:
            bins.append([capacity - s])
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_packs_everything_tightly(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 256])
    sizes = [min(capacity, max(1, int(r.expovariate(4 / capacity)))) for _ in range(r.choice([1, 30, 400]))]
    hist = {s: sizes.count(s) for s in set(sizes)}
    made = packing.plan(hist, capacity)
    used: dict = {}
    for times, content in made:
        assert sum(s * n for s, n in content) <= capacity
        for s, n in content:
            used[s] = used.get(s, 0) + n * times
    assert used == hist
    assert sum(t for t, _ in made) <= best_known(sizes, capacity) + max(1, len(sizes) // 100)


def test_two_for_one():
    # greedy takes 6 + 3 of 10 and leaves a gap; 2 + 2 in place of the 3 fill it
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])


def test_pack(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1, 7, 7, 7, 50, 100, 101, 250])) for i in range(700)]
    sized = spark.createDataFrame(rows, "doc_id long, tokens long")
    out = packing.pack(sized, 100, bucket=40).collect()
    fill: dict = {}
    for x in out:
        fill[x.bin_no] = fill.get(x.bin_no, 0) + x.size
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    per: dict = {}
    for x in out:
        per.setdefault(x.doc_id, []).append((x.piece_no, x.token_start, x.size, x.n_pieces))
    for i, t in rows:
        pieces = sorted(per[i])
        assert sum(p[2] for p in pieces) == t and len(pieces) == -(-t // 100) == pieces[0][3] and [p[1] for p in pieces] == [100 * k for k in range(len(pieces))]


def test_packing_report(spark):
    sized = spark.createDataFrame([(i, 60) for i in range(10)] + [(20, 250), (21, 40)], "doc_id long, tokens long")
    packed = packing.pack(sized, 100).selectExpr("*", "1 as container_id", "100 as capacity_tokens")
    (r,) = packing.packing_report(packed).collect()
    assert (r.tokens, r.fewest) == (890, 9) and r.bins == packed.select("bin_no").distinct().count() == 13 and abs(r.filled - 890 / 1300) < 1e-9


def test_pack_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "word " * 500), (None, "x")], "doc_id long, text string")
    boxes = spark.createDataFrame([(1, 64), (2, 512)], "container_id int, capacity_tokens int")
    rows = packing.pack_all(docs, boxes).collect()
    assert {x.doc_id for x in rows} == {1, 4} and sum(x.doc_id == 1 for x in rows) == 2
    assert packing.pack(packing.sizes(docs.limit(0)), 64).count() == 0


# --- leakage


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_bit_parallel_distance_is_edit_distance():
    r = random.Random(3)
    for _ in range(300):
        p = "".join(r.choice("abc ") for _ in range(r.randrange(1, 80)))
        t = "".join(r.choice("abc ") for _ in range(r.randrange(0, 100)))
        assert leakage.distance(p, t, 100) == min(plain_distance(p, t), 101)


def longest_run(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            new[j + 1] = row[j] + 1 if x == y else 0
            best = max(best, new[j + 1])
        row = new
    return best


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([5, 12, 20, 26])))) for i in range(30)]
    docs = []
    for d in range(150):
        words = [r.choice(vocab) for _ in range(30)]
        if d % 3:
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            part = w[a : a + r.randrange(8, 20)]
            words[10:10] = [x.upper() if r.random() < 0.3 else x for x in part]
        docs.append((d, "".join(w + r.choice([" ", ", ", "\n> ", "  **", "​ "]) for w in words)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    di = spark.createDataFrame([(*x, "clash") for x in items] + [(99, None, "")], "item_id long, text string, doc_id string")
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(d, i) for d, t in docs if t for i, x in items if longest_run(leakage.words_of(x).split(), leakage.words_of(t).split()) >= 12}
    assert want and {tuple(x) for x in leakage.leaked_pairs(dd, di).collect()} == want
    blocks = leakage.leaks(dd, di, block=700).where("words_in_a_row >= 12")
    assert {(x.doc_id, x.item_id) for x in blocks.collect()} == want
    assert leakage.leaked_pairs(dd.limit(0), di).count() == 0 and leakage.leaked_pairs(dd, di.limit(0)).count() == 0


def test_one_edit_is_within_the_budget(spark):
    words = [f"passage{i}" for i in range(12)]
    broken = list(words)
    broken[3] = broken[3][:-1] + "x"
    dd = spark.createDataFrame([(1, "so " + " ".join(broken) + " end"), (2, " ".join(words[:6]) + " other things follow here")], "doc_id long, text string")
    di = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(x) for x in leakage.leaks(dd, di).collect()] == [(1, 7, 1, 8)]
    assert leakage.leaked_pairs(dd, di).count() == 0


@pytest.mark.parametrize("budget", [1, 3, 5])
def test_edits_against_brute_force(spark, budget):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(80)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([12, 15, 20])))) for i in range(6)]
    docs, planted = [], []
    for d in range(60):
        words = [r.choice(vocab) for _ in range(20)]
        i, item = r.choice(items)
        at = r.randrange(len(item.split()) - 11)
        part = " ".join(item.split()[at : at + 12])
        edits = r.randrange(0, 7)
        for _ in range(edits):
            k = r.randrange(len(part))
            part = part[:k] + r.choice(["", "x", "xy"[:1] + part[k : k + 1]]) + part[k + 1 :]
        words[9:9] = part.split()
        docs.append((d, " ".join(words)))
        planted.append((d, i, edits))

    def least(item, text):
        w = item.split()
        return min(plain_distance(" " + " ".join(w[k : k + 12]) + " ", " " + text + " ") for k in range(len(w) - 11))

    want = {(d, i): x for d, t in docs for i, item in items if (x := least(item, t)) <= budget}
    got = {(x.doc_id, x.item_id): x.distance for x in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), budget=budget).collect()}
    # an edit inside a space joins two words, whose pieces then can't be found as whole words: all others are found
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.9 * len(want) and sum(1 for k in got if got[k] == want[k]) >= 0.9 * len(got)
    assert {(d, i) for d, i, e in planted if e == 0} <= set(got)


# --- shared spans


def random_text(r, n):
    return "".join(r.choice("abcdefghij \né世😀") for _ in range(n))


def test_places_are_covered():
    r = random.Random(6)
    for _ in range(50):
        d = shared.grams(shared.codes(random_text(r, r.randrange(1, 600))), 20)
        p = shared.places(d, 31)
        if len(d) >= 31:
            ends = [-1, *p.tolist(), len(d)]
            assert max(b - a for a, b in zip(ends, ends[1:], strict=False)) <= 31


@pytest.mark.parametrize("block", [1, 7, 100, 1000])
def test_blocks_choose_as_the_whole(block):
    r = random.Random(8)
    for n in (0, 1, 239, 240, 241, 700, 1500):
        t = random_text(r, n)
        whole = shared.places(shared.grams(shared.codes(t), 128), 113)
        d, p = shared.chosen(t, 240, 128, block)
        assert p.tolist() == whole.tolist() and d.tolist() == shared.grams(shared.codes(t), 128)[whole].tolist()


@pytest.mark.parametrize("small", [64, 1])
def test_pairs_against_brute_force(spark, small, monkeypatch):
    r = random.Random(7)
    stretches = [random_text(r, n) for n in (239, 240, 241, 300, 500)]
    texts = []
    for _ in range(60):
        t = random_text(r, r.randrange(0, 400))
        for s in r.sample(stretches, r.randrange(0, 3)):
            cut = r.choice([0, 0, 1, 30])
            t += s[cut:] + random_text(r, r.randrange(0, 200))
        texts.append(t)
    texts += [texts[3] * 1, texts[5], "z" * 239, "z" * 239, "q" * 1000, "q" * 400, None, ""]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, record string")
    grams = [{t[k : k + 240] for k in range(len(t) - 239)} if t else set() for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] & grams[j]}
    monkeypatch.setattr(shared.candidates, "__defaults__", (240, 128, small))
    assert {tuple(x) for x in shared.shared_pairs(df).collect()} == want and want
    first = {i: texts.index(t) for i, t in enumerate(texts)}
    links = {(first[i], first[j]) for i, j in want if first[i] != first[j]}
    for x in shared.class_links(df).collect():
        mine = first[x.doc_id]
        assert (x.class_id, x.copies, x.links) == (mine, sum(f == mine for f in first.values()), len({b for a, b in links | {(b, a) for a, b in links} if a == mine}))
    assert shared.shared_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [64, 1])
def test_spans_against_brute_force(spark, small):
    r = random.Random(9)
    common = [random_text(r, n) for n in (700, 240, 239, 300)]
    texts = [random_text(r, 50) + common[0] + random_text(r, 90) + common[1], common[0][100:600] + random_text(r, 300), random_text(r, 30) + common[1] + common[2], common[2]]
    own = random_text(r, 260)
    texts += [own + random_text(r, 20) + own, common[3], common[3], "short", "", None, common[0][:400] + random_text(r, 400) + common[0][300:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [{t[k : k + 240] for k in range(len(t or "") - 239)} for t in texts]
    rows = {x.doc_id: x for x in shared.shared_spans(df.unionByName(df.limit(3)), most=small).collect()}
    kept = {x.doc_id: x.text for x in shared.without(df, shared.shared_spans(df, most=small)).collect()}
    assert len(rows) == len(texts) and len(kept) == len(texts) - 1
    for i, t in enumerate(texts):
        other = set().union(*(h for j, h in enumerate(held) if j != i))
        at = {p for k in range(len(t or "") - 239) if t[k : k + 240] in other for p in range(k, k + 240)}
        assert {p for a, z in rows[i].spans for p in range(a, z)} == at and rows[i].shared_chars == len(at) and rows[i].chars == len(t or "")
        before = set().union(*(h for h in held[:i]))
        later = {p for k in range(len(t or "") - 239) if t[k : k + 240] in before for p in range(k, k + 240)}
        assert {p for a, z in rows[i].later_spans for p in range(a, z)} == later and rows[i].later_chars == len(later)
        if t:
            assert kept[i] == "".join(c for p, c in enumerate(t) if p not in later)
        assert rows[i].shared_share == (len(at) / len(t) if t else 0) and all(z < a for (_, z), (a, _) in zip(rows[i].spans, rows[i].spans[1:]))
    assert rows[0].shared_chars and rows[4].shared_chars == 0 and rows[5].spans == [[0, 300]]


def test_lines(spark):
    line, other = "l" * 50, "o" * 60
    df = spark.createDataFrame([(2, f"x\n{line}\n{other}"), (1, line), (3, f"{line}\n{line}"), (4, None), (5, "")], "doc_id long, text string")
    rows = {x.doc_id: x for x in shared.shared_lines(df).collect()}
    assert rows[1].shared_chars == 0 and rows[2].shared_chars == 50 and [(s.start, s.end) for s in rows[2].spans] == [(2, 52)]
    assert [(s.start, s.end) for s in rows[3].spans] == [(0, 50), (51, 101)] and rows[5].shared_chars == 0 and 4 not in rows


# --- scans

BODY = "the printed page shows the second table before the reviewer checks the measured distances again"


def scan_tables(spark):
    pages = [
        "Form fields Ostba   7\n\nthe printed page shows the sec-\nond table before the reviewer\nchecks thc measured distances\nagain in the half-\nempty box near the end\nand more text here\nuntil the\nend of the\npage is not yet rea-\nOffice copy",
        "Form fields Ostba   8\nched by the reader of text\n12\nremarks 4\nthe second table\nis here\nand there\nbut not\neverywhere at all\nso we go on\nand on\nOffice copy",
        "Forrn fields Ostba   9\nthe last page has the text\nthat ends here\nwith one\ntwo\nthree\nfour lines\nof text\nto be read\nby the reader\nof it.\nOffice copy",
    ]
    docs = spark.createDataFrame([("s", "pdf", "x"), ("s", "pdf", "x"), ("w", "docx", "x"), ("p", "pdf", "x")], "doc_id string, document_type string, gone string")
    rows = [("s", i, 10 + i, "paragraph", t) for i, t in enumerate(pages, 1)]
    rows += [("w", 1, 100 + i, "paragraph", BODY) for i in range(200)] + [("w", 1, 400 + i, "paragraph", "the half-empty box is reached by the reader") for i in range(40)]
    rows += [("p", 1, 900, "paragraph", pages[0]), ("p", 1, 901, "heading", "two on a page"), ("w", 2, 999, "paragraph", None), ("w", 2, 998, "paragraph", "")]
    elements = spark.createDataFrame([(*r, "clash") for r in rows + rows[:1]], "doc_id string, unit_index int, elem_no long, element_type string, text string, zone string")
    return docs, elements


def test_scan_noise(spark):
    docs, elements = scan_tables(spark)
    got = {tuple(r) for r in scans.scan_noise(docs, elements).collect()}
    assert {g for g in got if g[2] == "running_line"} == {(11, 1, "running_line"), (12, 1, "running_line"), (13, 1, "running_line"), (11, 12, "running_line"), (12, 12, "running_line"), (13, 12, "running_line")}
    assert {g for g in got if g[2] == "hyphen_break"} == {(11, 3, "hyphen_break"), (11, 11, "hyphen_break")}
    assert {g for g in got if g[2] == "misread"} == {(11, 5, "misread")}
    pages = {r.elem_no: r.text for r in scans.Scan(docs, elements).repaired().collect()}
    assert pages[11].startswith("the printed page shows the second table before the reviewer checks the measured distances again in the half-empty box") and pages[11].endswith("reached") and pages[12].startswith("by the reader")
    assert scans.scan_noise(docs.limit(0), elements.limit(0)).count() == 0


def test_reflow_around_a_table_rest():
    text = "the reviewer keeps the guar\xad\npeso neto 69\ndada copy\n\nnew para-\ngraph half-\nempty"
    assert scans.reflow(text, [], None, {1: "dada", 5: "graph"}, False, {"copy": "copies"}) == "the reviewer keeps the guardada peso neto 69 copies\n\nnew paragraph half-empty"
    assert scans.reflow("rest of it\nmore wo-", [], {"line_no": 1, "elem_no": 2, "line": "rds here"}, {2: "rds"}, True, {}) == "of it more words"
    assert scans.reflow("", [], None, {}, False, {}) == ""


def test_misread_numbers_come_out_right():
    page = "unit 4O of l9 and 5l\nin I3 lots, Ol0 and 7, copy Il and O"
    assert scans.reflow(page, [], None, {}, False, {"copy": "copies"}) == "unit 40 of 19 and 51 in 13 lots, 010 and 7, copies Il and O"


def test_each_reported_misread_number_is_gone(spark):
    body = "the reviewer measured {} distances in the box\nand then wrote {} pages about the table\nwithout any further remark on it"
    numbers = [("4O", "l9"), ("5l", "I3"), ("2oo", "17")]
    docs = spark.createDataFrame([("s", "pdf")], "doc_id string, document_type string")
    rows = [(10 + k, "s", k + 1, "paragraph", "\n".join([body.format(*n)] * 4)) for k, n in enumerate(numbers)]
    elements = spark.createDataFrame(rows, "elem_no long, doc_id string, unit_index int, element_type string, text string")
    scan = scans.Scan(docs, elements)
    reported = {(r.elem_no, r.line_no) for r in scan.noise().where("noise_kind = 'misread'").collect()}
    texts = {r.elem_no: r.text for r in scan.repaired().collect()}
    assert {e for e, _ in reported} == {10, 11, 12} and len(texts) == 3
    for e, no in reported:
        words = scans._WORD.findall(dict((r[0], r[4]) for r in rows)[e].split("\n")[no - 1])
        odd = [w for w in words if any(c.isdigit() for c in w) and not w.isdigit()]
        assert odd and not set(odd) & set(scans._WORD.findall(texts[e]))


def test_page_numbers_in_all_shapes():
    for line, n in [("[18]", 18), ("· 22 ·", 22), ("- 5 -", 5), ("39", 39), ("Página 36", 36), ("2 / 9", 2), ("4O", 40), ("· 5I ·", 51), ("iii", 3), ("lv", 4)]:
        assert scans.line_kind(line, n)[0] == "page_number", line
    assert scans.line_kind("27   Form fields 6 Ost", 27)[0] == "numbered" and scans.line_kind("remarks 290", 4)[0] is None and scans.line_kind("1057", 3) == (None, None)


def test_glyph_classes():
    for a, b in [("second", "sccond"), ("under", "uncler"), ("limit", "lirnit"), ("kürzt", "kiirzt"), ("table", "tab1e"), ("note", "riote"), ("missing", "missinq"), ("review", "rewew")]:
        assert scans.fold(a) == scans.fold(b)
