"""Splitting, encoding repair, look-alikes and languages."""

import itertools
import random
import unicodedata

import pytest

from paperloom.llm import encoding, language, lookalike, splitting, tokens


def elements(spark, texts, kind="paragraph", doc="d"):
    rows = [(i, doc, 1, i, kind, t, "clash") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "elem_no long, doc_id string, unit_index int, element_order int, element_type string, text string, piece string")


# --- splitting


@pytest.mark.parametrize("text", ["word " * 900, "x" * 7001, "A sentence here. " * 300, "para one line\n\n" * 400, "é" + "́" * 5000, " " * 4500, "\n" * 4500, "a" * 2001])
@pytest.mark.parametrize(("limit", "overlap"), [(2000, 200), (50, 10), (7, 0)])
def test_pieces_cover_and_fit(text, limit, overlap):
    got = splitting.pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (s, e, _), nxt in itertools.zip_longest(got, got[1:]):
        assert 0 < e - s <= limit
        if nxt:
            assert s < nxt[0] <= e and e < nxt[1]


def test_cuts_at_the_strongest_boundary():
    text = "a" * 30 + ". " + "b" * 30 + "\n\n" + "c" * 60
    (s, e, kind), *_ = splitting.pieces(text, 80, 5)
    assert kind == "paragraph" and text[s:e].endswith("\n\n")
    assert splitting.pieces("x" * 100, 60, 10)[0][2] == "hard"


def test_tokens_as_units():
    text = "The quick brown fox jumps over the lazy dog. " * 40
    starts = [i for i in range(0, len(text), 3)]
    for s, e, _ in splitting.pieces(text, 50, 10, starts):
        assert sum(s <= x < e for x in starts) <= 51


def test_split_elements(spark):
    texts = [None, "", "short", "w " * 1000, "w " * 1001, "x" * 2000, "x" * 2001]
    df = elements(spark, texts)
    df = df.unionByName(df)
    assert sorted(r.elem_no for r in splitting.split_found(df).collect()) == [5, 7]
    rows = splitting.split_elements(df).collect()
    assert len(rows) == len({(r.elem_no, r.piece_no) for r in rows}) and all(len(r.piece) <= 2000 for r in rows)
    assert splitting.split_found(df.limit(0)).count() == 0


def test_characters_of_several_tokens(spark):
    text = "\U00020000\U0001f9ff\u0f40" * 500
    starts = tokens.starts(text)
    assert len(starts) > 4000 and len(text) == 1500
    df = elements(spark, [text, "short"]).withColumnRenamed("doc_id", "piece")
    rows = splitting.long_pieces(df, ["elem_no"], "text", 2000, 200, tokens.DEFAULT).orderBy("piece_no").collect()
    assert len(rows) >= 3 and all(sum(r.start <= x < r.end for x in starts) <= 2000 for r in rows)
    assert rows[0].start == 0 and rows[-1].end == 1500 and all(a.end >= b.start for a, b in zip(rows, rows[1:], strict=False))


# --- encoding

SAMPLES = ["Die Prüfung erhält größere Maße für 5 €", "L’été déjà passé à l’hôtel", "mañana según la última versión", "não há informação", "порядок чтения страницы", "ترتيب القراءة في الصفحة"]


def wrong(text, written, seen):
    raw = text.encode(written)
    return "".join(encoding.char_table(seen)[b] for b in raw)


@pytest.mark.parametrize("text", SAMPLES)
@pytest.mark.parametrize("seen", ["cp1252", "latin-1", "cp1250", "cp1251", "cp1256", "mac_roman", "cp437"])
def test_utf8_read_wrongly_comes_back(text, seen):
    broken = wrong(text, "utf-8", seen)
    restored, damaged, _ = encoding.repair_text(broken)
    assert damaged and restored == text


def test_twice_and_in_a_stretch():
    text = SAMPLES[0]
    assert encoding.repair_text(wrong(wrong(text, "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == text
    mixed = SAMPLES[1] + " " + wrong(text, "utf-8", "cp1252") + " " + SAMPLES[2]
    assert encoding.repair_text(mixed)[:2] == (f"{SAMPLES[1]} {text} {SAMPLES[2]}", True)


@pytest.mark.parametrize(("text", "written", "seen"), [(SAMPLES[4], "cp1251", "cp1252"), (SAMPLES[4], "koi8_r", "cp1251"), (SAMPLES[5], "cp1256", "cp1252"), ("größere Prüfung", "cp1252", "cp437")])
def test_single_byte_tables(text, written, seen):
    restored, damaged, _ = encoding.repair_text(wrong(text, written, seen))
    assert damaged and restored == text


@pytest.mark.parametrize("text", [*SAMPLES, "REVISÃO NÃO", "РАЗМЕТКА СТРАНИЦ 5", "раssword", "12 m² № 5 ½ ①", "plain ascii", "Ｆｕｌｌ ﬁne", "co­op​erate"])
def test_sound_text_is_left(text):
    assert encoding.repair_text(text) == (text, False, "")


def test_long_tokens_in_blocks():
    for cut in range(4):
        text = "x" * cut + "größere«Prüfung»" * 200
        assert encoding.repair_text(wrong(text, "utf-8", "cp1252")) == (text, True, "cp1252>utf-8")
    assert encoding.repair_text("Привет" * 500)[1] is False


def test_damaged_elements(spark):
    df = elements(spark, [None, "", "fine", wrong(SAMPLES[0], "utf-8", "cp1252"), "lost � here", wrong(SAMPLES[4], "utf-8", "cp1251") * 500])
    rows = {r.elem_no: r for r in encoding.damaged_elements(df.unionByName(df)).collect()}
    assert sorted(rows) == [4, 5, 6] and rows[4].restored == SAMPLES[0] and rows[5].restored == "lost � here"
    kept = encoding.repair(df.withColumnRenamed("piece", "restored"))
    assert kept.count() == 6 and kept.columns.count("restored") == 1


# --- look-alikes

SAME = [("file name", "ﬁle name"), ("password", "раssword"), ("cross-check", "cross‑check"), ("Full", "Ｆｕｌｌ"), ("é", "é"), ("thread", "th​re⁠ad"), ("проверяет", "проверяeт"), ("لا", "ﻻ"), ("visible", "νisible"), ("\u212b", "\u00c5"), ("\u2126", "\u03a9"), ("\u1112\u1161\u11ab", "\ud55c"), ("\u0958", "\u0915\u093c"), ("q\u0307\u0323", "q\u0323\u0307")]
OTHER = [("m2", "m²"), ("1", "①"), ("1/2", "½"), ("No", "№"), ("a b", "a  b"), ("Case", "case"), ("end.", "end"), ("co-op", "coop"), ("–", "-")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert a != b and lookalike.canonical_text(a) == lookalike.canonical_text(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert lookalike.canonical_text(a) != lookalike.canonical_text(b)


def test_canonical_is_stable():
    r = random.Random(5)
    chars = "aеοcКΚ  ​́éﬁ-‑日أﻻ😀"
    for _ in range(500):
        t = "".join(r.choice(chars) for _ in range(r.randrange(12)))
        once = lookalike.canonical_text(t)
        assert lookalike.canonical_text(once) == once


def test_segments_give_the_normal_form_of_any_text():
    every = [chr(o) for o in range(0x110000) if not 0xD800 <= o < 0xE000]
    assert all(lookalike.composed(c) == unicodedata.normalize("NFC", c) for c in every)
    r = random.Random(8)
    odd = [c for c in every if unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or not unicodedata.is_normalized("NFD", c)]
    odd += [chr(o) for lo, hi in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3), (0xAC00, 0xAC20)) for o in range(lo, hi)]
    for _ in range(20_000):
        t = "".join(r.choice(odd) if r.random() < 0.7 else r.choice("aeo \n") for _ in range(r.randrange(1, 9)))
        assert lookalike.composed(t) == unicodedata.normalize("NFC", t)
        forms = {lookalike.canonical_text(unicodedata.normalize(f, t)) for f in ("NFC", "NFD")}
        assert len(forms) == 1


def test_many_elements_of_one_text(spark):
    df = elements(spark, ["password"] * 3000 + ["p\u0430ssword"])
    assert lookalike.same_look_pairs(df).count() == 3000


def test_pairs_against_brute_force(spark):
    r = random.Random(2)
    base = [x for p in SAME + OTHER for x in p] + ["", None, wrong(SAMPLES[0], "utf-8", "cp1252")]
    texts = [r.choice(base) for _ in range(150)]
    df = elements(spark, texts)
    got = {tuple(x) for x in lookalike.same_look_pairs(df.unionByName(df)).collect()}
    want = {
        (i, j)
        for (i, a), (j, b) in itertools.combinations(enumerate(texts, 1), 2)
        if a is not None and b is not None and a != b and lookalike.canonical_text(a) == lookalike.canonical_text(b) and not encoding.repair_text(a)[1] and not encoding.repair_text(b)[1]
    }
    assert got == want and want
    assert lookalike.same_look_pairs(df.limit(0)).count() == 0


def test_pairs_stay_in_their_document(spark):
    a, b = elements(spark, ["password"], doc="x"), elements(spark, ["", "раssword"], doc="y")
    assert lookalike.same_look_pairs(a.unionByName(b)).count() == 0


# --- languages

TRAIN = {
    "en": "the reviewer checks the printed page and the table is not complete for this order",
    "de": "der Prüfer prüft die gedruckte Seite und die Tabelle ist nicht vollständig für diesen Auftrag",
    "fr": "le relecteur vérifie la page imprimée et le tableau n’est pas complet pour cette commande",
    "es": "el revisor comprueba la página impresa y la tabla no está completa para este pedido",
    "pt": "o revisor verifica a página impressa e a tabela não está completa para este pedido",
    "ar": "المراجع يفحص الصفحة المطبوعة والجدول غير مكتمل لهذا الطلب",
    "ru": "рецензент проверяет печатную страницу и таблица не полна для этого заказа",
}


def corpus(spark):
    rows = [(i * 10 + k, t, lang) for i, (lang, t) in enumerate(TRAIN.items()) for k in range(5)] + [(900, None, "en"), (901, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spark):
    def props(label):
        return None if label is None else f'{{"word": {{"core_properties": {{"language": "{label}"}}}}}}'

    docs = [("a", props("en-US")), ("b", props("fr")), ("c", props("und")), ("d", None), ("e", props("English")), ("f", "not json"), ("g", props("pt_BR")), ("empty", props("en"))]
    d = spark.createDataFrame([(x, p, "docx", "docx", "clash") for x, p in docs], "doc_id string, properties string, document_type string, extension string, lang string")
    en, de = TRAIN["en"], TRAIN["de"]
    texts = {"a": [en] * 4 + [f"{en}\n{de}\nnur drei Wörter", wrong(TRAIN["ru"], "utf-8", "cp1251")], "b": [en] * 3, "c": [de], "d": [TRAIN["ar"]], "e": [en], "f": [TRAIN["ru"]], "g": [TRAIN["pt"]], "empty": [None, "", "123"]}
    rows = [(100 * i + k, x, "paragraph", t, 1) for i, (x, ts) in enumerate(texts.items()) for k, t in enumerate(ts)]
    e = spark.createDataFrame(rows, "elem_no long, doc_id string, element_type string, text string, confidence int")
    got = {tuple(r) for r in language.language_found(d.unionByName(d), e.unionByName(e), corpus(spark)).collect()}
    assert got == {("b", 0, 0, "en"), ("c", 0, 0, "de"), ("d", 0, 0, "ar"), ("f", 0, 0, "ru"), ("a", 4, 2, "de"), ("a", 5, 1, "ru")}
    per_doc, _ = language.detect(d, e, corpus(spark))
    assert all(0.5 < r.confidence <= 1 for r in per_doc.collect())
    assert language.language_found(d.limit(0), e.limit(0), corpus(spark)).count() == 0


def test_each_source_can_decide(spark):
    def said(label):
        return None if label is None else f'{{"word": {{"core_properties": {{"language": "{label}"}}}}}}'

    sure = [(f"s{i}", *(("en", "docx", "en") if i % 2 else ("de", "docx", "de"))) for i in range(60)] + [(f"p{i}", "es", "pdf", "es") for i in range(60)]
    docs = [(d, said(label), kind, kind) for d, label, kind, _ in sure]
    found = [(d, 1, lang, 1000, 300.0, []) for d, _, _, lang in sure]
    cases = [("label", "de", "docx", [("en", 10), ("de", 9)], 2.0, "de"), ("text", "de", "docx", [("ru", 900), ("de", 100)], 400.0, "ru"), ("prior", None, "pdf", [("fr", 10), ("es", 10)], 1.0, "es"), ("close", None, "pdf", [("fr", 30), ("es", 10)], 60.0, "fr")]
    for d, label, kind, shares, nats, _ in cases:
        docs.append((d, said(label), kind, kind))
        found += [(d, 1, lang, chars, nats / len(shares), []) for lang, chars in shares]
    f = spark.createDataFrame(found, "doc_id string, elem_no long, lang string, chars long, nats double, lines array<struct<line_no:int,confidence:float>>")
    got = {r.doc_id: r for r in language.fuse(f, spark.createDataFrame(docs, "doc_id string, properties string, document_type string, extension string")).collect()}
    assert {c[0]: got[c[0]].lang for c in cases} == {c[0]: c[-1] for c in cases}
    assert got["text"].confidence > 0.99 and 0.3 < got["label"].confidence < got["text"].confidence and got["s1"].confidence > 0.99


def test_languages_with_confidence(spark):
    d = spark.createDataFrame([("a", None, "docx", "docx")], "doc_id string, properties string, document_type string, extension string")
    e = spark.createDataFrame([(1, "a", "paragraph", "\n".join([TRAIN["en"]] * 3 + [TRAIN["de"]]))], "elem_no long, doc_id string, element_type string, text string")
    rows = {(r.elem_no, r.line_no): r for r in language.languages(d, e, corpus(spark)).collect()}
    assert {k: r.lang for k, r in rows.items()} == {(0, 0): "en", (1, 4): "de"} and all(r.confidence > 0.9 for r in rows.values())


def test_memory_of_unknown_words_starts_anew():
    scorer = language.Scorer(language.fit([(k, v) for k, v in TRAIN.items() for _ in range(3)]))
    for k in range(4):
        scorer.forget(100)
        texts = [" ".join(f"w{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)), TRAIN["de"]]
        scores = scorer.score(texts)[4]
        assert language.LANGS[scores[1].argmax()] == "de" and len(scorer.rows) <= scorer.known + 301


def test_model_on_held_out_sentences():
    model = language.fit([(k, v) for k, v in TRAIN.items() for _ in range(3)])
    held = {"en": "this page is not for the reviewer", "de": "die Tabelle für den Prüfer ist nicht gedruckt", "fr": "la commande n’est pas vérifiée pour le tableau", "es": "la tabla impresa no es para el revisor", "pt": "a tabela não é para o revisor da página", "ru": "страница не для этого рецензента", "ar": "هذا الجدول غير مكتمل في الصفحة"}
    scores = language.Scorer(model).score(list(held.values()))[4]
    assert [language.LANGS[i] for i in scores.argmax(axis=1)] == list(held)
