"""Very long texts, odd characters, null columns and clashing names: every operator ends with a defined result."""

import pytest

from paperloom.llm import encoding, language, leakage, lookalike, packing, scans, shared, splitting

LONG = ["word and more " * 30_000, "x" * 400_000, "Ãé" * 100_000, "日本語" * 60_000, "\n" * 200_000, "а" * 200_000, "́" * 50_000, "a\x00b퟿￿ " * 1000]


@pytest.fixture(scope="module")
def elements(spark):
    rows = [(i, "d", 1, i, "paragraph", t, None, 1, "x") for i, t in enumerate(LONG, 1)]
    rows += [(None, "d", 1, 1, "paragraph", "null number", None, 1, "x"), (90, None, None, None, None, "null rest", None, None, None), (91, "d", 1, 9, "paragraph", None, None, 1, "x")]
    return spark.createDataFrame(rows, "elem_no long, doc_id string, unit_index int, element_order int, element_type string, text string, data string, look int, record string")


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", "clash", 1) for i, t in enumerate(LONG, 1)] + [(50, LONG[0], None, "c", 2), (None, LONG[0], "en", None, None), (51, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, record string, tokens int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("d", None, "pdf", "pdf", "x"), (None, None, None, None, None)], "doc_id string, properties string, document_type string, extension string, lang string")


def test_splitting(elements):
    rows = splitting.split_elements(elements).collect()
    assert all(len(r.piece) <= 2000 for r in rows) and {r.elem_no for r in rows} == {i for i, t in enumerate(LONG, 1) if len(t) > 2000}


def test_encoding(elements):
    assert {r.elem_no for r in encoding.damaged_elements(elements).collect()} <= set(range(1, 9))


def test_lookalike(elements):
    assert lookalike.same_look_pairs(elements).count() == 0
    assert lookalike.canonical(elements).count() == elements.count()


def test_language(docs, elements, documents):
    rows = language.language_found(docs, elements, documents).collect()
    assert len(rows) >= 1 and all(r.doc_id == "d" for r in rows)


def test_leakage(spark, documents):
    items = spark.createDataFrame([(1, "word and more " * 10, None), (2, None, None), (None, "word and more " * 10, None), (1, "word and more " * 10, None)], "item_id long, text string, distance int")
    assert {tuple(r) for r in leakage.leaked_pairs(documents, items).collect()} >= {(1, 1), (50, 1)}


def test_shared(documents):
    assert (1, 50) in {tuple(r) for r in shared.shared_pairs(documents).collect()}
    assert shared.shared_lines(documents).count() == len(LONG) + 1


def test_packing(documents):
    rows = packing.pack(packing.sizes(documents), 8192).collect()
    fill: dict = {}
    for r in rows:
        fill[r.bin_no] = fill.get(r.bin_no, 0) + r.size
    assert max(fill.values()) <= 8192 and {r.doc_id for r in rows} == {*range(1, len(LONG) + 1), 50}


def test_scans(docs, elements):
    assert scans.scan_noise(docs, elements).count() >= 0
