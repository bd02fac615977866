"""Column functions, provenance, validation and rendering on small tables."""

import datetime as dt
import enum
import pathlib

from pyspark.sql import functions as F

from paperloom import schema
from paperloom.functions import text
from paperloom.operators import extract, manifest, provenance, render, validate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names_and_escapes(spark):
    assert one(spark, text.md_escape(F.lit("a\\b|c\nd"))) == "a\\\\b\\|c<br>d" and one(spark, text.md_escape(F.lit(None).cast("string"))) == ""
    for name, safe in [("a/b c?.png", "b_c_.png"), ("..", "asset.bin"), ("", "asset.bin"), ("äö.txt", "txt"), ("x\\y.bin", "y.bin")]:
        assert one(spark, text.safe_name(F.lit(name))) == safe, name
    assert [one(spark, text.extension(F.lit(x))) for x in ("A.PDF", ".hidden", "none", "a.tar.gz")] == ["pdf", "", "", "gz"]
    assert [one(spark, text.stem(F.lit(x))) for x in ("/d/a.b.PDF", ".hidden", "none")] == ["a.b", ".hidden", "none"]
    assert [one(spark, text.unsafe_path(F.lit(x))) for x in ("/a", "a/../b", "a/b..c", "..")] == [True, True, False, True]
    for s in ("a\nb", "a\r\nb\n", "", "\n", "a\x85b c", "a\n\n"):
        assert one(spark, text.split_lines(F.lit(s))) == s.splitlines()


def test_json_safe():
    class Kind(enum.Enum):
        A = "a"

    v = {1: [Kind.A, (dt.date(2024, 1, 2), dt.timedelta(1))], "b": b"xyz", "p": pathlib.PurePosixPath("/a"), "n": None, "t": True}
    assert extract.json_safe(v) == {"1": ["a", ["2024-01-02", "1 day, 0:00:00"]], "b": {"__bytes__": True, "length": 3}, "p": "/a", "n": None, "t": True}


def tables(spark, elements=(), units=(), assets=(), documents=(("d", "1.1", "f.docx", "docx", "docx", None, 1, "h", "x", None, "{}"),)):
    return [spark.createDataFrame(list(rows), s) for rows, s in ((documents, schema.DOCUMENTS), (units, schema.UNITS), (elements, schema.ELEMENTS), (assets, schema.ASSETS))]


def element(eid="e", unit=1, order=1, kind="paragraph", body="t", data="{}", source=None):
    return ("d", unit, eid, kind, order, body, None, data, source, None)


def test_every_rule(spark):
    src = (9, None, None, None, None, None, None, None, None, None)
    docs, units, elements, assets = tables(
        spark,
        [element("a", order=1), element("a", order=1), element("", order=2), element(None, order=3), element("far", order=4, source=src), element("other", unit=2, order=1)],
        [("d", 1, "page", None, "{}"), ("d", 1, "page", None, "{}"), ("d", 0, "page", None, "{}"), ("d", 2, "page", None, "{}")],
        [("d", "x", "t", None, "ok/a", None, None, None, None, "{}"), ("d", "x", "t", None, "/abs", None, None, None, None, "{}"), ("d", "y", "t", None, None, None, None, None, None, "{}")],
        [("d", " ", "f", "docx", "docx", None, 1, "h", "x", None, "{}"), ("e", None, "f", "docx", "docx", None, 1, "h", "x", None, "{}")],
    )
    got = sorted((r.rule, r.detail) for r in validate.violations(docs, units, elements, assets).collect())
    assert got == [("V1", "f"), ("V2", "1"), ("V3", "0"), ("V4", "2"), ("V4", "3"), ("V5", "a"), ("V6", "far"), ("V7", "1:1"), ("V8", "/abs"), ("V8", "x")]


def test_source_null_is_not_source_of_nulls(spark):
    blank = (None,) * 10
    _, units, elements, _ = tables(spark, [element("a"), element("b", order=2, source=blank), element("c", unit=7)], [("d", 1, "slide", "S", "{}")])
    got = {r.element_id: r.source for r in provenance.fill_source(elements, units).collect()}
    assert got["a"].slide_number == 1 and got["a"].unit_name == "S" and got["b"].unit_index is None and got["c"] is None


def test_last_asset_of_one_hash_wins(spark):
    rows = [("d", f"docx-asset-{i}", "t", None, None, None, h, None, None, "{}") for i, h in ((1, "h"), (2, "h"), (10, "h"), (3, None))]
    _, _, _, assets = tables(spark, assets=rows)
    images = spark.createDataFrame([("d", "h", 1), ("d", "none", 2), ("d", None, 3)], "doc_id string, sha256 string, k int")
    assert {r.k: r.asset_id for r in provenance.match_images(images, assets).collect()} == {1: "docx-asset-10", 2: None, 3: None}


def test_markdown_of_each_kind(spark):
    cases = [
        ("heading", "", "{}", "### [Heading]"), ("list", "", "{}", None), ("note", None, "{}", None), ("code", "", "{}", None), ("table", "t", '{"table": {"grid": [[true, null, 1]], "rows": [["no"]]}}', "| True |  | 1 |\n|---|---|---|"), ("heading", "H", "{}", "### H"), ("list", "a\nb\n", "{}", "- a\n- b"), ("table", "x | y", "{}", "x | y"),
        ("table", "x", '{"table": {"rows": [[{"text": "a|b"}], [{"text": "c"}, {"text": "d"}]]}}', "| a\\|b |  |\n|---|---|\n| c | d |"), ("note", "a\nb", "{}", "> **Note:** a b"),
        ("image", "alt", '{"image": {"filename": "p.png"}}', "[Image: p.png]"), ("image", None, "{}", "[Image: k11]"), ("link", "say", '{"uri": "http://x"}', "[say](http://x)"), ("link", "say", '{"destination": "p"}', None),
        ("code", "c", "{}", "```text\nc\n```"), ("other", "o", "{}", "o"), ("metadata", "m", "{}", None), ("paragraph", None, None, None), ("cell", "v", "{}", "v"),
    ]
    _, _, elements, _ = tables(spark, [element(f"k{i - 1}", order=i, kind=k, body=t, data=d) for i, (k, t, d, _) in enumerate(cases, 1)])
    got = {r.element_order: r.m for r in elements.select("element_order", render.element_markdown().alias("m")).collect()}
    assert [got[i] for i in range(1, len(cases) + 1)] == [c[3] for c in cases]


def test_documents_without_anything(spark):
    docs, units, elements, assets = tables(spark)
    warnings, unsupported = spark.createDataFrame([], schema.WARNINGS), spark.createDataFrame([], schema.UNSUPPORTED)
    assert render.markdown(docs, units, elements, assets, warnings, unsupported).first().markdown.startswith("# f.docx")
    assert '"units":[]' in render.json_document(docs, units, elements, assets, warnings, unsupported).first().json
    row = manifest.summary(docs, units, elements, assets, warnings, unsupported).first()
    assert (row.units, row.elements, row.assets, row.assets_failed) == (0, 0, 0, 0)


def test_written_assets_are_counted(spark):
    docs, units, elements, assets = tables(spark, assets=[("d", "a", "vba_project", None, "x", None, None, None, None, "{}"), ("d", "b", "embedded_media", None, "y", None, None, None, None, "{}")])
    written = spark.createDataFrame([("d", "x")], "doc_id string, path string")
    row = manifest.summary(docs, units, elements, assets, spark.createDataFrame([], schema.WARNINGS), None, written).first()
    assert (row.assets, row.active_assets, row.assets_written, row.assets_failed) == (2, 1, 1, 1)
