import json
import os

import pytest
from pyspark.sql import functions as F

from paperloom.operators import extract
from paperloom.operators.validate import InvalidDocuments, violations
from paperloom.options import Options
from paperloom.plans.pipeline import corpus
from paperloom.sources import files, pdf, sheet, sinks, slide, word
from paperloom.sources.office import Unreadable, declares_type
from tests import fixtures as fx


def texts(built, kind=None):
    return [e["text"] for e in built.elements if kind is None or e["element_type"] == kind]


def test_workbook():
    b = sheet.extract(fx.workbook())
    assert [u["name"] for u in b.units] == ["مبيعات", "Hidden"]
    cells = {e["source"]["cell"]: e for e in b.elements if e["element_type"] == "cell"}
    assert cells["C2"]["data"]["formula"] == "=B2*10" and cells["C2"]["data"]["cached_value"] == 20 and cells["C2"]["text"] == "=B2*10"
    assert cells["A2"]["data"]["comment"] == {"text": "look here", "author": "Reviewer", "width": 144, "height": 79} and cells["A2"]["data"]["hyperlink"] == {"target": "https://example.org/x", "location": None, "display": None, "tooltip": None}
    assert "B4" not in cells and cells["A4"]["text"] == "merged"
    assert cells["A5"]["data"]["is_date"] and cells["A5"]["text"].startswith("2024-01-01") and cells["A5"]["data"]["row_hidden"]
    assert b.units[0]["metadata"]["hidden_columns"] == ["D"] and b.units[1]["metadata"]["state"] == "hidden"
    assert b.elements[0]["element_order"] == 0 and b.elements[0]["element_type"] == "metadata"
    assert any(u["object_type"] == "xlsx_image" and u["metadata"]["asset_id"] == "xlsx-asset-1" for u in b.unsupported)
    assert [e["text"] for e in b.elements if e["element_type"] == "table"] == ["SalesTable"]


def test_workbook_reports_parts():
    b = sheet.extract(fx.workbook({"xl/pivotTables/p1.xml": "<a/>", "xl/connections.xml": "<a/>", "customXml/i.xml": "<a/>", "xl/vbaProject.bin": b"x"}))
    assert {"xlsx_pivot_table", "xlsx_data_connections", "vba_project"} <= {u["object_type"] for u in b.unsupported}
    assert [a["asset_type"] for a in b.assets][-1] == "vba_project"


def test_word():
    b = word.extract(fx.word())
    assert b.units[0]["kind"] == "document"
    assert texts(b, "heading") == ["A heading"] and "مرحبا" in texts(b, "paragraph") and texts(b, "list") == ["item"]
    table = next(e for e in b.elements if e["element_type"] == "table")
    assert table["text"] == "a1 | b1\na2 | b2" and table["data"]["row_count"] == 2
    assert table["data"]["rows"][0][0]["content"][1]["table"]["nested_depth"] == 1
    roles = {e["data"].get("role"): e["text"] for e in b.elements}
    assert roles["header"] == "the header" and roles["footer"] == "the footer" and roles["comment"] == "a comment" and roles["footnote"] == "real note"
    changes = [e["data"]["change_type"] for e in b.elements if e["data"].get("role") == "tracked_change"]
    assert changes == ["insertion", "deletion"] and roles["content_control"] == "" and roles["office_math"] == "x=1"
    assert [e["text"] for e in b.elements if e["data"].get("role") == "field_instruction"] == ["PAGE"]
    image = next(c for e in b.elements for r in e["data"].get("runs", []) for c in r["content"] if c["type"] == "image")
    assert image["asset_id"] == "docx-asset-1" and (image["width_px"], image["height_px"]) == (64, 32)
    assert b.assets[0]["media_type"] == "image/png" and all(e["source"]["unit_index"] == 1 for e in b.elements)
    assert next(e for e in b.elements)["data"]["runs"][0]["bold"] is True and next(e for e in b.elements)["data"]["runs"][0]["italic"] is None


def test_word_last_asset_of_equal_bytes_wins():
    b = word.extract(fx.word({"word/media/image2.png": fx.png()}))
    image = next(c for e in b.elements for r in e["data"].get("runs", []) for c in r["content"] if c["type"] == "image")
    assert image["asset_id"] == "docx-asset-2"


def test_doctype_is_refused():
    doc = "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>"
    for raw in (doc, f"<!--{'-=' * 5000}--> {doc}", ("<?xml version='1.0' encoding='utf-16'?>" + doc).encode("utf-16"), b"\xef\xbb\xbf" + doc.encode()):
        with pytest.raises(Unreadable, match="document type"):
            word.extract(fx.word({"word/document.xml": raw}))
    assert not declares_type(b"<a><![CDATA[<!DOCTYPE b>]]></a>")


def test_slides():
    b = slide.extract(fx.slides())
    assert [u["metadata"]["hidden"] for u in b.units] == [False, True]
    first = [e for e in b.elements if e["unit_index"] == 1]
    assert first[0]["element_type"] == "heading" and first[0]["text"] == "The title"
    assert first[2]["text"] == "1a | 1b\n2a | 2b" and first[3]["data"]["chart"]["series"] == [{"name": "Sales", "values": [10.0, 20.0]}]
    assert first[3]["data"]["chart"]["categories"] == ["Q1", "Q2"] and first[4]["data"]["image"]["asset_id"].startswith("pptx-asset")
    grouped = next(e for e in first if e["text"] == "grouped")
    assert grouped["parent_element_id"] == "slide-1-shape-8-6" and first[-1]["element_type"] == "note" and first[-1]["text"] == "speak slowly"
    assert len({e["element_id"] for e in b.elements}) == len(b.elements)


def test_pdf():
    b = pdf.extract(fx.pdf())
    assert [u["kind"] for u in b.units] == ["page", "page"]
    assert texts(b, "paragraph")[0] == "First page text of the file\nline two"
    links = [e["data"] for e in b.elements if e["element_type"] == "link"]
    assert links[0]["uri"] == "https://example.org" and links[1]["uri"] is None and links[1]["destination"]
    assert b.properties["pdf"]["page_count"] == 2 and b.properties["pdf"]["metadata"]["/Title"] == "A title"
    assert b.properties["pdf"]["outline"] == [{"title": "Chapter", "level": 1, "page_number": 2}]
    assert b.properties["pdf"]["form_fields"]["field"]["value"] == "val" and [a["asset_type"] for a in b.assets] == ["pdf_image", "pdf_image"]


def test_pdf_depth_has_no_limit():
    n, raw = 30, fx.pdf(attachment=b"deep")
    chain = "".join(f"{100 + i} 0 obj\n<< /T (f{i}) /Kids [{101 + i} 0 R] >>\nendobj\n" for i in range(n)) + f"{100 + n} 0 obj\n<< /T (leaf) /FT /Tx /V {'[' * 12}(deep){']' * 12} >>\nendobj\n"
    names = "".join(f"{200 + i} 0 obj\n<< /Kids [{201 + i} 0 R] >>\nendobj\n" for i in range(n)) + f"{200 + n} 0 obj\n<< /Names [(payload.txt) 8 0 R] /Kids [200 0 R] >>\nendobj\n"
    raw = raw.replace(b"/Fields [30 0 R]", b"/Fields [30 0 R 100 0 R]").replace(b"/EmbeddedFiles << /Names [(payload.txt) 8 0 R] >>", b"/EmbeddedFiles 200 0 R").replace(b"trailer", (chain + names).encode() + b"trailer")
    b = pdf.extract(raw)
    value = b.properties["pdf"]["form_fields"][".".join(f"f{i}" for i in range(n)) + ".leaf"]["value"]
    for _ in range(12):
        (value,) = value
    assert value == "deep" and [a["original_name"] for a in b.assets if a["asset_type"] == "pdf_attachment"] == ["payload.txt"]


def test_pdf_samples_become_pictures():
    (first, *_) = pdf.payloads(fx.pdf()).items()
    assert first[0].endswith("Im1.png") and first[1].startswith(b"\x89PNG")
    assert pdf.as_png(b"x", 2, 2, "DeviceGray", 8) is None and pdf.as_png(b"abcd", 2, 2, "DeviceCMYK", 8) is None


def test_pdf_fonts():
    raw = fx.pdf(pages=("caf\\351 \\200 \\001",)).replace(b"/BaseFont /Helvetica", b"/BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /ntilde] >>")
    assert texts(pdf.extract(raw), "paragraph")[0].startswith("café € ñ")
    assert [pdf.glyph(x) for x in ("A", "eacute", "uni0416", "seven", "germandbls", "nosuch")] == ["A", "é", "Ж", "7", "ß", None]


def test_pdf_object_streams():
    import re
    import zlib

    raw = fx.pdf()
    moved = {int(m.group(1)): m.group(2) for m in re.finditer(rb"(?m)^(5|6|7|30) 0 obj\n(.*)\nendobj\n", raw)}
    for n, body in moved.items():
        raw = raw.replace(b"%d 0 obj\n" % n + body + b"\nendobj\n", b"")
    heads, bodies = "", b""
    for n, body in moved.items():
        heads += f"{n} {len(bodies)} "
        bodies += body + b" "
    packed = zlib.compress(heads.encode() + bodies)
    extra = b"50 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(moved), len(heads), len(packed)) + packed + b"\nendstream\nendobj\n"
    b = pdf.extract(raw.replace(b"trailer", extra + b"trailer"))
    assert b.properties["pdf"]["outline"][0]["title"] == "Chapter" and b.properties["pdf"]["form_fields"]["field"]["value"] == "val"


def test_pdf_without_text_is_reported():
    b = pdf.extract(fx.pdf(pages=("",)).replace(b"line two", b""))
    assert any(w["code"] in ("pdf.possible_scanned_document", "pdf.docling.unavailable") for w in b.warnings)


def test_encrypted_pdf():
    raw = fx.pdf(password="secret")
    with pytest.raises(Unreadable):
        pdf.extract(raw)
    assert "First page text" in texts(pdf.extract(raw, "secret"), "paragraph")[0]


def test_aes():
    plain, key = bytes.fromhex("00112233445566778899aabbccddeeff"), bytes(range(32))
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        made = pdf.aes_cbc_encrypt(key[:size], bytes(16), plain)
        assert made.hex() == want and pdf.aes_cbc(key[:size], bytes(16) + made, padded=False) == plain


@pytest.mark.parametrize("revision", [5, 6])
def test_pdf_with_a_long_key(revision):
    key, salts = bytes(range(32)), (b"validate", b"key salt")

    def entry(password, more=b""):
        head = pdf.password_hash(revision, password, salts[0], more) + b"".join(salts)
        return head, pdf.aes_cbc_encrypt(pdf.password_hash(revision, password, salts[1], more), bytes(16), key)

    u, ue = entry("użer".encode())
    o, oe = entry(b"owner", u)
    raw = fx.pdf()

    def sealed(m):
        data = m.group(3)
        n = 16 - len(data) % 16
        data = b"v" * 16 + pdf.aes_cbc_encrypt(key, b"v" * 16, data + bytes([n]) * n)
        return m.group(1) + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream"

    import re

    raw = re.sub(rb"(<<[^\n]*?)/Length (\d+) >>\nstream\n(.*?)\nendstream", sealed, raw, flags=re.S)
    enc = f"40 0 obj\n<< /Filter /Standard /V 5 /R {revision} /U <{u.hex()}> /UE <{ue.hex()}> /O <{o.hex()}> /OE <{oe.hex()}> /P -4 >>\nendobj\n".encode()
    raw = raw.replace(b"trailer <<", enc + b"trailer << /Encrypt 40 0 R")
    for password in ("użer", "owner"):
        assert texts(pdf.extract(raw, password), "paragraph")[0].startswith("First page text")
    with pytest.raises(Unreadable):
        pdf.extract(raw, "wrong")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    made = {
        "same.xlsx": fx.workbook(), "same.docx": fx.word(), "deck.pptx": fx.slides(), "paper.pdf": fx.pdf(attachment=b"hello payload"), "bad.pdf": b"%PDF-1.4\n", "macro.xlsx": fx.workbook({"xl/vbaProject.bin": b"x"}),
        "locked.docx": bytes.fromhex(files.OLE) + b"x" * 64, "old.doc": bytes.fromhex(files.OLE) + b"x" * 64, "note.txt": b"no", "text.pdf": b"just text",
    }
    for n, raw in made.items():
        (d / n).write_bytes(raw)
    (d / "wrong.bin").write_bytes(fx.workbook())
    return d


def test_detection_by_content(spark, tree):
    rows = files.detect(spark.read.format("binaryFile").load(str(tree)))
    kinds = {os.path.basename(r.path): r for r in rows.select("path", "detected.*").collect()}
    assert kinds["wrong.bin"].document_type == "xlsx" and kinds["macro.xlsx"].document_type == "xlsm" and kinds["macro.xlsx"].is_macro_enabled
    assert kinds["locked.docx"].document_type == "encrypted_office" and kinds["old.doc"].document_type == "doc"
    assert kinds["text.pdf"].document_type == "pdf" and kinds["note.txt"].document_type == "txt" and kinds["paper.pdf"].media_type == "application/pdf"


def test_only_files_are_read_as_one(spark, tree):
    for path in (tree, tree / "none.pdf"):
        with pytest.raises(files.InvalidInput):
            files.read_file(spark, str(path))


def test_limits(spark, tree):
    one = files.read_file(spark, str(tree / "same.xlsx"))
    for options in (Options(max_file_size=1), Options(max_expanded=1), Options(max_members=1)):
        good, bad = files.guard(files.detect(one, options), options)
        assert good.count() == 0 and bad.first().error_type == "InvalidInputFileError"


def test_large_files_are_never_read(spark, tree):
    fits, large = files.by_size(files.scan(spark, str(tree)), Options(max_file_size=500))
    assert "LessThanOrEqual(length,500)" in fits._jdf.queryExecution().toString()
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1] and large.count() == 5
    c = corpus(files.scan(spark, str(tree)), Options(max_file_size=500))
    assert c.rejects.where("error_type = 'InvalidInputFileError'").count() == 5


def test_batch(spark, tree, tmp_path):
    c = corpus(files.scan(spark, str(tree)), store=str(tmp_path / "rows"))
    batch = {os.path.basename(r.source): r for r in c.batch().collect()}
    assert batch["bad.pdf"].status == "error" and batch["locked.docx"].error_type == "UnsupportedFileTypeError" and batch["old.doc"].error_type == "ExternalToolError"
    assert {n for n, r in batch.items() if r.status == "ok"} == {"same.xlsx", "same.docx", "deck.pptx", "paper.pdf", "macro.xlsx"}
    assert c.violations().count() == 0
    assert c.elements.where("source is null").count() == 0
    written = sinks.write_packages(c, str(tmp_path / "out"), root=str(tree)).collect()
    assert {r.path for r in written} >= {"document.json", "document.md", "assets/media/image1.png"}
    assert sorted(os.listdir(tmp_path / "out")) == ["deck__pptx_extracted", "macro__xlsx_extracted", "paper__pdf_extracted", "same__docx_extracted", "same__xlsx_extracted"]
    assert (tmp_path / "out/paper__pdf_extracted/assets/attachments/001_payload.txt").read_bytes() == b"hello payload"
    manifest = json.loads((tmp_path / "out/same__xlsx_extracted/manifest.json").read_text())
    assert manifest["summary"]["units"] == 2 and manifest["summary"]["assets_failed"] == 0 and manifest["files"]
    tree_json = json.loads((tmp_path / "out/same__docx_extracted/document.json").read_text())
    assert tree_json["units"][0]["elements"][0]["text"] == "A heading" and tree_json["metadata"]["properties"]["word"]["core_properties"]["title"] == "Title here"
    md = (tmp_path / "out/deck__pptx_extracted/document.md").read_text()
    assert md.startswith("# deck.pptx") and "### The title" in md and "## Slide 2: Slide 2" in md and "| 1a | 1b |" in md and md.endswith("\n") and not md.endswith("\n\n")
    md = (tmp_path / "out/same__docx_extracted/document.md").read_text()
    assert "### A heading" in md and "a1 | b1\na2 | b2" in md and "```text\nx=1\n```" in md and "- item" in md and "> **Note:** " in md and "- `docx-asset-1` → `assets/media/image1.png` (image/png)" in md
    md = (tmp_path / "out/same__xlsx_extracted/document.md").read_text()
    assert "- State: `visible`\n- Used range: 5 row(s) × 3 column(s)\n\n### Cells\n\n| Cell |" in md and "| C2 | =B2*10 | =B2*10 | 20 |  |  |" in md
    assert "| A2 | A |  |  | look here | https://example.org/x |" in md and "### Excel table definitions\n\n- `SalesTable`: `A1:C2`" in md and "- `xlsx-asset-1` anchored near row 1, column 4" in md and "- `xlsx_image` / " in md
    md = (tmp_path / "out/paper__pdf_extracted/document.md").read_text()
    assert "](https://example.org)" in md and "## PDF form fields\n\n- **field**: val (`/Tx`)" in md and "## Extraction warnings" in md
    summary = {"units": 2, "elements": c.elements.where("doc_id like '%same.xlsx'").count(), "warnings": 0, "unsupported_objects": 1, "assets_declared": 1, "assets_requested": True, "assets_written": 1, "assets_failed": 0, "potentially_active_assets": 0}
    assert manifest["summary"] == summary and {"path", "size_bytes", "sha256"} == set(manifest["files"][0]) and manifest["source"]["type"] == "xlsx"


def test_password_stays_out(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(fx.pdf(password="kw-77x"))
    c = corpus(files.read_file(spark, str(tmp_path / "p.pdf")), Options(pdf_password="kw-77x"))
    out = sinks.write_packages(c, str(tmp_path / "out"), Options(pdf_password="kw-77x"))
    assert "kw-77x" not in out._jdf.queryExecution().toString() and "kw-77x" not in repr(Options(pdf_password="kw-77x"))
    assert out.count() >= 2
    everything = "".join(p.read_text(errors="ignore") for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert "First page text" in everything and "kw-77x" not in everything


def test_own_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")

    def mine(raw, options):
        from paperloom.sources.office import Built

        b = Built("mine")
        b.unit(1, "page", None)
        b.element(1, "e", "paragraph", "hi")
        return b

    c = corpus(files.read_file(spark, str(tmp_path / "a.pdf")), registry=extract.Registry().adding(("pdf",), mine))
    assert c.elements.select("text", F.col("source.page_number")).collect() == [("hi", 1)]


def test_unsafe_asset_is_a_violation(spark):
    from paperloom import schema

    empty = {n: spark.createDataFrame([], s) for n, s in schema.RELATIONS.items()}
    bad = spark.createDataFrame([("d", "a", "x", "n", "../escape", None, None, None, None, None)], schema.ASSETS)
    with pytest.raises(InvalidDocuments):
        violations(empty["documents"], empty["units"], empty["elements"], bad, strict=True)
    assert violations(empty["documents"], empty["units"], empty["elements"], empty["assets"]).count() == 0


def test_streaming(spark, tmp_path):
    from paperloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(fx.workbook())
    (tmp_path / "in/b.xlsx").write_bytes(fx.workbook())
    ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.where("relation = 'documents'").count() == 2


def test_cli(tmp_path, capsys, spark):
    from paperloom.cli import main

    (tmp_path / "a.xlsx").write_bytes(fx.workbook())
    assert main(["doctor", "--json"]) == 0 and "pyspark" in capsys.readouterr().out
    assert main(["inspect", str(tmp_path / "a.xlsx")]) == 0 and capsys.readouterr().out.splitlines()[:2] == ["type=xlsx", "extension=xlsx"]
    assert main(["extract", str(tmp_path / "a.xlsx")]) == 0 and (tmp_path / "a_extracted/manifest.json").exists()
    assert main(["inspect", str(tmp_path / "none")]) == 3
    assert "Units: 2 | Elements: 12 | Assets: 1" in capsys.readouterr().out and not (tmp_path / "a_extracted/_rows").exists()
    for name, raw in {"a/x.xlsx": fx.workbook(), "b/x.xlsx": fx.workbook(), "a/bad.pdf": b"%PDF-1.4", "x.docx": fx.word()}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    out = tmp_path / "all"
    assert main(["inspect", str(tmp_path / "in")]) == 2 and main(["extract", str(tmp_path / "in")]) == 2 and main(["batch", str(tmp_path / "a.xlsx"), "-o", str(out)]) == 2
    assert main(["batch", str(tmp_path / "in"), "-o", str(out), "--recursive", "--no-assets"]) == 1 and "Batch complete: 3 succeeded, 1 failed." in capsys.readouterr().out
    assert all((out / n / "document.json").exists() for n in ("a/x__xlsx_extracted", "b/x__xlsx_extracted", "x__docx_extracted"))
    summary = json.loads((out / "batch-summary.json").read_text())
    assert summary["failures"] == 1 and [f["source"] for f in summary["files"]] == ["a/bad.pdf", "a/x.xlsx", "b/x.xlsx", "x.docx"]
    good = summary["files"][1]
    assert good["status"] == "ok" and (good["summary"]["assets_requested"], good["summary"]["assets_declared"], good["summary"]["assets_failed"]) == (False, 1, 0)
    with pytest.raises(SystemExit) as e:
        main(["--version"])
    assert e.value.code == 0


def test_a_broken_document_is_one_reject(spark, tmp_path):
    for n in ("a.pdf", "b.pdf"):
        (tmp_path / n).write_bytes(b"%PDF-1.4" + n.encode())

    def mine(raw, options):
        from paperloom.sources.office import Built

        b = Built("mine")
        b.unit(1, "page", None)
        for _ in range(2 if raw.endswith(b"b.pdf") else 1):
            b.element(1, "e", "paragraph", "hi")
        return b

    c = corpus(files.scan(spark, str(tmp_path)), registry=extract.Registry().adding(("pdf",), mine), judge=True)
    assert c.rejects.count() == 1 and c.rejects.first().error_type == "DocumentValidationError" and c.rejects.first().path.endswith("b.pdf")
    assert c.documents.count() == 1 and c.elements.count() == 1


def test_sheet_stories():
    assert sheet.story("&LLeft &P&C&\"Arial,Bold\"&14Title&RRight") == {"left": "Left &P", "center": "Title", "right": "Right"}
    assert sheet.story("plain")["center"] == "plain" and sheet.story(None) == {"left": None, "center": None, "right": None}


def test_legacy_by_a_converter():
    from paperloom.sources import convert

    b = convert.extract_legacy(b"old", "xls", Options(), lambda raw, kind, target, timeout: fx.workbook())
    assert b.properties["conversion"] == {"from": "xls", "to": "xlsx"} and b.assets[0]["asset_id"] == "xlsx-asset-1" and b.warnings[-1]["code"] == "office.legacy.converted"
    if convert.find() is None:
        with pytest.raises(convert.ToolMissing):
            convert.libreoffice(b"x", "doc", "docx", 1)


def test_rendered_pages():
    from paperloom.sources import convert

    raw = fx.word({"docProps/app.xml": "<Properties xmlns='x'><Pages>3</Pages></Properties>"})
    b = convert.add_pages(word.extract(raw), raw, "docx", Options(), lambda *a: fx.pdf())
    assert b.properties["word"]["pagination"]["rendered_page_count"] == 2 and b.properties["word"]["stored_page_count"] == 3
    assert {w["code"] for w in b.warnings} == {"docx.page_count.mismatch"}

    def broken(*a):
        raise convert.ToolMissing("no converter is installed")

    codes = {w["code"] for w in convert.add_pages(word.extract(raw), raw, "docx", Options(), broken).warnings}
    assert codes == {"docx.pagination.libreoffice_unavailable"}
    assert {w["code"] for w in convert.add_pages(word.extract(raw), raw, "docx", Options(render_word_pages=False)).warnings} == {"docx.pagination.disabled"}


def test_layout_backend():
    from paperloom.sources import layout

    items = [
        {"label": "title", "text": "T", "page_number": 1, "bbox": (1, 2, 3, 4), "coordinate_system": "top_left"}, {"label": "list_item", "text": "i", "page_number": 2},
        {"label": "table", "page_number": 1, "grid": [[{"text": "a"}, {"text": "b"}]]}, {"label": "text", "text": "nowhere"},
    ]
    b = layout.extractor(lambda raw: items)(fx.pdf(), Options())
    first = [(e["element_type"], e["element_order"], e["text"]) for e in b.elements if e["unit_index"] == 1]
    assert first[:2] == [("heading", 1, "T"), ("table", 2, "a | b")] and first[2][0] == "link"
    assert b.units[-1] ["name"] == "Unpaged content" and b.units[-1]["unit_index"] == 3

    def fails(raw):
        raise RuntimeError

    assert "pdf.docling.failed" in {w["code"] for w in layout.extractor(fails)(fx.pdf(), Options()).warnings}
