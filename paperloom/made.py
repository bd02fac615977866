"""Small Office and PDF files made of table rows, so that queries can run the parsers over whole tables.

A file holds the customers of one nation whose keys are in one block, so no group grows with the table.
"""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Callable
from typing import Any
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.sources.office import NS

#: Customers of a file: keys of one block.
BLOCK = 500
_FILE = "path string, modificationTime timestamp, length long, content binary"


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def rels(*items: tuple[str, str, str, bool]) -> str:
    kind = NS["r"]
    body = "".join(f"<Relationship Id={quoteattr(i)} Type={quoteattr(f'{kind}/{k}')} Target={quoteattr(t)}{' TargetMode=' + chr(34) + 'External' + chr(34) if out else ''}/>" for i, k, t, out in items)
    return f'<Relationships xmlns="{NS["pr"]}">{body}</Relationships>'


def files(customers: DataFrame, suffix: str, make: Callable[[list[Any]], bytes]) -> DataFrame:
    """path, modificationTime, length and content of one file for each nation and block of customers."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raw = make(list(rows.sort_values("c_custkey").itertuples()))
        return pd.DataFrame([(f"in/n{key[0]}-{key[1]}.{suffix}", dt.datetime(2024, 1, 1), len(raw), raw)], columns=["path", "modificationTime", "length", "content"])

    block = F.floor(F.col("c_custkey") / BLOCK).alias("block")
    return customers.select("*", block).groupBy("c_nationkey", "block").applyInPandas(build, _FILE)


def workbook(rows: list[Any]) -> bytes:
    """Names, keys, a formula and a truth value in each row; a second sheet is hidden and empty."""
    x, r = NS["x"], NS["r"]
    lines, links, link_rels, comments, merges = [], [], [], [], []
    for n, c in enumerate(rows, 1):
        cells = f'<c r="A{n}" t="inlineStr"><is><t>{escape(c.c_name)}</t></is></c><c r="B{n}"><v>{c.c_custkey}</v></c><c r="C{n}"><f>B{n}*10</f><v>{c.c_custkey * 10}</v></c><c r="D{n}" t="b"><v>{int(c.c_mktsegment == "BUILDING")}</v></c>'
        if c.c_mktsegment == "HOUSEHOLD":
            cells += "".join(f'<c r="{col}{n}" t="inlineStr"><is><t>{t}</t></is></c>' for col, t in (("E", "merged"), ("F", "covered")))
            merges.append(f'<mergeCell ref="E{n}:F{n}"/>')
        if c.c_mktsegment == "AUTOMOBILE":
            links.append(f'<hyperlink ref="A{n}" r:id="l{n}" tooltip="go"/>')
            link_rels.append((f"l{n}", "hyperlink", f"https://example.org/{c.c_custkey}", True))
        if c.c_mktsegment == "FURNITURE":
            comments.append(f'<comment ref="A{n}" authorId="0"><text><t>about {c.c_custkey}</t></text></comment>')
        lines.append(f'<row r="{n}"{" hidden=" + chr(34) + "1" + chr(34) if c.c_mktsegment == "MACHINERY" else ""}>{cells}</row>')
    sheet = f'<worksheet xmlns="{x}" xmlns:r="{r}"><sheetData>{"".join(lines)}</sheetData>'
    sheet += (f"<mergeCells>{''.join(merges)}</mergeCells>" if merges else "") + (f"<hyperlinks>{''.join(links)}</hyperlinks>" if links else "")
    sheet += "<headerFooter><oddHeader>&amp;LLeft&amp;RPage &amp;P</oddHeader></headerFooter></worksheet>"
    return package({
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": f'<workbook xmlns="{x}" xmlns:r="{r}"><sheets><sheet name="Customers" sheetId="1" r:id="rId1"/><sheet name="Empty" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("rId1", "worksheet", "worksheets/sheet1.xml", False), ("rId2", "worksheet", "worksheets/sheet2.xml", False)),
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/_rels/sheet1.xml.rels": rels(*link_rels, ("c", "comments", "../comments1.xml", False), ("t", "table", "../tables/table1.xml", False)),
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{x}"><sheetData/></worksheet>',
        "xl/comments1.xml": f'<comments xmlns="{x}"><authors><author>Reviewer</author></authors><commentList>{"".join(comments)}</commentList></comments>',
        "xl/tables/table1.xml": f'<table xmlns="{x}" name="T1" displayName="Customers" ref="A1:D{len(rows)}"/>',
    })


def _p(text: str, style: str | None = None, more: str = "") -> str:
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}<w:r><w:t>{escape(text)}</w:t></w:r>{more}</w:p>"


#: Paragraph styles by market segment.
STYLES = {"BUILDING": "Heading1", "FURNITURE": "ListBullet"}


def word(rows: list[Any]) -> bytes:
    """A paragraph for each customer with what its segment adds, one table, a header, comments and footnotes; media and embedded parts."""
    w, r = NS["w"], NS["r"]

    def more(n: int, c: Any) -> str:
        """A picture and a text box, a link, a content control, a field, or an insertion and a formula."""
        k = c.c_custkey
        return {
            "BUILDING": f'<w:r><w:drawing><a:blip xmlns:a="{NS["a"]}" r:embed="m{k}"/></w:drawing></w:r><w:r><w:pict><w:txbxContent>{_p(f"box {k}")}</w:txbxContent></w:pict></w:r>',
            "AUTOMOBILE": f'<w:hyperlink r:id="l{k}" w:anchor="top"><w:r><w:t>, linked</w:t></w:r></w:hyperlink>',
            "FURNITURE": f'<w:sdt><w:sdtPr><w:alias w:val="A{k}"/><w:tag w:val="T{k}"/></w:sdtPr><w:sdtContent><w:r><w:t>control {k}</w:t></w:r></w:sdtContent></w:sdt>',
            "HOUSEHOLD": f'<w:fldSimple w:instr=" PAGE {k % 3} "/>',
            "MACHINERY": f'<w:ins w:id="{n}" w:author="Editor"><w:r><w:t>added {k}</w:t></w:r></w:ins><m:oMath><m:r><m:t>x={k}</m:t></m:r></m:oMath>',
        }.get(c.c_mktsegment, "")

    body = "".join(_p(c.c_name, STYLES.get(c.c_mktsegment), more(n, c)) for n, c in enumerate(rows))
    links = [(f"m{c.c_custkey}", "image", f"media/item {c.c_custkey}.bin", False) for c in rows if c.c_mktsegment == "BUILDING"]
    links += [(f"l{c.c_custkey}", "hyperlink", f"https://example.org/{c.c_custkey}", True) for c in rows if c.c_mktsegment == "AUTOMOBILE"]
    table = "".join(f"<w:tr><w:tc>{_p(c.c_name)}</w:tc><w:tc>{_p(str(c.c_custkey))}</w:tc></w:tr>" for c in rows)
    comments = "".join(f'<w:comment w:id="{n}" w:author="C">{_p(f"see {c.c_custkey}")}</w:comment>' for n, c in enumerate(rows) if c.c_mktsegment == "AUTOMOBILE")
    notes = "".join(f'<w:footnote w:id="{n + 1}">{_p(f"note {c.c_custkey}")}</w:footnote>' for n, c in enumerate(rows) if c.c_mktsegment == "HOUSEHOLD")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("Heading1", "heading 1"), ("ListBullet", "List Bullet")))
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f'<w:document xmlns:w="{w}" xmlns:r="{r}" xmlns:m="{NS["m"]}"><w:body>{body}<w:tbl>{table}</w:tbl><w:sectPr><w:headerReference w:type="default" r:id="h"/></w:sectPr></w:body></w:document>',
        "word/_rels/document.xml.rels": rels(("h", "header", "header1.xml", False), *links),
        "word/styles.xml": f'<w:styles xmlns:w="{w}">{styles}</w:styles>',
        "word/header1.xml": f'<w:hdr xmlns:w="{w}">{_p("the header")}</w:hdr>',
        "word/comments.xml": f'<w:comments xmlns:w="{w}">{comments}</w:comments>',
        "word/footnotes.xml": f'<w:footnotes xmlns:w="{w}"><w:footnote w:id="-1">{_p("sep")}</w:footnote>{notes}</w:footnotes>',
    }
    for c in rows:
        if c.c_mktsegment in ("BUILDING", "FURNITURE"):
            parts[f"word/{'media' if c.c_mktsegment == 'BUILDING' else 'embeddings'}/item {c.c_custkey}.bin"] = c.c_name.encode()
    return package(parts)


def slides(rows: list[Any]) -> bytes:
    """A slide for each customer with a title and a box; some are hidden, some have notes."""
    p, a, r = NS["p"], NS["a"], NS["r"]

    def shape(i: int, text: str, place: str = "") -> str:
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="S{i}"/><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>'

    ids = "".join(f'<p:sldId id="{255 + n}" r:id="s{n}"/>' for n in range(1, len(rows) + 1))
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": "<Types/>",
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(*((f"s{n}", "slide", f"slides/slide{n}.xml", False) for n in range(1, len(rows) + 1))),
    }
    for n, c in enumerate(rows, 1):
        hidden = ' show="0"' if c.c_mktsegment == "MACHINERY" else ""
        tree = shape(2, c.c_name, '<p:ph type="title"/>') + shape(3, f"segment {c.c_mktsegment}")
        parts[f"ppt/slides/slide{n}.xml"] = f'<p:sld xmlns:p="{p}" xmlns:a="{a}" xmlns:r="{r}"{hidden}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>'
        if c.c_mktsegment == "HOUSEHOLD":
            parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = rels(("n", "notesSlide", f"../notesSlides/notesSlide{n}.xml", False))
            body = shape(3, f"note {c.c_custkey}", '<p:ph type="body"/>')
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f'<p:notes xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:notes>'
    return package(parts)


def pdf(rows: list[Any]) -> bytes:
    """A page for each customer with two lines of text, and a link on some; a form field and an outline for the file."""
    objects: dict[int, tuple[str, bytes | None]] = {}
    kids = " ".join(f"{100 + 2 * n} 0 R" for n in range(len(rows)))
    objects[1] = ("<< /Type /Catalog /Pages 2 0 R /Outlines 6 0 R /AcroForm << /Fields [5 0 R] >> >>", None)
    objects[2] = (f"<< /Type /Pages /Kids [{kids}] /Count {len(rows)} /MediaBox [0 0 200 100] >>", None)
    objects[3] = ("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", None)
    objects[4] = ("<< /Title (Customers) >>", None)
    objects[5] = (f"<< /T (count) /FT /Tx /V ({len(rows)}) >>", None)
    objects[6] = ("<< /First 7 0 R >>", None)
    objects[7] = ("<< /Title (First) /Dest [100 0 R /Fit] >>", None)
    for n, c in enumerate(rows):
        at = 100 + 2 * n
        link = f"/Annots [<< /Subtype /Link /Rect [0 0 1 1] /A << /URI (https://example.org/{c.c_custkey}) >> >>]" if c.c_mktsegment == "AUTOMOBILE" else ""
        objects[at] = (f"<< /Type /Page /Parent 2 0 R /Contents {at + 1} 0 R /Resources << /Font << /F1 3 0 R >> >> {link} >>", None)
        text = f"BT /F1 12 Tf 10 50 Td ({c.c_name}) Tj 0 -14 Td (key {c.c_custkey}) Tj ET".encode()
        objects[at + 1] = (f"<< /Length {len(text)} >>", text)
    out = io.BytesIO()
    out.write(b"%PDF-1.5\n")
    for i, (head, stream) in sorted(objects.items()):
        out.write(f"{i} 0 obj\n{head}\n".encode() + (b"stream\n" + stream + b"\nendstream\n" if stream is not None else b"") + b"endobj\n")
    out.write(b"trailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF")
    return out.getvalue()


#: Files of every kind that detection tells apart: name of the file and what it holds.
def odd_file(key: int) -> tuple[str, bytes]:
    ole = bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 24
    doc = {"[Content_Types].xml": "<Types/>", "word/document.xml": "<a/>"}
    many = {"[Content_Types].xml": "<Types/>", "xl/workbook.xml": "<a/>", "xl/a.xml": "<a/>", "xl/b.xml": "<a/>"}
    return (
        (f"in/{key}.docx", package(doc)), (f"in/{key}.docx", package(doc | {"word/vbaProject.bin": b"x"})), (f"in/{key}.docx", ole), (f"in/{key}.doc", ole),
        (f"in/{key}.bin", b"%PDF-1.4 x"), (f"in/{key}.zip", package({"a.txt": "a"})), (f"in/{key}.txt", b"plain text"), (f"in/{key}.docx", package(many)),
    )[key % 8]


def odd_files(customers: DataFrame) -> DataFrame:
    def build(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [odd_file(int(k)) for k in b["c_custkey"]]
            yield pd.DataFrame([(p, dt.datetime(2024, 1, 1), len(raw), raw) for p, raw in rows], columns=["path", "modificationTime", "length", "content"])

    return customers.select("c_custkey").mapInPandas(build, _FILE)
