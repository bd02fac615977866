"""Office and PDF files built with the standard library."""

import hashlib
import io
import struct
import zipfile
import zlib

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
C = "http://schemas.openxmlformats.org/drawingml/2006/chart"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"
XDR = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"


def png(width=64, height=32):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + b"\xff" * width * 3 for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data if isinstance(data, bytes) else data.encode())
    return out.getvalue()


def rels(*items):
    return f'<Relationships xmlns="{REL}">' + "".join(f'<Relationship Id="{i}" Type="{R}/{k}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if ext else ""}/>' for i, k, t, ext in items) + "</Relationships>"


CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Title here</dc:title><dc:creator>Someone</dc:creator></cp:coreProperties>'


def workbook(extra=None):
    sheet = f"""<worksheet xmlns="{X}" xmlns:r="{R}"><sheetViews><sheetView><pane topLeftCell="A2" state="frozen"/></sheetView></sheetViews>
    <cols><col min="4" max="4" hidden="1"/></cols><sheetData>
    <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Qty</t></is></c><c r="C1" t="str"><v>Total</v></c></row>
    <row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2</v></c><c r="C2"><f>B2*10</f><v>20</v></c></row>
    <row r="4"><c r="A4" t="inlineStr"><is><t>merged</t></is></c><c r="B4"><v>5</v></c></row>
    <row r="5" hidden="1"><c r="A5" s="1"><v>45292</v></c></row></sheetData>
    <mergeCells><mergeCell ref="A4:B4"/></mergeCells><hyperlinks><hyperlink ref="A2" r:id="rId1"/></hyperlinks>
    <drawing r:id="rId4"/></worksheet>"""
    parts = {
        "[Content_Types].xml": "<Types/>",
        "docProps/core.xml": CORE,
        "xl/workbook.xml": f'<workbook xmlns="{X}" xmlns:r="{R}"><sheets><sheet name="مبيعات" sheetId="1" r:id="rId1"/><sheet name="Hidden" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("rId1", "worksheet", "worksheets/sheet1.xml", 0), ("rId2", "worksheet", "worksheets/sheet2.xml", 0)),
        "xl/sharedStrings.xml": f'<sst xmlns="{X}"><si><t>Name</t></si><si><r><t>A</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{X}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("rId1", "hyperlink", "https://example.org/x", 1), ("rId2", "comments", "../comments1.xml", 0), ("rId3", "table", "../tables/table1.xml", 0), ("rId4", "drawing", "../drawings/drawing1.xml", 0)),
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{X}"><sheetData/></worksheet>',
        "xl/comments1.xml": f'<comments xmlns="{X}"><authors><author>Reviewer</author></authors><commentList><comment ref="A2" authorId="0"><text><t>look here</t></text></comment></commentList></comments>',
        "xl/tables/table1.xml": f'<table xmlns="{X}" name="SalesTable" displayName="SalesTable" ref="A1:C2"/>',
        "xl/drawings/drawing1.xml": f'<xdr:wsDr xmlns:xdr="{XDR}" xmlns:a="{A}" xmlns:r="{R}"><xdr:oneCellAnchor><xdr:from><xdr:col>4</xdr:col><xdr:row>1</xdr:row></xdr:from><xdr:pic><xdr:blipFill><a:blip r:embed="rId1"/></xdr:blipFill></xdr:pic></xdr:oneCellAnchor></xdr:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": rels(("rId1", "image", "../media/image1.png", 0)),
        "xl/media/image1.png": png(),
    }
    return package(parts | (extra or {}))


def wp(text, style=None, extra=""):
    ppr = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{ppr}<w:r><w:rPr><w:b/></w:rPr><w:t>{text}</w:t>{extra}</w:r></w:p>"


def word(extra=None, body=""):
    nested = f"<w:tbl><w:tr><w:tc>{wp('inner')}</w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc>{wp('a1')}{nested}</w:tc><w:tc>{wp('b1')}</w:tc></w:tr><w:tr><w:tc>{wp('a2')}</w:tc><w:tc>{wp('b2')}</w:tc></w:tr></w:tbl>"
    picture = f'<w:drawing><a:blip xmlns:a="{A}" r:embed="rId5"/></w:drawing>'
    doc = f"""<w:document xmlns:w="{W}" xmlns:r="{R}" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><w:body>{wp("A heading", "Heading1")}{wp("مرحبا", extra=picture)}{table}
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>item</w:t><w:br w:type="page"/></w:r></w:p>
    <w:p><w:ins w:author="B" w:id="9"><w:r><w:t>added</w:t></w:r></w:ins><w:del w:author="B" w:id="8"><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>
    <w:sdt><w:sdtPr><w:tag w:val="t1"/></w:sdtPr><w:sdtContent/></w:sdt><m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath>
    <w:p><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:instrText> PAGE </w:instrText></w:r></w:p>{body}{wp("second page marker")}
    <w:sectPr><w:headerReference w:type="default" r:id="rId2"/><w:footerReference w:type="default" r:id="rId3"/><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>"""
    parts = {
        "[Content_Types].xml": "<Types/>",
        "docProps/core.xml": CORE,
        "word/document.xml": doc,
        "word/_rels/document.xml.rels": rels(("rId2", "header", "header1.xml", 0), ("rId3", "footer", "footer1.xml", 0), ("rId5", "image", "media/image1.png", 0)),
        "word/styles.xml": f'<w:styles xmlns:w="{W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/header1.xml": f'<w:hdr xmlns:w="{W}">{wp("the header")}</w:hdr>',
        "word/footer1.xml": f'<w:ftr xmlns:w="{W}">{wp("the footer")}{wp(" ")}</w:ftr>',
        "word/comments.xml": f'<w:comments xmlns:w="{W}"><w:comment w:id="0" w:author="C">{wp("a comment")}</w:comment></w:comments>',
        "word/footnotes.xml": f'<w:footnotes xmlns:w="{W}"><w:footnote w:id="-1">{wp("sep")}</w:footnote><w:footnote w:id="0">{wp("cont")}</w:footnote><w:footnote w:id="1">{wp("real note")}</w:footnote></w:footnotes>',
        "word/media/image1.png": png(),
    }
    return package(parts | (extra or {}))


def _sp(i, text, ph=""):
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="Shape {i}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:rPr b="1"/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def slides(extra=None):
    table = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="5" name="T"/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl><a:tblPr firstRow="1"/>{"".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{r}{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in "ab") + "</a:tr>" for r in "12")}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    chart = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="6" name="C"/></p:nvGraphicFramePr><a:graphic><a:graphicData><c:chart xmlns:c="{C}" r:id="rId3"/></a:graphicData></a:graphic></p:graphicFrame>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="7" name="Pic" descr="alt"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId2"/></p:blipFill></p:pic>'
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="8" name="G"/></p:nvGrpSpPr>{_sp(9, "grouped")}</p:grpSp>'

    def slide(shapes, attrs=""):
        return f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"{attrs}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'

    pts = "".join
    parts = {
        "[Content_Types].xml": "<Types/>",
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="rId1"/><p:sldId id="257" r:id="rId2"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/slide1.xml", 0), ("rId2", "slide", "slides/slide2.xml", 0)),
        "ppt/slides/slide1.xml": slide(_sp(2, "The title", '<p:ph type="title"/>') + _sp(3, "a box") + table + chart + pic + group),
        "ppt/slides/_rels/slide1.xml.rels": rels(("rId2", "image", "../media/image1.png", 0), ("rId3", "chart", "../charts/chart1.xml", 0), ("rId4", "notesSlide", "../notesSlides/notesSlide1.xml", 0)),
        "ppt/slides/slide2.xml": slide(_sp(2, "hidden text"), ' show="0"'),
        "ppt/charts/chart1.xml": f'<c:chartSpace xmlns:c="{C}"><c:chart><c:plotArea><c:barChart><c:ser><c:tx><c:strRef><c:strCache><c:pt idx="0"><c:v>Sales</c:v></c:pt></c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache>{pts(f"<c:pt idx={chr(34)}{i}{chr(34)}><c:v>Q{i + 1}</c:v></c:pt>" for i in range(2))}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache><c:pt idx="0"><c:v>10</c:v></c:pt><c:pt idx="1"><c:v>20</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>',
        "ppt/notesSlides/notesSlide1.xml": f'<p:notes xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{_sp(3, "speak slowly", "<p:ph type=" + chr(34) + "body" + chr(34) + "/>")}</p:spTree></p:cSld></p:notes>',
        "ppt/media/image1.png": png(),
    }
    return package(parts | (extra or {}))


def pdf(attachment=None, password=None, pages=("First page text of the file", "Second page")):
    objects = {}

    def add(n, head, stream=None):
        objects[n] = (head, stream)

    kids = " ".join(f"{10 + i} 0 R" for i in range(len(pages)))
    names = "/Names << /EmbeddedFiles << /Names [(payload.txt) 8 0 R] >> >> " if attachment is not None else ""
    add(1, f"<< /Type /Catalog /Pages 2 0 R {names}/Outlines 6 0 R /AcroForm << /Fields [30 0 R] >> >>")
    add(2, f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 200 100] >>")
    add(3, "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    add(4, "<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8 >>", b"\xff\xff\xff")
    add(5, "<< /Title (A title) >>")
    add(6, "<< /First 7 0 R >>")
    add(7, "<< /Title (Chapter) /Dest [11 0 R /Fit] >>")
    add(30, "<< /T (field) /FT /Tx /V (val) >>")
    if attachment is not None:
        add(8, "<< /F (payload.txt) /EF << /F 9 0 R >> >>")
        add(9, "<< /Type /EmbeddedFile >>", attachment)
    for i, text in enumerate(pages):
        annots = "/Annots [<< /Subtype /Link /Rect [0 0 1 1] /A << /URI (https://example.org) >> >> << /Subtype /Link /Dest [11 0 R /Fit] >>]" if i == 0 else ""
        add(10 + i, f"<< /Type /Page /Parent 2 0 R /Contents {20 + i} 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 4 0 R >> >> {annots} >>")
        raw = zlib.compress(f"BT /F1 12 Tf 10 50 Td ({text}) Tj 0 -14 Td (line two) Tj ET".encode())
        add(20 + i, "<< /Filter /FlateDecode >>", raw)
    ids, encrypt = b"0123456789abcdef", ""
    key = None
    if password:
        from paperloom.sources.pdf import _PAD, rc4

        def m(x):
            return hashlib.md5(x).digest()

        pad = (password.encode() + _PAD)[:32]
        o = rc4(m(pad)[:5], pad)
        perm = (0xFFFFFFFC).to_bytes(4, "little")
        key = m(pad + o + perm + ids)[:5]
        u = rc4(key, _PAD)
        add(40, f"<< /Filter /Standard /V 1 /R 2 /O <{o.hex()}> /U <{u.hex()}> /P -4 >>")
        encrypt = f"/Encrypt 40 0 R /ID [<{ids.hex()}> <{ids.hex()}>]"
    out = io.BytesIO(b"")
    out.write(b"%PDF-1.5\n")
    for n, (head, stream) in sorted(objects.items()):
        if stream is not None:
            if key:
                from paperloom.sources.pdf import rc4

                stream = rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\x00\x00").digest()[:10], stream)
            head = head[:-2] + f"/Length {len(stream)} >>"
        out.write(f"{n} 0 obj\n{head}\n".encode())
        if stream is not None:
            out.write(b"stream\n" + stream + b"\nendstream\n")
        out.write(b"endobj\n")
    out.write(f"trailer << /Root 1 0 R /Info 5 0 R {encrypt} >>\n%%EOF".encode())
    return out.getvalue()
