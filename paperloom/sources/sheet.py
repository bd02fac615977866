"""Workbooks (X1-X11): one unit per sheet, its metadata and cells as elements."""

from __future__ import annotations

import datetime as dt
import posixpath
import re
from typing import Any

from paperloom.sources.office import Built, Package, Unreadable, collect_assets, link_images, local, number, q, report_parts

#: Built-in number formats that show dates or times (fixed values).
DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57})
BUILTIN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 22: "m/d/yy h:mm", 49: "@"}
_STORIES = ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")


def column_no(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def letters_of(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    return (int(m.group(2)), column_no(m.group(1))) if m else (0, 0)


def box(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    (r1, c1), (r2, c2) = place(a), place(b or a)
    return r1, c1, r2, c2


def shown(v: Any) -> str | None:
    return None if v is None else str(v)


class Styles:
    def __init__(self, package: Package):
        root = package.xml("xl/styles.xml")
        self.formats: dict[int, str] = dict(BUILTIN)
        self.ids: list[int] = []
        if root is not None:
            for f in root.iter(q("x:numFmt")):
                self.formats[number(f.get("numFmtId")) or 0] = f.get("formatCode", "")
            cells = root.find(q("x:cellXfs"))
            self.ids = [number(x.get("numFmtId")) or 0 for x in (cells if cells is not None else ())]

    def of(self, style: int) -> tuple[str, bool]:
        code = self.ids[style] if style < len(self.ids) else 0
        text = self.formats.get(code, "General")
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", text.lower())
        return text, code in DATE_FORMATS or code not in BUILTIN and bool(re.search(r"[dmyhs]", bare)) and "general" not in bare


def date_of(serial: float, base_1904: bool) -> str:
    start = dt.datetime(1904, 1, 1) if base_1904 else dt.datetime(1899, 12, 30)
    return (start + dt.timedelta(days=serial)).isoformat(timespec="seconds")


def cell_value(kind: str, raw: str | None, shared: list[str], is_date: bool, base_1904: bool) -> Any:
    if raw is None:
        return None
    if kind == "s":
        i = number(raw)
        return shared[i] if i is not None and i < len(shared) else None
    if kind == "b":
        return raw == "1"
    if kind in ("str", "e", "d"):
        return raw
    try:
        x = float(raw)
    except ValueError:
        return raw
    if is_date:
        return date_of(x, base_1904)
    return int(x) if x.is_integer() and "." not in raw and "e" not in raw.lower() else x


def extract(content: bytes) -> Built:
    package = Package(content)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise Unreadable("the workbook part is missing")
    built = Built("openpyxl-native")
    rels = package.rels("xl/workbook.xml")
    strings = package.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(q("x:t"))) for si in (strings if strings is not None else ()) if local(si.tag) == "si"]
    styles = Styles(package)
    calc, pr = book.find(q("x:calcPr")), book.find(q("x:workbookPr"))
    base_1904 = pr is not None and pr.get("date1904") in ("1", "true")
    sheets = [s for s in book.iter(q("x:sheet"))]
    built.properties["workbook"] = {
        "core_properties": package.core_properties(),
        "sheet_names": [s.get("name") for s in sheets],
        "defined_names": [{"name": d.get("name"), "value": d.text, "comment": d.get("comment"), "hidden": d.get("hidden") == "1", "local_sheet_id": number(d.get("localSheetId")), "type": "definedName"} for d in book.iter(q("x:definedName"))],
        "calculation": dict(calc.attrib) if calc is not None else {},
    }
    names = built.properties["workbook"]["defined_names"]
    collect_assets(package, "xlsx", built)
    report_parts(package, "xlsx", built)
    for i, s in enumerate(sheets, 1):
        part = rels.get(s.get(q("r:id"), ""), ("", "", False))
        if part[1] == "worksheet":
            _sheet(package, built, i, s, part[0], shared, styles, base_1904, names)
    link_images(built)
    return built


#: Keys of an anchor's end and their tags (fixed values).
_ANCHOR = (("row_zero_based", "row"), ("column_zero_based", "col"), ("row_offset_emu", "rowOff"), ("column_offset_emu", "colOff"))
#: Width and height of a comment whose box says nothing, in points.
COMMENT_SIZE = (144, 79)


def story(text: str | None) -> dict[str, str | None]:
    """A header's or footer's left, center and right part, without the codes of its fonts; fields keep their code."""
    parts: dict[str, str | None] = {"left": None, "center": None, "right": None}
    if text:
        pieces = re.split(r"&([LCR])", text if re.match("&[LCR]", text) else f"&C{text}")
        for side, part in zip(pieces[1::2], pieces[2::2], strict=False):
            plain = re.sub(r'&"[^"]*"|&K[0-9A-Fa-f]{6}|&\d+ ?|&[BIUESXY]', "", part)
            parts[{"L": "left", "C": "center", "R": "right"}[side]] = plain or None
    return parts


def titles(text: str | None, shape: str) -> str | None:
    found = re.search(shape, text or "")
    return found.group() if found else None


def _comment_sizes(package: Package, parts: list[str]) -> dict[str, dict[str, float]]:
    """Width and height of the comments' boxes by cell, from the old drawing part."""
    out = {}
    for part in parts:
        try:
            root = package.xml(part)
        except Unreadable:
            continue
        for shape in root.iter() if root is not None else ():
            style = dict(re.findall(r"(width|height):([\d.]+)pt", shape.get("style") or "")) if local(shape.tag) == "shape" else {}
            at = {local(x.tag): number((x.text or "").strip()) for x in shape.iter() if local(x.tag) in ("Row", "Column")}
            if len(style) == 2 and at.get("Row") is not None and at.get("Column") is not None:
                out[f"{letters_of(at['Column'] + 1)}{at['Row'] + 1}"] = {k: float(v) for k, v in style.items()}
    return out


def _sheet(package: Package, built: Built, index: int, entry, part: str, shared: list[str], styles: Styles, base_1904: bool, names: list[dict]) -> None:  # noqa: ANN001
    root = package.xml(part)
    if root is None:
        raise Unreadable(f"the sheet part {part} is missing")
    rels = package.rels(part)
    name = entry.get("name")
    merged = [m.get("ref", "") for m in root.iter(q("x:mergeCell"))]
    inside = {(r, c) for m in merged for r1, c1, r2, c2 in [box(m)] for r in range(r1, r2 + 1) for c in range(c1, c2 + 1) if (r, c) != (r1, c1)} if sum((b[2] - b[0] + 1) * (b[3] - b[1] + 1) for b in map(box, merged)) < 2_000_000 else None
    boxes = [box(m) for m in merged]

    def covered(r: int, c: int) -> bool:
        if inside is not None:
            return (r, c) in inside
        return any(r1 <= r <= r2 and c1 <= c <= c2 and (r, c) != (r1, c1) for r1, c1, r2, c2 in boxes)

    rows = [x for x in root.iter(q("x:row"))]
    hidden_rows = {number(x.get("r")) for x in rows if x.get("hidden") == "1"}
    columns = [x for x in root.iter(q("x:col"))]
    hidden_columns = {c for x in columns if x.get("hidden") == "1" for c in range(number(x.get("min")) or 1, (number(x.get("max")) or 1) + 1)}
    comments, links = {}, {}
    sizes = _comment_sizes(package, [t for t, kind, _ in rels.values() if kind == "vmlDrawing"])
    for target, kind, _ in rels.values():
        if kind == "comments" and (c := package.xml(target)) is not None:
            authors = [a.text for a in c.iter(q("x:author"))]
            for x in c.iter(q("x:comment")):
                a = number(x.get("authorId"))
                comments[x.get("ref")] = {"text": "".join(t.text or "" for t in x.iter(q("x:t"))), "author": authors[a] if a is not None and a < len(authors) else None, **sizes.get(x.get("ref"), {"width": COMMENT_SIZE[0], "height": COMMENT_SIZE[1]})}
    for x in root.iter(q("x:hyperlink")):
        target = rels.get(x.get(q("r:id"), ""), (None, "", False))[0]
        links[x.get("ref")] = {"target": target, "location": x.get("location"), "display": x.get("display"), "tooltip": x.get("tooltip")}
    tables, problems = [], {"tables": False, "validations": False}
    for target, kind, _ in rels.values():
        if kind == "table":
            try:
                t = package.xml(target)
            except Unreadable:
                t = None
            if t is None:
                problems["tables"] = True
                continue
            tables.append({"name": t.get("name"), "display_name": t.get("displayName"), "ref": t.get("ref"), "header_row_count": number(t.get("headerRowCount", "1")), "totals_row_count": number(t.get("totalsRowCount", "0"))})
    validations = [
        {"type": v.get("type"), "operator": v.get("operator"), "sqref": v.get("sqref"), "formula1": v.findtext(q("x:formula1")), "formula2": v.findtext(q("x:formula2")), "allow_blank": v.get("allowBlank") == "1"}
        for v in root.iter(q("x:dataValidation"))
    ]
    cells = []
    for x in rows:
        for c in x.iter(q("x:c")):
            ref = c.get("r", "")
            r, col = place(ref)
            cells.append((r, col, ref, c))
    cells.sort(key=lambda t: t[:2])
    dims = [d for d in ((number(x.get("r")), x.get("ht"), x.get("hidden") == "1", number(x.get("outlineLevel"))) for x in rows) if d[1] or d[2] or d[3]]
    view, pane, autofilter, header = root.find(f".//{q('x:sheetView')}"), root.find(f".//{q('x:pane')}"), root.find(q("x:autoFilter")), root.find(q("x:headerFooter"))
    own = {n["name"]: n["value"] for n in names if n["local_sheet_id"] == index - 1}
    metadata = {
        "max_row": max((t[0] for t in cells), default=1), "max_column": max((t[1] for t in cells), default=1), "state": entry.get("state", "visible"),
        "merged_ranges": merged, "hidden_rows": sorted(r for r in hidden_rows if r), "hidden_columns": [letters_of(c) for c in sorted(hidden_columns)],
        "freeze_panes": pane.get("topLeftCell") if pane is not None else None, "auto_filter": autofilter.get("ref") if autofilter is not None else None,
        "print_area": own.get("_xlnm.Print_Area"), "print_title_rows": titles(own.get("_xlnm.Print_Titles"), r"\$\d+:\$\d+"), "print_title_cols": titles(own.get("_xlnm.Print_Titles"), r"\$[A-Z]+:\$[A-Z]+"), "tables": tables, "data_validations": validations,
        "headers_footers": {re.sub(r"(?=[A-Z])", "_", k).lower(): story(header.findtext(q(f"x:{k}")) if header is not None else None) for k in _STORIES},
        "row_dimensions": {str(r): {"height": float(h) if h else None, "hidden": hid, "outline_level": o or 0} for r, h, hid, o in dims},
        "column_dimensions": {letters_of(number(x.get("min")) or 1): {"width": float(x.get("width")) if x.get("width") else None, "hidden": x.get("hidden") == "1", "outline_level": number(x.get("outlineLevel")) or 0} for x in columns},
        "view": {"zoom": number(view.get("zoomScale")), "show_grid_lines": view.get("showGridLines") != "0"} if view is not None else {},
    }
    source = {"unit_index": index, "unit_name": name, "sheet_name": name}
    built.unit(index, "sheet", name, metadata)
    meta = built.element(index, f"sheet-{index}-metadata", "metadata", None, metadata, dict(source))
    meta["element_order"], built.orders[index] = 0, 0
    formulas: dict[str, tuple[str, str]] = {}
    for r, col, ref, c in cells:
        style = number(c.get("s")) or 0
        fmt, is_date = styles.of(style)
        f, v, kind = c.find(q("x:f")), c.findtext(q("x:v")), c.get("t", "n")
        if kind == "inlineStr":
            raw: Any = "".join(t.text or "" for t in c.iter(q("x:t")))
        else:
            raw = cell_value(kind, v, shared, is_date, base_1904)
        formula = None
        if f is not None:
            si = f.get("si")
            if f.get("t") == "shared" and si is not None and f.text:
                formulas[si] = (f.text, ref)
            formula = "=" + (f.text or (formulas[si][0] if si in formulas else ""))
        value = formula if formula is not None else raw
        comment, link = comments.get(ref), links.get(ref)
        if covered(r, col) or value is None and comment is None and link is None:
            continue
        data = {
            "coordinate": ref, "row": r, "column": col, "value": value, "formula": formula, "cached_value": raw if formula is not None else None,
            "data_type": "f" if formula is not None else {"s": "s", "inlineStr": "s", "str": "s", "b": "b", "e": "e"}.get(kind, "d" if is_date else "n"), "number_format": fmt,
            "style_id": style, "is_date": is_date, "hyperlink": link, "comment": comment, "row_hidden": r in hidden_rows, "column_hidden": col in hidden_columns,
        }
        built.element(index, f"sheet-{index}-cell-{ref}", "cell", shown(value), data, source | {"row_no": r, "column_no": col, "cell": ref})
    for n, t in enumerate(tables, 1):
        built.element(index, f"sheet-{index}-table-{n}", "table", t["display_name"] or t["name"], t, dict(source))
    for target, kind, _ in rels.values():
        if kind == "drawing":
            _drawing(package, built, index, target, source)
    if problems["tables"]:
        built.warn("xlsx.tables.partial", "some table definitions can't be read", "warning", dict(source))
    if any(v["sqref"] is None for v in validations):
        built.warn("xlsx.data_validations.partial", "some data validations can't be read", "warning", dict(source))


def _drawing(package: Package, built: Built, index: int, part: str, source: dict) -> None:
    root = package.xml(part)
    rels = package.rels(part)
    images = charts = 0
    for anchor in root if root is not None else ():
        ends = {}
        for side in ("from", "to"):
            e = anchor.find(q(f"xdr:{side}"))
            if e is not None:
                ends[side] = {name: number(e.findtext(q(f"xdr:{k}"))) for name, k in _ANCHOR}
        blip = anchor.find(f".//{q('a:blip')}")
        if blip is not None:
            images += 1
            target = rels.get(blip.get(q("r:embed"), ""), ("", "", False))[0]
            data = package.image(target) | {"index": images} | ends
            built.element(index, f"sheet-{index}-image-{images}", "image", None, {"image": data}, source | {"archive_part": target})
            built.report("xlsx_image", "asset_extracted_structure_partial", posixpath.basename(target), dict(source), dict(data))
        elif anchor.find(f".//{q('c:chart')}") is not None:
            charts += 1
            built.report("xlsx_chart", "detected_partially_parsed", f"chart {charts}", dict(source), {"anchor": ends})
