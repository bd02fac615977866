"""Presentations (T1-T12): one unit per slide, shapes in drawing order, notes last."""

from __future__ import annotations

from typing import Any
from xml.etree import ElementTree as ET

from paperloom.sources.office import Built, Package, Unreadable, collect_assets, link_images, local, number, q, report_parts

PART = "ppt/presentation.xml"
_HEADINGS = {"title": "TITLE", "ctrTitle": "CENTER_TITLE", "subTitle": "SUBTITLE"}
_SHAPES = ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")
_BANDS = {"firstRow": "first_row", "firstCol": "first_col", "lastRow": "last_row", "lastCol": "last_col", "bandRow": "horz_banding", "bandCol": "vert_banding"}


def paragraphs(body: ET.Element | None) -> list[dict]:
    out = []
    for p in body.iter(q("a:p")) if body is not None else ():
        props = p.find(q("a:pPr"))
        runs = []
        for r in p:
            tag = local(r.tag)
            if tag in ("r", "fld"):
                rp = r.find(q("a:rPr"))
                get = rp.get if rp is not None else (lambda *_: None)
                runs.append({"text": r.findtext(q("a:t")) or "", "bold": _flag(get("b")), "italic": _flag(get("i")), "underline": get("u"), "size_emu": _points(get("sz")), "language": get("lang")})
            elif tag == "br":
                runs.append({"text": "\v", "bold": None, "italic": None, "underline": None, "size_emu": None, "language": None})
        out.append({"text": "".join(r["text"] for r in runs), "level": number(props.get("lvl")) or 0 if props is not None else 0, "alignment": props.get("algn") if props is not None else None, "runs": runs})
    return out


def _flag(v: str | None) -> bool | None:
    return None if v is None else v in ("1", "true")


def _points(v: str | None) -> int | None:
    n = number(v)
    return None if n is None else n * 127


def _name(shape: ET.Element) -> ET.Element | None:
    return next((e for e in shape.iter() if local(e.tag) == "cNvPr"), None)


def base(shape: ET.Element, z: int, parent: str | None) -> dict[str, Any]:
    n = _name(shape)
    frame = next((e for e in shape.iter() if local(e.tag) == "xfrm"), None)
    off, ext = (frame.find(q("a:off")), frame.find(q("a:ext"))) if frame is not None else (None, None)
    ph = next((e for e in shape.iter() if local(e.tag) == "ph"), None)
    kind = {"sp": "AUTO_SHAPE", "pic": "PICTURE", "graphicFrame": "GRAPHIC_FRAME", "grpSp": "GROUP", "cxnSp": "LINE"}[local(shape.tag)]
    if ph is not None:
        kind = "PLACEHOLDER"
    return {
        "role": "shape", "shape_id": number(n.get("id")) if n is not None else None, "name": n.get("name") if n is not None else None, "shape_type": kind, "z_index": z, "parent_shape": parent,
        "geometry_emu": {"left": number(off.get("x")), "top": number(off.get("y")), "width": number(ext.get("cx")), "height": number(ext.get("cy")), "rotation": (number(frame.get("rot")) or 0) / 60000} if off is not None and ext is not None else None,
        "placeholder": {"type": _HEADINGS.get(ph.get("type", "obj"), ph.get("type", "obj").upper()), "idx": number(ph.get("idx")) or 0} if ph is not None else None,
        "accessibility": {"title": n.get("title"), "alt_text": n.get("descr")} if n is not None else None,
    }


def table(t: ET.Element) -> dict[str, Any]:
    props = t.find(q("a:tblPr"))
    rows = []
    for tr in t.iter(q("a:tr")):
        row = []
        for tc in tr.findall(q("a:tc")):
            cp = tc.find(q("a:tcPr"))
            ps = paragraphs(tc.find(q("a:txBody")))
            span_h, span_w = number(tc.get("rowSpan")) or 1, number(tc.get("gridSpan")) or 1
            row.append(
                {
                    "text": "\n".join(p["text"] for p in ps), "is_merge_origin": span_h * span_w > 1, "is_spanned": "1" in (tc.get("hMerge"), tc.get("vMerge")), "span_height": span_h, "span_width": span_w,
                    "margins": {k: number(cp.get(a)) if cp is not None else None for k, a in (("left", "marL"), ("right", "marR"), ("top", "marT"), ("bottom", "marB"))},
                    "vertical_anchor": cp.get("anchor") if cp is not None else None, "paragraphs": ps,
                }
            )
        rows.append(row)
    return {"row_count": len(rows), "column_count": max((len(r) for r in rows), default=0), "rows": rows, **{v: props is not None and props.get(k) == "1" for k, v in _BANDS.items()}}


def chart(root: ET.Element) -> dict[str, Any]:
    def points(node: ET.Element | None) -> list[Any]:
        found = sorted((number(p.get("idx")) or 0, p.findtext(q("c:v"))) for p in (node.iter(q("c:pt")) if node is not None else ()))
        return [v for _, v in found]

    def values(node: ET.Element | None) -> list[Any]:
        out: list[Any] = []
        for v in points(node):
            try:
                out.append(float(v))
            except (TypeError, ValueError):
                out.append(v)
        return out

    series = [{"name": "".join(str(v) for v in points(s.find(q("c:tx")))) or None, "values": values(s.find(q("c:val")))} for s in root.iter(q("c:ser"))]
    first = next(root.iter(q("c:ser")), None)
    title, legend, style = root.find(f".//{q('c:title')}"), root.find(f".//{q('c:legend')}"), root.find(q("c:style"))
    return {
        "title": "".join(t.text or "" for t in title.iter(q("a:t"))) or None if title is not None else None, "series": series,
        "categories": points(first.find(q("c:cat"))) if first is not None else [], "has_legend": legend is not None, "chart_style": number(style.get("val")) if style is not None else None,
    }


def visible(tree: ET.Element | None) -> list[dict]:
    """Names and text, or alternative text, of a layout's or master's shapes."""
    out = []
    for s in tree.iter() if tree is not None else ():
        if local(s.tag) in ("sp", "pic"):
            n = _name(s)
            text = "\n".join(p["text"] for p in paragraphs(s.find(q("p:txBody")))) or (n.get("descr") if n is not None else None)
            if text and text.strip():
                out.append({"name": n.get("name") if n is not None else None, "text": text})
    return out


class Slides:
    def __init__(self, content: bytes):
        self.package = Package(content)
        self.root = self.package.xml(PART)
        if self.root is None:
            raise Unreadable("the presentation part is missing")
        self.built = Built("python-pptx-native")

    def shapes(self, tree: ET.Element, index: int, part: str, rels: dict, parent: str | None = None) -> None:
        source = {"unit_index": index, "slide_number": index, "archive_part": part}
        z = -1
        for s in tree:
            if local(s.tag) not in _SHAPES:
                continue
            z += 1
            data = base(s, z, parent)
            eid = f"slide-{index}-shape-{data['shape_id']}-{self.built.orders.get(index, 0) + 1}"

            def add(kind: str, text: str | None, data: dict = data, eid: str = eid) -> None:
                self.built.element(index, eid, kind, text, data, dict(source), parent=parent)

            t, c = s.find(f".//{q('a:tbl')}"), s.find(f".//{q('c:chart')}")
            if local(s.tag) == "graphicFrame" and t is not None:
                data["table"] = table(t)
                add("table", "\n".join(" | ".join(x["text"] for x in r) for r in data["table"]["rows"]))
            elif local(s.tag) == "graphicFrame" and c is not None:
                root = self.package.xml(rels.get(c.get(q("r:id"), ""), ("", "", True))[0])
                data["chart"] = chart(root) if root is not None else None
                add("other", data["chart"]["title"] if data["chart"] else None)
            elif local(s.tag) == "pic":
                blip = s.find(f".//{q('a:blip')}")
                target = rels.get(blip.get(q("r:embed"), ""), ("", "", True)) if blip is not None else ("", "", True)
                if not target[2]:
                    data["image"] = self.package.image(target[0])
                    data["filename"] = data["image"]["filename"]
                add("image", (data["accessibility"] or {}).get("alt_text"))
            elif local(s.tag) == "grpSp":
                add("other", None)
                self.shapes(s, index, part, rels, eid)
            else:
                if s.find(f".//{q('p:oleObj')}") is not None:
                    self.built.report("pptx_ole_object", "detected_not_fully_parsed", data["name"], dict(source))
                ps = paragraphs(s.find(q("p:txBody")))
                data["paragraphs"] = ps
                text = "\n".join(p["text"] for p in ps) if ps else None
                heading = (data["placeholder"] or {}).get("type") in _HEADINGS.values()
                add("heading" if heading else "paragraph" if s.find(q("p:txBody")) is not None else "other", text)

    def extract(self) -> Built:
        rels = self.package.rels(PART)
        size = self.root.find(q("p:sldSz"))
        masters, layouts = [], {}
        for target, kind, _ in rels.values():
            if kind == "slideMaster":
                mr = self.package.rels(target)
                own = []
                for lt, lk, _ in mr.values():
                    if lk == "slideLayout":
                        lroot = self.package.xml(lt)
                        c = lroot.find(q("p:cSld")) if lroot is not None else None
                        layouts[lt] = {"name": c.get("name") if c is not None else None, "visible_text": visible(lroot), "master": target}
                        own.append({"name": layouts[lt]["name"], "visible_text": layouts[lt]["visible_text"]})
                masters.append({"part": target, "visible_text": visible(self.package.xml(target)), "layouts": own})
        by_master = {m["part"]: m["visible_text"] for m in masters}
        ids = [s.get(q("r:id"), "") for s in self.root.iter(q("p:sldId"))]
        self.built.properties["powerpoint"] = {
            "core_properties": self.package.core_properties(), "slide_count": len(ids), "slide_width": number(size.get("cx")) if size is not None else None,
            "slide_height": number(size.get("cy")) if size is not None else None, "masters": masters,
        }
        collect_assets(self.package, "pptx", self.built)
        for i, rid in enumerate(ids, 1):
            part = rels.get(rid, ("", "", True))[0]
            root = self.package.xml(part)
            if root is None:
                raise Unreadable(f"the slide part {part} is missing")
            own = self.package.rels(part)
            layout = next((layouts.get(t) for t, k, _ in own.values() if k == "slideLayout"), None) or {}
            c = root.find(q("p:cSld"))
            meta = {
                "hidden": root.get("show") in ("0", "false", "False"), "layout_name": layout.get("name"),
                "layout_visible_text": layout.get("visible_text", []), "master_visible_text": by_master.get(layout.get("master"), []),
            }
            self.built.unit(i, "slide", (c.get("name") if c is not None else None) or f"Slide {i}", meta)
            self.shapes(root.find(f".//{q('p:spTree')}"), i, part, own)
            for target, kind, _ in own.values():
                if kind == "notesSlide":
                    self.notes(i, target)
        report_parts(self.package, "pptx", self.built)
        link_images(self.built)
        return self.built

    def notes(self, index: int, part: str) -> None:
        source = {"unit_index": index, "slide_number": index, "archive_part": part}
        try:
            root = self.package.xml(part)
        except Unreadable:
            self.built.warn("pptx.notes.partial", "the speaker notes can't be read", "warning", source)
            return
        for s in root.iter(q("p:sp")) if root is not None else ():
            ph = next((e for e in s.iter() if local(e.tag) == "ph"), None)
            if ph is not None and ph.get("type") == "body":
                ps = paragraphs(s.find(q("p:txBody")))
                text = "\n".join(p["text"] for p in ps)
                if text.strip():
                    self.built.element(index, f"slide-{index}-notes", "note", text, {"role": "speaker_notes", "paragraphs": ps}, source)


def extract(content: bytes) -> Built:
    return Slides(content).extract()
