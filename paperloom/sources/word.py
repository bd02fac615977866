"""Word documents (W1-W25): one unit, the body's blocks in order, then stories, notes and special content."""

from __future__ import annotations

from typing import Any
from xml.etree import ElementTree as ET

from paperloom.sources.office import Built, Package, Unreadable, collect_assets, link_images, local, number, q, report_parts, switch, text_of

_FONT = {"rFonts": "name", "sz": "size_half_points", "color": "color", "highlight": "highlight", "strike": "strike", "caps": "all_caps", "smallCaps": "small_caps", "vertAlign": "vertical_align", "u": "underline_style", "vanish": "hidden", "lang": "language"}
_EXTENDED = {"Application": False, "AppVersion": False, "Company": False, "Pages": True, "Words": True, "Characters": True, "CharactersWithSpaces": True, "Lines": True, "Paragraphs": True}
_STORIES = (("header", "default"), ("header", "first"), ("header", "even"), ("footer", "default"), ("footer", "first"), ("footer", "even"))
PART = "word/document.xml"


class Word:
    def __init__(self, content: bytes):
        self.package = Package(content)
        self.root = self.package.xml(PART)
        if self.root is None:
            raise Unreadable("the document part is missing")
        self.built = Built("python-docx-native")
        self.rels = self.package.rels(PART)
        styles = self.package.xml("word/styles.xml")
        self.styles = {s.get(q("w:styleId")): _val(s.find(q("w:name"))) for s in (styles.iter(q("w:style")) if styles is not None else ())}
        self.default = next((_val(s.find(q("w:name"))) for s in (styles.iter(q("w:style")) if styles is not None else ()) if s.get(q("w:default")) == "1" and s.get(q("w:type")) == "paragraph"), "Normal")
        self.source = {"unit_index": 1, "archive_part": PART}

    # --- inline content

    def style(self, properties: ET.Element | None, tag: str) -> str | None:
        e = properties.find(q(tag)) if properties is not None else None
        sid = _val(e)
        return self.styles.get(sid, sid)

    def run(self, r: ET.Element, rels: dict) -> dict[str, Any]:
        p = r.find(q("w:rPr"))
        content: list[dict] = []
        for node in r:
            tag = local(node.tag)
            if tag in ("t", "delText"):
                content.append({"type": "text", "text": node.text or ""})
            elif tag == "tab":
                content.append({"type": "text", "text": "\t"})
            elif tag in ("br", "cr"):
                content.append({"type": "page_break"} if node.get(q("w:type")) == "page" else {"type": "text", "text": "\n"})
            elif tag == "lastRenderedPageBreak":
                content.append({"type": "rendered_page_break"})
            elif tag in ("drawing", "pict"):
                blips = list(node.iter(q("a:blip")))
                for b in blips:
                    target = rels.get(b.get(q("r:embed"), ""), ("", "", True))
                    content.append({"type": "image", **self.package.image(target[0])} if not target[2] and target[0] in self.package.known else {"type": "drawing"})
                if not blips:
                    content.append({"type": "drawing"})
        find = (lambda t: p.find(q(t))) if p is not None else (lambda t: None)
        font = {}
        for tag, name in _FONT.items():
            e = find(f"w:{tag}")
            if tag == "rFonts":
                font[name] = e.get(q("w:ascii")) if e is not None else None
            elif tag in ("strike", "caps", "smallCaps", "vanish"):
                font[name] = switch(e)
            else:
                font[name] = _val(e)
        return {
            "text": "".join(c["text"] for c in content if c["type"] == "text"), "bold": switch(find("w:b")), "italic": switch(find("w:i")),
            "underline": None if find("w:u") is None else _val(find("w:u")) != "none", "style": self.style(p, "w:rStyle"), "font": font, "content": content,
        }

    def paragraph(self, p: ET.Element, rels: dict | None = None) -> dict[str, Any]:
        rels = self.rels if rels is None else rels
        props = p.find(q("w:pPr"))
        runs, links, text = [], [], []
        for node in p:
            tag = local(node.tag)
            if tag == "r":
                runs.append(self.run(node, rels))
                text.append(runs[-1]["text"])
            elif tag == "hyperlink":
                inner = [self.run(r, rels) for r in node.iter(q("w:r"))]
                said = "".join(r["text"] for r in inner)
                address = rels.get(node.get(q("r:id"), ""), (None, "", True))[0]
                fragment = node.get(q("w:anchor"))
                links.append({"text": said, "address": address, "fragment": fragment, "url": f"{address or ''}{'#' + fragment if fragment else ''}" or None, "contains_page_break": any(c["type"] == "page_break" for r in inner for c in r["content"])})
                text.append(said)
        style = self.style(props, "w:pStyle") or self.default
        num = props.find(q("w:numPr")) if props is not None else None
        numbering = {"num_id": number(_val(num.find(q("w:numId")))), "level": number(_val(num.find(q("w:ilvl")))) or 0} if num is not None else None
        breaks = [c for r in runs for c in r["content"] if c["type"].endswith("page_break")]
        ind, gap = (props.find(q("w:ind")), props.find(q("w:spacing"))) if props is not None else (None, None)

        def toggle(tag: str) -> bool | None:
            return switch(props.find(q(tag))) if props is not None else None

        return {
            "text": "".join(text), "style": style, "numbering": numbering, "alignment": _val(props.find(q("w:jc"))) if props is not None else None, "runs": runs, "hyperlinks": links,
            "contains_page_break": any(c["type"] == "page_break" for c in breaks), "rendered_page_break_count": sum(c["type"] == "rendered_page_break" for c in breaks),
            "format": {
                "left_indent": _twips(ind, "left"), "right_indent": _twips(ind, "right"), "first_line_indent": _twips(ind, "firstLine"), "space_before": _twips(gap, "before"), "space_after": _twips(gap, "after"),
                "line_spacing": gap.get(q("w:line")) if gap is not None else None, "keep_together": toggle("w:keepLines"), "keep_with_next": toggle("w:keepNext"), "page_break_before": toggle("w:pageBreakBefore"), "widow_control": toggle("w:widowControl"),
            },
        }

    def table(self, t: ET.Element, depth: int = 0, rels: dict | None = None) -> dict[str, Any]:
        rows = []
        for tr in [x for x in t if local(x.tag) == "tr"]:
            cells = []
            for tc in [x for x in tr if local(x.tag) == "tc"]:
                content = []
                for node in tc:
                    if local(node.tag) == "p":
                        content.append({"type": "paragraph"} | self.paragraph(node, rels))
                    elif local(node.tag) == "tbl":
                        content.append({"type": "table", "table": self.table(node, depth + 1, rels)})
                align = tc.find(f"{q('w:tcPr')}/{q('w:vAlign')}")
                span = tc.find(f"{q('w:tcPr')}/{q('w:gridSpan')}")
                cell = {"text": "\n".join(c["text"] for c in content if c["type"] == "paragraph"), "vertical_alignment": _val(align), "content": content}
                cells += [cell] * max(1, number(_val(span)) or 1)
            rows.append(cells)
        return {"row_count": len(rows), "column_count": max((len(r) for r in rows), default=0), "nested_depth": depth, "style": self.style(t.find(q("w:tblPr")), "w:tblStyle"), "rows": rows}

    # --- elements

    def kind(self, data: dict) -> str:
        style = (data["style"] or "").lower()
        if style.startswith(("heading", "title")):
            return "heading"
        return "list" if data["numbering"] or style.startswith("list") else "paragraph"

    def body(self) -> None:
        n = {"paragraph": 0, "table": 0}
        for node in _blocks(self.root.find(q("w:body"))):
            if local(node.tag) == "p":
                n["paragraph"] += 1
                data = self.paragraph(node)
                self.built.element(1, f"doc-paragraph-{n['paragraph']}", self.kind(data), data.pop("text"), {"role": "body"} | data, dict(self.source))
            else:
                n["table"] += 1
                data = self.table(node)
                text = "\n".join(" | ".join(c["text"] for c in row) for row in data["rows"])
                self.built.element(1, f"doc-table-{n['table']}", "table", text, data, dict(self.source))

    def sections(self) -> list[dict]:
        out, inherited = [], {}
        for i, s in enumerate(self.root.iter(q("w:sectPr")), 1):
            size, margin, start, columns = (s.find(q(f"w:{t}")) for t in ("pgSz", "pgMar", "type", "cols"))
            own = {(local(r.tag)[: -len("Reference")], r.get(q("w:type"), "default")): self.rels.get(r.get(q("r:id"), ""), (None,))[0] for r in s if local(r.tag) in ("headerReference", "footerReference")}
            stories = {}
            for story in _STORIES:
                linked = story not in own
                part = own.get(story) or inherited.get(story)
                inherited[story] = part
                stories["_".join(reversed(story)) if story[1] != "default" else story[0]] = {"is_linked_to_previous": linked, **self.story(part)}
            out.append(
                {
                    "index": i, "start_type": _val(start), "orientation": size.get(q("w:orient"), "portrait") if size is not None else None, "page_width": _twips(size, "w"), "page_height": _twips(size, "h"),
                    **{f"{k}_margin": _twips(margin, k) for k in ("left", "right", "top", "bottom")}, "gutter": _twips(margin, "gutter"), "header_distance": _twips(margin, "header"), "footer_distance": _twips(margin, "footer"),
                    "column_count": number(columns.get(q("w:num"))) if columns is not None else None, "stories": stories,
                }
            )
        return out

    def story(self, part: str | None) -> dict:
        root = self.package.xml(part) if part else None
        if root is None:
            return {"part": part, "blocks": []}
        rels = self.package.rels(part)
        return {"part": part, "blocks": [{"type": "paragraph"} | self.paragraph(n, rels) if local(n.tag) == "p" else {"type": "table", "table": self.table(n, 0, rels)} for n in _blocks(root)]}

    def stories(self, sections: list[dict]) -> None:
        for s in sections:
            for name, story in s["stories"].items():
                if story["is_linked_to_previous"] and s["index"] > 1:
                    continue
                for b, block in enumerate(story["blocks"], 1):
                    role, source = {"role": name, "section": s["index"]}, self.source | {"archive_part": story["part"]}
                    eid = f"doc-section-{s['index']}-{name}-{b}"
                    if block["type"] == "table":
                        text = "\n".join(" | ".join(c["text"] for c in row) for row in block["table"]["rows"])
                        self.built.element(1, eid, "table", text, role | {"table": block["table"]}, source)
                    elif block["text"].strip():
                        self.built.element(1, eid, self.kind(block), block["text"], role | {k: v for k, v in block.items() if k not in ("text", "type")}, source)

    def special(self) -> dict[str, int]:
        counts = {}
        comments = self.package.xml("word/comments.xml")
        found = list(comments.iter(q("w:comment"))) if comments is not None else []
        for n, c in enumerate(found, 1):
            text = "\n".join(text_of(p, "w:t") for p in c.iter(q("w:p")))
            self.built.element(1, f"doc-comment-{n}", "note", text, {"role": "comment", "comment_id": c.get(q("w:id")), "author": c.get(q("w:author")), "initials": c.get(q("w:initials")), "timestamp": c.get(q("w:date"))}, self.source | {"archive_part": "word/comments.xml"})
        counts["comment_count"] = len(found)
        for kind in ("footnote", "endnote"):
            part = f"word/{kind}s.xml"
            root = self.package.xml(part)
            notes = [(x.get(q("w:id")), text_of(x, "w:t", "w:delText")) for x in (root if root is not None else ())]
            notes = [(i, t) for i, t in notes if i not in ("-1", "0") and t.strip()]
            for i, t in notes:
                self.built.element(1, f"doc-{kind}-{i}", "note", t, {"role": kind, "note_id": i}, self.source | {"archive_part": part})
            counts[f"{kind}_count"] = len(notes)
        boxes = [text_of(x, "w:t", "w:delText") for x in self.root.iter(q("w:txbxContent"))]
        for n, t in enumerate(boxes, 1):
            if t.strip():
                self.built.element(1, f"doc-textbox-{n}", "paragraph", t, {"role": "text_box"}, dict(self.source))
        counts["text_box_count"] = sum(bool(t.strip()) for t in boxes)
        n = 0
        for kind, tag in (("insertion", "w:ins"), ("deletion", "w:del")):
            for x in self.root.iter(q(tag)):
                t = text_of(x, "w:t", "w:delText")
                if t:
                    n += 1
                    self.built.element(1, f"doc-change-{n}", "note", t, {"role": "tracked_change", "change_type": kind, "author": x.get(q("w:author")), "date": x.get(q("w:date")), "change_id": x.get(q("w:id"))}, dict(self.source))
        counts["tracked_change_count"] = n
        controls = list(self.root.iter(q("w:sdt")))
        for n, x in enumerate(controls, 1):
            pr, content = x.find(q("w:sdtPr")), x.find(q("w:sdtContent"))
            alias, tag = (_val(pr.find(q(f"w:{t}"))) if pr is not None else None for t in ("alias", "tag"))
            self.built.element(1, f"doc-content-control-{n}", "paragraph", text_of(content, "w:t", "w:delText") if content is not None else "", {"role": "content_control", "index": n, "alias": alias, "tag": tag}, dict(self.source))
        counts["content_control_count"] = len(controls)
        formulas = list(self.root.iter(q("m:oMath")))
        for n, x in enumerate(formulas, 1):
            self.built.element(1, f"doc-formula-{n}", "formula", text_of(x, "m:t"), {"role": "office_math"}, dict(self.source))
        counts["formula_count"] = len(formulas)
        fields = [(x.text or "").strip() for x in self.root.iter(q("w:instrText"))] + [(x.get(q("w:instr")) or "").strip() for x in self.root.iter(q("w:fldSimple"))]
        fields = list(dict.fromkeys(f for f in fields if f))
        for n, f in enumerate(fields, 1):
            self.built.element(1, f"doc-field-{n}", "metadata", f, {"role": "field_instruction"}, dict(self.source))
        counts["field_count"] = len(fields)
        return counts

    def extract(self, render: bool = True) -> Built:
        extended = {}
        app = self.package.xml("docProps/app.xml")
        for e in app if app is not None else ():
            if local(e.tag) in _EXTENDED and e.text:
                n = number(e.text) if _EXTENDED[local(e.tag)] else None
                extended[local(e.tag)] = e.text if n is None else n
        unit = self.built.unit(1, "document", "Document")
        self.body()
        sections = self.sections()
        self.stories(sections)
        counts = self.special()
        collect_assets(self.package, "docx", self.built)
        report_parts(self.package, "docx", self.built)
        chunks = sum(1 for _ in self.root.iter(q("w:altChunk")))
        if chunks:
            self.built.report("docx_altchunk", "detected_not_fully_parsed", "embedded alternative content", dict(self.source), {"count": chunks})
        link_images(self.built)
        body = self.root.find(q("w:body"))
        blocks = list(_blocks(body))
        pages = extended.get("Pages")
        self.built.properties["word"] = {
            "core_properties": self.package.core_properties(), "extended_properties": extended, "stored_page_count": pages if isinstance(pages, int) else None,
            "section_count": len(sections), "inline_shape_count": sum(1 for _ in self.root.iter(q("wp:inline"))), "sections": sections,
        }
        unit["metadata"] = {"paragraph_count": sum(local(b.tag) == "p" for b in blocks), "table_count": sum(local(b.tag) == "tbl" for b in blocks), "section_count": len(sections), "inline_shape_count": sum(1 for _ in self.root.iter(q("wp:inline"))), **counts}
        if not isinstance(pages, int):
            self.built.warn("docx.page_count.unavailable", "the document stores no page count", "info", dict(self.source))
        if not render:
            self.built.warn("docx.pagination.disabled", "page rendering is switched off", "info", dict(self.source))
        else:
            self.built.warn("docx.pagination.libreoffice_unavailable", "no converter for page rendering", "info", dict(self.source))
        return self.built


def _blocks(container: ET.Element | None):  # noqa: ANN202
    """Paragraphs and tables of a story, in order; content controls are looked into."""
    for node in container if container is not None else ():
        tag = local(node.tag)
        if tag in ("p", "tbl"):
            yield node
        elif tag == "sdt":
            yield from _blocks(node.find(q("w:sdtContent")))


def _val(e: ET.Element | None) -> str | None:
    return None if e is None else e.get(q("w:val"))


def _twips(e: ET.Element | None, name: str) -> int | None:
    """A twentieth of a point in EMU."""
    n = number(e.get(q(f"w:{name}"))) if e is not None else None
    return None if n is None else n * 635


def extract(content: bytes, render: bool = True) -> Built:
    return Word(content).extract(render)



