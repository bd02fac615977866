"""PDF elements from a layout or OCR backend.

A backend is a callable from a file's bytes to items: label, text, page_number, bbox, coordinate_system,
level, layer, ref, and for tables grid (rows of {text, row_span, column_span, column_header, row_header}).
None is bundled; where it fails, the operators' text is used and a warning says so.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from paperloom.options import Options
from paperloom.sources import pdf
from paperloom.sources.office import Built

Backend = Callable[[bytes], list[dict[str, Any]]]
#: Kinds of items by label (fixed values).
KINDS = {"title": "heading", "section_header": "heading", "field_heading": "heading", "table": "table", "picture": "image", "figure": "image", "formula": "formula", "code": "code"}


def kind_of(label: str) -> str:
    return "list" if "list" in label and label not in KINDS else KINDS.get(label, "paragraph")


def text_of(item: dict[str, Any]) -> str | None:
    if item.get("text"):
        return item["text"]
    grid = item.get("grid") or []
    return "\n".join(" | ".join(c.get("text", "") for c in row) for row in grid) or None


def extractor(backend: Backend) -> Callable[[bytes, Options], Built]:
    """A PDF extractor that takes its elements from `backend` and everything else from the file."""

    def extract(content: bytes, options: Options) -> Built:
        built = pdf.extract(content, options.pdf_password)
        try:
            items = backend(content)
        except Exception as e:  # noqa: BLE001  a backend's failure is a warning, not a lost file
            built.warn("pdf.docling.failed", "the layout backend failed; text comes from the page's operators", "warning", None, {"error": type(e).__name__})
            return built
        built.warnings = [w for w in built.warnings if w["code"] not in ("pdf.docling.unavailable", "pdf.possible_scanned_document")]
        pages = {u["unit_index"] for u in built.units}
        others = [e for e in built.elements if not e["element_id"].endswith("-text")]
        built.elements, built.orders = [], {}
        unpaged = len(pages) + 1
        for n, item in enumerate(items, 1):
            page = item.get("page_number")
            unit = page if page in pages else unpaged
            if unit == unpaged and unpaged not in pages:
                pages.add(unpaged)
                built.unit(unpaged, "document", "Unpaged content")
            box = item.get("bbox")
            source = {"unit_index": page if page in pages else None, "page_number": page, "bbox": dict(zip(("left_x", "top_y", "right_x", "bottom_y"), map(float, box), strict=True)) | {"coordinate_system": item.get("coordinate_system")} if box else None}
            data = {k: item.get(k) for k in ("label", "level", "layer", "ref")} | {"backend": "layout"}
            if item.get("grid"):
                data["table"] = {"rows": item["grid"], "row_count": len(item["grid"]), "column_count": max(map(len, item["grid"]))}
            built.element(unit, f"page-{page or 0}-docling-{n}", kind_of(item.get("label") or ""), text_of(item), data, source)
        for e in others:  # links and notes follow the page's own items
            built.element(e["unit_index"], e["element_id"], e["element_type"], e["text"], e["data"], e["source"])
        return built

    return extract
