"""Office packages: parts, relationships, assets and parts that are only reported (S13, J7, 2.14, 2.15)."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree as ET
from xml.parsers import expat

from paperloom.functions.text import MEDIA_TYPES

#: XML namespaces (fixed values).
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "x": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "c": "http://schemas.openxmlformats.org/drawingml/2006/chart",
    "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "xdr": "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "pr": "http://schemas.openxmlformats.org/package/2006/relationships",
    "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "ep": "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties",
}
#: Parts of a package that are kept as assets: folder in the package, asset type, folder under `assets/`; in the order
#: of their numbers (fixed values).
ASSET_FOLDERS = {
    "docx": (
        ("word/media/", "embedded_media", "media"),
        ("word/embeddings/", "embedded_object", "embeddings"),
        ("word/activeX/", "activex_part", "activex"),
        ("word/charts/", "raw_package_part", "package-parts/charts"),
        ("word/diagrams/", "raw_package_part", "package-parts/diagrams"),
        ("customXml/", "raw_package_part", "package-parts/custom-xml"),
        ("word/vbaProject.bin", "vba_project", "macros"),
    ),
    "pptx": (
        ("ppt/media/", "embedded_media", "media"),
        ("ppt/embeddings/", "embedded_object", "embeddings"),
        ("ppt/activeX/", "activex_part", "activex"),
        ("ppt/charts/", "raw_package_part", "package-parts/charts"),
        ("ppt/diagrams/", "raw_package_part", "package-parts/diagrams"),
        ("customXml/", "raw_package_part", "package-parts/custom-xml"),
        ("ppt/vbaProject.bin", "vba_project", "macros"),
    ),
    "xlsx": (
        ("xl/media/", "embedded_media", "media"),
        ("xl/embeddings/", "embedded_object", "embeddings"),
        ("xl/activeX/", "activex_part", "activex"),
        ("xl/charts/", "raw_package_part", "package-parts/charts"),
        ("xl/diagrams/", "raw_package_part", "package-parts/diagrams"),
        ("xl/pivotTables/", "raw_package_part", "package-parts/pivot-tables"),
        ("xl/slicers/", "raw_package_part", "package-parts/slicers"),
        ("xl/queryTables/", "raw_package_part", "package-parts/query-tables"),
        ("customXml/", "raw_package_part", "package-parts/custom-xml"),
        ("xl/connections.xml", "raw_package_part", "package-parts/connections"),
        ("xl/vbaProject.bin", "vba_project", "macros"),
    ),
}
#: Asset types that may run, and the media type of a macro project (fixed values).
ACTIVE = ("embedded_object", "activex_part", "vba_project")
MACRO_TYPE = "application/vnd.ms-office.vbaProject"
#: Family, prefix, object type and status of parts that are reported (fixed values).
REPORTED = (
    ("docx", "word/charts/", "docx_chart", "detected_not_fully_parsed"),
    ("docx", "word/diagrams/", "docx_smartart", "detected_not_fully_parsed"),
    ("docx", "word/embeddings/", "docx_embedded_object", "detected_not_fully_parsed"),
    ("xlsx", "xl/pivotTables/", "xlsx_pivot_table", "detected_not_fully_parsed"),
    ("xlsx", "xl/slicers/", "xlsx_slicer", "detected_not_fully_parsed"),
    ("xlsx", "xl/threadedComments/", "xlsx_threaded_comments", "detected_not_fully_parsed"),
    ("xlsx", "xl/queryTables/", "xlsx_query_table", "detected_not_fully_parsed"),
    ("xlsx", "xl/connections.xml", "xlsx_data_connections", "detected_not_fully_parsed"),
    ("xlsx", "xl/externalLinks/", "external_workbook_links", "detected_partially_parsed"),
    ("pptx", "ppt/diagrams/", "pptx_smartart", "detected_not_fully_parsed"),
    ("pptx", "ppt/embeddings/", "pptx_embedded_object", "detected_not_fully_parsed"),
    ("pptx", "ppt/comments/", "pptx_comments", "detected_not_fully_parsed"),
)
_CORE = ("author", "category", "comments", "content_status", "created", "identifier", "keywords", "language", "last_modified_by", "last_printed", "modified", "revision", "subject", "title", "version")
_CORE_TAGS = {"creator": "author", "description": "comments", "contentStatus": "content_status", "lastModifiedBy": "last_modified_by", "lastPrinted": "last_printed"}


def q(name: str) -> str:
    """A prefixed name as ElementTree writes it."""
    prefix, _, local = name.partition(":")
    return f"{{{NS[prefix]}}}{local}"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Unreadable(Exception):
    """The file can't be parsed."""


class _Stop(Exception):
    pass


def declares_type(raw: bytes) -> bool:
    """Whether an XML document has a DOCTYPE, by the parser itself, in any encoding and behind any comment."""
    found = []

    def doctype(*_: Any) -> None:
        found.append(True)
        raise _Stop

    def element(*_: Any) -> None:
        raise _Stop

    p = expat.ParserCreate()
    p.StartDoctypeDeclHandler, p.StartElementHandler = doctype, element
    try:
        p.Parse(raw, True)
    except (_Stop, expat.ExpatError):
        pass  # what isn't well formed is refused by the reader of the tree
    return bool(found)


@dataclass
class Built:
    """What an extractor found, in canonical form but for doc_id; `data` values are plain Python."""

    extractor: str
    properties: dict[str, Any] = field(default_factory=dict)
    units: list[dict] = field(default_factory=list)
    elements: list[dict] = field(default_factory=list)
    assets: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    unsupported: list[dict] = field(default_factory=list)
    orders: dict[int, int] = field(default_factory=dict)

    def unit(self, index: int, kind: str, name: str | None, metadata: dict | None = None) -> dict:
        u = {"unit_index": index, "kind": kind, "name": name, "metadata": metadata if metadata is not None else {}}
        self.units.append(u)
        return u

    def element(self, unit: int, element_id: str, kind: str, text: str | None, data: dict | None = None, source: dict | None = None, markdown: str | None = None, parent: str | None = None) -> dict:
        e = {"unit_index": unit, "element_id": element_id, "element_type": kind, "element_order": self._next(unit), "text": text, "markdown": markdown, "data": data or {}, "source": source, "parent_element_id": parent}
        self.elements.append(e)
        return e

    def _next(self, unit: int) -> int:
        self.orders[unit] = self.orders.get(unit, 0) + 1
        return self.orders[unit]

    def warn(self, code: str, message: str, severity: str = "warning", source: dict | None = None, details: dict | None = None) -> None:
        self.warnings.append({"code": code, "message": message, "severity": severity, "source": source, "details": details or {}})

    def report(self, kind: str, status: str, description: str | None = None, source: dict | None = None, metadata: dict | None = None) -> None:
        self.unsupported.append({"object_type": kind, "status": status, "description": description, "source": source, "metadata": metadata or {}})


class Package:
    """A ZIP package with its parts read once."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            self.names = self.zip.namelist()
        except (zipfile.BadZipFile, OSError) as e:
            raise Unreadable("the package can't be opened") from e
        self.known = set(self.names)

    def read(self, name: str) -> bytes:
        try:
            return self.zip.read(name)
        except (KeyError, zipfile.BadZipFile, zlib.error, EOFError, RuntimeError) as e:
            raise Unreadable(f"the part {name} can't be read") from e

    def xml(self, name: str) -> ET.Element | None:
        """The root of a part; null where it is absent. Parts with a document type are refused."""
        if name not in self.known:
            return None
        raw = self.read(name)
        if declares_type(raw):
            raise Unreadable(f"the part {name} declares a document type")
        try:
            return ET.fromstring(raw)
        except ET.ParseError as e:
            raise Unreadable(f"the part {name} isn't well formed") from e

    def rels(self, name: str) -> dict[str, tuple[str, str, bool]]:
        """rId -> (target part or address, kind, external) of a part."""
        folder, base = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
        out = {}
        for r in root if root is not None else ():
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not external:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (target, r.get("Type", "").rpartition("/")[2], external)
        return out

    def core_properties(self) -> dict[str, str]:
        root = self.xml("docProps/core.xml")
        found = {_CORE_TAGS.get(local(e.tag), local(e.tag)): e.text for e in (root if root is not None else ())}
        return {k: found[k] for k in _CORE if found.get(k)}

    def image(self, name: str) -> dict[str, Any]:
        raw = self.read(name) if name in self.known else b""
        return {"filename": posixpath.basename(name), "archive_part": name, "sha1": hashlib.sha1(raw).hexdigest(), "sha256": hashlib.sha256(raw).hexdigest(), **pixels(raw)}


def pixels(raw: bytes) -> dict[str, Any]:
    """Format and size of a picture by its header."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        w, h = struct.unpack(">II", raw[16:24])
        return {"format": "png", "width_px": w, "height_px": h}
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        w, h = struct.unpack("<HH", raw[6:10])
        return {"format": "gif", "width_px": w, "height_px": h}
    if raw[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(raw) and raw[i] == 0xFF:
            size = struct.unpack(">H", raw[i + 2 : i + 4])[0]
            if 0xC0 <= raw[i + 1] <= 0xCF and raw[i + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[i + 5 : i + 9])
                return {"format": "jpeg", "width_px": w, "height_px": h}
            i += 2 + size
        return {"format": "jpeg", "width_px": None, "height_px": None}
    return {"format": None, "width_px": None, "height_px": None}


def safe(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", posixpath.basename(name)).strip("._") or "asset.bin"


def collect_assets(package: Package, family: str, built: Built) -> None:
    """The package's assets, ranked by the folder they are in and then by name; equal paths are told apart by the number."""
    ranked = []
    for name in package.known:
        for rank, (place, kind, folder) in enumerate(ASSET_FOLDERS[family]):
            inside = name.startswith(place) and not name.endswith("/") if place.endswith("/") else name == place
            if inside:
                ranked.append((rank, name, kind, folder))
    taken: dict[str, int] = {}
    for i, (_, name, kind, folder) in enumerate(sorted(ranked), 1):
        raw, base = package.read(name), safe(name)
        first = taken.setdefault(f"{folder}/{base}", i) == i
        a = {"asset_id": f"{family}-asset-{i}", "asset_type": kind, "original_name": base, "output_path": f"assets/{folder}/{base if first else f'{i:03d}_{base}'}"}
        guess = MEDIA_TYPES.get(base.rpartition(".")[2].lower()) if "." in base else None
        a["media_type"] = MACRO_TYPE if kind == "vba_project" and guess in (None, "application/octet-stream") else guess
        a |= {"sha256": hashlib.sha256(raw).hexdigest(), "size_bytes": len(raw), "source": {"archive_part": name}}
        a["metadata"] = {"archive_member": name, "potentially_active_content": kind in ACTIVE}
        built.assets.append(a)


def report_parts(package: Package, family: str, built: Built) -> None:
    for fam, prefix, kind, status in REPORTED:
        members = sorted(n for n in package.names if fam == family and n.startswith(prefix) and not n.endswith("/"))
        if members:
            built.report(kind, status, f"{len(members)} package part(s)", {"archive_part": members[0]}, {"count": len(members), "parts": members})
    macros = [n for n in package.names if n.endswith("vbaProject.bin")]
    if macros:
        built.report("vba_project", "detected_not_parsed", "macro code is kept as an asset", {"archive_part": macros[0]})


def link_images(built: Built) -> None:
    """asset_id of each image by its hash; of assets with one hash the last is taken."""
    by_hash = {a["sha256"]: a["asset_id"] for a in built.assets}

    def visit(v: Any) -> None:
        if isinstance(v, dict):
            if v.get("sha256") in by_hash and "filename" in v:
                v["asset_id"] = by_hash[v["sha256"]]
            for x in v.values():
                visit(x)
        elif isinstance(v, list):
            for x in v:
                visit(x)

    for e in built.elements:
        visit(e["data"])
    for u in built.unsupported:
        visit(u["metadata"])


def text_of(node: ET.Element, *tags: str) -> str:
    names = {q(t) for t in tags}
    return "".join(e.text or "" for e in node.iter() if e.tag in names)


def number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def switch(node: ET.Element | None) -> bool | None:
    """A toggle property: absent is null, which isn't false."""
    if node is None:
        return None
    return (node.get(q("w:val")) or "true").lower() not in ("0", "false", "off", "none")
