"""Legacy Office files and rendered Word pages by an outside converter.

The converter is LibreOffice where it is installed; another one can be passed. Each call has a profile and
a folder of its own and a time limit, so that tasks don't disturb one another.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import replace

from paperloom.options import Options
from paperloom.sources import pdf, sheet, slide, word
from paperloom.sources.office import Built, Unreadable

#: Legacy type and the modern one it is converted to (fixed values).
TARGETS = {"doc": "docx", "xls": "xlsx", "ppt": "pptx"}
Converter = Callable[[bytes, str, str, int], bytes]


class ToolMissing(Exception):
    """No converter is installed, or it failed."""


def find() -> str | None:
    return shutil.which("soffice") or shutil.which("libreoffice")


def libreoffice(content: bytes, suffix: str, target: str, timeout: int) -> bytes:
    """`content` of a file with `suffix` as a file of type `target`."""
    tool = find()
    if tool is None:
        raise ToolMissing("no converter is installed")
    with tempfile.TemporaryDirectory() as d:
        source = os.path.join(d, f"input.{suffix}")
        with open(source, "wb") as f:
            f.write(content)
        out = os.path.join(d, "out")
        os.mkdir(out)
        command = [tool, f"-env:UserInstallation=file://{d}/profile", "--headless", "--convert-to", target, "--outdir", out, source]
        try:
            done = subprocess.run(command, capture_output=True, timeout=timeout, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise ToolMissing("the converter didn't finish") from e
        made = [os.path.join(out, n) for n in os.listdir(out)]
        expected = os.path.join(out, f"input.{target}")
        path = expected if expected in made else max(made, key=os.path.getmtime, default=None)
        if path is None or done.returncode:
            raise ToolMissing("the converter made no file")
        with open(path, "rb") as f:
            return f.read()


def extract_legacy(content: bytes, kind: str, options: Options, convert: Converter = libreoffice) -> Built:
    """A legacy file by way of its modern form; the document keeps its own type, assets are numbered in the modern family."""
    target = TARGETS[kind]
    modern = convert(content, kind, target, options.libreoffice_timeout)
    parse = {"docx": lambda b: word.extract(b, options.render_word_pages), "xlsx": sheet.extract, "pptx": slide.extract}[target]
    built = parse(modern)
    built.properties["conversion"] = {"from": kind, "to": target}
    built.warn("office.legacy.converted", f"read by way of {target}", "info", None, {"from": kind, "to": target})
    return built


def add_pages(built: Built, content: bytes, kind: str, options: Options, convert: Converter = libreoffice) -> Built:
    """Text of the rendered pages of a Word document, or the warning that says why there is none."""
    built.warnings = [w for w in built.warnings if w["code"] not in ("docx.pagination.libreoffice_unavailable", "docx.pagination.disabled")]
    if not options.render_word_pages:
        built.warn("docx.pagination.disabled", "page rendering is switched off", "info")
        return built
    try:
        rendered = pdf.extract(convert(content, kind, "pdf", options.libreoffice_timeout))
    except ToolMissing as e:
        code = "docx.pagination.libreoffice_unavailable" if "installed" in str(e) else "docx.pagination.failed"
        built.warn(code, str(e), "info" if code.endswith("unavailable") else "warning")
        return built
    except Unreadable as e:
        built.warn("docx.pagination.failed", str(e))
        return built
    texts = {e["unit_index"]: e["text"] for e in rendered.elements if e["element_type"] == "paragraph"}
    pages = len(rendered.units)
    facts = built.properties.setdefault("word", {})
    facts["pagination"] = {"rendered_page_count": pages, "renderer": "libreoffice", "rendered_pages": [{"page_number": i, "text": texts.get(i, "")} for i in range(1, pages + 1)]}
    stored = facts.get("stored_page_count")
    if isinstance(stored, int) and stored != pages:
        built.warn("docx.page_count.mismatch", f"{stored} pages are stored, {pages} were rendered", "warning", None, {"stored": stored, "rendered": pages})
    return built


def legacy_extractor(kind: str, convert: Converter = libreoffice) -> Callable[[bytes, Options], Built]:
    return lambda b, o: extract_legacy(b, kind, o, convert)


def word_extractor(kind: str = "docx", convert: Converter = libreoffice) -> Callable[[bytes, Options], Built]:
    """Word extraction with rendered pages."""
    return lambda b, o: add_pages(word.extract(b, True), b, kind, replace(o), convert)
