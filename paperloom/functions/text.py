"""Column functions for names, paths and Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by extension; a fixed table, so results don't depend on the machine (fixed values).
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "docm": "application/vnd.ms-word.document.macroEnabled.12",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "pptm": "application/vnd.ms-powerpoint.presentation.macroEnabled.12",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "zip": "application/zip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp",
    "tiff": "image/tiff", "tif": "image/tiff", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf", "xml": "application/xml",
    "rels": "application/xml", "bin": "application/octet-stream", "txt": "text/plain", "html": "text/html", "csv": "text/csv", "json": "application/json",
}


def md_escape(text: Column) -> Column:
    """Text for a Markdown table cell; null is empty."""
    x = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def safe_name(path: Column) -> Column:
    """A file name of letters, digits, dot, underscore and hyphen only."""
    clean = F.btrim(F.regexp_replace(basename(path), r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("asset.bin"))


def unsafe_path(path: Column) -> Column:
    """Absolute, or with a parent step."""
    return path.startswith("/") | F.array_contains(F.split(path, "/", -1), "..")


def media_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.element_at(table, ext)


def split_lines(text: Column) -> Column:
    """Lines by any line break, without one empty last line."""
    parts = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
