"""What this environment offers."""

from __future__ import annotations

import importlib.metadata
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession

MODULES = ("pyspark", "pyarrow", "pandas", "numpy")


def _version(command: list[str]) -> str | None:
    try:
        out = subprocess.run(command, capture_output=True, text=True, timeout=15, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return (out.stdout or out.stderr).strip().split("\n")[0] or None


def environment() -> list[tuple[str, bool, str | None]]:
    """(component, available, version) of the modules and outside tools."""
    rows: list[tuple[str, bool, str | None]] = []
    for m in MODULES:
        try:
            rows.append((m, True, importlib.metadata.version(m)))
        except importlib.metadata.PackageNotFoundError:
            rows.append((m, False, None))
    office = shutil.which("soffice") or shutil.which("libreoffice")
    rows.append(("libreoffice", office is not None, _version([office, "--version"]) if office else None))
    ocr = shutil.which("tesseract")
    rows.append(("tesseract", ocr is not None, _version([ocr, "--version"]) if ocr else None))
    return rows


def report(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(environment(), "component string, available boolean, version string")
