"""Command line: inspect, extract, batch and doctor.

Ends with 0, with 1 if some files of a batch failed, with 2 on an error of this library and with 3 on one
of the file system.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from contextlib import nullcontext

from pyspark.errors import AnalysisException

from paperloom import __version__, doctor
from paperloom.options import Options
from paperloom.plans import pipeline
from paperloom.runtime import is_local, session
from paperloom.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom", description="Documents as canonical relations on Spark.")
    p.add_argument("--version", action="version", version=f"paperloom {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("inspect", help="detect a file's type by its content")
    one.add_argument("input")
    for name in ("extract", "batch"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("-o", "--output", required=name == "batch")
        if name == "extract":
            s.add_argument("--format", choices=("both", "json", "markdown"), default="both")
            s.add_argument("--json-indent", type=int, default=2)
        else:
            s.add_argument("--recursive", action="store_true")
        for flag in ("--no-assets", "--no-render-word-pages"):
            s.add_argument(flag, action="store_true")
        for flag, default in LIMITS.items():
            s.add_argument(flag, type=int, default=default)
        s.add_argument("--password", help="password of encrypted PDF files; it is seen in the list of processes")
        s.add_argument("--password-env", help="environment variable that holds the password")
    d = sub.add_parser("doctor", help="what this environment offers")
    d.add_argument("--json", action="store_true")
    return p


#: Flags of limits with their defaults (fixed values).
LIMITS = {"--max-file-size-mb": 512, "--max-archive-uncompressed-mb": 2048, "--max-archive-members": 100_000, "--max-archive-member-mb": 1024, "--libreoffice-timeout": 180}


def options_of(a: argparse.Namespace) -> Options:
    return Options(
        render_word_pages=not a.no_render_word_pages, max_file_size=a.max_file_size_mb << 20, max_expanded=a.max_archive_uncompressed_mb << 20, max_members=a.max_archive_members,
        max_member=a.max_archive_member_mb << 20, libreoffice_timeout=a.libreoffice_timeout, pdf_password=a.password or (os.environ.get(a.password_env) if a.password_env else None),
        json_indent=getattr(a, "json_indent", 2), extract_assets=not a.no_assets, output_format=getattr(a, "format", "both"),
    )


def inspected(row: dict) -> str:
    """The facts of detection, a line each."""
    lines = [f"{name}={row[key] or ''}" for name, key in (("type", "document_type"), ("extension", "extension"), ("media_type", "media_type"))]
    return "\n".join([*lines, *(f"{name}={str(bool(row[f'is_{name}'])).lower()}" for name in ("legacy_office", "macro_enabled", "encrypted_office"))])


def report(source: str, kind: str, counts: dict, target: str) -> str:
    """What was extracted from one file."""
    return "\n".join((
        f"Extracted: {source}", f"Type: {kind}", f"Units: {counts['units']} | Elements: {counts['elements']} | Assets: {counts['assets']}",
        f"Warnings: {counts['warnings']} | Unsupported/partial: {counts['unsupported']}", f"Output: {target}",
    ))


def extract_one(spark, a: argparse.Namespace) -> int:  # noqa: ANN001
    options = options_of(a)
    target = a.output or f"{os.path.splitext(a.input.rstrip('/'))[0]}_extracted"
    with tempfile.TemporaryDirectory() if is_local(spark.sparkContext) else nullcontext(os.path.join(target, "_rows")) as store:
        corpus = pipeline.corpus(files.read_file(spark, a.input), options, store=os.path.join(store, "rows"), judge=True)
        lost = corpus.rejects.first()
        if lost:
            print(f"Error: {lost.error_type}: {lost.error or ''}", file=sys.stderr)
            return 2
        sinks.write_packages(corpus, target, options, flat=True)
        print(report(a.input, corpus.documents.first().document_type, corpus.summary().first().asDict(), target))
    return 0


def extract_batch(spark, a: argparse.Namespace) -> int:  # noqa: ANN001
    options = options_of(a)
    with tempfile.TemporaryDirectory() if is_local(spark.sparkContext) else nullcontext(os.path.join(a.output, "_rows")) as store:
        corpus = pipeline.corpus(files.scan(spark, a.input, a.recursive), options, store=os.path.join(store, "rows"), judge=True)
        root = os.path.abspath(a.input)
        written = sinks.write_packages(corpus, a.output, options, root=root)
        good, bad = sinks.write_batch_summary(corpus, written, a.output, options, root)
        for r in corpus.rejects.orderBy("path").toLocalIterator():
            print(f"Failed: {r.path}: {r.error or r.error_type}", file=sys.stderr)
    print(f"Batch complete: {good} succeeded, {bad} failed.")
    return 1 if bad else 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "doctor":
        rows = doctor.environment()
        print(json.dumps([dict(zip(("component", "available", "version"), r, strict=True)) for r in rows], indent=2) if a.json else "\n".join(f"{c}: {v or ('yes' if ok else 'no')}" for c, ok, v in rows))
        return 0
    try:
        if not os.path.exists(a.input):
            raise FileNotFoundError(a.input)
        if os.path.isdir(a.input) != (a.command == "batch"):
            print(f"Error: {'a directory' if a.command == 'batch' else 'a file'} is needed: {a.input}", file=sys.stderr)
            return 2
        spark = session()
        if a.command == "inspect":
            print(inspected(files.detect(files.read_file(spark, a.input)).select("detected.*").first().asDict()))
            return 0
        return extract_one(spark, a) if a.command == "extract" else extract_batch(spark, a)
    except AnalysisException as e:
        print(f"Error: {e.getMessage()}", file=sys.stderr)
        return 2
    except OSError as e:
        print(f"I/O error: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
