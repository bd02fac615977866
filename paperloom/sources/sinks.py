"""Output packages (K1-K8): a directory per document with its JSON, Markdown, assets and manifest.

Executors write the files of their own rows; nothing passes through the driver. The target is a path that
every executor sees.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.manifest import output_directory, relative_path
from paperloom.options import Options
from paperloom.plans.pipeline import Corpus
from paperloom.runtime import cut
from paperloom.sources import convert, pdf
from paperloom.sources.office import Built, Package, Unreadable, collect_assets

_WRITTEN = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.StringType()), ("path", T.StringType()), ("size_bytes", T.LongType()), ("sha256", T.StringType()), ("is_asset", T.BooleanType()))])


def put(root: str, relative: str, raw: bytes) -> None:
    """Write under `root`, by a rename, so that a repeated task leaves a whole file."""
    if relative.startswith("/") or ".." in relative.split("/"):
        raise ValueError("the path leaves the output directory")
    path = os.path.join(root, *relative.split("/"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(raw)
    os.replace(part, path)


def payloads(kind: str, content: bytes, password: str | None, timeout: int = 180) -> Iterator[tuple[str, bytes]]:
    """output_path and bytes of a file's assets, named and numbered as its extractor declares them."""
    if kind in convert.TARGETS:  # a legacy file's assets are its modern form's
        content, kind = convert.libreoffice(content, kind, convert.TARGETS[kind], timeout), convert.TARGETS[kind]
    if kind == "pdf":
        yield from pdf.payloads(content, password).items()
        return
    package, built = Package(content), Built("")
    collect_assets(package, kind.replace("m", "x") if kind.endswith("m") else kind, built)
    for a in built.assets:
        raw = package.read(a["source"]["archive_part"])
        if hashlib.sha256(raw).hexdigest() == a["sha256"]:
            yield a["output_path"], raw


def _directory(flat: bool, root: str | None) -> Column:
    return F.lit(".") if flat else output_directory("doc_id", root)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_WRITTEN.names, r, strict=True)) for r in rows], schema=_ARROW)


def write_assets(corpus: Corpus, target: str, options: Options = Options(), flat: bool = False, root: str | None = None) -> DataFrame:  # noqa: B008
    """Writes the assets where their file is read, so that no file's bytes are shuffled."""
    files = corpus.files.select(F.col("path").alias("doc_id"), "document_type", "content").withColumn("directory", _directory(flat, root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: list[tuple] = []
            for doc, kind, content, directory in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    for path, raw in payloads(kind, content, options.pdf_password, options.libreoffice_timeout):
                        put(os.path.join(target, directory), path, raw)
                        done.append((doc, path, len(raw), hashlib.sha256(raw).hexdigest(), True))
                except (Unreadable, convert.ToolMissing, ValueError, KeyError, TypeError, EOFError):
                    continue  # a file that can't be parsed is a reject already; the manifest counts what is missing
            yield _batch(done)

    return files.mapInArrow(run, _WRITTEN)


def write_texts(corpus: Corpus, target: str, options: Options = Options(), flat: bool = False, root: str | None = None) -> DataFrame:  # noqa: B008
    """Writes document.json and document.md."""
    out = corpus.documents.select("doc_id", _directory(flat, root).alias("directory"))
    none = F.lit(None).cast("string")
    out = out.join(corpus.json(), "doc_id", "left") if options.output_format in ("both", "json") else out.withColumn("json", none)
    out = out.join(corpus.markdown(), "doc_id", "left") if options.output_format in ("both", "markdown") else out.withColumn("markdown", none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: list[tuple] = []
            for doc, directory, tree, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                made = {}
                if tree is not None:
                    made["document.json"] = (json.dumps(json.loads(tree), ensure_ascii=False, indent=options.json_indent) + "\n").encode()
                if text is not None:
                    made["document.md"] = text.encode()
                for path, raw in made.items():
                    put(os.path.join(target, directory), path, raw)
                    done.append((doc, path, len(raw), hashlib.sha256(raw).hexdigest(), False))
            yield _batch(done)

    return out.select("doc_id", "directory", "json", "markdown").mapInArrow(run, _WRITTEN)


def write_packages(corpus: Corpus, target: str, options: Options = Options(), flat: bool = False, root: str | None = None) -> DataFrame:  # noqa: B008
    """Writes every document's package; doc_id, path, size_bytes, sha256 and is_asset of each file but the manifests.

    Each document has a directory under `target` that keeps its place under `root`; with `flat`, for a single file, `target` is it. What was
    written is checkpointed, so that the manifests are made from it and no file is written again for them.
    """
    if "://" in target:
        raise ValueError("packages are written to a folder that every executor has mounted, not to an address")
    written = write_texts(corpus, target, options, flat, root)
    if options.extract_assets:
        written = written.unionByName(write_assets(corpus, target, options, flat, root).join(corpus.documents.select("doc_id"), "doc_id", "left_semi"))
    written = cut(written)
    listed = written.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", "size_bytes", "sha256"))).alias("files"), F.count_if("is_asset").alias("written"))
    out = corpus.documents.select("doc_id", "schema_version", "filename", "sha256", F.col("document_type").alias("type"), _directory(flat, root).alias("directory")).join(corpus.summary(), "doc_id", "left").join(listed, "doc_id", "left")
    done = F.coalesce("written", F.lit(0)).cast("long")
    summary = package_summary(options.extract_assets, done)
    manifest = F.to_json(F.struct("schema_version", F.struct("filename", "sha256", "type").alias("source"), summary.alias("summary"), F.coalesce("files", F.array()).alias("files")), {"ignoreNullFields": "false"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for directory, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                put(os.path.join(target, directory), "manifest.json", (json.dumps(json.loads(text), ensure_ascii=False, indent=options.json_indent) + "\n").encode())
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["directory"])

    out.select("directory", manifest.alias("manifest")).mapInArrow(run, "directory string").write.format("noop").mode("overwrite").save()
    return written


_ARROW = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string()), ("is_asset", pa.bool_())])


def package_summary(requested: bool, written: Column) -> Column:
    """The manifest's summary from the columns of `manifest.summary`."""
    failed = F.greatest(F.lit(0).cast("long"), F.col("assets") - written) if requested else F.lit(0).cast("long")
    return F.struct(
        "units", "elements", "warnings", F.col("unsupported").alias("unsupported_objects"), F.col("assets").alias("assets_declared"), F.lit(requested).alias("assets_requested"),
        written.alias("assets_written"), failed.alias("assets_failed"), F.col("active_assets").alias("potentially_active_assets"),
    )


def batch_rows(corpus: Corpus, written: DataFrame, options: Options = Options(), root: str | None = None) -> DataFrame:  # noqa: B008
    """line (JSON) of every file of the batch: source, status, and summary or error_type and error."""
    source = relative_path("path", root)
    done = written.groupBy("doc_id").agg(F.count_if("is_asset").alias("written"))
    ok = corpus.summary().join(done, "doc_id", "left").select(F.col("doc_id").alias("path"), package_summary(options.extract_assets, F.coalesce("written", F.lit(0)).cast("long")).alias("summary"))
    good = ok.select("path", F.to_json(F.struct(source.alias("source"), F.lit("ok").alias("status"), "summary")).alias("line"), F.lit(0).alias("failed"))
    bad = corpus.rejects.select("path", F.to_json(F.struct(source.alias("source"), F.lit("error").alias("status"), "error_type", F.coalesce("error", F.lit("")).alias("error"))).alias("line"), F.lit(1).alias("failed"))
    return good.unionByName(bad)


def write_batch_summary(corpus: Corpus, written: DataFrame, target: str, options: Options = Options(), root: str | None = None) -> tuple[int, int]:  # noqa: B008
    """`batch-summary.json` under `target`, files in the order of their paths; returns (succeeded, failed).

    The lines come to the driver one partition at a time and are written as they come.
    """
    rows = cut(batch_rows(corpus, written, options, root).orderBy("path"))
    os.makedirs(target, exist_ok=True)
    path = os.path.join(target, "batch-summary.json")
    total = failures = 0
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write('{\n  "files": [')
        for r in rows.toLocalIterator():
            f.write(("," if total else "") + "\n    " + json.dumps(json.loads(r.line), ensure_ascii=False))
            total, failures = total + 1, failures + r.failed
        f.write(f'\n  ],\n  "failures": {failures}\n}}\n')
    os.replace(f"{path}.part", path)
    return total - failures, failures
