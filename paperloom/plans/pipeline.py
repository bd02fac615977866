"""The whole extraction of a corpus as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import extract, manifest, provenance, render, validate
from paperloom.options import Options
from paperloom.runtime import cut, small
from paperloom.sources import files


@dataclass(frozen=True)
class Corpus:
    """The canonical relations of a corpus."""

    documents: DataFrame
    units: DataFrame
    elements: DataFrame
    assets: DataFrame
    warnings: DataFrame
    unsupported: DataFrame
    rejects: DataFrame
    files: DataFrame

    def parts(self) -> tuple[DataFrame, ...]:
        return self.documents, self.units, self.elements, self.assets, self.warnings, self.unsupported

    def violations(self, strict: bool = False) -> DataFrame:
        return validate.violations(self.documents, self.units, self.elements, self.assets, strict)

    def markdown(self) -> DataFrame:
        return render.markdown(*self.parts())

    def json(self) -> DataFrame:
        return render.json_document(*self.parts())

    def summary(self) -> DataFrame:
        return manifest.summary(*self.parts())

    def batch(self) -> DataFrame:
        return manifest.batch_summary(self.documents, self.rejects)


def corpus(content: DataFrame, options: Options = Options(), registry: extract.Registry = extract.Registry(), store: str | None = None, judge: bool = False) -> Corpus:  # noqa: B008
    """Relations of the files in `content` (path, modificationTime, length, content).

    With `store`, the found rows are written there once and every relation reads them; without it each
    relation scans and parses the files anew, which is only right for small corpora and tests. With `judge`, a
    document that breaks an invariant is a reject and none of its rows stays.
    """
    # the size filter reaches the scan, so a file beyond the limit is never read; its reject comes from path and length
    fits, large = files.by_size(content, options)
    good, rejected = files.guard(files.detect(fits, options), options)
    rejected = rejected.unionByName(large)
    found = extract.found_rows(good, options, registry)
    if store:
        found.write.mode("overwrite").partitionBy("relation").parquet(store)
        found = content.sparkSession.read.parquet(store)
    units = extract.relation(found, "units")
    elements = provenance.fill_source(extract.relation(found, "elements"), units)
    rejects = rejected.unionByName(extract.relation(found, "rejects").select("path", "error_type", "error"))
    documents, assets, warnings, unsupported = extract.documents(found), extract.relation(found, "assets"), extract.relation(found, "warnings"), extract.relation(found, "unsupported")
    if judge:
        bad = cut(validate.violations(documents, units, elements, assets))
        lost = bad.groupBy("doc_id").agg(F.min(F.struct("rule", "detail")).alias("v"))
        rejects = rejects.unionByName(lost.select(F.col("doc_id").alias("path"), F.lit("DocumentValidationError").alias("error_type"), F.concat_ws(" ", "v.rule", "v.detail").alias("error")))
        ids = small(lost.select("doc_id"))
        documents, units, elements, assets, warnings, unsupported = (df.join(ids, "doc_id", "left_anti").select(*df.columns) for df in (documents, units, elements, assets, warnings, unsupported))
    return Corpus(
        documents, units, elements, assets, warnings, unsupported, rejects, good.select("path", F.col("detected.document_type").alias("document_type"), "content"),
    )


def scan_corpus(spark: SparkSession, path: str, recursive: bool = False, options: Options = Options(), store: str | None = None) -> Corpus:  # noqa: B008
    return corpus(files.scan(spark, path, recursive), options, store=store)
