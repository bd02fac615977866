"""Counts and summaries of documents and batches (A1-A10, K6-K9)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import extension, stem

#: Asset types that may run (fixed values).
ACTIVE = ("embedded_object", "activex_part", "vba_project")


def summary(documents: DataFrame, units: DataFrame, elements: DataFrame, assets: DataFrame, warnings: DataFrame, unsupported: DataFrame | None = None, written: DataFrame | None = None) -> DataFrame:
    """One row per document: units, elements, assets, active_assets, assets_written, assets_failed, warnings, unsupported."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.count("*").alias(name))

    out = documents.select("doc_id").dropDuplicates()
    for df, name in ((units, "units"), (elements, "elements"), (warnings, "warnings"), (unsupported, "unsupported"), (written, "assets_written")):
        if df is not None:
            out = out.join(counted(df, name), "doc_id", "left")
        else:
            out = out.withColumn(name, F.lit(0).cast("long"))
    held = assets.groupBy("doc_id").agg(F.count("*").alias("assets"), F.count_if(F.col("asset_type").isin(*ACTIVE)).alias("active_assets"))
    out = out.join(held, "doc_id", "left").fillna(0)
    return out.withColumn("assets_failed", F.greatest(F.lit(0).cast("long"), F.col("assets") - F.col("assets_written")) if written is not None else F.lit(0).cast("long"))


def batch_summary(documents: DataFrame, rejects: DataFrame) -> DataFrame:
    """source, status, error_type and error of every file of a batch."""
    ok = documents.select(F.col("doc_id").alias("source"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error"))
    return ok.unionByName(rejects.select(F.col("path").alias("source"), F.lit("error").alias("status"), "error_type", "error"))


def relative_path(path: str = "path", root: str | None = None) -> Column:
    """A path relative to `root`, the scanned directory; one that lies elsewhere, and each without a root, whole but for the scheme."""
    c = F.regexp_replace(path, "^([a-zA-Z0-9+.-]+:)?/*", "")
    if root is None:
        return c
    plain = re.sub("^([a-zA-Z0-9+.-]+:)?/*", "", root).rstrip("/")
    return F.when(c.startswith(f"{plain}/"), F.substring(c, len(plain) + 2, 1 << 30)).otherwise(c)


def output_directory(path: str = "path", root: str | None = None) -> Column:
    """`<parent>/<stem>__<suffix>_extracted`: files that differ in suffix or folder don't share a directory."""
    c = relative_path(path, root)
    parent = F.regexp_extract(c, r"^(.*/)[^/]*$", 1)
    suffix = F.coalesce(F.nullif(extension(c), F.lit("")), F.lit("file"))
    return F.concat(parent, stem(c), F.lit("__"), suffix, F.lit("_extracted"))
