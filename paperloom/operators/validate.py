"""The canonical invariants V1-V8 as one relation of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import unsafe_path


class InvalidDocuments(ValueError):
    """Some documents break an invariant."""


def _rows(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select("doc_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy("doc_id", *keys).agg(F.count("*").alias("n")).where("n > 1")


def rules(documents: DataFrame, units: DataFrame, elements: DataFrame, assets: DataFrame) -> dict[str, DataFrame]:
    """doc_id, rule and detail of the violations of each rule."""
    from paperloom.operators.provenance import orphan_sources

    def blank(c: str) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    return {
        "V1": _rows(documents.where(blank("schema_version")), "V1", F.col("filename")),
        "V2": _rows(repeated(units, "unit_index"), "V2", F.col("unit_index")),
        "V3": _rows(units.where(F.coalesce("unit_index", F.lit(0)) <= 0), "V3", F.col("unit_index")),
        "V4": _rows(elements.where(blank("element_id")), "V4", F.col("element_order")),
        "V5": _rows(repeated(elements.where(~blank("element_id")), "element_id"), "V5", F.col("element_id")),
        "V6": _rows(orphan_sources(elements, units), "V6", F.col("element_id")),
        "V7": _rows(repeated(elements, "unit_index", "element_order"), "V7", F.concat_ws(":", "unit_index", "element_order")),
        "V8": _rows(repeated(assets, "asset_id"), "V8", F.col("asset_id")).unionByName(_rows(assets.where(unsafe_path(F.col("output_path"))), "V8", F.col("output_path"))),
    }


def violations(documents: DataFrame, units: DataFrame, elements: DataFrame, assets: DataFrame, strict: bool = False) -> DataFrame:
    found = reduce(DataFrame.unionByName, rules(documents, units, elements, assets).values())
    if strict and (first := found.limit(1).collect()):
        raise InvalidDocuments(f"{first[0].doc_id}: {first[0].rule} {first[0].detail}")
    return found
