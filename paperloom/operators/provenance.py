"""Where an element comes from, and which asset an image is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_source(elements: DataFrame, units: DataFrame) -> DataFrame:
    """Elements whose source is null get their unit's; a source whose fields are all null is left alone."""
    own = units.select("doc_id", "unit_index", F.col("kind").alias("__kind"), F.col("name").alias("__name")).dropDuplicates(["doc_id", "unit_index"])
    # only the rows without a source meet the units; the others, nearly all, are never shuffled
    joined = elements.where("source is null").join(own, ["doc_id", "unit_index"], "left")
    kind, index, name = F.col("__kind"), F.col("unit_index"), F.col("__name")
    fields = {f.name: f.dataType for f in elements.schema["source"].dataType.fields}
    given = {"unit_index": index, "unit_name": name, "page_number": F.when(kind == "page", index), "sheet_name": F.when(kind == "sheet", name), "slide_number": F.when(kind == "slide", index)}
    made = F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()))
    filled = joined.withColumn("source", F.when(kind.isNotNull(), made)).select(*elements.columns)
    return elements.where("source is not null").unionByName(filled)


def assets_by_hash(assets: DataFrame) -> DataFrame:
    """doc_id, sha256 and asset_id; of several assets with one hash the last by number wins."""
    number = F.regexp_extract("asset_id", r"(\d+)$", 1).try_cast("int")
    return assets.where("sha256 is not null").groupBy("doc_id", "sha256").agg(F.max_by("asset_id", F.struct(number, "asset_id")).alias("asset_id"))


def match_images(images: DataFrame, assets: DataFrame) -> DataFrame:
    """`images` (doc_id, sha256, ...) with the asset_id of the same bytes, null where there is none."""
    return images.join(assets_by_hash(assets), ["doc_id", "sha256"], "left")


def orphan_sources(elements: DataFrame, units: DataFrame) -> DataFrame:
    """Elements whose source names a unit their document lacks."""
    named = elements.where("source.unit_index is not null").select("doc_id", "element_id", F.col("source.unit_index").alias("unit_index"))
    return named.join(units.select("doc_id", "unit_index"), ["doc_id", "unit_index"], "left_anti").select("doc_id", "element_id", "unit_index")
