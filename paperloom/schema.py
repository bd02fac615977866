"""The canonical relations' schemas."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.1"


def _struct(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


BBOX = _struct("left_x:double top_y:double right_x:double bottom_y:double coordinate_system:string")
SOURCE = T.StructType(
    [*_struct("unit_index:int unit_name:string page_number:int sheet_name:string slide_number:int row_no:int column_no:int cell:string").fields, T.StructField("bbox", BBOX), T.StructField("archive_part", T.StringType())]
)


def _with_source(before: str, after: str = "") -> T.StructType:
    return T.StructType([*_struct(before).fields, T.StructField("source", SOURCE), *_struct(after).fields])


DOCUMENTS = _struct("doc_id:string schema_version:string filename:string extension:string document_type:string media_type:string size_bytes:long sha256:string extractor:string extractor_version:string properties:string")
UNITS = _struct("doc_id:string unit_index:int kind:string name:string metadata:string")
ELEMENTS = _with_source("doc_id:string unit_index:int element_id:string element_type:string element_order:int text:string markdown:string data:string", "parent_element_id:string")
ASSETS = _with_source("doc_id:string asset_id:string asset_type:string original_name:string output_path:string media_type:string sha256:string size_bytes:long", "metadata:string")
WARNINGS = _with_source("doc_id:string code:string message:string severity:string", "details:string")
UNSUPPORTED = _with_source("doc_id:string object_type:string status:string description:string", "metadata:string")
REJECTS = _struct("path:string error_type:string error:string")
PARTS = _struct("ordinal:int member:string file_size:long compress_size:long payload:binary")

RELATIONS = {"documents": DOCUMENTS, "units": UNITS, "elements": ELEMENTS, "assets": ASSETS, "warnings": WARNINGS, "unsupported": UNSUPPORTED, "rejects": REJECTS}
