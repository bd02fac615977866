"""Queries that make files of table rows and run detection, guards and parsers over them, with the SQL of what is in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import made
from paperloom.operators import extract
from paperloom.options import Options
from paperloom.runtime import table
from paperloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Customers with their file and their number in it.
_CUSTOMERS = f"""WITH c AS (SELECT *, 'in/n' || c_nationkey || '-' || c_custkey // {made.BLOCK} AS file, row_number() OVER (PARTITION BY c_nationkey, c_custkey // {made.BLOCK} ORDER BY c_custkey) AS r FROM customer) """


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        SQL[name] = _CUSTOMERS + sql
        return fn

    return add


def parsed(spark: SparkSession, d: str, suffix: str, make: Callable[[list], bytes], relation: str) -> DataFrame:
    """One relation of the files that `make` writes of the customers."""
    options = Options(render_word_pages=False)
    good, _ = files.guard(files.detect(made.files(table(spark, d, "customer"), suffix, make), options), options)
    found = extract.found_rows(good, options)
    return (extract.documents(found) if relation == "documents" else extract.relation(found, relation)).withColumnRenamed("doc_id", "path")


def get(path: str, column: str = "data", kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(column), f"$.{path}", kind)


@query(
    "sheet_cells",
    """SELECT file || '.xlsx' AS path, u.x.cell AS cell, u.x.text AS text, u.x.formula AS formula, u.x.cached AS cached_value, u.x.kind AS data_type, c_mktsegment = 'MACHINERY' AS row_hidden, u.x.comment AS comment, u.x.link AS link
    FROM c, unnest([{cell: 'A' || r, text: c_name, formula: NULL, cached: NULL, kind: 's', comment: CASE WHEN c_mktsegment = 'FURNITURE' THEN 'about ' || c_custkey END, link: CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'https://example.org/' || c_custkey END},
      {cell: 'B' || r, text: CAST(c_custkey AS VARCHAR), formula: NULL, cached: NULL, kind: 'n', comment: NULL, link: NULL},
      {cell: 'C' || r, text: '=B' || r || '*10', formula: '=B' || r || '*10', cached: CAST(c_custkey * 10 AS VARCHAR), kind: 'f', comment: NULL, link: NULL},
      {cell: 'D' || r, text: CASE WHEN c_mktsegment = 'BUILDING' THEN 'True' ELSE 'False' END, formula: NULL, cached: NULL, kind: 'b', comment: NULL, link: NULL},
      {cell: CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'E' || r END, text: 'merged', formula: NULL, cached: NULL, kind: 's', comment: NULL, link: NULL}]) AS u(x) WHERE u.x.cell IS NOT NULL""",
)
def sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = parsed(spark, d, "xlsx", made.workbook, "elements").where("element_type = 'cell'")
    return cells.select("path", F.col("source.cell").alias("cell"), "text", get("formula").alias("formula"), get("cached_value").alias("cached_value"), get("data_type").alias("data_type"), get("row_hidden", kind="boolean").alias("row_hidden"), get("comment.text").alias("comment"), get("hyperlink.target").alias("link"))


@query(
    "sheet_units",
    """SELECT file || '.xlsx' AS path, u.s AS unit_index, CASE u.s WHEN 1 THEN 'Customers' ELSE 'Empty' END AS name, CASE u.s WHEN 1 THEN 'visible' ELSE 'hidden' END AS state, CASE u.s WHEN 1 THEN CAST(count(*) AS INTEGER) ELSE 1 END AS max_row,
      CASE WHEN u.s = 2 THEN 1 WHEN bool_or(c_mktsegment = 'HOUSEHOLD') THEN 6 ELSE 4 END AS max_column, CASE u.s WHEN 1 THEN CAST(count_if(c_mktsegment = 'HOUSEHOLD') AS INTEGER) ELSE 0 END AS merged,
      CASE u.s WHEN 1 THEN CAST(count_if(c_mktsegment = 'MACHINERY') AS INTEGER) ELSE 0 END AS hidden_rows, CASE u.s WHEN 1 THEN 'Left' END AS header_left, CASE u.s WHEN 1 THEN 'Page &P' END AS header_right
    FROM c, unnest([1, 2]) AS u(s) GROUP BY file, u.s""",
)
def sheet_units(spark: SparkSession, d: str) -> DataFrame:
    units = parsed(spark, d, "xlsx", made.workbook, "units")
    size = [F.size(get(k, "metadata", "array<variant>")).alias(n) for k, n in (("merged_ranges", "merged"), ("hidden_rows", "hidden_rows"))]
    return units.select("path", "unit_index", "name", get("state", "metadata").alias("state"), *(get(k, "metadata", "int").alias(k) for k in ("max_row", "max_column")), *size, *(get(f"headers_footers.odd_header.{k}", "metadata").alias(f"header_{k}") for k in ("left", "right")))


@query("merged_cells", "SELECT file || '.xlsx' AS path, 'E' || r AS cell, 'E' || r || ':F' || r AS merged FROM c WHERE c_mktsegment = 'HOUSEHOLD'")
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells of merged ranges that are kept: the first of each, by what the sheet says is merged."""
    cells = parsed(spark, d, "xlsx", made.workbook, "elements").where("element_type = 'cell' and source.column_no >= 5").select("path", F.col("source.cell").alias("cell"))
    ranges = parsed(spark, d, "xlsx", made.workbook, "units").select("path", F.explode(get("merged_ranges", "metadata", "array<string>")).alias("merged"))
    return cells.join(ranges, ["path"]).where(F.substring_index("merged", ":", 1) == F.col("cell"))


@query("sheet_tables", "SELECT file || '.xlsx' AS path, 'Customers' AS text, 'T1' AS name, 'A1:D' || count(*) AS ref, CAST(5 * count(*) - count_if(c_mktsegment <> 'HOUSEHOLD') + 1 AS INTEGER) AS element_order FROM c GROUP BY file")
def sheet_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = parsed(spark, d, "xlsx", made.workbook, "elements").where("element_type = 'table'")
    return rows.select("path", "text", get("name").alias("name"), get("ref").alias("ref"), "element_order")


@query(
    "word_elements",
    """, e AS (SELECT file, 1 AS place, r, CASE c_mktsegment WHEN 'BUILDING' THEN 'heading' WHEN 'FURNITURE' THEN 'list' ELSE 'paragraph' END AS element_type, 'body' AS role, c_name || CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN ', linked' ELSE '' END AS text FROM c
      UNION ALL SELECT file, 2, 0, 'table', NULL, string_agg(c_name || ' | ' || c_custkey, chr(10) ORDER BY r) FROM c GROUP BY file UNION ALL SELECT DISTINCT file, 3, 0, 'paragraph', 'header', 'the header' FROM c
      UNION ALL SELECT file, 4, r, 'note', 'comment', 'see ' || c_custkey FROM c WHERE c_mktsegment = 'AUTOMOBILE' UNION ALL SELECT file, 5, r, 'note', 'footnote', 'note ' || c_custkey FROM c WHERE c_mktsegment = 'HOUSEHOLD'
      UNION ALL SELECT file, 6, r, 'paragraph', 'text_box', 'box ' || c_custkey FROM c WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT file, 7, r, 'note', 'tracked_change', 'added ' || c_custkey FROM c WHERE c_mktsegment = 'MACHINERY'
      UNION ALL SELECT file, 8, r, 'paragraph', 'content_control', 'control ' || c_custkey FROM c WHERE c_mktsegment = 'FURNITURE' UNION ALL SELECT file, 9, r, 'formula', 'office_math', 'x=' || c_custkey FROM c WHERE c_mktsegment = 'MACHINERY'
      UNION ALL SELECT file, 10, min(r), 'metadata', 'field_instruction', 'PAGE ' || c_custkey % 3 FROM c WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY file, c_custkey % 3)
    SELECT file || '.docx' AS path, CAST(row_number() OVER (PARTITION BY file ORDER BY place, r) AS INTEGER) AS element_order, element_type, role, text FROM e""",
)
def word_elements(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d, "docx", made.word, "elements").select("path", "element_order", "element_type", get("role").alias("role"), "text")


@query(
    "word_assets",
    """, a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY c_mktsegment, 'item ' || c_custkey || '.bin') AS no FROM c WHERE c_mktsegment IN ('BUILDING', 'FURNITURE'))
    SELECT file || '.docx' AS path, 'docx-asset-' || no AS asset_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'embedded_media' ELSE 'embedded_object' END AS asset_type, 'assets/' || CASE c_mktsegment WHEN 'BUILDING' THEN 'media' ELSE 'embeddings' END || '/item_' || c_custkey || '.bin' AS output_path,
      'application/octet-stream' AS media_type, sha256(c_name) AS sha256, CAST(octet_length(encode(c_name)) AS BIGINT) AS size_bytes, c_mktsegment = 'FURNITURE' AS active, 'word/' || CASE c_mktsegment WHEN 'BUILDING' THEN 'media' ELSE 'embeddings' END || '/item ' || c_custkey || '.bin' AS part FROM a""",
)
def word_assets(spark: SparkSession, d: str) -> DataFrame:
    rows = parsed(spark, d, "docx", made.word, "assets")
    return rows.select("path", "asset_id", "asset_type", "output_path", "media_type", "sha256", "size_bytes", get("potentially_active_content", "metadata", "boolean").alias("active"), F.col("source.archive_part").alias("part"))


@query(
    "word_images",
    """, a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY 'item ' || c_custkey || '.bin') AS no FROM c WHERE c_mktsegment = 'BUILDING')
    SELECT file || '.docx' AS path, CAST(r AS INTEGER) AS element_order, 'item ' || c_custkey || '.bin' AS filename, sha256(c_name) AS sha256, 'docx-asset-' || no AS asset_id FROM a""",
)
def word_images(spark: SparkSession, d: str) -> DataFrame:
    rows = parsed(spark, d, "docx", made.word, "elements")
    runs = rows.select("path", "element_order", F.explode(get("runs", kind="array<struct<content:array<struct<type:string,filename:string,sha256:string,asset_id:string>>>>")).alias("run"))
    return runs.select("path", "element_order", F.explode("run.content").alias("c")).where("c.type = 'image'").select("path", "element_order", "c.filename", "c.sha256", "c.asset_id")


@query("word_links", "SELECT file || '.docx' AS path, CAST(r AS INTEGER) AS element_order, ', linked' AS text, 'https://example.org/' || c_custkey AS address, 'top' AS fragment, 'https://example.org/' || c_custkey || '#top' AS url FROM c WHERE c_mktsegment = 'AUTOMOBILE'")
def word_links(spark: SparkSession, d: str) -> DataFrame:
    rows = parsed(spark, d, "docx", made.word, "elements")
    links = rows.select("path", "element_order", F.explode(get("hyperlinks", kind="array<struct<text:string,address:string,fragment:string,url:string>>")).alias("l"))
    return links.select("path", "element_order", "l.text", "l.address", "l.fragment", "l.url")


@query("word_unsupported", "SELECT file || '.docx' AS path, 'docx_embedded_object' AS object_type, 'detected_not_fully_parsed' AS status, count(*) AS parts FROM c WHERE c_mktsegment = 'FURNITURE' GROUP BY file")
def word_unsupported(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d, "docx", made.word, "unsupported").select("path", "object_type", "status", get("count", "metadata", "long").alias("parts"))


@query(
    "word_counts",
    """SELECT file || '.docx' AS path, CAST(count_if(c_mktsegment = 'AUTOMOBILE') AS INTEGER) AS comments, CAST(count_if(c_mktsegment = 'HOUSEHOLD') AS INTEGER) AS footnotes, CAST(count_if(c_mktsegment = 'MACHINERY') AS INTEGER) AS changes, 1 AS sections, CAST(count(*) AS INTEGER) AS paragraphs, 1 AS tables FROM c GROUP BY file""",
)
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    meta = parsed(spark, d, "docx", made.word, "units")
    names = {"comment_count": "comments", "footnote_count": "footnotes", "tracked_change_count": "changes", "section_count": "sections", "paragraph_count": "paragraphs", "table_count": "tables"}
    return meta.select("path", *(get(k, "metadata", "int").alias(n) for k, n in names.items()))


@query(
    "slide_elements",
    """SELECT file || '.pptx' AS path, CAST(r AS INTEGER) AS unit_index, u.x.kind AS element_type, u.x.text AS text, CAST(u.x.no AS INTEGER) AS element_order
    FROM c, unnest([{no: 1, kind: 'heading', text: c_name}, {no: 2, kind: 'paragraph', text: 'segment ' || c_mktsegment}, {no: 3, kind: 'note', text: CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'note ' || c_custkey END}]) AS u(x) WHERE u.x.text IS NOT NULL""",
)
def slide_elements(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d, "pptx", made.slides, "elements").select("path", "unit_index", "element_type", "text", "element_order")


@query("slide_units", "SELECT file || '.pptx' AS path, CAST(r AS INTEGER) AS unit_index, 'slide' AS kind, 'Slide ' || r AS name, c_mktsegment = 'MACHINERY' AS hidden FROM c")
def slide_units(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d, "pptx", made.slides, "units").select("path", "unit_index", "kind", "name", get("hidden", "metadata", "boolean").alias("hidden"))


@query(
    "pdf_elements",
    """SELECT file || '.pdf' AS path, CAST(r AS INTEGER) AS unit_index, 'paragraph' AS element_type, c_name || chr(10) || 'key ' || c_custkey AS text, CAST(NULL AS VARCHAR) AS uri FROM c
    UNION ALL SELECT file || '.pdf', CAST(r AS INTEGER), 'link', 'https://example.org/' || c_custkey, 'https://example.org/' || c_custkey FROM c WHERE c_mktsegment = 'AUTOMOBILE'""",
)
def pdf_elements(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d, "pdf", made.pdf, "elements").select("path", "unit_index", "element_type", "text", get("uri").alias("uri"))


@query("pdf_documents", "SELECT file || '.pdf' AS path, 'pdf' AS document_type, 'application/pdf' AS media_type, CAST(count(*) AS INTEGER) AS pages, 'Customers' AS title, 'First' AS outline, CAST(count(*) AS VARCHAR) AS field_value, '/Tx' AS field_type FROM c GROUP BY file")
def pdf_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = parsed(spark, d, "pdf", made.pdf, "documents")
    fields = [get(f"pdf.form_fields.count.{k}", "properties").alias(f"field_{n}") for k, n in (("value", "value"), ("field_type", "type"))]
    return rows.select("path", "document_type", "media_type", get("pdf.page_count", "properties", "int").alias("pages"), get("pdf.metadata['/Title']", "properties").alias("title"), get("pdf.outline[0].title", "properties").alias("outline"), *fields)


@query(
    "detected_files",
    """SELECT 'in/' || c_custkey || '.' || CASE c_custkey % 8 WHEN 3 THEN 'doc' WHEN 4 THEN 'bin' WHEN 5 THEN 'zip' WHEN 6 THEN 'txt' ELSE 'docx' END AS path,
      CASE c_custkey % 8 WHEN 0 THEN 'docx' WHEN 1 THEN 'docm' WHEN 2 THEN 'encrypted_office' WHEN 3 THEN 'doc' WHEN 4 THEN 'pdf' WHEN 5 THEN 'zip' WHEN 6 THEN 'txt' ELSE 'xlsx' END AS document_type,
      c_custkey % 8 = 1 AS is_macro_enabled, c_custkey % 8 = 3 AS is_legacy_office, c_custkey % 8 = 2 AS is_encrypted_office, CAST(CASE c_custkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 5 THEN 1 WHEN 7 THEN 4 END AS BIGINT) AS members FROM c""",
)
def detected_files(spark: SparkSession, d: str) -> DataFrame:
    found = files.detect(made.odd_files(table(spark, d, "customer")))
    return found.select("path", "detected.document_type", "detected.is_macro_enabled", "detected.is_legacy_office", "detected.is_encrypted_office", F.when(F.col("archive.is_zip"), F.col("archive.members")).alias("members"))


@query(
    "guarded_files",
    """SELECT 'in/' || c_custkey || '.' || CASE c_custkey % 8 WHEN 5 THEN 'zip' WHEN 6 THEN 'txt' ELSE 'docx' END AS path, CASE c_custkey % 8 WHEN 7 THEN 'InvalidInputFileError' ELSE 'UnsupportedFileTypeError' END AS error_type,
      CASE c_custkey % 8 WHEN 2 THEN 'the Office file is encrypted' WHEN 5 THEN 'no extractor for zip' WHEN 6 THEN 'no extractor for txt' ELSE 'archive limit: members' END AS error FROM c WHERE c_custkey % 8 IN (2, 5, 6, 7)""",
)
def guarded_files(spark: SparkSession, d: str) -> DataFrame:
    options = Options(max_members=3)
    return files.guard(files.detect(made.odd_files(table(spark, d, "customer")), options), options)[1]
