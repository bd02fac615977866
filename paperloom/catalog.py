"""Registered queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from paperloom import doctor, parsing
from paperloom.functions import text
from paperloom.operators import drift, manifest, nested, provenance, render, validate
from paperloom.options import Options
from paperloom.runtime import once_each, table
from paperloom.sources import files, layout

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(table(spark, d, "canonical_docs"), table(spark, d, "elements"))


_VERSION_SQL = "array_to_string(list_transform(string_split(regexp_replace(trim(schema_version), '^[vV]?\\s*', ''), '.'), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), '.')"


@query(
    "p2_fields",
    f"""WITH d AS (SELECT DISTINCT doc_id, extractor, {_VERSION_SQL} AS schema_version FROM canonical_docs WHERE regexp_matches(regexp_replace(trim(schema_version), '^[vV]?\\s*', ''), '^[0-9]+(\\.[0-9]+)*$') AND extractor IS NOT NULL),
      e AS (SELECT doc_id, TRY_CAST(data AS JSON) AS j FROM elements), t AS (SELECT e.doc_id, replace(substr(x.fullkey, 3), '"', '') AS field_path, x.type FROM e, json_tree(e.j) AS x WHERE json_type(e.j) = 'OBJECT' AND x.fullkey NOT LIKE '%[%' AND x.fullkey <> '$')
    SELECT d.extractor, d.schema_version, t.field_path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS json_type, count(*) AS elements
    FROM t JOIN d ON d.doc_id = t.doc_id WHERE t.type NOT IN ('NULL', 'OBJECT') GROUP BY 1, 2, 3, 4""",
)
def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    found = drift.versioned(drift.catalogue(table(spark, d, "canonical_docs"), table(spark, d, "elements")))
    path = F.translate("field", drift.SEP, ".").alias("field_path")
    return found.groupBy("extractor", "schema_version", path, "json_type").agg(F.sum("elements").cast("long").alias("elements"))


@query("p2_unified")
def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "canonical_docs"), table(spark, d, "elements"))


#: The same by recursion over JSON.
_NODES_SQL = r"""WITH RECURSIVE raw AS (SELECT DISTINCT rec_id, ltrim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS p FROM raw_extracts),
 a AS (SELECT rec_id, CASE WHEN starts_with(p, '"') THEN ltrim(TRY_CAST(p AS JSON)->>'$', chr(65279) || ' ' || chr(10)) ELSE p END AS p FROM raw),
 doc AS (SELECT rec_id, CASE WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN j->0 ELSE j END AS j FROM (SELECT rec_id, TRY_CAST(p AS JSON) AS j FROM a)),
 node(rec_id, kind, path, parent, ordinal, j) AS (
  SELECT rec_id, 'doc', '', '', 0, j FROM doc WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT n.rec_id, c.kind, CASE WHEN n.path = '' THEN c.seg ELSE n.path || '.' || c.seg END, n.path, CAST(c.i AS INTEGER), c.x FROM node n, LATERAL (
    SELECT CASE WHEN n.kind = 'doc' THEN 'unit' ELSE 'element' END AS kind, CAST(k.i AS VARCHAR) AS seg, k.i AS i, k.x AS x
      FROM (SELECT CASE n.kind WHEN 'doc' THEN n.j->'units' WHEN 'unit' THEN n.j->'elements' WHEN 'element' THEN n.j->'children' END AS v) s, unnest(CASE json_type(s.v) WHEN 'ARRAY' THEN s.v->'$[*]' WHEN 'OBJECT' THEN [s.v] ELSE [] END) WITH ORDINALITY AS k(x, i) WHERE json_type(k.x) = 'OBJECT'
    UNION ALL
    SELECT 'cell', 'r' || r.i || 'c' || k.i, k.i, k.x FROM (SELECT CASE n.kind WHEN 'element' THEN [n.j->'data'->'rows'] WHEN 'cell' THEN CASE WHEN json_type(n.j->'content') = 'ARRAY' THEN list_transform(json_extract(n.j, '$.content[*]'), lambda y: json_extract(y, '$.table.rows')) ELSE [] END ELSE [] END AS tables) s,
      unnest(s.tables) AS t(v), unnest(CASE json_type(t.v) WHEN 'ARRAY' THEN t.v->'$[*]' ELSE [] END) WITH ORDINALITY AS r(x, i), unnest(CASE json_type(r.x) WHEN 'ARRAY' THEN r.x->'$[*]' ELSE [] END) WITH ORDINALITY AS k(x, i) WHERE json_type(k.x) <> 'NULL') c)"""


@query("p7_found", _NODES_SQL + " SELECT DISTINCT rec_id, path AS node_path, parent AS parent_path FROM node WHERE kind IN ('element', 'cell')")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes_found(table(spark, d, "raw_extracts"))


@query("p7_relations", _NODES_SQL + " SELECT DISTINCT rec_id, kind AS relation, path AS node_path, parent AS parent_path, ordinal, j->>'$.element_id' AS node_id, j->>'$.element_type' AS node_type, j->>'$.text' AS text, j->>'$.kind' AS kind, j->>'$.name' AS name FROM node WHERE kind <> 'doc'")
def p7_relations(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_records(table(spark, d, "raw_extracts"))


# --- the extraction engine's own operators, over the canonical tables -----------------------------------

#: Deliveries of one row differ in `ingested_at` alone; the earliest counts.
_ONCE_SQL = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ingested_at) AS rn FROM {table}) WHERE rn = 1)"
_KEYS = {"canonical_docs": ("doc_id",), "units": ("doc_id", "unit_index"), "elements": ("elem_no",), "assets": ("doc_id", "asset_id")}


def once(spark: SparkSession, d: str, name: str) -> DataFrame:
    df, keys = table(spark, d, name), _KEYS[name]
    return once_each(df, keys[0]) if len(keys) == 1 else df.dropDuplicates(list(keys))


def once_sql(name: str) -> str:
    return _ONCE_SQL.format(keys=", ".join(_KEYS[name]), table=name)


DOCS, UNITS, ELEMENTS, ASSETS = (once_sql(n) for n in ("canonical_docs", "units", "elements", "assets"))


@query("doc_sha256_size", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents WHERE text IS NOT NULL")
def doc_sha256_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


_EXT_SQL = "lower(regexp_extract({0}, '[^.]\\.([^.]+)$', 1))"


@query(
    "detect_signature",
    f"""WITH s AS (SELECT doc_id, {_EXT_SQL.format('filename')} AS ext,
      CASE WHEN document_type = 'pdf' THEN '255044462D312E37' WHEN substr(sha256, 1, 1) < '4' THEN 'D0CF11E0A1B11AE1' WHEN substr(sha256, 1, 1) < '6' THEN '68656C6C6F' ELSE '504B030414000600' END AS sig FROM {DOCS})
    SELECT doc_id, CASE WHEN sig LIKE '255044462D%' THEN 'pdf' WHEN sig LIKE 'D0CF11E0A1B11AE1%' AND ext IN ('docx','docm','xlsx','xlsm','pptx','pptm') THEN 'encrypted_office'
      WHEN sig LIKE 'D0CF11E0A1B11AE1%' AND ext IN ('doc','xls','ppt') THEN ext WHEN sig LIKE 'D0CF11E0A1B11AE1%' THEN 'legacy_office'
      WHEN sig NOT LIKE '504B%' THEN coalesce(nullif(ext, ''), 'unknown') ELSE 'package' END AS detected FROM s""",
)
def detect_signature(spark: SparkSession, d: str) -> DataFrame:
    docs = once(spark, d, "canonical_docs")
    first = F.substring("sha256", 1, 1)
    sig = F.when(F.col("document_type") == "pdf", "255044462D312E37").when(first < "4", files.OLE).when(first < "6", "68656C6C6F").otherwise("504B030414000600")
    return docs.select("doc_id", F.coalesce(files.signature_type(sig, text.extension(F.col("filename"))), F.lit("package")).alias("detected"))


@query("size_limit_rejects", f"SELECT doc_id AS path, 'InvalidInputFileError' AS error_type, 'the file is larger than the limit' AS error FROM {DOCS} WHERE size_bytes > 150000")
def size_limit_rejects(spark: SparkSession, d: str) -> DataFrame:
    docs = once(spark, d, "canonical_docs")
    archive = F.struct(F.lit(None).cast("string").alias("broken"))
    facts = docs.select(F.col("doc_id").alias("path"), F.col("size_bytes").alias("length"), F.struct("document_type", F.lit(False).alias("is_encrypted_office")).alias("detected"), archive.alias("archive"))
    return files.guard(facts, Options(max_file_size=150_000))[1].where("error_type = 'InvalidInputFileError'")


_LINES_SQL = "SELECT doc_id, u.line AS line, u.pos AS pos FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE text IS NOT NULL"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", "line", (F.col("p") + 1).cast("long").alias("pos"))


_BLOCK_SQL = """CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^\\s*([-*•]|[0-9]+[.)]) ') THEN 'list'
 WHEN line LIKE '|%' THEN 'table' WHEN line LIKE '> %' THEN 'note' ELSE 'paragraph' END"""


def _block_kind() -> Column:
    line = F.col("line")
    return F.when(line.rlike(r"^#{1,6} "), "heading").when(line.rlike(r"^\s*([-*•]|[0-9]+[.)]) "), "list").when(line.startswith("|"), "table").when(line.startswith("> "), "note").otherwise("paragraph")


@query(
    "doc_line_elements",
    f"""SELECT doc_id, 'doc-' || kind || '-' || row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS element_id, kind AS element_type,
      CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS element_order, line AS text
    FROM (SELECT *, {_BLOCK_SQL} AS kind FROM ({_LINES_SQL}) WHERE trim(line) <> '')""",
)
def doc_line_elements(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).where(F.trim("line") != "").withColumn("kind", _block_kind())
    per, every = W.partitionBy("doc_id", "kind").orderBy("pos"), W.partitionBy("doc_id").orderBy("pos")
    return rows.select("doc_id", F.concat(F.lit("doc-"), "kind", F.lit("-"), F.row_number().over(per)).alias("element_id"), F.col("kind").alias("element_type"), F.row_number().over(every).alias("element_order"), F.col("line").alias("text"))


@query("classify_blocks", f"SELECT kind, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {_BLOCK_SQL} AS kind FROM ({_LINES_SQL})) GROUP BY kind")
def classify_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(_block_kind().alias("kind")).agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("documents"))


@query("element_type_counts", f"SELECT doc_id, element_type, count(*) AS elements, count(text) AS with_text, CAST(sum(length(text)) AS BIGINT) AS chars FROM {ELEMENTS} GROUP BY doc_id, element_type")
def element_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "elements").groupBy("doc_id", "element_type").agg(F.count("*").alias("elements"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("chars"))


@query(
    "pdf_label_kinds",
    f"""SELECT label, CASE WHEN label IN ('title','section_header','field_heading') THEN 'heading' WHEN label LIKE '%list%' THEN 'list' WHEN label = 'table' THEN 'table' WHEN label IN ('picture','figure') THEN 'image'
      WHEN label = 'formula' THEN 'formula' WHEN label = 'code' THEN 'code' ELSE 'paragraph' END AS kind, count(*) AS n
    FROM (SELECT coalesce(data->>'label', data->>'docling_label') AS label FROM {ELEMENTS}) WHERE label IS NOT NULL GROUP BY 1, 2""",
)
def pdf_label_kinds(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("data")
    label = F.coalesce(F.try_variant_get(v, "$.label", "string"), F.try_variant_get(v, "$.docling_label", "string"))
    labels = once(spark, d, "elements").select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(kind=b["label"].map(layout.kind_of))[["label", "kind", "n"]]

    return labels.mapInPandas(kinds, "label string, kind string, n long")


@query("sheet_dimensions", f"SELECT doc_id, unit_index, max(source.row_no) AS max_row, max(source.column_no) AS max_column, count(*) AS cells FROM {ELEMENTS} WHERE element_type = 'cell' GROUP BY doc_id, unit_index")
def sheet_dimensions(spark: SparkSession, d: str) -> DataFrame:
    cells = once(spark, d, "elements").where("element_type = 'cell'")
    return cells.groupBy("doc_id", "unit_index").agg(F.max("source.row_no").alias("max_row"), F.max("source.column_no").alias("max_column"), F.count("*").alias("cells"))


@query(
    "provenance_fill",
    f"""SELECT e.elem_no, coalesce(e.source.unit_index, CASE WHEN e.source IS NULL THEN u.unit_index END) AS source_unit, CASE WHEN e.source IS NULL THEN CASE WHEN u.kind = 'page' THEN u.unit_index END ELSE e.source.page_number END AS page_number,
      CASE WHEN e.source IS NULL THEN CASE WHEN u.kind = 'sheet' THEN u.name END ELSE e.source.sheet_name END AS sheet_name, CASE WHEN e.source IS NULL THEN CASE WHEN u.kind = 'slide' THEN u.unit_index END ELSE e.source.slide_number END AS slide_number
    FROM {ELEMENTS} e LEFT JOIN {UNITS} u ON e.doc_id = u.doc_id AND e.unit_index = u.unit_index""",
)
def provenance_fill(spark: SparkSession, d: str) -> DataFrame:
    filled = provenance.fill_source(once(spark, d, "elements"), once(spark, d, "units"))
    return filled.select("elem_no", F.col("source.unit_index").alias("source_unit"), "source.page_number", "source.sheet_name", "source.slide_number")


_ASSET_NO = "TRY_CAST(regexp_extract(asset_id, '([0-9]+)$', 1) AS INTEGER)"


@query(
    "asset_match_by_hash",
    f"""WITH a AS (SELECT *, {_ASSET_NO} AS no FROM {ASSETS}), last AS (SELECT doc_id, sha256, arg_max(asset_id, (no, asset_id)) AS matched FROM a WHERE sha256 IS NOT NULL GROUP BY 1, 2)
    SELECT a.doc_id, a.asset_id, last.matched FROM a LEFT JOIN last ON a.doc_id = last.doc_id AND a.sha256 = last.sha256""",
)
def asset_match_by_hash(spark: SparkSession, d: str) -> DataFrame:
    assets = once(spark, d, "assets")
    return provenance.match_images(assets.select("doc_id", "sha256", F.col("asset_id").alias("own")), assets).select("doc_id", F.col("own").alias("asset_id"), F.col("asset_id").alias("matched"))


def _violations(rule: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return validate.rules(table(spark, d, "canonical_docs"), table(spark, d, "units"), once(spark, d, "elements"), table(spark, d, "assets"))[rule]

    return run


_RULE_SQL = {
    "V1": "SELECT doc_id, 'V1' AS rule, filename AS detail FROM canonical_docs WHERE coalesce(schema_version, '') = ''",
    "V2": "SELECT doc_id, 'V2' AS rule, CAST(unit_index AS VARCHAR) AS detail FROM units GROUP BY doc_id, unit_index HAVING count(*) > 1",
    "V3": "SELECT doc_id, 'V3' AS rule, CAST(unit_index AS VARCHAR) AS detail FROM units WHERE coalesce(unit_index, 0) <= 0",
    "V4": f"SELECT doc_id, 'V4' AS rule, CAST(element_order AS VARCHAR) AS detail FROM {ELEMENTS} WHERE coalesce(element_id, '') = ''",
    "V5": f"SELECT doc_id, 'V5' AS rule, element_id AS detail FROM {ELEMENTS} WHERE coalesce(element_id, '') <> '' GROUP BY doc_id, element_id HAVING count(*) > 1",
    "V6": f"SELECT e.doc_id, 'V6' AS rule, e.element_id AS detail FROM {ELEMENTS} e WHERE e.source.unit_index IS NOT NULL AND NOT EXISTS (SELECT 1 FROM units u WHERE u.doc_id = e.doc_id AND u.unit_index = e.source.unit_index)",
    "V7": f"SELECT doc_id, 'V7' AS rule, concat_ws(':', unit_index, element_order) AS detail FROM {ELEMENTS} GROUP BY doc_id, unit_index, element_order HAVING count(*) > 1",
    "V8": "SELECT doc_id, 'V8' AS rule, asset_id AS detail FROM assets GROUP BY doc_id, asset_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'V8', output_path FROM assets WHERE output_path LIKE '/%' OR list_contains(string_split(output_path, '/'), '..')",
}
for _rule, _sql in _RULE_SQL.items():
    query(f"validation_{_rule.lower()}", _sql)(_violations(_rule))


@query("validation_counts", "SELECT rule, count(*) AS violations, count(DISTINCT doc_id) AS documents FROM (" + " UNION ALL ".join(f"({s})" for s in _RULE_SQL.values()) + ") GROUP BY rule")
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    found = validate.violations(table(spark, d, "canonical_docs"), table(spark, d, "units"), once(spark, d, "elements"), table(spark, d, "assets"))
    return found.groupBy("rule").agg(F.count("*").alias("violations"), F.countDistinct("doc_id").alias("documents"))


@query("orphan_units", f"SELECT e.doc_id, e.unit_index, count(*) AS elements FROM {ELEMENTS} e WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.doc_id = e.doc_id AND u.unit_index = e.unit_index) GROUP BY 1, 2")
def orphan_units(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "units").select("doc_id", "unit_index")
    return once(spark, d, "elements").join(units, ["doc_id", "unit_index"], "left_anti").groupBy("doc_id", "unit_index").agg(F.count("*").alias("elements"))


_SAFE_SQL = "coalesce(nullif(trim(regexp_replace(regexp_extract({0}, '([^/\\\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'asset.bin')"


@query("safe_asset_names", f"SELECT doc_id, filename, {_SAFE_SQL.format('filename')} AS safe_name FROM {DOCS}")
def safe_asset_names(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "canonical_docs").select("doc_id", "filename", text.safe_name(F.col("filename")).alias("safe_name"))


@query(
    "asset_path_collisions",
    f"""SELECT doc_id, asset_id, CASE WHEN rn = 1 THEN path ELSE 'assets/' || lpad(CAST(no AS VARCHAR), 3, '0') || '_' || name END AS output_path FROM (
      SELECT *, 'assets/' || name AS path, row_number() OVER (PARTITION BY doc_id, name ORDER BY no, asset_id) AS rn FROM (SELECT doc_id, asset_id, {_ASSET_NO} AS no, {_SAFE_SQL.format("coalesce(original_name, '')")} AS name FROM {ASSETS}))""",
)
def asset_path_collisions(spark: SparkSession, d: str) -> DataFrame:
    no = F.regexp_extract("asset_id", r"([0-9]+)$", 1).try_cast("int")
    rows = once(spark, d, "assets").select("doc_id", "asset_id", no.alias("no"), text.safe_name(F.coalesce("original_name", F.lit(""))).alias("name"))
    rn = F.row_number().over(W.partitionBy("doc_id", "name").orderBy("no", "asset_id"))
    other = F.concat(F.lit("assets/"), F.lpad(F.col("no").cast("string"), 3, "0"), F.lit("_"), F.col("name"))
    return rows.withColumn("rn", rn).select("doc_id", "asset_id", F.when(F.col("rn") == 1, F.concat(F.lit("assets/"), "name")).otherwise(other).alias("output_path"))


_MEDIA_SQL = "map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.MEDIA_TYPES.items()) + "}, {0})[1]"


@query("media_type_by_name", f"SELECT doc_id, asset_id, {_EXT_SQL.format('output_path')} AS extension, media_type IS NOT DISTINCT FROM {_MEDIA_SQL.replace('{0}', _EXT_SQL.format('output_path'))} AS agrees FROM {ASSETS}")
def media_type_by_name(spark: SparkSession, d: str) -> DataFrame:
    ext = text.extension(F.col("output_path"))
    rows = once(spark, d, "assets").select("doc_id", "asset_id", ext.alias("extension"), "media_type")
    return rows.select("doc_id", "asset_id", "extension", F.col("media_type").eqNullSafe(text.media_type(F.col("extension"))).alias("agrees"))


@query("extension_contradicts", f"SELECT doc_id, extension, document_type FROM {DOCS} WHERE extension <> document_type")
def extension_contradicts(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "canonical_docs").where("extension <> document_type").select("doc_id", "extension", "document_type")


_ESCAPE_SQL = "replace(replace(replace(coalesce({0}, ''), '\\', '\\\\'), '|', '\\|'), chr(10), '<br>')"


@query("md_escape", f"SELECT elem_no, {_ESCAPE_SQL.format('text')} AS escaped FROM {ELEMENTS}")
def md_escape(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "elements").select("elem_no", text.md_escape(F.col("text")).alias("escaped"))


_LINES_OF_SQL = r"CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END FROM (SELECT string_split_regex({0}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l)"
_BLANK_SQL = "nullif({0}, '')"
#: One element outside a sheet.
_ELEMENT_SQL = f"""CASE element_type WHEN 'metadata' THEN NULL WHEN 'heading' THEN '### ' || coalesce({_BLANK_SQL.format('text')}, '[Heading]')
  WHEN 'list' THEN CASE WHEN text <> '' THEN (SELECT array_to_string(list_transform({_LINES_OF_SQL.format('text').replace(' FROM', ', lambda x: chr(45) || chr(32) || x), chr(10)) FROM', 1)}) END
  WHEN 'table' THEN {_BLANK_SQL.format('text')} WHEN 'note' THEN '> **Note:** ' || replace({_BLANK_SQL.format('text')}, chr(10), ' ')
  WHEN 'image' THEN '[Image: ' || coalesce({_BLANK_SQL.format("data->'image'->>'filename'")}, element_id) || ']'
  WHEN 'link' THEN '[' || coalesce({_BLANK_SQL.format('text')}, data->>'uri') || '](' || {_BLANK_SQL.format("data->>'uri'")} || ')'
  WHEN 'code' THEN '```text' || chr(10) || {_BLANK_SQL.format('text')} || chr(10) || '```' WHEN 'formula' THEN '```text' || chr(10) || {_BLANK_SQL.format('text')} || chr(10) || '```' ELSE {_BLANK_SQL.format('text')} END"""


@query("md_elements", f"SELECT elem_no, {_ELEMENT_SQL} AS markdown FROM {ELEMENTS}")
def md_elements(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "elements").select("elem_no", render.element_markdown().alias("markdown"))


def _rendered(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return (*(once(spark, d, n) for n in ("canonical_docs", "units", "elements", "assets")), table(spark, d, "warnings"))


_UNIT_SQL = """rtrim(CASE WHEN kind = 'sheet' THEN '## Sheet ' || unit_index || ': ' || coalesce(name, '') WHEN kind = 'page' THEN '## Page ' || unit_index
  WHEN kind = 'slide' THEN '## Slide ' || unit_index || ': ' || coalesce(name, '') ELSE '## Document content: ' || coalesce(name, '') END)"""
_VALUE_SQL = "CASE json_type(data->'{0}') WHEN 'BOOLEAN' THEN CASE data->>'{0}' WHEN 'true' THEN 'True' ELSE 'False' END ELSE data->>'{0}' END"
_CELL_SQL = "'| ' || concat_ws(' | ', " + ", ".join(
    _ESCAPE_SQL.format(x)
    for x in ("coalesce(data->>'coordinate', source.cell)", *(_VALUE_SQL.format(k) for k in ("value", "formula", "cached_value")), "data->'comment'->>'text'", "coalesce(nullif(data->'hyperlink'->>'target', ''), data->'hyperlink'->>'location')")
) + ") || ' |'"
#: Everything a document's Markdown holds, block by block, as the elements' tree is written out line by line.
_BLOCKS_SQL = f"""WITH d AS {DOCS}, u AS {UNITS}, a AS {ASSETS}, e AS (SELECT e.*, u.kind FROM {ELEMENTS} e JOIN u ON u.doc_id = e.doc_id AND u.unit_index = e.unit_index),
 counts AS (SELECT d.doc_id, (SELECT count(*) FROM u WHERE u.doc_id = d.doc_id) AS units, (SELECT count(*) FROM e WHERE e.doc_id = d.doc_id) AS elements, (SELECT count(*) FROM a WHERE a.doc_id = d.doc_id) AS assets FROM d),
 b(doc_id, section, unit_no, zone, order_no, tie, glue, block) AS (
  SELECT d.doc_id, 0, 0, 0, 0, NULL, false, '# ' || coalesce(filename, '') || chr(10) || chr(10) || array_to_string(['- Type: `' || coalesce(document_type, '') || '`', '- Units: ' || c.units, '- Elements: ' || c.elements, '- Assets: ' || c.assets, '- SHA-256: `' || coalesce(sha256, '') || '`', '- Extractor: `' || coalesce(extractor, '') || '`'], chr(10)) FROM d JOIN counts c ON c.doc_id = d.doc_id
  UNION ALL SELECT doc_id, 1, unit_index, 0, 0, NULL, false, {_UNIT_SQL} FROM u
  UNION ALL SELECT doc_id, 1, unit_index, 0, 1, NULL, false, '- State: `' || coalesce(metadata->>'state', '') || '`' || chr(10) || '- Used range: ' || coalesce(metadata->>'max_row', '0') || ' row(s) × ' || coalesce(metadata->>'max_column', '0') || ' column(s)' FROM u WHERE kind = 'sheet'
  UNION ALL SELECT DISTINCT doc_id, 1, unit_index, 0, 3, NULL, false, '### Cells' || chr(10) || chr(10) || '| Cell | Value | Formula | Cached value | Comment | Hyperlink |' || chr(10) || '|---|---|---|---|---|---|' FROM e WHERE kind = 'sheet' AND element_type = 'cell'
  UNION ALL SELECT doc_id, 1, unit_index, 1, element_order, element_id, true, {_CELL_SQL} FROM e WHERE kind = 'sheet' AND element_type = 'cell'
  UNION ALL SELECT doc_id, 1, unit_index, 2, element_order, element_id, false, {_ELEMENT_SQL} FROM e WHERE kind IS DISTINCT FROM 'sheet'
  UNION ALL SELECT doc_id, 1, unit_index, 3, 0, NULL, false, '### Excel table definitions' || chr(10) || chr(10) || string_agg('- `' || coalesce(nullif(data->>'display_name', ''), nullif(data->>'name', ''), element_id) || '`: `' || coalesce(data->>'ref', '') || '`', chr(10) ORDER BY element_order, element_id) FROM e WHERE kind = 'sheet' AND element_type = 'table' GROUP BY doc_id, unit_index
  UNION ALL SELECT doc_id, 1, unit_index, 4, 0, NULL, false, '### Images' || chr(10) || chr(10) || string_agg('- `' || coalesce(nullif(data->'image'->>'asset_id', ''), 'unlinked-asset') || '` anchored near row ' || coalesce(data->'image'->'from'->>'row_zero_based', '?') || ', column ' || coalesce(data->'image'->'from'->>'column_zero_based', '?'), chr(10) ORDER BY element_order, element_id) FROM e WHERE kind = 'sheet' AND element_type = 'image' GROUP BY doc_id, unit_index
  UNION ALL SELECT doc_id, 4, 0, 0, 0, NULL, false, '## Assets' || chr(10) || chr(10) || string_agg('- `' || asset_id || '` → `' || coalesce(output_path, original_name, '') || '` (' || coalesce(media_type, asset_type, '') || ')', chr(10) ORDER BY {_ASSET_NO}, asset_id) FROM a GROUP BY doc_id
  UNION ALL SELECT doc_id, 5, 0, 0, 0, NULL, false, '## Extraction warnings' || chr(10) || chr(10) || string_agg('- `' || code || '`: ' || coalesce(message, ''), chr(10) ORDER BY '- `' || code || '`: ' || coalesce(message, '')) FROM warnings GROUP BY doc_id)"""
_JOINED_SQL = "string_agg(CASE WHEN {first} THEN '' WHEN glue THEN chr(10) ELSE chr(10) || chr(10) END || block, '' ORDER BY section, unit_no, zone, order_no, tie NULLS FIRST, block)"
_PLACE_SQL = "row_number() OVER (PARTITION BY {keys} ORDER BY section, unit_no, zone, order_no, tie NULLS FIRST, block) = 1 AS first"


@query(
    "md_documents",
    f"""{_BLOCKS_SQL} SELECT doc_id, regexp_replace({_JOINED_SQL.format(first='first')}, '\\s+$', '') || chr(10) AS markdown
  FROM (SELECT *, {_PLACE_SQL.format(keys='doc_id')} FROM b WHERE block IS NOT NULL AND doc_id IN (SELECT doc_id FROM d)) GROUP BY doc_id""",
)
def md_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = once(spark, d, "canonical_docs").select("doc_id")
    return render.markdown(*_rendered(spark, d)).join(docs, "doc_id", "left_semi")


@query(
    "md_chunks",
    f"""{_BLOCKS_SQL} SELECT doc_id, section, unit_no, zone, CAST(chunk AS INTEGER) AS chunk_no, bool_or(glue AND first) AS glue, {_JOINED_SQL.format(first='first')} AS markdown
  FROM (SELECT *, {_PLACE_SQL.format(keys='doc_id, section, unit_no, zone, chunk')} FROM (SELECT *, greatest(order_no, 0) // {render.CHUNK} AS chunk FROM b WHERE block IS NOT NULL)) GROUP BY doc_id, section, unit_no, zone, chunk""",
)
def md_chunks(spark: SparkSession, d: str) -> DataFrame:
    return render.markdown_chunks(*_rendered(spark, d))


@query("json_documents")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    return render.json_document(once(spark, d, "canonical_docs"), once(spark, d, "units"), once(spark, d, "elements"), once(spark, d, "assets"), table(spark, d, "warnings"))


@query(
    "json_elements",
    f"""WITH u AS {UNITS}, e AS (SELECT e.* FROM {ELEMENTS} e JOIN u ON u.doc_id = e.doc_id AND u.unit_index = e.unit_index WHERE e.doc_id IN (SELECT doc_id FROM canonical_docs))
    SELECT doc_id, unit_index, element_id, element_type, element_order, text, source.row_no AS row_no, source.bbox.left_x AS left_x, source IS NOT NULL AS placed, CAST(len(json_keys(coalesce(TRY_CAST(data AS JSON), '{{}}'))) AS INTEGER) AS fields FROM e""",
)
def json_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements as they are read back from the documents' JSON."""
    shape = "units array<struct<index:int,elements:array<struct<element_id:string,element_type:string,`order`:int,text:string,data:map<string,string>,source:struct<row:int,bbox:struct<left:double>>>>>>"
    docs = json_documents(spark, d).select("doc_id", F.from_json("json", shape).alias("j"))
    units = docs.select("doc_id", F.explode("j.units").alias("u")).select("doc_id", F.col("u.index").alias("unit_index"), F.explode("u.elements").alias("e"))
    return units.select(
        "doc_id", "unit_index", "e.element_id", "e.element_type", F.col("e.order").alias("element_order"), "e.text", F.col("e.source.row").alias("row_no"),
        F.col("e.source.bbox.left").alias("left_x"), F.col("e.source").isNotNull().alias("placed"), F.size(F.map_keys("e.data")).alias("fields"),
    )


@query("md_unit_headings", f"SELECT doc_id, unit_index, {_UNIT_SQL} AS heading FROM {UNITS}")
def md_unit_headings(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "units").select("doc_id", "unit_index", render.unit_heading().alias("heading"))


@query("md_cell_table", f"SELECT elem_no, {_CELL_SQL} AS line FROM {ELEMENTS} WHERE element_type = 'cell'")
def md_cell_table(spark: SparkSession, d: str) -> DataFrame:
    return render.cells_of(once(spark, d, "elements")).select("elem_no", render.cell_line().alias("line"))


@query("grid_table_text", "SELECT r_name AS sheet, '| ' || r_name || ' | Key |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS grid FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def grid_table_text(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows, fixed
    rows = joined.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.col("r_name"), F.lit("Key"))), F.transform("r", lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string"))))
    return rows.select(F.col("r_name").alias("sheet"), render.grid(cells).alias("grid"))


@query(
    "archive_running_total",
    f"""SELECT doc_id, asset_id, size_bytes, total, total > 1000000 AND total - size_bytes <= 1000000 AS first_over FROM (SELECT doc_id, asset_id, size_bytes,
      CAST(sum(size_bytes) OVER (PARTITION BY doc_id ORDER BY {_ASSET_NO}, asset_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {ASSETS})""",
)
def archive_running_total(spark: SparkSession, d: str) -> DataFrame:
    no = F.regexp_extract("asset_id", r"([0-9]+)$", 1).try_cast("int")
    total = F.sum("size_bytes").over(W.partitionBy("doc_id").orderBy(no, "asset_id").rowsBetween(W.unboundedPreceding, 0))
    return once(spark, d, "assets").select("doc_id", "asset_id", "size_bytes", total.alias("total")).withColumn("first_over", (F.col("total") > 1_000_000) & (F.col("total") - F.col("size_bytes") <= 1_000_000))


@query(
    "scanned_heuristic",
    f"""SELECT d.doc_id, coalesce(t.chars, 0) AS chars, u.pages, coalesce(t.chars, 0) < greatest(10, 3 * u.pages) AS possibly_scanned FROM {DOCS} d JOIN (SELECT doc_id, count(*) AS pages FROM {UNITS} GROUP BY 1) u ON u.doc_id = d.doc_id
      LEFT JOIN (SELECT doc_id, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM {ELEMENTS} GROUP BY 1) t ON t.doc_id = d.doc_id""",
)
def scanned_heuristic(spark: SparkSession, d: str) -> DataFrame:
    pages = once(spark, d, "units").groupBy("doc_id").agg(F.count("*").alias("pages"))
    chars = once(spark, d, "elements").groupBy("doc_id").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    rows = once(spark, d, "canonical_docs").select("doc_id").join(pages, "doc_id").join(chars, "doc_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0)).cast("long"))
    return rows.select("doc_id", "chars", "pages", (F.col("chars") < F.greatest(F.lit(10), 3 * F.col("pages"))).alias("possibly_scanned"))


@query("distinct_keep_first", f"SELECT doc_id, line, min(pos) AS first_pos, count(*) AS times FROM ({_LINES_SQL}) WHERE trim(line) <> '' GROUP BY doc_id, line")
def distinct_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(F.trim("line") != "").groupBy("doc_id", "line").agg(F.min("pos").alias("first_pos"), F.count("*").alias("times"))


@query("outline_levels", f"SELECT doc_id, CAST(length(regexp_extract(line, '^(#+) ', 1)) AS INTEGER) AS level, trim(regexp_replace(line, '^#+ ', '')) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS position FROM ({_LINES_SQL}) WHERE regexp_matches(line, '^#{{1,6}} ')")
def outline_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).where(F.col("line").rlike(r"^#{1,6} "))
    return rows.select("doc_id", F.length(F.regexp_extract("line", r"^(#+) ", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+ ", "")).alias("title"), F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).cast("long").alias("position"))


@query("dynamic_data_get", "SELECT event_id, TRY_CAST(props->>'k' AS BIGINT) AS k, json_type(props) AS shape FROM events")
def dynamic_data_get(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    shape = F.schema_of_variant(v)
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.when(shape.startswith("OBJECT"), "OBJECT").when(shape.startswith("ARRAY"), "ARRAY").otherwise(shape).alias("shape"))


@query(
    "manifest_summary",
    f"""SELECT d.doc_id, coalesce(u.n, 0) AS units, coalesce(e.n, 0) AS elements, coalesce(a.n, 0) AS assets, coalesce(a.act, 0) AS active_assets, coalesce(w.n, 0) AS warnings FROM {DOCS} d
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM {UNITS} GROUP BY 1) u ON u.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM {ELEMENTS} GROUP BY 1) e ON e.doc_id = d.doc_id
      LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(count_if(asset_type IN ('embedded_object','activex_part','vba_project')) AS BIGINT) AS act FROM {ASSETS} GROUP BY 1) a ON a.doc_id = d.doc_id
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM warnings GROUP BY 1) w ON w.doc_id = d.doc_id""",
)
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest.summary(once(spark, d, "canonical_docs"), once(spark, d, "units"), once(spark, d, "elements"), once(spark, d, "assets"), table(spark, d, "warnings"))
    return rows.select("doc_id", "units", "elements", "assets", "active_assets", "warnings")


@query(
    "batch_summary",
    f"SELECT doc_id AS source, 'ok' AS status, CAST(NULL AS VARCHAR) AS error_type, CAST(NULL AS VARCHAR) AS error FROM {DOCS} UNION ALL SELECT path, 'error', error_type, error FROM rejects",
)
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest.batch_summary(once(spark, d, "canonical_docs"), table(spark, d, "rejects"))


@query("reject_reasons", "SELECT error_type, count(*) AS files, count(error) AS with_text FROM rejects GROUP BY error_type")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rejects").groupBy("error_type").agg(F.count("*").alias("files"), F.count("error").alias("with_text"))


@query("rejected_yet_present", f"SELECT DISTINCT r.path, d.doc_id FROM rejects r JOIN {DOCS} d ON regexp_extract(r.path, '([^/]*)$', 1) = d.filename")
def rejected_yet_present(spark: SparkSession, d: str) -> DataFrame:
    rejects = table(spark, d, "rejects").select("path", text.basename(F.col("path")).alias("filename"))
    return rejects.join(once(spark, d, "canonical_docs").select("doc_id", "filename"), "filename").select("path", "doc_id").dropDuplicates()


_STEM_SQL = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '([^.])\\.[^.]+$', '\\1')"


@query("output_directories", f"SELECT path, regexp_extract(regexp_replace(path, '^inbox/', ''), '^(.*/)[^/]*$', 1) || {_STEM_SQL.format('path')} || '__' || coalesce(nullif({_EXT_SQL.format('path')}, ''), 'file') || '_extracted' AS directory FROM (SELECT 'inbox/' || extension || '/' || filename AS path FROM {DOCS} UNION ALL SELECT path FROM rejects)")
def output_directories(spark: SparkSession, d: str) -> DataFrame:
    docs = once(spark, d, "canonical_docs").select(F.concat(F.lit("inbox/"), "extension", F.lit("/"), "filename").alias("path"))
    return docs.unionByName(table(spark, d, "rejects").select("path")).select("path", manifest.output_directory("path", "inbox").alias("directory"))


@query("warnings_by_code", "SELECT code, severity, count(*) AS n, count(DISTINCT doc_id) AS documents, count(source) AS with_source FROM warnings GROUP BY code, severity")
def warnings_by_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "warnings").groupBy("code", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.count("source").alias("with_source"))


@query("hidden_units", f"SELECT doc_id, unit_index, kind FROM {UNITS} WHERE metadata->>'hidden' = 'true'")
def hidden_units(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "units").where(F.try_variant_get(F.try_parse_json("metadata"), "$.hidden", "boolean")).select("doc_id", "unit_index", "kind")


@query(
    "core_properties",
    f"""SELECT doc_id, coalesce(p->'word'->'core_properties'->>'title', p->'workbook'->'core_properties'->>'title', p->'powerpoint'->'core_properties'->>'title', p->'pdf'->'metadata'->>'title') AS title,
      TRY_CAST(coalesce(p->'word'->'core_properties'->>'revision', p->'workbook'->'core_properties'->>'revision', p->'powerpoint'->'core_properties'->>'revision', p->'pdf'->'metadata'->>'revision') AS BIGINT) AS revision
    FROM (SELECT doc_id, CAST(properties AS JSON) AS p FROM {DOCS})""",
)
def core_properties(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("properties")
    roots = ("word.core_properties", "workbook.core_properties", "powerpoint.core_properties", "pdf.metadata")

    def get(name: str, kind: str) -> Column:
        return F.coalesce(*(F.try_variant_get(v, f"$.{r}.{name}", kind) for r in roots))

    return once(spark, d, "canonical_docs").select("doc_id", get("title", "string").alias("title"), get("revision", "long").alias("revision"))


@query("element_order_dense", f"SELECT elem_no, CAST(row_number() OVER (PARTITION BY doc_id, unit_index ORDER BY element_order, elem_no) AS INTEGER) AS position FROM {ELEMENTS}")
def element_order_dense(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "elements").select("elem_no", F.row_number().over(W.partitionBy("doc_id", "unit_index").orderBy("element_order", "elem_no")).alias("position"))


@query("children_of_elements", f"SELECT p.doc_id, p.element_id AS parent_id, count(*) AS children FROM {ELEMENTS} p JOIN {ELEMENTS} c ON c.doc_id = p.doc_id AND c.parent_element_id = p.element_id GROUP BY 1, 2")
def children_of_elements(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "elements").select("doc_id", "element_id", "parent_element_id")
    kids = rows.where("parent_element_id is not null").groupBy("doc_id", F.col("parent_element_id").alias("element_id")).agg(F.count("*").alias("children"))
    parents = rows.groupBy("doc_id", "element_id").agg(F.count("*").alias("same_id"))
    return kids.join(parents, ["doc_id", "element_id"]).select("doc_id", F.col("element_id").alias("parent_id"), (F.col("children") * F.col("same_id")).alias("children"))


@query("latest_delivery", "SELECT elem_no, count(*) AS deliveries, max(ingested_at) AS last_seen FROM elements GROUP BY elem_no HAVING count(*) > 1")
def latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").groupBy("elem_no").agg(F.count("*").alias("deliveries"), F.max("ingested_at").alias("last_seen")).where("deliveries > 1")


@query("asset_type_summary", "SELECT asset_type, asset_type IN ('embedded_object','activex_part','vba_project') AS active, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(size_bytes) AS largest FROM assets GROUP BY 1, 2")
def asset_type_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assets").groupBy("asset_type", F.col("asset_type").isin(*manifest.ACTIVE).alias("active")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"))


@query("iso_timestamps", f"SELECT doc_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') AS ingested FROM {DOCS} WHERE ingested_at IS NOT NULL")
def iso_timestamps(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "canonical_docs").groupBy("doc_id").agg(F.min("ingested_at").alias("t")).where("t is not null")
    return first.select("doc_id", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("ingested"))


@query("environment")
def environment(spark: SparkSession, d: str) -> DataFrame:
    return doctor.report(spark)


QUERIES.update(parsing.QUERIES)
SQL.update(parsing.SQL)
