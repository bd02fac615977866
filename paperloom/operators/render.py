"""Markdown and JSON of documents.

Markdown is a relation of lines with sort keys, built element by element inside the JVM, and one ordered
aggregate per document. Each element becomes one row with its finished text, so a document's aggregate
holds as many rows as it has elements.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import md_escape, split_lines
from paperloom.runtime import small


def _json(path: str, column: str = "data", kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(column), path, kind)


def shown(v: Column) -> Column:
    """A JSON value as text: truth values with a capital, null as null."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text)).otherwise(text)


def grid(rows: Column) -> Column:
    """A Markdown table of array<array<string>>: padded to one width, the first row as header; null if there is nothing."""
    width = F.array_max(F.transform(rows, F.size))

    def line(cells: Column) -> Column:
        full = F.concat(F.transform(cells, md_escape), F.array_repeat(F.lit(""), width - F.size(cells)))
        return F.concat(F.lit("| "), F.array_join(full, " | ", ""), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when((F.size(rows) > 0) & (width > 0), F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n"))


def table_rows(column: str = "data") -> Column:
    """array<array<string>> of `data.table`: its grid, else its rows; cells by their text, or values as they are."""
    first, second = (_json(f"$.table.{k}", column, "array<array<variant>>") for k in ("grid", "rows"))
    cells = F.when(F.size(first) > 0, first).otherwise(second)
    return F.transform(cells, lambda r: F.transform(r, lambda c: F.when(F.schema_of_variant(c).startswith("OBJECT"), shown(F.try_variant_get(c, "$.text", "variant"))).otherwise(shown(c))))


def element_markdown() -> Column:
    """The Markdown of one element outside a sheet, null where it has none."""
    text, kind = F.nullif(F.col("text"), F.lit("")), F.col("element_type")
    listed = F.array_join(F.transform(split_lines(text), lambda x: F.concat(F.lit("- "), x)), "\n")
    name = F.coalesce(F.nullif(_json("$.image.filename"), F.lit("")), F.col("element_id"))
    uri = F.nullif(_json("$.uri"), F.lit(""))
    is_table = _json("$.table", kind="map<string,variant>").isNotNull()
    return (
        F.when(kind == "metadata", F.lit(None))
        .when(kind == "heading", F.concat(F.lit("### "), F.coalesce(text, F.lit("[Heading]"))))
        .when(kind == "list", listed)
        .when(kind == "table", F.when(is_table, grid(table_rows())).otherwise(text))
        .when(kind == "note", F.concat(F.lit("> **Note:** "), F.replace(text, F.lit("\n"), F.lit(" "))))
        .when(kind == "image", F.concat(F.lit("[Image: "), name, F.lit("]")))
        .when(kind == "link", F.concat(F.lit("["), F.coalesce(text, uri), F.lit("]("), uri, F.lit(")")))
        .when(kind.isin("code", "formula"), F.concat(F.lit("```text\n"), text, F.lit("\n```")))
        .otherwise(text)
    )


def unit_heading() -> Column:
    name, index, kind = F.coalesce("name", F.lit("")), F.col("unit_index").cast("string"), F.col("kind")
    return F.rtrim(
        F.when(kind == "sheet", F.concat(F.lit("## Sheet "), index, F.lit(": "), name))
        .when(kind == "page", F.concat(F.lit("## Page "), index))
        .when(kind == "slide", F.concat(F.lit("## Slide "), index, F.lit(": "), name))
        .otherwise(F.concat(F.lit("## Document content: "), name))
    )


#: A document's sections in their order.
HEAD, UNITS, FORMS, RENDERED, ASSETS, WARNINGS, UNSUPPORTED = range(7)
#: What stands in a unit, in its order: title and facts, cells, everything else.
TITLE, CELLS, BODY, TABLES, IMAGES = range(5)


def _block(df: DataFrame, section: int, block: Column, unit: Column | None = None, zone: int = TITLE, order: Column | None = None, tie: Column | None = None, glue: bool = False) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "doc_id", F.lit(section).alias("section"), (F.lit(0) if unit is None else unit).cast("int").alias("unit_no"), F.lit(zone).alias("zone"), (F.lit(0) if order is None else order).cast("int").alias("order_no"),
        (none if tie is None else tie).cast("string").alias("tie"), F.lit(glue).alias("glue"), block.alias("block"),
    ).where("block is not null")


def _code(c: Column) -> Column:
    return F.concat(F.lit("`"), F.coalesce(c.cast("string"), F.lit("")), F.lit("`"))


#: Head of a sheet's table of cells (fixed value).
CELL_HEAD = "### Cells\n\n| Cell | Value | Formula | Cached value | Comment | Hyperlink |\n|---|---|---|---|---|---|"


def cell_line() -> Column:
    """A cell's row of its sheet's six-column table."""
    link = F.coalesce(F.nullif(_json("$.hyperlink.target"), F.lit("")), _json("$.hyperlink.location"))
    columns = [F.coalesce(_json("$.coordinate"), F.col("source.cell")), *(shown(_json(f"$.{k}", kind="variant")) for k in ("value", "formula", "cached_value")), _json("$.comment.text"), link]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(md_escape(c) for c in columns)), F.lit(" |"))


def cells_of(elements: DataFrame) -> DataFrame:
    return elements.where("element_type = 'cell'")


def sheet_facts() -> Column:
    """State and used range of a sheet."""
    size = [F.coalesce(_json(f"$.{k}", "metadata"), F.lit("0")) for k in ("max_row", "max_column")]
    return F.concat(F.lit("- State: "), _code(_json("$.state", "metadata")), F.lit("\n- Used range: "), size[0], F.lit(" row(s) × "), size[1], F.lit(" column(s)"))


def sheet_stories() -> Column:
    """Headers and footers of a sheet, by role."""
    stories = F.map_entries(F.from_json(F.get_json_object("metadata", "$.headers_footers"), "map<string,struct<left:string,center:string,right:string>>"))
    lines = F.transform(stories, lambda x: F.struct(x["key"].alias("role"), F.array_join(F.filter(F.array(x["value"]["left"], x["value"]["center"], x["value"]["right"]), lambda v: v.isNotNull() & (v != "")), " | ").alias("text")))
    shown_lines = F.filter(lines, lambda x: x["text"] != "")
    listed = F.array_join(F.transform(shown_lines, lambda x: F.concat(F.lit("- **"), F.initcap(F.replace(x["role"], F.lit("_"), F.lit(" "))), F.lit("**: "), x["text"])), "\n")
    return F.when(F.size(shown_lines) > 0, F.concat(F.lit("### Headers / footers\n\n"), listed))


def listing(df: DataFrame, keys: list[str], title: str, line: Column, order: Column) -> DataFrame:
    """`keys` and one block for each: the title and the lines in order."""
    rows = df.select(*keys, F.struct(order.alias("o"), line.alias("line")).alias("r")).where("r.line is not null")
    text = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return text.select(*keys, F.concat(F.lit(f"{title}\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("block"))


def blocks(documents: DataFrame, units: DataFrame, elements: DataFrame, assets: DataFrame, warnings: DataFrame, unsupported: DataFrame | None = None) -> DataFrame:
    """doc_id, section, unit_no, zone, order_no, tie, glue and block of everything a document's Markdown holds.

    Elements of a unit that isn't there have no place and are left out, as in the tree of the document.
    """
    index, order, tie = F.col("unit_index"), F.col("element_order"), F.col("element_id")
    kinds = small(units.select("doc_id", "unit_index", "kind").dropDuplicates(["doc_id", "unit_index"]))
    placed = elements.join(kinds, ["doc_id", "unit_index"])
    sheets, other = placed.where("kind = 'sheet'"), placed.where("kind is null or kind <> 'sheet'")
    counts = documents.select("doc_id")
    for name, df in (("units", kinds), ("elements", placed), ("assets", assets)):
        counts = counts.join(df.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    head = documents.join(counts, "doc_id")
    facts = [("Type", _code(F.col("document_type"))), *((n, F.coalesce(F.col(n.lower()), F.lit(0)).cast("string")) for n in ("Units", "Elements", "Assets")), ("SHA-256", _code(F.col("sha256"))), ("Extractor", _code(F.col("extractor")))]
    title = F.concat(F.lit("# "), F.coalesce("filename", F.lit("")), F.lit("\n\n"), F.concat_ws("\n", *(F.concat(F.lit(f"- {n}: "), c) for n, c in facts)))
    table_name = F.coalesce(*(F.nullif(_json(f"$.{k}"), F.lit("")) for k in ("display_name", "name")), tie)
    anchor = [F.coalesce(_json(f"$.image.from.{k}_zero_based"), F.lit("?")) for k in ("row", "column")]
    picture = F.concat(F.lit("- "), _code(F.coalesce(F.nullif(_json("$.image.asset_id"), F.lit("")), F.lit("unlinked-asset"))), F.lit(" anchored near row "), anchor[0], F.lit(", column "), anchor[1])
    in_order = F.struct(order, tie)
    sheet_units = units.where("kind = 'sheet'")
    tables = listing(sheets.where("element_type = 'table'"), ["doc_id", "unit_index"], "### Excel table definitions", F.concat(F.lit("- "), _code(table_name), F.lit(": "), _code(_json("$.ref"))), in_order)
    images = listing(sheets.where("element_type = 'image'"), ["doc_id", "unit_index"], "### Images", picture, in_order)
    number = F.regexp_extract("asset_id", r"(\d+)$", 1).try_cast("int")
    asset = F.concat(F.lit("- "), _code(F.col("asset_id")), F.lit(" → "), _code(F.coalesce("output_path", "original_name")), F.lit(" ("), F.coalesce("media_type", "asset_type", F.lit("")), F.lit(")"))
    parts = [
        _block(head, HEAD, title),
        _block(units, UNITS, unit_heading(), index),
        _block(sheet_units, UNITS, sheet_facts(), index, order=F.lit(1)),
        _block(sheet_units, UNITS, sheet_stories(), index, order=F.lit(2)),
        _block(cells_of(sheets).select("doc_id", "unit_index").dropDuplicates(), UNITS, F.lit(CELL_HEAD), index, order=F.lit(3)),
        _block(cells_of(sheets), UNITS, cell_line(), index, CELLS, order, tie, True),
        _block(slide_inherited(units), UNITS, F.col("block"), index, order=F.lit(1)),
        _block(other, UNITS, element_markdown(), index, BODY, order, tie),
        _block(tables, UNITS, F.col("block"), index, TABLES),
        _block(images, UNITS, F.col("block"), index, IMAGES),
        _block(form_fields(documents), FORMS, F.col("block")),
        _block(rendered_pages(documents), RENDERED, F.col("block")),
        _block(listing(assets, ["doc_id"], "## Assets", asset, F.struct(number, F.col("asset_id"))), ASSETS, F.col("block")),
        _block(listing(warnings, ["doc_id"], "## Extraction warnings", F.concat(F.lit("- "), _code(F.col("code")), F.lit(": "), F.coalesce("message", F.lit(""))), F.lit(0)), WARNINGS, F.col("block")),
    ]
    if unsupported is not None:
        line = F.rtrim(F.concat(F.lit("- "), _code(F.col("object_type")), F.lit(" / "), _code(F.col("status")), F.lit(": "), F.coalesce("description", F.lit(""))))
        parts.append(_block(listing(unsupported, ["doc_id"], "## Unsupported or partially parsed objects", line, F.lit(0)), UNSUPPORTED, F.col("block")))
    return reduce(DataFrame.unionByName, parts)


def slide_inherited(units: DataFrame) -> DataFrame:
    """Text of a slide's layout and master, each text once."""
    item = "array<struct<text:string,accessibility:struct<description:string>>>"
    texts = F.concat(*(F.coalesce(_json(f"$.{k}_visible_text", "metadata", item), F.array().cast(item)) for k in ("layout", "master")))
    once = F.array_distinct(F.transform(texts, lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["accessibility"]["description"])))
    found = units.where("kind = 'slide'").select("doc_id", "unit_index", F.filter(once, lambda x: x.isNotNull() & (x != "")).alias("t")).where(F.size("t") > 0)
    return found.select("doc_id", "unit_index", F.concat(F.lit("### Inherited layout/master content\n\n"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("block"))


def form_fields(documents: DataFrame) -> DataFrame:
    """Form fields of a PDF in their order."""
    fields = F.map_entries(F.from_json(F.get_json_object("properties", "$.pdf.form_fields"), "map<string,struct<value:string,field_type:string>>"))
    found = documents.where("document_type = 'pdf'").select("doc_id", fields.alias("f")).where(F.size("f") > 0)
    line = F.transform("f", lambda x: F.concat(F.lit("- **"), x["key"], F.lit("**: "), md_escape(x["value"]["value"]), F.lit(" (`"), F.coalesce(x["value"]["field_type"], F.lit("")), F.lit("`)")))
    return found.select("doc_id", F.concat(F.lit("## PDF form fields\n\n"), F.array_join(line, "\n")).alias("block"))


#: What stands above the rendered pages (fixed value).
RENDERED_NOTE = "Native Word elements above preserve document structure; the following renderer-derived text preserves page boundaries."


def rendered_pages(documents: DataFrame) -> DataFrame:
    """Text of a Word document's rendered pages."""
    pages = _json("$.word.pagination.rendered_pages", "properties", "array<struct<page_number:int,text:string>>")
    found = documents.where(F.col("document_type").isin("docx", "docm", "doc")).select("doc_id", pages.alias("p")).where(F.size("p") > 0)
    text = F.transform("p", lambda x: F.concat(F.lit("### Rendered page "), x["page_number"].cast("string"), F.lit("\n\n"), F.coalesce(F.nullif(x["text"], F.lit("")), F.lit("[No extractable text]"))))
    return found.select("doc_id", F.concat(F.lit(f"## Rendered Word pagination reference\n\n{RENDERED_NOTE}\n\n"), F.array_join(text, "\n\n")).alias("block"))


#: Blocks of one chunk at most, as element orders count within a unit.
CHUNK = 1000


def markdown_chunks(*relations: DataFrame) -> DataFrame:
    """doc_id, section, unit_no, chunk_no and markdown: a document in pieces of bounded size, in the order of these keys.

    What a document of any size can be written from: no group grows with it.
    """
    keys = ["doc_id", "section", "unit_no", "zone", "chunk_no"]
    rows = blocks(*relations).withColumn("chunk_no", F.floor(F.greatest("order_no", F.lit(0)) / CHUNK).cast("int"))
    grouped = rows.select(*keys, F.struct("order_no", "tie", "glue", "block").alias("r")).groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return grouped.select(*keys, F.col("rows")[0]["glue"].alias("glue"), joined(F.col("rows"), "block").alias("markdown"))


def joined(rows: Column, text: str) -> Column:
    """Texts of array<struct> with a blank line between them, or only a line end before those that are glued on."""
    parts = F.transform(rows, lambda r, i: F.concat(F.when(i == 0, "").when(r["glue"], "\n").otherwise("\n\n"), r[text]))
    return F.array_join(parts, "")


def markdown(*relations: DataFrame) -> DataFrame:
    """doc_id and markdown: a document's blocks in order, one blank line between them and one line end at the end."""
    rows = markdown_chunks(*relations).select("doc_id", F.struct("section", "unit_no", "zone", "chunk_no", "glue", "markdown").alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return rows.select("doc_id", F.concat(F.regexp_replace(joined(F.col("rows"), "markdown"), r"\s+$", ""), F.lit("\n")).alias("markdown"))


def _raw(column: str) -> Column:
    return F.coalesce(F.try_parse_json(column), F.parse_json(F.lit("{}")))


def source_object() -> Column:
    """An element's source under the names of the document's tree; null where it has none."""
    names = {"row_no": "row", "column_no": "column"}
    sides = {"left_x": "left", "top_y": "top", "right_x": "right", "bottom_y": "bottom"}
    box = F.when(F.col("source.bbox").isNotNull(), F.struct(*(F.col(f"source.bbox.{c}").alias(n) for c, n in sides.items()), F.col("source.bbox.coordinate_system").alias("coordinate_system")))
    fields = ("unit_index", "unit_name", "page_number", "sheet_name", "slide_number", "row_no", "column_no", "cell")
    return F.when(F.col("source").isNotNull(), F.struct(*(F.col(f"source.{c}").alias(names.get(c, c)) for c in fields), box.alias("bbox"), F.col("source.archive_part").alias("archive_part")))


def json_document(documents: DataFrame, units: DataFrame, elements: DataFrame, assets: DataFrame, warnings: DataFrame, unsupported: DataFrame | None = None) -> DataFrame:
    """doc_id and json: the whole tree of each document, nulls kept; an element has parent_element_id beside its tree's fields."""
    keep = {"ignoreNullFields": "false"}
    tree = F.struct("element_id", "element_type", F.col("element_order").alias("order"), "text", "markdown", _raw("data").alias("data"), source_object().alias("source"), F.array().cast("array<string>").alias("children"), "parent_element_id")
    e = elements.select("doc_id", "unit_index", F.struct("element_order", "element_id", F.to_json(tree, keep).alias("j")).alias("x"))
    per_unit = e.groupBy("doc_id", "unit_index").agg(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["j"]).alias("elements"))
    u = units.join(per_unit, ["doc_id", "unit_index"], "left")
    head = F.to_json(F.struct(F.col("unit_index").alias("index"), "kind", "name"), keep)
    unit_json = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"elements":['), F.coalesce(F.array_join("elements", ","), F.lit("")), F.lit('],"metadata":'), F.to_json(_raw("metadata")), F.lit("}"))
    lists = {"units": u.select("doc_id", F.col("unit_index").alias("k"), unit_json.alias("j"))}
    for name, df, key in (("warnings", warnings, "code"), ("unsupported_objects", unsupported, "object_type"), ("assets", assets, "asset_id")):
        if df is not None:
            columns = [_raw(c).alias(c) if c in ("metadata", "details") else source_object().alias(c) if c == "source" else F.col(c) for c in df.columns if c not in ("doc_id", "ingested_at")]
            order = F.regexp_extract(key, r"(\d+)$", 1).try_cast("int") if name == "assets" else F.col(key)
            lists[name] = df.select("doc_id", F.struct(order, key).alias("k"), F.to_json(F.struct(*columns), keep).alias("j"))
    out = documents.select("doc_id", F.to_json(F.struct(*(c if c != "properties" else _raw(c).alias(c) for c in documents.columns if c not in ("doc_id", "schema_version", "ingested_at"))), keep).alias("m"), F.to_json(F.struct("schema_version"), keep).alias("v"))
    out = out.select("doc_id", "v", F.concat(F.lit('{"metadata":'), "m").alias("j"))
    for name in ("units", "warnings", "unsupported_objects", "assets"):
        text = F.lit("")
        if name in lists:
            grouped = lists[name].groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda s: s["j"]).alias("__l"))
            out, text = out.join(grouped, "doc_id", "left"), F.coalesce(F.array_join("__l", ","), F.lit(""))
        version = F.concat(F.lit(","), F.regexp_replace("v", r"^\{|\}$", "")) if name == "units" else F.lit("")
        out = out.select("doc_id", "v", F.concat("j", F.lit(f',"{name}":['), text, F.lit("]"), version).alias("j"))
    return out.select("doc_id", F.concat("j", F.lit("}")).alias("json"))
