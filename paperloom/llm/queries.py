"""Registered queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import encoding, language, leakage, lookalike, packing, scans, shared, splitting, tokens
from paperloom.runtime import table

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


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged_elements(table(spark, d, "elements")).select("elem_no")


@query("p3_repaired")
def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged_elements(table(spark, d, "elements"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, d, "elements"))


@query("p5_canonical")
def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "elements").select("elem_no", "text").dropDuplicates(["elem_no"])
    return lookalike.canonical(once).select("elem_no", "canonical", (F.col("text") != F.col("canonical")).alias("changed"))


_NAME_SQL = "lower(regexp_extract(trim(coalesce(p->'word'->'core_properties'->>'language', p->'workbook'->'core_properties'->>'language', p->'powerpoint'->'core_properties'->>'language', p->'pdf'->'metadata'->>'$.\"/Lang\"')), '^([^\\s_-]*)', 1))"
_LABEL_SQL = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(n) for n in names.split())}) THEN '{lang}'" for lang, names in language.NAMES.items()) + " END"


@query("p6_labels", f"SELECT DISTINCT doc_id, {_LABEL_SQL} AS label FROM (SELECT doc_id, {_NAME_SQL} AS name FROM (SELECT doc_id, TRY_CAST(properties AS JSON) AS p FROM canonical_docs WHERE doc_id IS NOT NULL))")
def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    return language.labels(table(spark, d, "canonical_docs")).select("doc_id", "label")


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return language.language_found(table(spark, d, "canonical_docs"), table(spark, d, "elements"), table(spark, d, "documents"))


@query("p6_languages")
def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "canonical_docs"), table(spark, d, "elements"), table(spark, d, "documents"))


#: Every window of twelve words of an item, looked up in every document.
_LEAKS_SQL = r"""WITH n AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(nfc_normalize(regexp_replace(text, '[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{fe0e}\x{fe0f}\x{feff}]', '', 'g'))), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
 i AS (SELECT item_id, string_split(trim(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM eval_items),
 p AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[k : k + 11], ' ') || ' ' AS s FROM i, unnest(range(1, len(w) - 10)) AS r(k))
 SELECT DISTINCT doc_id, item_id FROM n JOIN p ON contains(n.t, p.s)"""


@query("p9_found", _LEAKS_SQL)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


#: Edits of a passage of twelve words that p9_leaks allows.
EDITS = 3


@query("p9_leaks")
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), budget=EDITS)


#: Every stretch of 240 characters of every document.
_SHARED_SQL = """WITH g AS (SELECT DISTINCT doc_id, hash(substr(text, k, 240)) AS h FROM documents, unnest(range(1, length(text) - 238)) AS r(k) WHERE length(text) >= 240),
 s AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), m AS (SELECT g.* FROM g SEMI JOIN s ON g.h = s.h)
 SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id"""


@query("p10_found", _SHARED_SQL)
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared.shared_pairs(table(spark, d, "documents"))


@query(
    "p10_classes",
    f"""WITH p AS ({_SHARED_SQL}), c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE length(text) >= 240),
 l AS (SELECT a.class_id AS x, b.class_id AS y FROM p JOIN c a ON a.doc_id = p.doc_id_a JOIN c b ON b.doc_id = p.doc_id_b WHERE a.class_id <> b.class_id), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 n AS (SELECT x, count(*) AS links FROM e GROUP BY x)
 SELECT doc_id, class_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN n ON n.x = c.class_id""",
)
def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return shared.class_links(table(spark, d, "documents"))


#: Every place of a stretch of 240 characters that another document holds too, places within reach of each other made one span; the same for those that an earlier document holds.
_RECORDS_SQL = """WITH g AS (SELECT doc_id, k, hash(substr(text, k, 240)) AS h FROM documents, unnest(range(1, length(text) - 238)) AS r(k) WHERE length(text) >= 240),
 s AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
 m AS (SELECT doc_id, k, kind FROM g JOIN s ON g.h = s.h, unnest(CASE WHEN doc_id > first THEN ['all', 'later'] ELSE ['all'] END) AS u(kind)),
 t AS (SELECT *, k - lag(k) OVER (PARTITION BY kind, doc_id ORDER BY k) AS step FROM m),
 i AS (SELECT *, sum(CASE WHEN step <= 240 THEN 0 ELSE 1 END) OVER (PARTITION BY kind, doc_id ORDER BY k) AS island FROM t),
 x AS (SELECT kind, doc_id, min(k) - 1 AS a, max(k) + 239 AS z FROM i GROUP BY kind, doc_id, island),
 p AS (SELECT kind, doc_id, CAST(sum(z - a) AS BIGINT) AS n, list([a, z] ORDER BY a) AS spans FROM x GROUP BY kind, doc_id)
 SELECT d.doc_id, coalesce(length(d.text), 0) AS chars, coalesce(p.n, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN coalesce(p.n, 0) / length(d.text) ELSE 0.0::DOUBLE END AS shared_share, coalesce(p.spans, []) AS spans,
  coalesce(q.n, 0) AS later_chars, coalesce(q.spans, []) AS later_spans FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND p.kind = 'all' LEFT JOIN p q ON q.doc_id = d.doc_id AND q.kind = 'later'"""


@query("p10_records", _RECORDS_SQL)
def p10_records(spark: SparkSession, d: str) -> DataFrame:
    return shared.shared_spans(table(spark, d, "documents"))


@query("p10_without")
def p10_without(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared.without(docs, shared.shared_spans(docs))


_LINE_SPANS_SQL = """WITH l AS (SELECT doc_id, u.line AS line, length(u.line) AS n, sum(length(u.line) + 1) OVER (PARTITION BY doc_id ORDER BY u.pos ROWS UNBOUNDED PRECEDING) - length(u.line) - 1 AS start
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE text IS NOT NULL),
 f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, start) AS nth FROM l WHERE n >= 40)
 SELECT doc_id, CAST(start AS BIGINT) AS start_char, CAST(start + n AS BIGINT) AS end_char FROM f WHERE nth > 1"""


@query("p10_line_spans", _LINE_SPANS_SQL)
def p10_line_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = shared.shared_lines(table(spark, d, "documents")).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", F.col("s.start").cast("long").alias("start_char"), F.col("s.end").cast("long").alias("end_char"))


@query("p10_lines", f"SELECT d.doc_id, length(d.text) AS chars, CAST(coalesce(s.n, 0) AS BIGINT) AS shared_chars FROM documents d LEFT JOIN (SELECT doc_id, sum(end_char - start_char) AS n FROM ({_LINE_SPANS_SQL}) GROUP BY 1) s ON s.doc_id = d.doc_id WHERE d.text IS NOT NULL")
def p10_lines(spark: SparkSession, d: str) -> DataFrame:
    return shared.shared_lines(table(spark, d, "documents")).drop("spans")


@query("p1_found", "SELECT DISTINCT elem_no FROM elements WHERE length(text) > 2000")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_found(table(spark, d, "elements"))


@query("p1_pieces")
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_elements(table(spark, d, "elements"))


@query("p1_token_pieces")
def p1_token_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_elements(table(spark, d, "elements"), 512, 64, tokens.DEFAULT)


@query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_all(table(spark, d, "documents"), table(spark, d, "container_sizes"))


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(packing.pack_all(table(spark, d, "documents"), table(spark, d, "container_sizes")))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "canonical_docs"), table(spark, d, "elements"))


@query("p4_pages")
def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scan(table(spark, d, "canonical_docs"), table(spark, d, "elements")).repaired()
