import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import drift


def tables(spark, versions):
    docs, elements = [], []
    for i, (version, rows) in enumerate(versions):
        docs.append((f"d{i}", "ex", version, "clash"))
        elements += [(i * 1000 + k, f"d{i}", r if isinstance(r, (str, type(None))) else json.dumps(r), "clash") for k, r in enumerate(rows)]
    return (
        spark.createDataFrame(docs, "doc_id string, extractor string, schema_version string, field_path string"),
        spark.createDataFrame(elements, "elem_no long, doc_id string, data string, extractor string"),
    )


def report(spark, versions):
    docs, elements = tables(spark, versions)
    return {(r.schema_version, r.change_kind, r.field_path, r.new_path) for r in drift.drift_report(docs, elements).collect()}


def test_changes(spark):
    old = [{"style": f"Heading {i % 3}", "size": i, "gone": True, "n": {"w": 1000 + i}} for i in range(40)]
    new = [{"style_name": f"Heading {i % 3}", "size": str(i), "n": {"cx": 1000 + i, "extra": "e"}} for i in range(40)]
    got = report(spark, [("v1.9", old), (" 1.10 ", new), (None, [{"never": 1}])])
    assert got == {("1.10", "renamed", "style", "style_name"), ("1.10", "retyped", "size", ""), ("1.10", "removed", "gone", ""), ("1.10", "renamed", "n.w", "n.cx"), ("1.10", "added", "n.extra", "")}


def test_different_information_is_no_rename(spark):
    old = [{"a": f"Heading {i % 3}"} for i in range(40)]
    new = [{"b": f"https://example.org/{'x' * (i % 20)}"} for i in range(40)]
    assert report(spark, [("1", old), ("2", new)]) == {("2", "removed", "a", ""), ("2", "added", "b", "")}


def test_field_that_comes_back(spark):
    assert report(spark, [("1.0", [{"a": 1, "b": 1}]), ("1.1", [{"b": 1}]), ("1.2", [{"a": 1, "b": 1}])]) == {("1.1", "removed", "a", ""), ("1.2", "added", "a", "")}


def test_nulls_odd_data_and_empty(spark):
    odd = [{"a": None, "b": []}, None, "", "not json", "[1]", "{}", {"c": {}}]
    assert report(spark, [("1", [{"b": []}]), ("2", odd)]) == set()
    assert report(spark, [("1", odd)]) == set()
    docs, elements = tables(spark, [("1", [{"a": 1}])])
    assert drift.drift_report(docs.where("false"), elements.where("false")).count() == 0


def test_leaves_of_schema_strings():
    assert drift.leaves("OBJECT<a: BIGINT, b: OBJECT<c: STRING, d: VOID>, e: ARRAY<OBJECT<x: BIGINT>>, `f g`: DECIMAL(3,1), h: BOOLEAN>") == [("a", "number"), ("b\x1fc", "string"), ("e", "array"), ("f g", "number"), ("h", "boolean")]


def test_unified_table(spark):
    old = [{"style": f"Heading {i % 3}", "size": i} for i in range(40)]
    new = [{"style_name": f"Heading {i % 3}", "size": str(i)} for i in range(40)]
    docs, elements = tables(spark, [("1.0", old), ("1.1", new)])
    rows = drift.unify(docs, elements).collect()
    assert len(rows) == 80 and {r.style_name for r in rows} == {"Heading 0", "Heading 1", "Heading 2"} and all(isinstance(r["size"], str) for r in rows)


def test_unified_table_has_documents_without_a_version(spark):
    old = [{"style": f"Heading {i % 3}", "size": i} for i in range(40)]
    new = [{"style_name": f"Heading {i % 3}", "size": i} for i in range(40)]
    odd = [{"style": "Heading 0", "size": "large", "own": 1}, None]
    docs, elements = tables(spark, [("1.0", old), ("1.1", new), (None, odd), ("", odd), ("draft", odd), ("1.0", odd)])
    docs = docs.withColumn("extractor", F.when(docs.doc_id != "d5", docs.extractor))
    rows = drift.unify(docs.unionByName(docs), elements).collect()
    assert len(rows) == len({r.elem_no for r in rows}) == 88
    for d in ("d2", "d3", "d4", "d5"):
        a, b = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.elem_no)
        assert (a.schema_version, a.style_name, a["size"], a.own, b.own) == ("1.0" if d == "d5" else None, "Heading 0", "large", 1.0, None)
    assert "style" not in rows[0].asDict()


def test_keys_with_signs_get_columns_of_their_own(spark):
    rows = [{"a.b": 1, "a_b": 2, "a": {"b": 3}, "A_B": 4, "it's": 5, 'q"\'': {"x.y": 6}, "doc_id": 7, "[0]": 8}]
    docs, elements = tables(spark, [("1", rows)])
    out = drift.unify(docs, elements)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    r = out.first().asDict()
    assert sorted(v for k, v in r.items() if isinstance(v, float)) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0] and r["doc_id"] == "d0" and r["it's"] == 5.0


def test_fields_that_differ_late_are_not_renames(spark):
    head = "the same beginning of all of these texts, " * 3
    old = [{"a": f"{head}{'x' * (i % 9)}"} for i in range(40)]
    new = [{"b": f"{head}{'Y; ' * (300 + i % 9)}"} for i in range(40)]
    assert report(spark, [("1", old), ("2", new)]) == {("2", "removed", "a", ""), ("2", "added", "b", "")}


def test_rename_of_a_field_that_became_rarer(spark):
    old = [{"style": f"Heading {i % 3}", "z": 1} for i in range(60)]
    new = [{"style_name": f"Heading {i % 3}", "z": 1} if i % 4 == 0 else {"z": 1} for i in range(60)]
    assert report(spark, [("1", old), ("2", new)]) == {("2", "renamed", "style", "style_name")}


def test_too_many_fields_are_refused(spark):
    docs, elements = tables(spark, [("1", [{f"k{i}": i} for i in range(30)])])
    with pytest.raises(drift.TooManyFields):
        drift.unify(docs, elements, most=20)
