import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import nested

DOC = {
    "units": [
        {"elements": [{"children": {"element_id": "only"}, "data": {"rows": [[{"text": "a"}, None, {"content": [{"table": {"rows": [[{"text": "in"}]]}}, "x"]}]]}}, None, {"children": [None, {"text": "t"}]}]},
        {"elements": None},
    ]
}
WANT = {("1.1", "1"), ("1.1.1", "1.1"), ("1.1.r1c1", "1.1"), ("1.1.r1c3", "1.1"), ("1.1.r1c3.r1c1", "1.1.r1c3"), ("1.3", "1"), ("1.3.2", "1.3")}


def found(spark, rows):
    df = spark.createDataFrame(rows, "rec_id long, payload string, node_path string, relation string, text string")
    return {(r.rec_id, r.node_path, r.parent_path) for r in nested.nodes_found(df).collect()}


def test_paths_and_wrappings(spark):
    plain = json.dumps(DOC)
    forms = [plain, "﻿" + plain, "  " + json.dumps(plain), json.dumps([DOC]), json.dumps({"units": DOC["units"][0]}), plain]
    rows = [(i, p, "x", "y", "z") for i, p in enumerate(forms)] + [(0, plain, None, None, None)]
    got = found(spark, rows)
    assert got == {(i, a, b) for i in range(len(forms)) for a, b in WANT}


def test_any_number_of_wrappings(spark):
    rows, text = [], json.dumps(DOC)
    for i in range(7):
        rows.append((i, text, None, None, None))
        text = json.dumps(text) if i % 2 else "\ufeff " + json.dumps([text])
    assert found(spark, rows) == {(i, a, b) for i in range(7) for a, b in WANT}


def test_depth_has_no_limit(spark):
    depth = 3_000
    deep = '{"units": [{"elements": [' + '{"children": [' * depth + "{}" + "]}" * depth + "]}]}"
    bad = [("[" * 200_000), ("[" * 200_000 + "]" * 200_000), '{"units": [' + '{"a": [' * 100_000]
    df = spark.createDataFrame([(1, deep), (2, json.dumps(DOC)), *((10 + i, b) for i, b in enumerate(bad))], "rec_id long, payload string")
    got = nested.nodes_found(df).groupBy("rec_id").agg(F.count("*"), F.max(F.size(F.split("node_path", "[.]")))).collect()
    assert {tuple(r) for r in got} == {(1, depth + 1, depth + 2), (2, len(WANT), 4)}


def test_deep_reader_agrees_with_the_usual_one():
    good = [json.dumps(DOC), "[]", "{}", '[1, -2.5e3, "a\\u00e9", true, null, {"a": {}, "b": [[], [{}]]}] ', '"x"', "0"]
    assert [nested.deep_json(t) for t in good] == [json.loads(t) for t in good]
    for bad in ("", "[1", "{a: 1}", '{"a" 1}', "[1 2]", "01", "NaN", '{"a": 1}}', "[1,]", '{"a": 1,}', '"\n"'):
        for read in (nested.deep_json, nested.read_json):
            with pytest.raises(ValueError):
                read(bad)


def test_many_repeated_records(spark):
    plain, other = json.dumps(DOC), json.dumps({"units": [{"elements": [{"text": "z"}, {"text": "y"}]}]})
    df = spark.createDataFrame([(i % 5 if i % 7 else None, other if i % 3 else plain) for i in range(60)], "rec_id long, payload string")
    a, b = (sorted(map(tuple, nested.flatten_records(df, fields=False, at_most=n).collect()), key=repr) for n in (0, 100))
    assert a == b and len(a) == len(set(a)) and {r[0] for r in a} == {0, 1, 2, 3, 4, None}


def test_unreadable_gives_nothing(spark):
    bad = [None, "", "  ", "null", "{}", "3", '{"units": [', json.dumps(DOC)[:-3], "[]", "not json", json.dumps({"units": "text"})]
    assert found(spark, [(i, p, None, None, None) for i, p in enumerate(bad)]) == set()
    assert found(spark, []) == set()


def test_deep_nesting_against_recursion(spark):
    node = {"element_id": "leaf"}
    for i in range(12):
        node = {"element_id": str(i), "children": [node, {"element_id": "x"}] if i % 2 else node}
    doc = {"units": {"elements": node}}
    want = set()

    def walk(v, path):
        for i, x in enumerate(v if isinstance(v, list) else [v] if isinstance(v, dict) else [], 1):
            want.add((1, f"{path}.{i}", path))
            walk(x.get("children"), f"{path}.{i}")

    walk(node, "1")
    assert found(spark, [(1, json.dumps(doc), None, None, None)]) == want


def test_relations_keep_links_and_fields(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC))], "rec_id long, payload string")
    rows = nested.flatten_records(df).collect()
    keys = {(r.relation, r.node_path) for r in rows}
    assert all(r.parent_path == "" or any(k[1] == r.parent_path for k in keys) for r in rows)
    assert {r.text for r in rows if r.relation == "cell"} == {"a", "in", None} and next(r for r in rows if r.node_path == "1.1.1").node_id == "only"


def test_merged_schema_folds_recursion(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, None)], "rec_id long, payload string")
    got = {r.node_path: r for r in nested.merged_schema(df, "payload").collect() if r.json_type == "object"}
    assert "units.elements.children" in got and got["units"].occurrences == 2
