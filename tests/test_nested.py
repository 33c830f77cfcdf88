import json

from tallymill.operators import nested


def cases(spark, *bodies):
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "report_id BIGINT, body STRING, branch STRING")
    return {tuple(r) for r in nested.child_cases(nested.flatten_reports(df)).collect()}


def test_all_shapes_of_children(spark):
    report = {"wrap": [{"data": json.dumps({"candidates": [
        {"spec": "s1", "per_item": [{"id": "a", "gold": "A"}, {"id": None}, {"gold": "B"}, {"id": "a"}]},
        {"spec": "s2", "per_item": {"b": {"gold": "A"}, "c": json.dumps({"gold": "B"})}},
        {"spec": "s3", "per_item": {"id": "d", "gold": "A"}},
        {"spec": "s4", "per_item": None},
    ]})}]}
    assert cases(spark, json.dumps(report)) == {(0, "per_item", "s1", "a"), (0, "per_item", "s2", "b"), (0, "per_item", "s2", "c"), (0, "per_item", "s3", "d")}


def test_labels_as_map_and_list(spark):
    a = {"labels": {"i1": {"x": "A", "y": {"verdict": "unsure"}, "z": None, "w": {"verdict": None}}}}
    b = {"labels": [{"item_id": "i2", "verdicts": {"x": {"verdict": "B"}}}]}
    assert cases(spark, json.dumps(a), json.dumps([b])) == {(0, "label", "i1", "x"), (0, "label", "i1", "y"), (1, "label", "i2", "x")}


def test_findings_at_any_depth(spark):
    body = {"domains": [{"question": "q", "findings": [
        "plain", {"claim": "c1", "findings": {"claim": "c2", "findings": [{"claim": None, "findings": [{"claim": "c4"}]}, {"claim": "c3"}]}}]},
        {"question": "q2", "findings": None}]}
    assert cases(spark, json.dumps(body)) == {
        (0, "finding", "q", "plain"), (0, "finding", "q", "c1"), (0, "finding", "c1", "c2"), (0, "finding", "c2", "c3"), (0, "finding", None, "c4")}


def test_links_lead_from_children_to_parents(spark):
    body = json.dumps({"candidates": [{"spec": "s", "per_item": [{"id": "a"}, {"id": "b"}]}]})
    df = spark.createDataFrame([(5, body)], "report_id BIGINT, body STRING")
    rows = {r.row_id: r for r in nested.flatten_reports(df).collect()}
    for r in rows.values():
        if r.branch == "per_item":
            assert rows[r.parent_row_id].branch == "candidates" and rows[r.parent_row_id].child_key == r.parent_key == "s"
    assert {r.child_key: r.ordinal for r in rows.values() if r.branch == "per_item"} == {"a": 0, "b": 1}
    assert nested.flat_table(nested.flatten_reports(df), "per_item").first()["members"]["id"] == "a"


def test_unreadable_bodies(spark):
    good = '{"labels": {"i": {"x": "A"}}}'
    got = cases(spark, None, "", "upload failed", good[:-1], '{"labels": {"i": {"x": NaN}}}', "[" * 100_000, "﻿\n\n" + good + "\n", "null")
    assert got == {(6, "label", "i", "x")}


def test_odd_keys_and_repeats(spark):
    body = '{"labels": {"p-\\u00e9 \\"q\\"": {"x": "A"}, "lone \\ud800": {"x": "A"}}}'
    got = cases(spark, body, body)
    assert (0, "label", 'p-é "q"', "x") in got and len(got) == 4


def test_schema_is_merged(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [{"c-1": "x"}]}',), ('{"a": "t", "b": []}',), ("broken",)], "body STRING")
    got = {r.path: (list(r.types), r.n, r.kind) for r in nested.infer_schema(df).collect()}
    assert got["$.a"] == (["long", "string"], 2, "column") and got["$.b"] == (["array"], 2, "child table")
    assert got["$.b[].*"][2] == "map entry"


def test_empty_table(spark):
    df = spark.createDataFrame([], "report_id BIGINT, body STRING")
    assert nested.child_cases(nested.flatten_reports(df)).count() == 0 and nested.infer_schema(df).count() == 0


def test_unforeseen_arrays_become_tables(spark):
    a = {"run": {"host": {"name": "h1", "cores": 8}, "steps": [{"name": "s1", "tools": [{"tool": "t1", "ms": 5}, {"tool": "t2"}]}, {"name": "s2"}, 7]}, "tags": ["x", "y"]}
    b = {"run": {"steps": {"name": "alone", "tools": {"tool": "t3"}}}}
    c = {"run": {"steps": {"k-1": {"name": "keyed"}, "k-2": {"tools": json.dumps([{"tool": "t4"}])}}}}
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate((a, b, c))], "report_id BIGINT, body STRING")
    flat = nested.flatten_reports(df)
    rows = {r.row_id: r for r in flat.collect()}
    assert len(rows) == flat.count()
    up = lambda r: rows[r.parent_row_id]
    steps = [(r.report_id, r.ordinal, json.loads(r.members), up(r).branch) for r in rows.values() if r.branch == "steps"]
    assert sorted(steps, key=str) == [
        (0, 0, {"name": "s1"}, "report"), (0, 1, {"name": "s2"}, "report"), (0, 2, {"value": 7}, "report"), (1, 0, {"name": "alone"}, "report"),
        (2, 0, {"name": "keyed"}, "report"), (2, 1, {}, "report")]
    tools = {json.loads(r.members)["tool"]: (r.report_id, r.ordinal, json.loads(up(r).members).get("name"), up(r).child_key) for r in rows.values() if r.branch == "tools"}
    assert tools == {"t1": (0, 0, "s1", None), "t2": (0, 1, "s1", None), "t3": (1, 0, "alone", None), "t4": (2, 0, None, "k-2")}
    top = json.loads(next(r for r in rows.values() if r.report_id == 0 and r.branch == "report").members)
    assert top == {"run.host.name": "h1", "run.host.cores": 8, "tags": ["x", "y"]}


def test_schema_tells_an_entry_alone_from_a_map(spark):
    listed = {"candidates": [{"spec": "s", "per_item": [{"id": "a", "note": "n"}]}]}
    alone = {"candidates": {"spec": "t", "per_item": {"note": "has no id"}}}
    by_key = {"candidates": {"u": {"per_item": {"b": {"note": "n"}}}}}
    assert cases(spark, *map(json.dumps, (listed, alone, by_key))) == {(0, "per_item", "s", "a"), (2, "per_item", "u", "b")}


def test_json_quoted_twice(spark):
    body = json.dumps({"data": json.dumps(json.dumps({"labels": {"i": {"x": "A"}}})), "findings": '"just quoted"'})
    assert cases(spark, body) == {(0, "label", "i", "x"), (0, "finding", None, '"just quoted"')}


def test_fields_of_wide_entries_are_known(spark):
    listed = {"candidates": [{"spec": "s", "per_item": [{"id": "a", **{f"f{i}": 0 for i in range(100)}}]}]}
    alone = {"candidates": {"spec": "t", "per_item": {"f1": 1, "f2": {"x": 1}}}}
    assert cases(spark, *map(json.dumps, (listed, alone))) == {(0, "per_item", "s", "a")}


def test_rare_members_are_known(spark):
    often = [{f"m{i}": [{"x": 1}] for i in range(5000)}] * 2
    rare = [{"zz": [{"x": 1}]}, {"zz": {"x": 2}}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([*often, *rare])], "report_id BIGINT, body STRING")
    for how in ({}, {"schema_chars": 0}):
        got = nested.flatten_reports(df, **how).where("branch = 'zz'").select("report_id", "members").collect()
        assert sorted(map(tuple, got)) == [(2, '{"x": 1}'), (3, '{"x": 2}')]


def test_schema_joined_as_broadcast(spark, data):
    shapes = [
        {"run": {"steps": [{"name": "s1", "tools": [{"tool": "t1"}]}, 7]}, "k": {"a-1": 1, "a-2": {"y": 2}}, "": [{"p": 1}], "*": {"p": 1}},
        {"run": {"steps": {"name": "alone", "tools": {"tool": "t3"}}}, "k": {"y": {"z": 1}}, "w": {"": {"p": 2}, "*": {"q": 1}, "steps": {"u": {"tools": {}}}}},
        {"run": json.dumps({"steps": json.dumps({"k-1": {"name": "keyed"}, "k_2": {"tools": json.dumps([{"tool": "t4"}])}})})},
        [{"per_item": {"tools": {"gold": "A"}, "x": 1}}, {"per_item": [[{"id": "b", "gold": "B"}]]}],
        {"steps": {"b": {"name": {"c": 1}}, "run": {"d": 2}}, "tools": {"e": {"f": 1}, "g": {"tool": 3}}},
    ]
    made = spark.createDataFrame([(i % 5, json.dumps(x)) for i, x in enumerate(shapes * 2)] + [(9, "broken"), (10, None)], "report_id BIGINT, body STRING")
    for df in (made, spark.read.parquet(f"{data}/raw_reports.parquet")):
        whole, parts = (sorted(map(str, nested.flatten_reports(df, schema_chars=n).collect())) for n in (nested.SCHEMA_CHARS, 0))
        assert whole == parts != []
