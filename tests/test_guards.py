import pytest
from pyspark.sql import functions as F

from tallymill.functions import guards


def test_versions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(guards.known_schema(F.lit("1")), guards.known_schema(F.lit(0))) == (1, 0)
    for bad in ("2", "x", None):
        with pytest.raises(Exception, match="UNKNOWN_SCHEMA"):
            one(guards.known_schema(F.lit(bad)))
    v = lambda *x: one(guards.versioned(*map(F.lit, x)))[0]
    assert v("a", "1", "a", "1") == "same" and v("a", "1", "b", "2") == "changed"
    with pytest.raises(Exception, match="CONTENT_CHANGED_UNDER_LABEL"):
        v("a", "1", "a", "2")
    with pytest.raises(Exception, match="LABEL_CHANGED_WITHOUT_CONTENT"):
        v("a", "1", "b", "1")


def test_budget_leaves_and_tasks(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "seq INT, who STRING")
    assert {r.seq: (r.place, r.allowed) for r in guards.within_budget(df, 1, "who").collect()} == {1: (1, True), 2: (1, True), 3: (2, False)}
    docs = spark.createDataFrame([('{"a": ["x", {"b": "y", "c": null}], "d": 7, "e": true}',), ("plain",), (None,)], "t STRING")
    assert [r.l for r in docs.select(guards.string_leaves("t").alias("l")).collect()] == [["x", "y", "7"], ["plain"], None]
    puzzles = spark.createDataFrame([("p", 5, 60, 9, "c", "a")], "puzzle_id STRING, min_k INT, time_budget_seconds INT, tool_call_budget INT, puzzle_class STRING, capability_aspect STRING")
    task = guards.task_export(puzzles, spark.createDataFrame([("p", "do it")], "puzzle_id STRING, prompt STRING")).first().task
    assert (task.name, task.epochs, task.time_limit, task.dataset[0].input) == ("p", 5, 60, "do it")


def test_maps_and_numbers(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(guards.tier_map(F.lit('{"a": true, "b": false}')), guards.tier_map(F.lit(None).cast("string")), guards.tier_map(F.lit("{}"))) == ({"a": True, "b": False}, None, {})
    for bad in ('{"a": "true"}', '{"a": 1}', '{"": true}', "[]", "no"):
        with pytest.raises(Exception, match="BAD_TIER_MAP"):
            one(guards.tier_map(F.lit(bad)))
    assert one(guards.number(F.lit("1")), guards.number(F.lit("2.5")), guards.number(F.lit("null"))) == (1.0, 2.5, None)
    for bad in ("true", '"1"', "[1]", "x"):
        with pytest.raises(Exception, match="NOT_A_NUMBER"):
            one(guards.number(F.lit(bad)))
