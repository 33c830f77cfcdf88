import collections
import json
import random

import pytest

from tallymill.llm import runs

SCHEMA = "attempt_id STRING, seq BIGINT, kind STRING, role STRING, payload STRING, ts TIMESTAMP, part STRING"


def frame(spark, rows):
    return spark.createDataFrame([(a, s, k, r, p if p is None or isinstance(p, str) else json.dumps(p), None, "x") for a, s, k, r, p in rows], SCHEMA)


def found(spark, rows):
    return {tuple(r) for r in runs.repeats(frame(spark, rows)).collect()}


def call(**more):
    return {"tool": "t", "args": {"a": 1, "b": [1.0, "X"]}, **more}


@pytest.mark.parametrize("one,other,same", [
    (call(), '{ "args":{"b":[1,"X"],"a":1.0}, "tool":"\\u0074" }', True),
    (call(request_id="1", at="x"), call(request_id="2", latency_ms=3, meta={"call_id": "z", "worker": 1}), True),
    (call(), {"tool": "t", "args": {"a": 2, "b": [1, "X"]}}, False),
    (call(), {"tool": "t", "args": {"a": 1, "b": [1, "x"]}}, False),
    (call(), {"tool": "T", "args": {"a": 1, "b": [1, "X"]}}, False),
    ({"args": {"id": 1}}, {"args": {"id": 2}}, False),
    ({"content": "Try 4 of 9"}, {"content": " try  12 OF 9 "}, True),
    ({"content": "Try 4 of 9"}, {"content": "Try 4 or 9"}, False),
    ({"value": 0.5, "scorer": "p"}, {"scorer": "p", "value": 5e-1}, True),
    ({"value": 0.5}, {"value": 0.51}, False),
    ({"value": True}, {"value": 1}, False),
    (None, None, True),
    (None, {}, False),
    ("not JSON 1", "NOT json 2", True),
])
def test_what_says_the_same(one, other, same):
    text = lambda p: p if p is None or isinstance(p, str) else json.dumps(p)
    assert (runs.signature("k", None, text(one)) == runs.signature("k", None, text(other))) is same


def test_kind_and_role_count():
    assert runs.signature("k", None, "{}") != runs.signature("k", "r", "{}") != runs.signature("j", "r", "{}")


def test_runs_over_gaps_copies_and_nulls(spark):
    rows = [("a", 1, "k", None, {"message": "x 1"}), ("a", 9, "k", None, {"message": "X 2"}), ("a", 9, "k", None, {"message": "X 2"}), ("a", 10, "k", "r", {"message": "x"}),
            ("b", 3, "k", None, None), ("b", 4, "k", None, None), (None, 1, "k", None, None), ("c", None, "k", None, None), ("c", 1, "k", None, None)]
    assert found(spark, rows) == {("a", 1, 9), ("b", 3, 4)}
    assert found(spark, []) == set()


def test_long_hot_sequence_against_brute_force(spark):
    rng = random.Random(3)
    rows, seq = [], 0
    for a, n in (("hot", 3000), ("b", 40), ("c", 1)):
        word = "w"
        for _ in range(n):
            seq += rng.choice([1, 1, 2, 5000])
            word = word if rng.random() < 0.9 else f"w{'xyz'[rng.randrange(3)]}"
            rows.append((a, seq, "k", None, {"message": word}))
    rng.shuffle(rows)
    by = collections.defaultdict(list)
    for a, s, _, _, p in rows:
        by[a].append((s, p["message"]))
    want = set()
    for a, events in by.items():
        events.sort()
        i = 0
        while i < len(events):
            j = i
            while j + 1 < len(events) and events[j + 1][1] == events[i][1]:
                j += 1
            if j > i:
                want.add((a, events[i][0], events[j][0]))
            i = j + 1
    assert found(spark, rows) == want
    assert runs.collapse_runs(frame(spark, rows)).agg({"n_events": "sum"}).first()[0] == len(rows)


def test_duration(spark):
    df = spark.sql("SELECT 'a' AS attempt_id, id AS seq, 'k' AS kind, 'r' AS role, '{}' AS payload, IF(id = 1, NULL, TIMESTAMP_SECONDS(id * 10)) AS ts FROM RANGE(3)")
    r = runs.collapse_runs(df).first()
    assert (r.n_events, r.duration_s) == (3, 20.0)


def test_both_ways_of_doubling_agree(spark):
    rows = [(p, s, s // n) for p, n in (("a", 1), ("b", 2), ("c", 37), ("d", 500)) for s in range(500)]
    events = spark.createDataFrame(rows, "part STRING, seq BIGINT, sig BIGINT")
    few, many = ({tuple(r) for r in runs.run_starts(events, limit).collect()} for limit in (10**6, 0))
    assert few == many == {(p, s, s - s % n) for p, n in (("a", 1), ("b", 2), ("c", 37), ("d", 500)) for s in range(500) if s % n}
    assert runs.run_starts(events.limit(0)).count() == 0
