import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tallymill.sources import chain, files
from tallymill.streaming import streams

META = {"puzzle_id": "p1", "point_threshold": 50, "rewards": {"solve": 100, "elegance_bonus_max": 24, "novelty_bonus_max": 40, "canonical_call_count": 5}, "penalties": []}


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_puzzles(spark, tmp_path):
    put(f"{tmp_path}/p1/meta.json", json.dumps(META, indent=1))
    put(f"{tmp_path}/p1/prompt.md", "Solve\nthis")
    put(f"{tmp_path}/p1/oracle/check.py", "secret")
    r = files.read_puzzles(spark, str(tmp_path)).first()
    assert (r.puzzle_id, r.prompt, r.rewards.solve) == ("p1", "Solve\nthis", 100.0)
    a, b = [files.folder_hashes(spark, str(tmp_path), n).first().content_hash for n in (["meta.json", "prompt.md"], ["prompt.md", "meta.json"])]
    import hashlib

    body = b"".join(n.encode() + b"\0" + open(f"{tmp_path}/p1/{n}", "rb").read() + b"\0" for n in ("meta.json", "prompt.md"))
    assert a == hashlib.sha256(body).hexdigest()[:16] != b
    put(f"{tmp_path}/p1/meta.json", json.dumps({**META, "rewards": {**META["rewards"], "elegance_bonus_max": 31}}))
    with pytest.raises(Exception, match="REWARD_BOUND"):
        files.read_puzzles(spark, str(tmp_path)).collect()


def test_items(spark, tmp_path):
    item = {"id": "a", "category": "known_trivial", "prompt": "q", "gold": "A", "expected_pass": {"weak": True}}
    put(f"{tmp_path}/one.json", json.dumps(item))
    put(f"{tmp_path}/two.json", json.dumps([{**item, "id": "b"}, {**item, "id": "c"}], indent=2))
    got = files.read_items(spark, str(tmp_path))
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c"] and got.first().expected_pass == {"weak": True}
    from tallymill.operators import items

    bank = got.unionByName(got.withColumns({"id": F.concat("id", F.lit("2")), "difficulty": F.lit(0.5)}))
    items.write_bank(bank.coalesce(1), f"{tmp_path}/written")
    again = files.read_items(spark, f"{tmp_path}/written/*.json")
    assert sorted(again.collect(), key=str) == sorted(bank.collect(), key=str)
    for bad, code in (({**item, "extra": 1}, "UNKNOWN_MEMBER"), ({**item, "gold": None}, "MISSING_MEMBER"), ({**item, "category": "x"}, "BAD_CATEGORY")):
        put(f"{tmp_path}/bad/x.json", json.dumps(bad))
        with pytest.raises(Exception, match=code):
            files.read_items(spark, f"{tmp_path}/bad").collect()


def test_labels(spark, tmp_path):
    put(f"{tmp_path}/l.json", json.dumps({"annotators": {"x": {"tier": "expert"}}, "labels": {"i": {"x": "A"}, "j": {"x": None}}}, indent=1))
    assert {tuple(r) for r in files.read_human_labels(spark, f"{tmp_path}/l.json").collect()} == {("i", "x", "expert", "A"), ("j", "x", "expert", None)}
    put(f"{tmp_path}/b.json", json.dumps({"annotators": {}, "labels": {"i": {"x": "A"}}}))
    with pytest.raises(Exception, match="BAD_ANNOTATOR"):
        files.read_human_labels(spark, f"{tmp_path}/b.json").collect()


def test_panel_round_trip(spark, tmp_path):
    put(f"{tmp_path}/p.json", json.dumps({"schema_version": 1, "seats": [{"model_id": "m", "reliability_weight": 0.5}], "threshold": 0.25}, indent=1))
    panel = files.read_panel(spark, f"{tmp_path}/p.json")
    files.write_panel(panel, f"{tmp_path}/out")
    assert files.read_panel(spark, f"{tmp_path}/out").collect() == panel.collect()
    put(f"{tmp_path}/n.json", json.dumps({"schema_version": 2}))
    with pytest.raises(Exception, match="NEWER_SCHEMA"):
        files.read_panel(spark, f"{tmp_path}/n.json").collect()


def test_frozen_system(spark, tmp_path):
    put(f"{tmp_path}/s.yaml", '# record\nmodel: "m-1"\nnote: a: b\n')
    assert {tuple(r) for r in files.read_frozen_system(spark, f"{tmp_path}/s.yaml").collect()} == {("model", "m-1"), ("note", "a: b")}
    record = spark.createDataFrame([("model", "m-1.2"), ("note", 'a: "b" \\ c'), ("none", None)], "key STRING, value STRING")
    files.write_frozen_system(record, f"{tmp_path}/w")
    assert {tuple(r) for r in files.read_frozen_system(spark, f"{tmp_path}/w").collect()} == {("model", "m-1.2"), ("note", 'a: "b" \\ c'), ("none", "")}
    for key, value, code in (("model", "latest", "ALIAS_NOT_PINNED"), ("a:b", "1", "BAD_LINE"), ("a", "1\n2", "BAD_LINE")):
        with pytest.raises(Exception, match=code):
            files.write_frozen_system(spark.createDataFrame([(key, value)], "key STRING, value STRING"), f"{tmp_path}/x")
    for text, code in (("a: 1\na: 2\n", "DUPLICATE_KEY"), ("  a: 1\n", "BAD_LINE"), ("plain\n", "BAD_LINE")):
        put(f"{tmp_path}/bad.yaml", text)
        with pytest.raises(Exception, match=code):
            files.read_frozen_system(spark, f"{tmp_path}/bad.yaml").collect()


def test_chain(spark, tmp_path):
    lines = chain.append([{"b": 1, "a": "é"}, {"x": [1, 2]}, {"y": None}])
    path = f"{tmp_path}/log.jsonl"
    check = lambda ls: (put(path, "\n".join(ls)), chain.verified(chain.read_log(spark, path)).first().verified)[1]
    assert check(lines)
    assert not check([lines[0], lines[1].replace("[1, 2]", "[1, 3]"), lines[2]])
    assert not check([lines[0], lines[2]])
    assert check([lines[0].replace('"b": 1', '"b":   1'), *lines[1:]])
    both = [[lines[1]], [lines[2], "", lines[0]]]
    for k, some in enumerate(both):
        put(f"{tmp_path}/parts/{k}.jsonl", "\n".join(some))
    assert chain.verified(chain.read_log(spark, f"{tmp_path}/parts")).first().verified
    assert chain.append_to(spark, f"{tmp_path}/new", [{"a": 1}, {"b": 2}]) == 2 and chain.append_to(spark, f"{tmp_path}/new", [{"c": 3}]) == 1 and chain.append_to(spark, f"{tmp_path}/new", []) == 0
    grown = chain.read_log(spark, f"{tmp_path}/new")
    assert chain.verified(grown).first().verified and [r.seq for r in grown.orderBy("seq").collect()] == [0, 1, 2]
    put(path, '{"prev_hash": "0", "payload": {}}')
    with pytest.raises(Exception, match="BAD_ENVELOPE"):
        chain.read_log(spark, path).select("hash").collect()
    assert chain.verified(spark.createDataFrame([], "seq BIGINT, prev_hash STRING, payload STRING, hash STRING")).first().verified


def test_evaluation_log(spark):
    attempts = spark.createDataFrame([("a", "p", "m", "x", None, "done", 1.0, None, {})], "attempt_id STRING, puzzle_id STRING, model STRING, framing_arm STRING, output STRING, terminated_by STRING, wall_time DOUBLE, error STRING, scores MAP<STRING, STRING>")
    events = spark.createDataFrame([("a", 2, "k", None, "{}"), ("a", 1, "k", None, "{}")], "attempt_id STRING, seq BIGINT, kind STRING, role STRING, payload STRING")
    stray = spark.createDataFrame([("b", 1, "k", None, "{}"), ("a", None, "k", None, "{}")], events.schema)
    rows = files.evaluation_log(attempts, events.unionByName(stray)).orderBy("attempt_id", "place").collect()
    assert [r.place for r in rows] == [-1, 1, 2]
    head = json.loads(rows[0].document)
    assert head["stats"]["error"] is None and head["sample"]["attempt_id"] == "a" and json.loads(rows[2].document)["seq"] == 2


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_stream_stores_each_record_once(spark, tmp_path):
    schema = "seq BIGINT, puzzle_content_hash STRING, model_id STRING, started_at STRING, nonce STRING"
    row = lambda seq, nonce: (seq, "h", "m", "2025-01-01T00:00:00Z", nonce)
    for k, rows in enumerate(([row(1, "a"), row(2, "A")], [row(3, "a "), row(4, "b")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        _drain(streams.ingest_once(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert sorted(r.seq for r in streams.ingested(spark, f"{tmp_path}/out").collect()) == [1, 4]


def test_running_statistics(spark, tmp_path):
    schema = "puzzle_id STRING, model_id STRING, successes INT, n INT, puzzle_content_hash STRING, started_at STRING, nonce STRING, ingested_at TIMESTAMP"
    when = datetime.datetime(2025, 1, 1)
    spark.createDataFrame([("p", "m", 20, 20, "h", "t", x, when) for x in ("a", "b", "A ")], schema).write.parquet(f"{tmp_path}/runs")
    for late, name in ((None, "evidence"), ("1 day", "bounded")):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/runs")
        _drain(streams.running_evidence(stream, late=late).writeStream.outputMode("update").format("memory").queryName(name).start())
        assert spark.table(name).orderBy(F.desc("runs")).first().e_value == pytest.approx(20.006402, abs=1e-5)
    calls = "attempt_id STRING, seq BIGINT, signature BIGINT"
    put = lambda rows: spark.createDataFrame(rows, calls).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
    put([("a", 1, 5), ("a", 2, 5), ("a", 4, 5), ("a", 5, 6), ("a", 5, 6)])
    stream = spark.readStream.schema(calls).parquet(f"{tmp_path}/calls")
    got = []

    def drained():
        writer = streams.running_runs(stream).writeStream.outputMode("update").foreachBatch(lambda batch, _: got.extend(tuple(r) for r in batch.collect()))
        writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
        out = set(got)
        got.clear()
        return out

    assert drained() == {("a", 1, 4, 3, 0), ("a", 5, 5, 1, 0)}
    put([("a", 7, 6), ("a", 3, 5), ("a", 8, 9), ("b", 1, 1)])
    assert drained() == {("a", 5, 7, 2, 1), ("a", 8, 8, 1, 1), ("b", 1, 1, 1, 0)}
    put([("a", 2, 9)])
    assert drained() == {("a", 8, 8, 1, 2)}
    stream = spark.readStream.schema(calls).parquet(f"{tmp_path}/calls")
    _drain(streams.spent(stream, 2, "attempt_id").writeStream.outputMode("complete").format("memory").queryName("spent").start())
    assert dict(spark.table("spent").select("attempt_id", "allowed").collect()) == {"a": False, "b": True}
    spark.sql("SELECT TIMESTAMP '2025-01-01 00:00:00' AS ts, 'k' AS kind").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts TIMESTAMP, kind STRING").parquet(f"{tmp_path}/ev")
    _drain(streams.counted(stream).writeStream.outputMode("update").format("memory").queryName("counts").start())
    assert spark.table("counts").first().n == 1
