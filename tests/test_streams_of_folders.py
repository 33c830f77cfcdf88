"""The streaming queries read a table that is a folder of files like one that is a file."""

import os

import pytest

import __spark_entry__ as entry
from tallymill.operators import catalog
from tallymill.session import table
from tallymill.streaming import streams


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("parts"))
    table(spark, data, "catalog_runs").repartition(3).write.parquet(f"{out}/catalog_runs.parquet")
    assert os.path.isdir(f"{out}/catalog_runs.parquet")
    return out


def rows(spark, name, folder):
    return sorted(map(str, entry.queries()[name](spark, folder).collect()))


def test_running_evidence(spark, data, folder):
    assert rows(spark, "j3_running_evidence", folder) == rows(spark, "j3_running_evidence", data) != []


def test_running_evidence_of_no_runs(spark, data, tmp_path):
    table(spark, data, "catalog_runs").limit(0).write.parquet(f"{tmp_path}/catalog_runs.parquet")
    assert rows(spark, "j3_running_evidence", tmp_path) == []


def test_running_evidence_of_partitions(spark, data, folder, tmp_path):
    table(spark, data, "catalog_runs").write.partitionBy("n").parquet(f"{tmp_path}/catalog_runs.parquet")
    assert rows(spark, "j3_running_evidence", tmp_path) == rows(spark, "j3_running_evidence", data)


def test_running_evidence_of_redelivered_runs(spark, tmp_path):
    schema = "kind STRING, seq BIGINT, run_id STRING, puzzle_id STRING, model_id STRING, successes INT, n INT, puzzle_content_hash STRING, started_at STRING, nonce STRING"
    row = lambda seq, model, x=1, run=None, nonce="a": ("run", seq, run, "p", model, x, 20, "h", "2025-01-01T00:00:00Z", nonce)
    batches = [[row(5, " M"), row(6, "m ")], [row(2, "m", 20), row(9, "M", 3)], [row(i, "q", 7, None, None) for i in (10, 10, 11)], [row(13, "r", 2, "x", None), row(12, "r", 4, "x", None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        kept = streams.kept_runs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        streams.latest(kept, f"{tmp_path}/out", f"{tmp_path}/state", availableNow=True, fold=streams.evidence).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    once = catalog.runs(spark.read.parquet(f"{tmp_path}/in"))
    want = streams.evidence(once)
    text = lambda df: sorted((r.puzzle_id, r.model_id, r.runs, round(r.log_e, 9)) for r in df.collect())
    assert text(got) == text(want) and [r[1:3] for r in text(got)] == [("m", 1), ("q", 3), ("r", 1)]


def test_ingested(spark, data, folder):
    assert rows(spark, "j5_ingested", folder) == rows(spark, "j5_ingested", data) != []


def test_ingested_of_no_runs(spark, data, tmp_path):
    table(spark, data, "catalog_runs").limit(0).write.parquet(f"{tmp_path}/catalog_runs.parquet")
    assert rows(spark, "j5_ingested", tmp_path) == []
