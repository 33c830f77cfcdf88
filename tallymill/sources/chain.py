"""An append-only log whose lines are bound by hashes: reading, checking, appending."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.ids import canonical, canonical_json
from tallymill.skew import ranged_lag

GENESIS = "0" * 64


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, prev_hash, payload, hash) of a log of JSON lines {seq, prev_hash, payload, hash}; a line of another form is an error. Lines are read
    apart, so a log may be split and spread over files: its order is that of seq."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    member = lambda name: F.get_json_object("value", f"$.{name}")
    keys, wanted = F.json_object_keys("value"), F.array(*[F.lit(x) for x in ("hash", "payload", "prev_hash", "seq")])
    seq = member("seq").try_cast("bigint")
    sound = keys.isNotNull() & (F.array_sort(keys) == wanted) & seq.isNotNull()
    guarded = F.when(~F.coalesce(sound, F.lit(False)), F.raise_error(F.lit("BAD_ENVELOPE"))).otherwise(member("hash"))
    return lines.select(seq.alias("seq"), member("prev_hash").alias("prev_hash"), member("payload").alias("payload"), guarded.alias("hash"))


def broken_links(log: DataFrame) -> DataFrame:
    """(seq, reason) of the lines that don't continue the chain: another hash than their own content gives, or another
    predecessor than the line before. Lines are compared with the one before them in blocks of seq."""
    rows = log.select("seq", F.col("prev_hash").alias("stated"), "hash", canonical_json("payload").alias("payload"), F.lit(0).alias("log"))
    rows = rows.withColumn("own", F.sha2(F.concat("stated", "payload"), 256)).drop("payload")
    linked = ranged_lag(rows, "log", "seq", ["hash"])
    before = F.coalesce("prev_hash", F.lit(GENESIS))
    reason = F.when(~F.col("own").eqNullSafe(F.col("hash")), "content").when(before != F.col("stated"), "link")
    return linked.select("seq", reason.alias("reason")).where("reason IS NOT NULL")


def verified(log: DataFrame) -> DataFrame:
    """(verified): whether the whole chain holds; an empty log does."""
    return broken_links(log).agg((F.count("*") == 0).alias("verified"))


def tail(log: DataFrame) -> tuple[str, int]:
    """(hash, next seq) that an append to the log goes on from."""
    last = log.agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq")).first()
    return (GENESIS, 0) if last["seq"] is None else (last["hash"], last["seq"] + 1)


def append(payloads: list[object], previous: str = GENESIS, first_seq: int = 0) -> list[str]:
    """The lines that append payloads to a chain ending in `previous`. A chain is serial by nature."""
    out = []
    for i, payload in enumerate(payloads):
        text = canonical(payload)
        digest = hashlib.sha256((previous + text).encode()).hexdigest()
        out.append(json.dumps({"seq": first_seq + i, "prev_hash": previous, "payload": payload, "hash": digest}, ensure_ascii=False))
        previous = digest
    return out


def append_to(spark: SparkSession, path: str, payloads: list[object]) -> int:
    """Appends payloads to the log in the folder at path, as one more file, and gives their number. A chain has one writer at a time; what it appends at
    once is what a batch of events is, not a table."""
    try:
        previous, first = tail(read_log(spark, path))
    except AnalysisException as error:  # no log yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        previous, first = GENESIS, 0
    lines = append(payloads, previous, first)
    if lines:
        spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.mode("append").text(path)
    return len(lines)
