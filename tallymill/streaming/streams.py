"""The log's folds as Structured Streaming: exactly-once ingestion, running evidence, run lengths, counts in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallymill.functions import stats
from tallymill.operators import dedup
from tallymill.session import cut


#: Parts that the keys of stored records are kept in, by hash.
KEY_PARTS = 64


def _start(writer, now: bool):
    return (writer.trigger(availableNow=True) if now else writer).start()


def _digest(rows: DataFrame) -> dict[str, Column]:
    """The digest of a record's identity, null if that isn't whole, and the part it is kept in."""
    fields = dedup.identity(rows)
    whole = F.lit(True)
    for field in fields:
        whole = whole & field.isNotNull()
    digest = F.when(whole, F.unhex(F.md5(F.concat_ws("\u0000", *fields))))
    return {"digest": digest, "part": F.pmod(F.xxhash64(digest), F.lit(KEY_PARTS)).cast("int")}


def ingest_once(stream: DataFrame, target: str, checkpoint: str, availableNow: bool = False):
    """Starts a query that appends each record of stream to the table at target once, however often and in whichever batches it
    is delivered; read it with ingested.

    Beside the rows lie the 16-byte digests of their identities, by hash parts: a batch reads the digests of the parts it has
    records of, never the rows. A batch writes folders of its own number, so one that runs again overwrites what it left half done.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = dedup.exactly_once(batch).withColumns(_digest(batch))
        try:
            stored = spark.read.schema("digest BINARY, batch BIGINT, part INT").parquet(f"{target}/keys").where(F.col("batch") < number)
        except AnalysisException as error:  # nothing is stored before the first batch
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = None
        if stored is not None:
            once = cut(once)
            parts = [r["part"] for r in once.select("part").distinct().collect()]  # KEY_PARTS at most
            once = once.join(stored.where(F.col("part").isin(parts)).select("part", "digest"), ["part", "digest"], "left_anti")
        once.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        # the digests come from the rows as they are stored, so that no other copy of them is kept
        rows = spark.read.schema(batch.schema).parquet(f"{target}/rows/batch={number}")
        keys = rows.select(*[c.alias(n) for n, c in _digest(rows).items()]).where("digest IS NOT NULL")
        keys.write.mode("overwrite").partitionBy("part").parquet(f"{target}/keys/batch={number}")

    return _start(stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), availableNow)


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The records that ingest_once has stored."""
    return spark.read.parquet(f"{target}/rows").drop("batch")


def running_evidence(runs: DataFrame, p0: float = 0.90, p1: float = 0.97, late: str | None = None) -> DataFrame:
    """Per puzzle and model, the e-value over the runs so far, for update or complete mode: valid whenever it is read.

    A run delivered again doesn't count again; the delivery that is met first stands, which kept_runs decides by seq. With `late`, a watermark on ingested_at, identities are forgotten after that time, which bounds the state;
    without it they are kept.
    """
    names = [f"identity_{i}" for i in range(len(dedup.IDENTITY))]
    keyed = runs.withColumns(dict(zip(names, dedup.identity(runs))))
    once = keyed.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(names) if late else keyed.dropDuplicates(names)
    return evidence(once, p0, p1)


def evidence(once: DataFrame, p0: float = 0.90, p1: float = 0.97) -> DataFrame:
    """The e-values of runs counted once; column times, where there is one, has how many runs a row stands for."""
    times = F.col("times") if "times" in once.columns else F.lit(1)
    sums = once.groupBy("puzzle_id", "model_id").agg(F.sum(times * stats.log_e(F.col("successes"), F.col("n"), p0, p1)).alias("log_e"), F.sum(times).alias("runs"))
    return sums.withColumn("e_value", stats.guarded_exp(F.col("log_e")))


def kept_runs(runs: DataFrame) -> DataFrame:
    """(puzzle_id, model_id, successes, n, times) of the runs that catalog.runs keeps, for complete mode: a record's delivery of the lowest seq stands, in
    whichever batch, file or order it comes, so the values are those of the whole log however it is cut up. State is a digest and one delivery per record.

    Rows whose identity isn't whole are told apart by run_id, those without run_id all count.
    """
    values = ["puzzle_id", "model_id", "successes", "n"]
    whole = F.lit(True)
    for field in dedup.IDENTITY:
        whole = whole & F.col(field).isNotNull()
    single = ~whole & F.col("run_id").isNull()
    named = F.when(whole, F.to_json(F.array(*dedup.identity(runs)))).when(single, F.to_json(F.struct(*values))).otherwise(F.concat(F.lit("r"), "run_id"))
    first = F.struct(F.col("seq").isNull().alias("last"), "seq", F.xxhash64(*dedup.IDENTITY, *values).alias("tie"), *values)
    rows = runs.select(F.unhex(F.md5(named)).alias("digest"), single.alias("single"), first.alias("first"))
    kept = rows.groupBy("digest").agg(F.min("first").alias("first"), F.count_if("single").alias("singles"))
    return kept.select(*[f"first.{v}" for v in values], F.greatest("singles", F.lit(1)).alias("times"))


def latest(rows: DataFrame, target: str, checkpoint: str, availableNow: bool = False, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows):
    """Starts a query that keeps the whole result of an aggregation, or what fold makes of it, in the table at target, written anew after each batch."""
    store = lambda batch, _: fold(batch).write.mode("overwrite").parquet(target)
    return _start(rows.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint), availableNow)


def counted(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per kind and window of event time; events later than `late` are left out of windows that are closed."""
    return events.where("ts IS NOT NULL").withWatermark("ts", late).groupBy(F.window("ts", every), "kind").agg(F.count("*").alias("n"))


def running_runs(calls: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(attempt_id, first_seq, last_seq, n, late): runs of equal consecutive signatures of calls(attempt_id, seq, signature), in update mode: a run is
    emitted again as it grows. State per attempt is its open run only, and is dropped when the attempt has been idle for idle_ms, where given (such a query runs until it is stopped). Order within an
    attempt is by seq within a batch; calls older than the open run's last can't be placed any more and are counted as late."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
        signature, first, last, n, late = state.get if state.exists else (None, None, None, 0, 0)
        old = rows["seq"] <= last if last is not None else rows["seq"] != rows["seq"]
        late, rows = late + int(old.sum()), rows[~old]
        if len(rows):
            signatures = rows["signature"]
            before = signatures.shift(1)
            before.iloc[0] = signature if n else None
            run = (signatures != before).cumsum()
            runs = rows.groupby(run).agg(first_seq=("seq", "min"), last_seq=("seq", "max"), n=("seq", "size"), signature=("signature", "first"))
            if runs.index[0] == 0:  # the open run goes on
                runs.loc[0, ["first_seq", "n"]] = [first, runs.loc[0, "n"] + n]
            signature, first, last, n = (int(runs.iloc[-1][c]) for c in ("signature", "first_seq", "last_seq", "n"))
        else:
            runs = pd.DataFrame([(first, last, n)], columns=["first_seq", "last_seq", "n"])
        state.update((signature, first, last, n, late))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield runs.assign(attempt_id=key[0], late=late)[["attempt_id", "first_seq", "last_seq", "n", "late"]].astype({"first_seq": "int64", "last_seq": "int64", "n": "int64"})

    return calls.groupBy("attempt_id").applyInPandasWithState(
        step, "attempt_id STRING, first_seq BIGINT, last_seq BIGINT, n BIGINT, late BIGINT", "signature BIGINT, first BIGINT, last BIGINT, n BIGINT, late BIGINT",
        "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )


def spent(queries: DataFrame, budget: int, owner: str = "owner") -> DataFrame:
    """(owner, spent, allowed) of a stream of queries, in update mode: how many an owner has made, and whether a further one is within the budget."""
    return queries.groupBy(owner).agg(F.count("*").alias("spent")).withColumn("allowed", F.col("spent") < budget)
