"""Traces of attempts: order, repeated calls, read and touched paths, large payloads.

Calls are numbered in blocks (tallymill.skew.blocked_number), so no window spans an attempt, which may hold a large
share of all events, nor all equal calls of one.
"""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallymill.skew import blocked_number, lookback

#: Commands that read the files they are given.
READERS = ("grep rg cat bat head tail less more open sed awk nl tac cut od xxd strings").split()
FILE_TOOLS = ("read_file", "write_file")
#: Calls before a call among which an equal one makes it redundant, and calls of one tool on one path before a further one does.
NEAR, SAME_PATH = 3, 2
#: Texts of so many characters or more are kept aside.
BLOB_CHARS = 1024


def events(trace: DataFrame) -> DataFrame:
    """The events, each (attempt, seq) once; of differing copies the one with the smallest payload text."""
    keep = F.min(F.struct("payload", "kind", "role", "ts"))
    rows = trace.where("attempt_id IS NOT NULL AND seq IS NOT NULL").groupBy("attempt_id", "seq").agg(keep.alias("e"))
    return rows.select("attempt_id", "seq", "e.kind", "e.role", "e.payload", "e.ts")


def numbered(trace: DataFrame) -> DataFrame:
    """events with place, 0, 1, 2 ... within the attempt: gaps in seq closed."""
    return blocked_number(events(trace), "attempt_id", "seq")


def since(trace: DataFrame, offset: int) -> DataFrame:
    """The events from seq `offset` on: what a mirror that has the rest still needs."""
    return events(trace).where(F.col("seq") >= offset)


def arguments(payload: Column) -> Column:
    """A tool call's arguments as a text that doesn't depend on the order of members: a variant keeps them sorted."""
    return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(payload), "$.args", "variant")), F.lit("{}"))


def deliveries_of_calls(trace: DataFrame) -> DataFrame:
    """(attempt_id, seq, tool, args, signature): the tool events as delivered, payloads read before anything is shuffled; signature agrees for equal calls."""
    tool = F.coalesce(F.get_json_object("payload", "$.tool"), F.lit(""))
    rows = trace.where("kind = 'tool' AND attempt_id IS NOT NULL AND seq IS NOT NULL").select("attempt_id", "seq", tool.alias("tool"), arguments(F.col("payload")).alias("args"))
    return rows.withColumn("signature", F.xxhash64("tool", "args"))


def once(deliveries: DataFrame, *columns: str) -> DataFrame:
    """(attempt_id, seq, *columns): each event once; of differing copies the one with the smallest columns. Only these columns are shuffled."""
    kept = deliveries.groupBy("attempt_id", "seq").agg(F.min(F.struct(*columns)).alias("e"))
    return kept.select("attempt_id", "seq", *[F.col(f"e.{c}").alias(c) for c in columns])


def calls(trace: DataFrame) -> DataFrame:
    """(attempt_id, seq, signature, tool, args): the tool events, each once."""
    return once(deliveries_of_calls(trace), "signature", "tool", "args")


@F.pandas_udf(ArrayType(StringType()))
def _tokens(command: pd.Series) -> pd.Series:
    def split(text):
        try:
            return shlex.split(text)
        except ValueError:
            return text.split()

    return command.map(lambda t: None if t is None else split(t))


def _is_path(token: Column) -> Column:
    return (token != "") & ~token.startswith("-") & (token.contains("/") | token.contains("."))


def paths(tool_calls: DataFrame) -> DataFrame:
    """tool_calls with read and touched, arrays of paths, and path, the one a call is counted under."""
    command = F.coalesce(F.get_json_object("args", "$.command"), F.get_json_object("args", "$.argv"))
    listed = F.from_json(command, "ARRAY<STRING>")
    has_exec = tool_calls.withColumn("tokens", F.when(F.col("tool") == "exec", F.coalesce(listed, _tokens(F.when(F.col("tool") == "exec", command)))))
    file_path = F.when(F.col("tool").isin(*FILE_TOOLS), F.get_json_object("args", "$.path"))
    none = F.array().cast("array<string>")
    single = F.when(file_path.isNotNull() & (file_path != ""), F.array(file_path)).otherwise(none)
    operands = F.filter(F.slice("tokens", 2, F.greatest(F.lit(0), F.size("tokens") - 1)), _is_path)
    reads = F.get("tokens", F.lit(0)).isin(*READERS)
    return has_exec.withColumns({
        "read": F.when(F.col("tool") == "exec", F.when(reads, operands).otherwise(none)).otherwise(single),
        "touched": F.when(F.col("tool") == "exec", F.coalesce(F.filter("tokens", _is_path), none)).otherwise(single),
    }).withColumn("path", F.get("read", F.lit(0))).drop("tokens")


def redundancy(trace: DataFrame) -> DataFrame:
    """(attempt_id, tool_calls, redundant, tcrr): calls equal to one of the NEAR before them, or beyond the second of one tool on one path.

    All numbering is in blocks, so an attempt that does nothing but repeat one call is spread like any other.
    """
    known = once(paths(deliveries_of_calls(trace)), "signature", "tool", "path")
    rows = lookback(blocked_number(known, "attempt_id", "seq"), "attempt_id", "place", "signature", NEAR)
    rows = rows.withColumn("near", F.array_contains("before", F.col("signature"))).drop("before")
    some = rows.where("path IS NOT NULL").withColumn("spot", F.struct("attempt_id", "tool", "path"))
    pathed = blocked_number(some, "spot", "place", "nth").drop("spot")
    flagged = pathed.unionByName(rows.where("path IS NULL").withColumn("nth", F.lit(0).cast("bigint")))
    flagged = flagged.withColumn("again", F.col("near") | (F.col("nth") >= SAME_PATH))
    return flagged.groupBy("attempt_id").agg(
        F.count("*").alias("tool_calls"), F.count_if("again").alias("redundant"), F.avg(F.col("again").cast("double")).alias("tcrr")
    )


def first_halt(trace: DataFrame, budgets: DataFrame) -> DataFrame:
    """(attempt_id, seq, reason): the first tool call that a governor refuses, given budgets(attempt_id, identical,
    tool_call_budget): the n-th equal call in a row, else the one past the budget; the former is looked at first. Equal
    calls stand in a row where their place less their rank among equal calls stays the same; ranks are counted in blocks."""
    rows = blocked_number(once(deliveries_of_calls(trace), "signature"), "attempt_id", "seq")
    rows = blocked_number(rows.withColumn("same", F.struct("attempt_id", "signature")), "same", "place", "rank")
    rows = rows.withColumn("run", F.struct("attempt_id", "signature", F.col("place") - F.col("rank")))
    rows = blocked_number(rows, "run", "place", "length").join(budgets, "attempt_id")
    reason = F.when(F.col("length") + 1 >= F.col("identical"), "hard_kill").when(F.col("place") >= F.col("tool_call_budget"), "budget")
    halted = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    return halted.groupBy("attempt_id").agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))


def time_halt(trace: DataFrame, budgets: DataFrame) -> DataFrame:
    """(attempt_id, seq, elapsed): the first event past the time budget, given budgets(attempt_id, started_at, time_budget_seconds); an event on the
    boundary is within it, one without time is passed over."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    times = trace.where("attempt_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").groupBy("attempt_id", "seq").agg(F.min("ts").alias("ts"))
    late = times.join(budgets, "attempt_id").withColumn("elapsed", seconds).where("elapsed > time_budget_seconds")
    return late.groupBy("attempt_id").agg(F.min("seq").alias("seq"), F.min_by("elapsed", "seq").alias("elapsed"))


def path_sets(trace: DataFrame) -> DataFrame:
    """(attempt_id, path, reads, touches): how often each path of an attempt was read and touched."""
    rows = once(paths(deliveries_of_calls(trace)), "signature", "read", "touched")
    both = rows.select("attempt_id", F.explode("read").alias("path"), F.lit(1).alias("r"), F.lit(0).alias("t")).unionByName(
        rows.select("attempt_id", F.explode("touched").alias("path"), F.lit(0).alias("r"), F.lit(1).alias("t"))
    )
    return both.groupBy("attempt_id", "path").agg(F.sum("r").alias("reads"), F.sum("t").alias("touches"))


def spill(trace: DataFrame, limit: int = BLOB_CHARS) -> tuple[DataFrame, DataFrame]:
    """(events with `content`, blobs): texts of `limit` characters or more are replaced by a reference to blobs(digest, content),
    which has each text once."""
    text = F.coalesce(F.get_json_object("payload", "$.content"), F.get_json_object("payload", "$.message"))
    rows = events(trace).withColumn("content", text).withColumn("digest", F.when(F.length("content") >= limit, F.sha2(F.col("content"), 256)))
    blobs = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("content").alias("content"))
    ref = F.concat(F.lit("attachment://sha256/"), F.col("digest"))
    return rows.withColumn("content", F.coalesce(ref, F.col("content"))).drop("payload"), blobs
