"""Repeated consecutive events in sequences: each run becomes one event with count and duration.

Method: pointer doubling. An event that says the same as the one before it points to that
predecessor; self-joins replace each pointer by its target's pointer until all reach the start of
their run, so a run of n events takes about log2(n) joins on unique keys, and no run or sequence, however long, is
gathered in one task. Predecessors come from ranges of events that are sampled even (tallymill.skew.ranged_lag).

Two events say the same when kind and role agree (null agrees with null) and so do their payloads,
but for how the JSON is written, members that only identify, time or place the single call, and, in
free text alone, letter case, spacing and the digits of numbers.

Defined results: copies of one (sequence, seq) are one event; events without sequence id or seq have
no place in an order and are left out; a null payload agrees with a null payload only; a payload that
isn't JSON counts as free text; duration is null when no event of a run has a time; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallymill.session import cut
from tallymill.skew import ranged_lag

#: Members that identify, time or place a single call.
CALL_MEMBERS = frozenset(
    "request_id call_id trace_id span_id event_id message_id session_id id uuid nonce latency_ms elapsed_ms duration_ms "
    "latency elapsed duration at ts time timestamp started_at finished_at created_at worker host node pid shard attempt_no".split()
)
#: Members that hold free text.
TEXT_MEMBERS = frozenset("content message text note notes detail details reason explanation summary comment".split())
#: Members whose values must be equal, and so are taken as they are.
EXACT_MEMBERS = frozenset("args arguments value values score scores".split())
_DIGITS = re.compile(r"\d+")


def _plain_text(text: str) -> str:
    text = "".join(unicodedata.normalize("NFC", text).split()).casefold()
    return _DIGITS.sub("0", text)


def _exact(value):
    if isinstance(value, dict):
        return {k: _exact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_exact(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def _said(value, text: bool = False):
    """value without what belongs to the single call; None stands for nothing left of an object."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if k in CALL_MEMBERS:
                continue
            if k in EXACT_MEMBERS:
                out[k] = _exact(v)
            else:
                kept = _said(v, text or k in TEXT_MEMBERS)
                if isinstance(v, dict) and v and not kept:
                    continue
                out[k] = kept
        return out
    if isinstance(value, list):
        return [_said(v, text) for v in value]
    if isinstance(value, str):
        return _plain_text(value) if text else value
    return _exact(value)


def signature(kind: str | None, role: str | None, payload: str | None) -> int:
    """64 bits that agree for events that say the same."""
    said: object = None
    if payload is not None:
        try:
            value = json.loads(payload)
            said = ["json", _said(value) if isinstance(value, (dict, list)) else _said(value, True)]
        except (ValueError, RecursionError):
            said = ["text", _plain_text(payload)]
    whole = json.dumps([kind, role, said], sort_keys=True, ensure_ascii=True)
    return xxhash.xxh64_intdigest(whole.encode()) - (1 << 63)


@F.pandas_udf(LongType())
def _signatures(kind: pd.Series, role: pd.Series, payload: pd.Series) -> pd.Series:
    none = lambda s: [None if pd.isna(v) else v for v in s]
    return pd.Series([signature(*e) for e in zip(none(kind), none(role), none(payload))], dtype="int64")


def said_events(df: DataFrame, part: str = "attempt_id", order: str = "seq", ts: str = "ts") -> DataFrame:
    """(part, seq, sig, ts): one row per event, with what it says as a number."""
    rows = df.where(F.col(part).isNotNull() & F.col(order).isNotNull()).select(
        F.col(part).alias("part"),
        F.col(order).cast("bigint").alias("seq"),
        _signatures(F.col("kind"), F.col("role"), F.col("payload")).alias("sig"),
        F.col(ts).alias("ts"),
    )
    return rows.groupBy("part", "seq").agg(F.min("sig").alias("sig"), F.min("ts").alias("ts"))


#: So many moving pointers, counted, are broadcast at most, some 50 bytes each.
BROADCAST_POINTERS = 200_000


def run_starts(events: DataFrame, broadcast_pointers: int = BROADCAST_POINTERS) -> DataFrame:
    """(part, seq, ptr): for each event that repeats its predecessor, the seq its run starts at.

    Pointers that have arrived are set aside: a round joins the moving ones only, with all pointers as they stand, and when few are left
    all others stay where they are written.
    """
    lagged = ranged_lag(events.select("part", "seq", "sig"), "part", "seq", ["sig"])
    moving = cut(lagged.where("prev_sig = sig").select("part", "seq", F.col("prev_seq").alias("ptr")))
    n, arrived = moving.count(), []
    width, first = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, n)
    while n:
        table = moving
        for some in arrived:
            table = table.unionByName(some)
        target = table.select("part", F.col("seq").alias("ptr"), F.col("ptr").alias("further"))
        few = n <= broadcast_pointers
        # pointers get fewer, and so do their partitions
        tasks = -(-width * n // first)
        further = cut((F.broadcast(moving) if few else moving).join(target, ["part", "ptr"]).select("part", "seq", F.col("further").alias("ptr")).coalesce(tasks))
        left = further.count()
        if not left:
            break  # all that still moved have arrived
        keys = further.select("part", "seq")
        arrived.append(cut(moving.join(F.broadcast(keys) if few else keys, ["part", "seq"], "left_anti").coalesce(tasks)))
        moving, n = further, left
    out = moving
    for some in arrived:
        out = out.unionByName(some)
    return out


def collapse_runs(df: DataFrame, part: str = "attempt_id", order: str = "seq", ts: str = "ts") -> DataFrame:
    """One row per run, also of a single event: (part, first_seq, last_seq, n_events, started, ended, duration_s)."""
    events = cut(said_events(df, part, order, ts))
    starts = run_starts(events)
    placed = events.join(starts, ["part", "seq"], "left").select(
        "part", "seq", "ts", F.coalesce("ptr", "seq").alias("first_seq")
    )
    runs = placed.groupBy("part", "first_seq").agg(
        F.max("seq").alias("last_seq"),
        F.count("*").alias("n_events"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
    )
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return runs.withColumn("duration_s", seconds).withColumnRenamed("part", part)


def repeats(df: DataFrame, part: str = "attempt_id", order: str = "seq", ts: str = "ts") -> DataFrame:
    """(part, first_seq, last_seq) of each run of two or more events."""
    return collapse_runs(df, part, order, ts).where("n_events >= 2").select(part, "first_seq", "last_seq")
