"""Messages delivered more than once: exactly one copy of each record stays.

Method: partition by message identifier, rank by arrival with a deterministic tie-break, keep the
first; new batches are anti-joined against the stored identifiers.

Defined results: a record with a null identity field can't be matched and is always kept; letter
case and surrounding white space (of any kind) don't count; a start time that can't be parsed is compared as text; a null
arrival ranks last; equal rows count as copies; an empty table gives an empty result; extra columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import cut
from tallymill.skew import fresh, spread_join

IDENTITY = ("puzzle_content_hash", "model_id", "started_at", "nonce")


def folded(value: Column) -> Column:
    """value without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(value, r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""))


def instant(value: Column) -> Column:
    """The instant an ISO-8601 text names, as microseconds in text form; UTC where no zone is given.

    Text that can't be read as a time is returned folded.
    """
    text = folded(value)
    zoned = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(zoned.rlike(r"(z|[+-]\d{2}:\d{2})$") & zoned.rlike(":"), zoned).otherwise(F.concat(zoned, F.lit("z")))
    time = F.upper(zoned).try_cast("timestamp")
    return F.coalesce(F.unix_micros(time).cast("string"), F.concat(F.lit("?"), text))


def identity(df: DataFrame, fields: tuple[str, ...] = IDENTITY, times: tuple[str, ...] = ("started_at",)) -> list[Column]:
    """The columns that make rows of df the same record."""
    return [instant(F.col(f)) if f in times else folded(F.col(f)) for f in fields]


def _keyed(df: DataFrame, fields: tuple[str, ...], times: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    names = fresh(df, *[f"key_{i}" for i in range(len(fields))])
    return df.withColumns(dict(zip(names, identity(df, fields, times)))), names


def _known(names: list[str]) -> Column:
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    return known


def _first(keyed: DataFrame, names: list[str], arrival: tuple[str, ...], tie: Column) -> DataFrame:
    """The first delivery of each record of keyed rows: ranked by arrival within the record, ties by hash.

    The rank filter lets Spark limit each group before the shuffle, so a hot record sends one row
    per map task, however many copies it has.
    """
    (rank,) = fresh(keyed, "rank")
    window = Window.partitionBy(*names).orderBy(*[F.col(a).asc_nulls_last() for a in arrival], tie)
    return keyed.where(_known(names)).withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank)


def _tie(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c, t in df.dtypes if not t.startswith("map")])


def exactly_once(
    df: DataFrame,
    fields: tuple[str, ...] = IDENTITY,
    times: tuple[str, ...] = ("started_at",),
    arrival: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """df with the first delivery of each record only."""
    keyed, names = _keyed(df, fields, times)
    first = _first(keyed, names, arrival, _tie(df))
    return first.select(*df.columns).unionByName(keyed.where(~_known(names)).select(*df.columns))


def surplus(
    df: DataFrame,
    fields: tuple[str, ...] = IDENTITY,
    times: tuple[str, ...] = ("started_at",),
    seq: str = "seq",
) -> DataFrame:
    """(kept_seq, dup_seq): each surplus delivery beside the record's first one.

    The kept rows are those of exactly_once, by the same rank. Deliveries per record are counted with partial aggregation; only
    records delivered more than once are written out and joined back, hot ones salted.
    """
    keyed, names = _keyed(df.select(*fields, seq), fields, times)
    (dup,) = fresh(keyed, "dup_seq")
    rows = keyed.where(_known(names) & F.col(seq).isNotNull()).select(*names, F.col(seq).alias(dup))
    kept = _first(rows, names, (dup,), F.col(dup)).withColumnRenamed(dup, "kept_seq")
    counts = rows.groupBy(*names).agg(F.count("*").alias("deliveries")).where("deliveries > 1")
    joined = spread_join(rows, cut(kept.join(counts, names)), names, "deliveries", F.col(dup))
    return joined.where(F.col(dup) != F.col("kept_seq")).select("kept_seq", F.col(dup).alias("dup_seq")).distinct()


def accept_batch(
    stored: DataFrame,
    batch: DataFrame,
    fields: tuple[str, ...] = IDENTITY,
    times: tuple[str, ...] = ("started_at",),
    arrival: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """The rows of batch to append to stored: exactly one of each record that isn't stored yet."""
    once, names = _keyed(exactly_once(batch, fields, times, arrival), fields, times)
    seen = stored.select(*[c.alias(n) for c, n in zip(identity(stored, fields, times), names)]).distinct()
    return once.join(seen, names, "left_anti").select(*batch.columns)
