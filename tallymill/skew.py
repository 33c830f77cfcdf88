"""Joins and lags that keep working when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.session import cut

#: A key counts as hot from this many rows on.
HOT_ROWS = 50_000
#: At most so many hot keys are broadcast; each key beyond them holds less than 1/MAX_HOT of all rows.
MAX_HOT = 4096
#: A hot key is spread over so many sub-keys.
SALTS = 64


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that don't clash with df's, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    size: str,
    salt_by: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT,
    salts: int = SALTS,
) -> DataFrame:
    """rows joined with facts (one row per key; column size counts the key's rows), hot keys salted.

    The hottest keys, max_hot at most, are found from facts and broadcast (a limit proves the
    bound); rows of such a key are spread over salts sub-keys by salt_by, and the key's facts
    are repeated as often. All other keys join as usual. Every row is kept exactly once. Null keys
    match nothing. Columns of rows keep their names; those of facts must not clash with them.
    """
    spark_keys = [F.col(k) for k in keys]
    hot = facts.where(F.col(size) >= hot_rows).orderBy(F.desc(size), *spark_keys).limit(max_hot)
    flag, salt = fresh(rows.join(facts.limit(0), keys), "is_hot", "salt")
    hot = F.broadcast(hot.select(*keys, F.lit(True).alias(flag)))
    spread = rows.join(hot, keys, "left").withColumn(
        salt, F.when(F.col(flag), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    copies = facts.join(hot, keys, "left").withColumn(
        salt, F.explode(F.when(F.col(flag), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return spread.drop(flag).join(copies.drop(flag), [*keys, salt], how).drop(salt)


def ranged_lag(df: DataFrame, part: str, order: str, values: list[str]) -> DataFrame:
    """df with prev_<v> for each v of values and prev_<order>: those of the row before it in its part.

    (part, order) should be unique. Rows are spread over ranges of (part, order) that Spark samples, so they are even however hot a part is and however
    its order is spaced, and written once. Within a range a row's predecessor is the row before it, one pass over Arrow batches; only each range's
    last row, one per partition, goes over the driver to the range after it. Rows with null part or order have no predecessor and are none.
    """
    (pid,) = fresh(df, "pid")
    cols = [order, *values]
    placed = df.where(F.col(part).isNotNull() & F.col(order).isNotNull())
    # an explicit number, so that ranges aren't merged by their size
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(placed.repartitionByRange(n, part, order).sortWithinPartitions(part, order).withColumn(pid, F.spark_partition_id()))
    lasts = ranged.groupBy(pid).agg(F.max(F.struct(part, order, *[v for v in values])).alias("last")).orderBy(pid).collect()
    before, previous = {}, None
    for row in lasts:
        before[row[pid]] = previous
        previous = tuple(row["last"])
    shared = df.sparkSession.sparkContext.broadcast(before)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"prev_{c}", kinds[c]) for c in cols]])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                row = shared.value.get(batch.column(pid)[0].as_py())
                carried = [pa.array([x], type=batch.column(c).type) for x, c in zip(row or [None] * (len(cols) + 1), [part, *cols])]
                first = False
            head = batch.num_rows - 1
            moved = [pa.concat_arrays([old.cast(batch.column(c).type), batch.column(c).slice(0, head)]) for old, c in zip(carried, [part, *cols])]
            same = pc.fill_null(pc.equal(moved[0], batch.column(part)), False)
            out = [pc.if_else(same, m, pa.nulls(batch.num_rows, m.type)) for m in moved[1:]]
            carried = [batch.column(c).slice(head, 1) for c in [part, *cols]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *out], [*names, *[f"prev_{c}" for c in cols]])

    lagged = ranged.mapInArrow(shift, schema)
    rest = df.where(F.col(part).isNull() | F.col(order).isNull()).withColumns({f"prev_{c}": F.lit(None).cast(kinds[c]) for c in cols})
    return lagged.unionByName(rest)


def blocked_number(df: DataFrame, part: str, order: str, name: str = "place", block: int = 4096) -> DataFrame:
    """df with name: 0, 1, 2 ... along order within part. (part, order) must be unique, order a whole number.

    Rows are numbered in blocks of order values; running sums of the blocks' counts give what a block starts at.
    """
    blocks = df.withColumn("blk", F.floor(F.col(order) / block))
    sizes = blocks.groupBy(part, "blk").agg(F.count("*").alias("in_blk"))
    before = F.coalesce(F.sum("in_blk").over(Window.partitionBy(part).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(part, "blk", before.alias("blk_start"))
    inside = F.row_number().over(Window.partitionBy(part, "blk").orderBy(order)) - 1
    return blocks.withColumn(name, inside).join(starts, [part, "blk"]).withColumn(name, F.col(name) + F.col("blk_start")).drop("blk", "blk_start")


def lookback(rows: DataFrame, part: str, place: str, column: str, reach: int, block: int = 4096) -> DataFrame:
    """rows with before: the column's values in the `reach` places before, nearest first, without nulls. (part, place) must be unique and place number a
    part's rows without gaps.

    Places are windowed in blocks, to each of which the last `reach` rows of the block before are lent.
    """
    (blk,) = fresh(rows, "blk")
    own = F.floor(F.col(place) / block)
    spread = rows.withColumn(blk, F.explode(F.when(F.col(place) % block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))))
    inside = Window.partitionBy(part, blk).orderBy(place)
    before = F.array_compact(F.array(*[F.lag(column, k).over(inside) for k in range(1, reach + 1)]))
    return spread.withColumn("before", before).where(F.col(blk) == own).drop(blk)
