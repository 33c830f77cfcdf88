"""Changes of a puzzle's tier as events of the log: ids, folds, the current tier, and the catalog's health.

When a puzzle changes its tier is a business rule and isn't decided here; the changes are input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import ids

#: The tiers, the first of which holds without any change, and the reasons that end an attempt to graduate.
TIERS = ("lab", "arena", "regression")
DEFERRED, GRADUATED = "defer_to_designer", "graduate_wilson"


def deferred(panel: Column) -> Column:
    """Whether a panel's word is too weak to decide by: absent, without quorum, or escalating; null members count as false."""
    said = lambda member: F.coalesce(panel[member], F.lit(False))
    return ~said("present") | ~said("meets_quorum") | said("escalate")


def transition_id() -> Column:
    """16 hex digits of what a change is: puzzle, tiers, the runs behind it in any order, and the rule; not its reason or time."""
    return ids.stable_id(F.col("puzzle_id"), F.col("from_tier"), F.col("to_tier"), ids.listed(F.coalesce("contributing_run_ids", F.array().cast("array<string>"))), F.col("rule_version"))


def transitions(changes: DataFrame) -> DataFrame:
    """The changes with their transition_id, each once, the first in log order. The rank filter limits each id's rows before the shuffle."""
    first = F.row_number().over(Window.partitionBy("transition_id").orderBy("seq"))
    return changes.withColumn("transition_id", transition_id()).withColumn("nth", first).where("nth = 1").drop("nth")


def new_transitions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """What an append of batch adds to stored: each change once that isn't there yet."""
    seen = stored.select(transition_id().alias("transition_id")).distinct()
    return transitions(batch).join(seen, "transition_id", "left_anti")


def current_tiers(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """(puzzle_id, tier): the last change's tier, the first tier for puzzles that only have runs; puzzles that only have changes count too."""
    last = changes.groupBy("puzzle_id").agg(F.max_by("to_tier", "seq").alias("tier"))
    seen = runs.select("puzzle_id").distinct()
    return seen.join(last, "puzzle_id", "full").select("puzzle_id", F.coalesce("tier", F.lit(TIERS[0])).alias("tier"))


def health(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """(tier, puzzles, total, defer_fraction): puzzles of each tier, also of empty ones, and the share of first-tier puzzles whose
    last attempt to graduate was deferred."""
    spark = runs.sparkSession
    attempt = changes.where(F.col("reason_code").isin(DEFERRED, GRADUATED)).groupBy("puzzle_id").agg(F.max_by("reason_code", "seq").alias("last"))
    state = current_tiers(runs, changes).join(attempt, "puzzle_id", "left")
    counts = state.groupBy("tier").agg(F.count("*").alias("puzzles"), F.count_if(F.col("last") == DEFERRED).alias("held"))
    known = spark.createDataFrame([(t,) for t in TIERS], "tier STRING")
    rows = known.join(counts, "tier", "full").fillna(0, ["puzzles", "held"])
    everything = Window.partitionBy()  # one row per tier
    lab = lambda c: F.sum(F.when(F.col("tier") == TIERS[0], F.col(c))).over(everything)
    return rows.select("tier", "puzzles", F.sum("puzzles").over(everything).alias("total"), F.coalesce(F.try_divide(lab("held"), lab("puzzles")), F.lit(0.0)).alias("defer_fraction"))


def views(classified: DataFrame, runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Per puzzle: tier, number of runs and changes, the last change, and, where there are runs, the aggregates and typology of classified."""
    timeline = changes.groupBy("puzzle_id").agg(
        F.count("*").alias("n_transitions"), F.max_by("reason_code", "seq").alias("last_reason"), F.max_by("decided_by", "seq").alias("decided_by")
    )
    count = runs.groupBy("puzzle_id").agg(F.count("*").alias("n_runs"))
    facts = classified.select("puzzle_id", "own_s", "own_n", "cohort_s", "cohort_n", "typology", "delta", "lower", "upper", "p", "survived")
    tiers = current_tiers(runs, changes)
    return tiers.join(count, "puzzle_id", "left").join(timeline, "puzzle_id", "left").join(facts, "puzzle_id", "left").fillna(0, ["n_runs", "n_transitions"])


def show(views_of: DataFrame, changes: DataFrame, puzzle_id: str) -> DataFrame:
    """One puzzle's view with its timeline, the changes in log order."""
    one = changes.where(F.col("puzzle_id") == puzzle_id)
    steps = one.groupBy("puzzle_id").agg(F.array_sort(F.collect_list(F.struct("seq", "recorded_at", "from_tier", "to_tier", "reason_code", "decided_by"))).alias("timeline"))
    return views_of.where(F.col("puzzle_id") == puzzle_id).join(steps, "puzzle_id", "left")
