"""Reducing several scores or verdicts to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(votes: DataFrame, key: str, verdict: str, seq: str = "seq") -> DataFrame:
    """(key, verdict, n): the most frequent verdict; of equally frequent ones the first seen."""
    counts = votes.where(F.col(verdict).isNotNull()).groupBy(key, verdict).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.groupBy(key).agg(F.max_by(verdict, F.struct("n", -F.col("first"))).alias(verdict), F.max("n").alias("n"))


def histogram(votes: DataFrame, key: str, verdict: str) -> DataFrame:
    """(key, verdict, n): verdicts counted."""
    return votes.groupBy(key, verdict).agg(F.count("*").alias("n"))


def median(votes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) over the finite values. percentile keeps counts of distinct values, so hot keys combine before the shuffle."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return votes.where(finite).groupBy(key).agg(F.percentile(value, 0.5).alias("median"))


def weighted_mean(votes: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, mean): finite values weighted; null where the weights sum to 0."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return votes.where(finite).groupBy(key).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def weighted(votes: DataFrame, key: str, verdict: str, weight: str, seq: str = "seq", escalate_below: float = 0.5) -> DataFrame:
    """(key, verdict, margin, escalate): the verdict with most weight, of equal ones the first seen; margin is its
    lead over the next one, as a share of all weight. Weights that sum to 0 are an error."""
    sums = votes.groupBy(key, verdict).agg(F.sum(weight).alias("w"), F.min(seq).alias("first"))
    out = sums.groupBy(key).agg(
        F.max_by(verdict, F.struct("w", -F.col("first"))).alias(verdict), F.sum("w").alias("all"), F.array_sort(F.collect_list("w"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("ws")
    )
    lead = F.get("ws", F.lit(0)) - F.coalesce(F.get("ws", F.lit(1)), F.lit(0.0))
    margin = F.when(F.col("all") > 0, lead / F.when(F.col("all") > 0, F.col("all"))).otherwise(F.raise_error(F.lit("NO_WEIGHT")).cast("double"))
    return out.withColumn("margin", margin).select(key, verdict, "margin", (F.col("margin") <= escalate_below).alias("escalate"))


def strict_majority(flag: Column) -> Column:
    """Aggregate: more than half of the votes that were cast are true; false for none."""
    return F.coalesce(F.count_if(flag) * 2 > F.count(flag), F.lit(False))


def veto(flag: Column, confidence: Column, threshold: float) -> Column:
    """Aggregate: one flag of enough confidence, or of unknown confidence, is enough."""
    return F.coalesce(F.some(flag & F.coalesce(confidence >= threshold, F.lit(True))), F.lit(False))


def eligible(judges: DataFrame, generator: str, strict: bool = False) -> DataFrame:
    """The judges(model_id, family) that may judge what a family generated: those of another family; without one, only where not strict."""
    family = F.lower(F.trim("family"))
    known = F.when(family != "", family)
    return judges.where(F.coalesce(known != generator.strip().lower(), F.lit(not strict)))


def panel_scores(votes: DataFrame, key: str, verdict: str, error: str, seq: str = "seq") -> DataFrame:
    """Per key: the verdict most votes without error give (at equal counts the one cast first), how many gave it, voted and failed;
    status is 'failed' where all votes did."""
    sound = F.col(error).isNull() & F.col(verdict).isNotNull()
    per = votes.groupBy(key, F.when(sound, F.col(verdict)).alias(verdict)).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    voted = F.col(verdict).isNotNull()
    best = F.max_by(verdict, F.when(voted, F.struct(F.col("n"), -F.col("first"))))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.groupBy(key).agg(
        best.alias(verdict), F.coalesce(F.max(F.when(voted, F.col("n"))), F.lit(0)).alias("votes"), total(voted).alias("voted"), total(~voted).alias("failed"),
    ).withColumn("status", F.when(F.col("voted") == 0, "failed").otherwise("scored"))
