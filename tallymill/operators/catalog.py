"""The run log folded: each run once, aggregates per puzzle and model, evidence, differences between families.

The reference's rules for moving a puzzle between tiers are business rules and are left out; what they read is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import exact, stats
from tallymill.operators import dedup
from tallymill.operators.judges import step_up_by_counts
from tallymill.session import cut

#: Parts of a model id that mark a frontier model.
FRONTIER = ("claude", "qwen3-coder", "deepseek", "glm", "kimi", "gpt-oss", "minimax", "nemotron")
GENERAL_CEILING, MIN_DIFFERENCE, FDR_Q = 0.20, 0.30, 0.10
DEFAULT_MIN_K = 10


def runs(log: DataFrame) -> DataFrame:
    """The runs of the log, each once: of deliveries of one record (its identity, whatever its spelling) the first; of rows
    whose identity isn't whole, the first of each run_id, and all that have none either. Rank filters limit each group before the shuffle."""
    rows = log.where("kind = 'run'")
    whole = F.lit(True)
    for field in dedup.IDENTITY:
        whole = whole & F.col(field).isNotNull()
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    rest = rows.where(~whole)
    named = rest.where("run_id IS NOT NULL").withColumn("nth", first).where("nth = 1").drop("nth")
    return dedup.exactly_once(rows.where(whole)).unionByName(named).unionByName(rest.where("run_id IS NULL"))


def new_runs(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of batch that an append adds to stored."""
    fresh = runs(batch)
    return fresh.join(stored.where("run_id IS NOT NULL").select("run_id").distinct(), "run_id", "left_anti").select(*batch.columns)


def run_id() -> Column:
    """16 hex digits of a run's identity."""
    parts = F.concat_ws("\u0000", "puzzle_content_hash", "model_id", "started_at", "nonce")
    return F.substring(F.sha2(parts, 256), 1, 16)


def is_frontier(model: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a model id has one of the marks, or of extra ones, in any letter case."""
    low = F.lower(model)
    out = F.lit(False)
    for m in (*FRONTIER, *(x.lower() for x in extra)):
        out = out | low.contains(m)
    return F.coalesce(out, F.lit(False))


def min_k(log: DataFrame) -> DataFrame:
    """(puzzle_id, min_k): the latest one that the log has."""
    return runs(log).groupBy("puzzle_id").agg(F.coalesce(F.max_by("min_k", "seq"), F.lit(DEFAULT_MIN_K)).alias("min_k"))


def aggregate(log: DataFrame, generator: str) -> DataFrame:
    """Per puzzle: successes and trials of the generator's family and of all others (a null family is one of
    them), the latest content hash, the latest panel that was present (by start, then log order), and the number of runs."""
    own = F.coalesce(F.lower("family") == generator.lower(), F.lit(False))
    split = lambda c, flag: F.sum(F.when(flag, F.col(c)).otherwise(0)).alias
    panel = F.when(F.col("panel.present"), F.struct("started_at", "seq"))
    return runs(log).groupBy("puzzle_id").agg(
        split("successes", own)("own_s"), split("n", own)("own_n"), split("successes", ~own)("cohort_s"), split("n", ~own)("cohort_n"),
        F.max_by("puzzle_content_hash", "seq").alias("content_hash"), F.max_by("panel", panel).alias("panel"), F.count("*").alias("runs"),
    )


def series(log: DataFrame, frontier: tuple[str, ...] = ()) -> DataFrame:
    """Per puzzle and model: runs, totals, first place in the log, and whether the model is a frontier one."""
    return runs(log).groupBy("puzzle_id", "model_id").agg(
        F.count("*").alias("runs"), F.sum("successes").alias("s"), F.sum("n").alias("n"), F.min("seq").alias("first_seq")
    ).withColumn("frontier", is_frontier(F.col("model_id"), frontier))


def evidence(log: DataFrame, p0: float = 0.90, p1: float = 0.97, low: float = 0.75) -> DataFrame:
    """Per puzzle and model: the e-values for saturation (p1 against p0) and for a fall (failures, 0.5 against 1 - low);
    valid at every look, so the sum over runs may be read at any time."""
    bad = (F.col("n") <= 0) | (F.col("successes") < 0) | (F.col("successes") > F.col("n"))
    rows = runs(log).withColumn("n", stats.guarded(bad, "BAD_COUNTS", F.col("n")))
    sums = rows.groupBy("puzzle_id", "model_id").agg(
        F.count("*").alias("runs"), F.sum("n").alias("n"),
        F.sum(stats.log_e(F.col("successes"), F.col("n"), p0, p1)).alias("log_up"),
        F.sum(stats.log_e(F.col("n") - F.col("successes"), F.col("n"), 1 - low, 0.5)).alias("log_down"),
    )
    return sums.withColumns({"e_saturated": stats.guarded_exp(F.col("log_up")), "e_fallen": stats.guarded_exp(F.col("log_down"))})


def differences(aggregates: DataFrame) -> DataFrame:
    """Per puzzle: the difference of the two families' rates with Newcombe's interval, and the typology it gives;
    a gap or strength needs an interval without 0 and a difference of MIN_DIFFERENCE."""
    s1, n1, s2, n2 = (F.col(c) for c in ("own_s", "own_n", "cohort_s", "cohort_n"))
    (l1, u1), (l2, u2) = stats.wilson(s1, n1), stats.wilson(s2, n2)
    arms = aggregates.withColumns({"p1": F.try_divide(s1, n1), "l1": l1, "u1": u1, "p2": F.try_divide(s2, n2), "l2": l2, "u2": u2})
    lower, upper, delta = stats.newcombe_of(*[F.col(c) for c in ("p1", "l1", "u1", "p2", "l2", "u2")])
    empty = (n1 == 0) | (n2 == 0)
    rows = arms.withColumns({
        "lower": F.when(empty, -1.0).otherwise(lower), "upper": F.when(empty, 1.0).otherwise(upper), "delta": F.when(empty, 0.0).otherwise(delta),
    })
    excludes = (F.col("lower") > 0) | (F.col("upper") < 0)
    directional = ~empty & excludes & (F.abs("delta") >= MIN_DIFFERENCE)
    both_fail = (F.col("u1") <= GENERAL_CEILING) & (F.col("u2") <= GENERAL_CEILING)
    typology = (
        F.when(directional & (F.col("upper") < 0), "gap").when(directional, "strength")
        .when(~empty & ~excludes & both_fail, "general").otherwise("inconclusive")
    )
    return rows.withColumns({"typology": typology, "resolvable": (F.col("upper") - F.col("lower")) / 2}).drop("p1", "l1", "u1", "p2", "l2", "u2")


def guarded_aggregates(aggregates: DataFrame) -> DataFrame:
    """aggregates, with an error where a count is negative or has more successes than trials; no trials are allowed."""
    bad = lambda s, n: (F.col(s) < 0) | (F.col(n) < 0) | (F.col(s) > F.col(n))
    wrong = bad("own_s", "own_n") | bad("cohort_s", "cohort_n")
    return aggregates.withColumn("own_n", stats.guarded(wrong, "BAD_COUNTS", F.col("own_n")))


def classified(aggregates: DataFrame, q: float = FDR_Q) -> DataFrame:
    """differences with Fisher's p, and directional findings that don't survive the control of false discoveries
    over all directional ones made inconclusive."""
    p = exact.fisher_p(*[F.col(c).cast("double") for c in ("own_s", "own_n", "cohort_s", "cohort_n")])
    # written once, a row per puzzle: the step-up looks at it three times
    rows = cut(differences(guarded_aggregates(aggregates)).withColumn("p", p))
    directional = F.col("typology").isin("gap", "strength")
    out = step_up_by_counts(rows, "p", q, directional).withColumn("survived", F.when(directional, F.col("reject")).otherwise(True)).drop("reject")
    return out.withColumn("typology", F.when(F.col("survived"), F.col("typology")).otherwise("inconclusive"))
