"""The documents that a characterization or a diagnostic run ends in, as small tables and one JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions import ids, stats
from tallymill.operators import catalog, judges, transitions, trials
from tallymill.session import cut


def missed_trivial(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """(model_id, missed): the trivial items each judge's majority got wrong, sorted. A bank has few trivial items."""
    trivial = bank.where("category = 'known_trivial'").select(F.col("id").alias("item_id"))
    wrong = judges.grade_matrix(rows.join(trivial, "item_id", "left_semi")).where("NOT correct")
    found = wrong.groupBy("model_id").agg(F.array_sort(F.collect_set("item_id")).alias("missed"))
    none = F.array().cast("array<string>")
    return rows.select("model_id").distinct().join(found, "model_id", "left").withColumn("missed", F.coalesce("missed", none))


def correlation_report(rows: DataFrame) -> DataFrame:
    """(pair, rho): error correlations under "a|b", rounded to four places, halves to even."""
    return judges.error_correlation(judges.error_vectors(rows)).select(F.concat_ws("|", "a", "b").alias("pair"), F.bround("rho", 4).alias("rho"))


def perturbation_report(rows: DataFrame) -> DataFrame:
    """(judges, max_flip_rate): the worst judge's share of changed decisions."""
    return judges.perturbation(judges.measure(rows)).agg(F.count("*").alias("judges"), F.max("flip_rate").alias("max_flip_rate"))


def run_rollup(attempts: DataFrame, k: int = 3) -> DataFrame:
    """(puzzle_id, place, document): JSON lines of a puzzle's roll-up, the head (solves, pass^k, interval) and then each attempt's gate facts under
    its id, each its own row, however many attempts there are. Written sorted by (puzzle_id, place), with the head's place first, it is the document."""
    view = trials.attempt_view(attempts)
    facts = view.groupBy("puzzle_id").agg(F.count("*").alias("n_attempts"), F.count_if("solved").alias("n_solved"))
    lower, upper = stats.wilson(F.col("n_solved"), F.col("n_attempts"))
    head = F.struct(
        "puzzle_id", F.lit(k).alias("k"), "n_attempts", "n_solved", (F.col("n_solved") / F.col("n_attempts")).alias("solve_rate"),
        stats.pass_hat_k(F.col("n_solved"), F.col("n_attempts"), k).alias("pass_hat_k"), F.struct(lower.alias("lower"), upper.alias("upper")).alias("wilson"),
    )
    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias("document")
    one = F.struct("attempt_id", "solved", "gate_passed", "ended", "penalties")
    return facts.select("puzzle_id", F.lit("head").alias("place"), as_json(head)).unionByName(view.select("puzzle_id", F.concat(F.lit("sample "), "attempt_id").alias("place"), as_json(one)))


def run_records(attempts: DataFrame, puzzles: DataFrame, k: int = 3) -> DataFrame:
    """One RUN row per puzzle, model and arm: trials, successes, pass^k, Wilson interval and a stable id."""
    counts = trials.judged(attempts).groupBy("puzzle_id", "model", "framing_arm").agg(
        F.count("*").alias("n"), F.count_if("solved").alias("successes"), F.min("started_at").alias("started_at")
    )
    lower, upper = stats.wilson(F.col("successes"), F.col("n"))
    return counts.join(puzzles.select("puzzle_id", "min_k"), "puzzle_id", "left").withColumns({
        "k": F.lit(k), "pass_hat_k": stats.pass_hat_k(F.col("successes"), F.col("n"), k), "wilson_lower": lower, "wilson_upper": upper,
        "run_id": ids.stable_id(F.col("puzzle_id"), F.col("model"), F.col("framing_arm"), F.unix_micros(F.col("started_at").cast("timestamp"))),
    })


def personal_best(attempts: DataFrame) -> DataFrame:
    """(puzzle_id, model, best): the highest number that a model's earlier scores on a puzzle's class show."""
    value = F.trim(trials.score_of("oracle")["value"])
    number = F.when(value.isin("true", "false"), (value == "true").cast("double")).when(value.rlike(r"^-?[0-9]"), value.try_cast("double"))
    return attempts.groupBy("puzzle_id", "model").agg(F.max(number).alias("best")).where("best IS NOT NULL")


def catalog_list(log: DataFrame, changes: DataFrame, generator: str) -> DataFrame:
    """One row per puzzle of the log or its changes: tier, aggregates, and the typology after the control of false discoveries."""
    runs = cut(catalog.runs(log))
    rows = transitions.views(catalog.classified(catalog.aggregate(log, generator)), runs, transitions.transitions(changes))
    return rows.select("puzzle_id", F.col("tier").alias("state"), "n_runs", "own_s", "own_n", "cohort_s", "cohort_n", F.bround("delta", 3).alias("delta"), "typology", "survived")


def characterization(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """The report of a panel as rows (part, key, document), document in JSON: profiles, grades, screen, correlations, missed trivial items.
    Each part is one row per judge, item or pair, so the report is as distributed as what it is made of; write it with partitionBy("part")."""
    grades = judges.grade_matrix(rows)
    as_part = lambda part, df, *key: df.select(F.lit(part).alias("part"), F.concat_ws("|", *key).alias("key"), F.to_json(F.struct("*")).alias("document"))
    parts = [
        as_part("profile", judges.decide(judges.measure(rows)), "model_id"), as_part("grade", grades, "model_id", "item_id"), as_part("screen", judges.screen_items(grades), "item_id"),
        as_part("correlation", correlation_report(rows), "pair"), as_part("missed_trivial", missed_trivial(rows, bank), "model_id"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
