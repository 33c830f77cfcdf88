"""Queries of the reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import reports, trials
from tallymill.plans import judging as J
from tallymill.plans import trials as T
from tallymill.plans.judging import R, rounded
from tallymill.session import table


def _rows(s, d):
    return J._rows(s, d)


def _records(s, d):
    return rounded(reports.run_records(T.attempts(s, d), T.puzzles(s, d)).select("puzzle_id", "model", "framing_arm", "n", "successes", "min_k", "k", "pass_hat_k", "wilson_lower", "wilson_upper"))


_WL, _WU = T.wilson_sql("successes", "n")

QUERIES = {
    "d102_missed_trivial": lambda s, d: reports.missed_trivial(_rows(s, d), table(s, d, "calibration_items")).withColumn("missed", F.array_join("missed", "|")),
    "d103_correlation_report": lambda s, d: reports.correlation_report(_rows(s, d)),
    "d105_perturbation_report": lambda s, d: rounded(reports.perturbation_report(_rows(s, d))),
    "a14_run_records": _records,
    "f137_personal_best": lambda s, d: reports.personal_best(T.attempts(s, d)),
    "b33_penalty_lookup": lambda s, d: _penalties(s, d),
    "d72_candidates": lambda s, d: trials.puzzle_history(T.attempts(s, d)).where("candidate").select("puzzle_id"),
}


def _penalties(s, d):
    outcomes = T.attempts(s, d).select("attempt_id", "puzzle_id", F.array(F.lit("repeat_calls"), F.lit("test_edit")).alias("triggered"))
    rows = trials.penalty_lookup(outcomes, T.puzzles(s, d))
    return rows.select("attempt_id", F.array_join(F.array_sort(F.transform("drawn", lambda p: p["name"])), "|").alias("drawn"), F.array_join(F.array_sort("unknown"), "|").alias("unknown"))


SQL = {
    "d102_missed_trivial": f"""WITH {J._MATRIX}, w AS (SELECT g.model_id, string_agg(item_id, '|' ORDER BY item_id) AS missed FROM g JOIN calibration_items ON id = item_id
        WHERE category = 'known_trivial' AND NOT correct GROUP BY 1) SELECT model_id, coalesce(missed, '') AS missed FROM (SELECT DISTINCT model_id FROM j) LEFT JOIN w USING (model_id)""",
    "d103_correlation_report": f"WITH {J._RHO} SELECT a || '|' || b AS pair, round_even(rho, 4) + 0.0 AS rho FROM rho",
    "d105_perturbation_report": J._M + "count(*) AS judges, " + R("max((" + " + ".join(f"CAST({m} <> {J._seat()} AS INT)" for m in J._MOVES) + ") / 12.0)") + " AS max_flip_rate FROM m",
    "a14_run_records": f"""WITH {T.A}, c AS (SELECT puzzle_id, model, framing_arm, count(*) AS n, count(*) FILTER (WHERE solved) AS successes FROM a GROUP BY 1, 2, 3)
      SELECT c.puzzle_id, model, framing_arm, n, successes, min_k, 3 AS k, {R('pow(successes::DOUBLE / n, 3)')} AS pass_hat_k, {R(_WL)} AS wilson_lower, {R(_WU)} AS wilson_upper FROM c LEFT JOIN puzzles USING (puzzle_id)""",
    "f137_personal_best": f"""WITH {T.A}, v AS (SELECT puzzle_id, model, CASE WHEN trim(o['value']) IN ('true', 'false') THEN CAST(trim(o['value']) = 'true' AS INT)::DOUBLE
        WHEN regexp_matches(trim(o['value']), '^-?[0-9]') THEN TRY_CAST(trim(o['value']) AS DOUBLE) END AS x FROM a)
      SELECT puzzle_id, model, max(x) AS best FROM v GROUP BY 1, 2 HAVING max(x) IS NOT NULL""",
    "b33_penalty_lookup": """SELECT attempt_id, array_to_string(list_sort(list_filter(list_transform(penalties, lambda p: p['name']), lambda n: n IN ('repeat_calls', 'test_edit'))), '|') AS drawn,
        array_to_string(list_sort(list_filter(['repeat_calls', 'test_edit'], lambda n: NOT coalesce(list_contains(list_transform(penalties, lambda p: p['name']), n), false))), '|') AS unknown
      FROM attempts LEFT JOIN puzzles USING (puzzle_id)""",
    "d72_candidates": f"""WITH {T.A}, h AS (SELECT puzzle_id, count(*) AS n, count(*) FILTER (WHERE solved) AS n_solved FROM a GROUP BY 1) SELECT puzzle_id FROM h WHERE {T._WL} >= 0.1 AND {T._WU} <= 0.9""",
}
