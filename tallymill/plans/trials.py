"""Queries over attempts, traces and the run log, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions.stats import Z95
from tallymill.operators import catalog, trace, trials
from tallymill.plans.data_quality import RUNS
from tallymill.plans.judging import R, rounded
from tallymill.session import table


def _t(name):
    return lambda spark, d: table(spark, d, name)


attempts, puzzles, traces, log = _t("attempts"), _t("puzzles"), _t("trace_events"), _t("catalog_runs")


def wilson_sql(s: str, n: str, z: float = Z95) -> tuple[str, str]:
    p, q = f"({s})::DOUBLE / nullif({n}, 0)", z * z
    half = f"{z!r} * sqrt(({p}) * (1 - {p}) / ({n}) + {q!r} / (4.0 * ({n}) * ({n}))) / (1 + {q!r} / ({n}))"
    mid = f"(({p}) + {q!r} / (2.0 * ({n}))) / (1 + {q!r} / ({n}))"
    return f"(CASE WHEN ({n}) = 0 THEN 0.0 ELSE greatest(0.0, {mid} - {half}) END)", f"(CASE WHEN ({n}) = 0 THEN 1.0 ELSE least(1.0, {mid} + {half}) END)"


def _truthy(v: str) -> str:
    return f"""CASE WHEN {v} IN ('true', 'false') THEN {v} = 'true' WHEN regexp_matches({v}, '^-?[0-9]') THEN coalesce(TRY_CAST({v} AS DOUBLE) > 0, false)
      WHEN starts_with({v}, '"') THEN coalesce(lower(trim(json_extract_string({v}, '$'))) IN ('c', 'correct', 'pass', 'passed', 'true', '1'), false) ELSE false END"""


def _flag(md: str, member: str) -> str:
    return f"CASE WHEN json_type({md}, '$.{member}') = 'BOOLEAN' THEN CAST(json_extract_string({md}, '$.{member}') AS BOOLEAN) END"


A = f"""s AS (SELECT *, scores['oracle'] AS o, scores['panel'] AS p FROM attempts),
  a AS (SELECT *, coalesce({_flag("o['metadata']", 'gate_passed')}, {_truthy("trim(o['value'])")}) AS ok,
      coalesce(CASE WHEN NOT (terminated_by IS NULL OR terminated_by = 'completed') OR o IS NULL THEN false
        ELSE coalesce({_flag("o['metadata']", 'gate_passed')}, {_truthy("trim(o['value'])")}) END, false) AS solved,
      coalesce({_flag("o['metadata']", 'novelty_validated')}, false) OR coalesce({_flag("p['metadata']", 'novelty_validated')}, false) AS novel FROM s)"""
_WL, _WU = wilson_sql("n_solved", "n")

T = "t AS (SELECT DISTINCT ON (attempt_id, seq) * FROM trace_events WHERE attempt_id IS NOT NULL AND seq IS NOT NULL ORDER BY attempt_id, seq, payload)"
C = f"""{T}, c AS (SELECT attempt_id, seq, coalesce(json_extract_string(payload, '$.tool'), '') AS tool,
    CASE WHEN json_extract_string(payload, '$.tool') IN ('read_file', 'write_file') THEN json_extract_string(payload, '$.args.path') END AS path,
    concat_ws(chr(1), coalesce(json_extract_string(payload, '$.tool'), ''), coalesce(json_extract_string(payload, '$.args.path'), '-'),
      coalesce(json_extract_string(payload, '$.args.q'), '-'), coalesce(json_extract_string(payload, '$.args.line'), '-'),
      coalesce(json_extract_string(payload, '$.args.opts.deep'), '-'), coalesce(json_extract_string(payload, '$.args.opts.limit'), '-')) AS sig
  FROM t WHERE kind = 'tool')"""
_RED = f"""{C}, w AS (SELECT *, coalesce(sig IN (lag(sig, 1) OVER q, lag(sig, 2) OVER q, lag(sig, 3) OVER q), false)
      OR (path IS NOT NULL AND row_number() OVER (PARTITION BY attempt_id, tool, path ORDER BY seq) > 2) AS again FROM c WINDOW q AS (PARTITION BY attempt_id ORDER BY seq)),
  red AS (SELECT attempt_id, count(*) AS tool_calls, count(*) FILTER (WHERE again) AS redundant, avg(CAST(again AS INT)::DOUBLE) AS tcrr FROM w GROUP BY 1)"""
_OUT = f"""{A}, {_RED}, pz AS (SELECT *, list_transform(penalties, lambda p: p['name']) AS known FROM puzzles),
  oc AS (SELECT a.attempt_id, a.puzzle_id, ok AS solved, o['value'] AS v, rewards, penalties, known, point_threshold, tool_call_budget, time_budget_seconds,
      coalesce(CASE WHEN regexp_matches(trim(o['value']), '^-?[0-9]') THEN TRY_CAST(trim(o['value']) AS DOUBLE) END, CASE WHEN ok THEN rewards['solve'] ELSE 0.0 END) AS q,
      coalesce(tool_calls, 0) AS used, wall_time AS tm,
      coalesce(tcrr, 0) > 0.3 AND coalesce(list_contains(known, 'repeat_calls'), false) AS loops, coalesce(terminated_by = 'hard_kill', false) AS killed,
      p IS NOT NULL AS claimed, coalesce({_flag("p['metadata']", 'novelty_validated')}, false) AS validated
    FROM a JOIN pz USING (puzzle_id) LEFT JOIN red USING (attempt_id) WHERE o IS NOT NULL),
  oc2 AS (SELECT *, list_filter(penalties, lambda x: (loops AND x['name'] = 'repeat_calls') OR (killed AND x['name'] = 'hard_kill')) AS drawn,
      killed AND NOT coalesce(list_contains(known, 'hard_kill'), false) AS unknown FROM oc),
  oc3 AS (SELECT *, coalesce(list_sum(list_transform(drawn, lambda x: x['weight'])), 0.0) AS pen,
      coalesce(list_sum(list_transform(list_filter(drawn, lambda x: x['goodhart_flavor'] <> 'adversarial'), lambda x: x['weight'])), 0.0) AS minor,
      coalesce(len(list_filter(drawn, lambda x: x['goodhart_flavor'] = 'adversarial')), 0) > 0 AS critical,
      CASE WHEN rewards['elegance_bonus_max'] > 0 AND used > 0 AND used <= rewards['canonical_call_count']
        THEN rewards['elegance_bonus_max'] * (rewards['canonical_call_count'] - used) / rewards['canonical_call_count'] ELSE 0.0 END AS eleg,
      CASE WHEN claimed AND validated THEN rewards['novelty_bonus_max'] ELSE 0.0 END AS nov FROM oc2),
  g AS (SELECT *, concat_ws('|', CASE WHEN tm IS NULL THEN 'non_finite_input' END, CASE WHEN NOT solved THEN 'not_solved' END,
      CASE WHEN q < point_threshold THEN 'below_point_threshold' END, CASE WHEN critical THEN 'critical_penalty' END,
      CASE WHEN unknown THEN 'unknown_penalty_fired' END, CASE WHEN minor < 0 AND q + minor < point_threshold THEN 'penalty_adjusted_below_threshold' END,
      CASE WHEN used > tool_call_budget THEN 'over_tool_budget' END, CASE WHEN tm > time_budget_seconds THEN 'over_time_budget' END,
      CASE WHEN claimed AND NOT validated THEN 'novelty_unvalidated' END) AS failed FROM oc3)"""

#: What the run log of these tables calls the generators' family, and parts of its names of frontier models.
GENERATOR, FRONTIER = "borealis", ("405b", "x1", "large", "deep")
L = RUNS
_AGG = f"""{L}, g AS (SELECT puzzle_id,
      sum(CASE WHEN coalesce(lower(family) = 'borealis', false) THEN successes ELSE 0 END)::BIGINT AS own_s, sum(CASE WHEN coalesce(lower(family) = 'borealis', false) THEN n ELSE 0 END)::BIGINT AS own_n,
      sum(CASE WHEN coalesce(lower(family) = 'borealis', false) THEN 0 ELSE successes END)::BIGINT AS cohort_s, sum(CASE WHEN coalesce(lower(family) = 'borealis', false) THEN 0 ELSE n END)::BIGINT AS cohort_n,
      arg_max(puzzle_content_hash, seq) AS content_hash, count(*) AS runs FROM r GROUP BY 1),
  pn0 AS (SELECT puzzle_id, panel, row_number() OVER (PARTITION BY puzzle_id ORDER BY started_at DESC, seq DESC) AS k FROM r WHERE panel['present']),
  pn AS (SELECT puzzle_id, panel['fairness'] AS fairness, panel['meets_quorum'] AS quorum FROM pn0 WHERE k = 1)"""
_L1, _U1 = wilson_sql("own_s", "own_n")
_L2, _U2 = wilson_sql("cohort_s", "cohort_n")
_P1, _P2 = "(own_s::DOUBLE / nullif(own_n, 0))", "(cohort_s::DOUBLE / nullif(cohort_n, 0))"
_D = f"({_P1} - {_P2})"
_DIFF = f"""{_AGG}, x AS (SELECT *, own_n = 0 OR cohort_n = 0 AS empty,
      CASE WHEN own_n = 0 OR cohort_n = 0 THEN 0.0 ELSE {_D} END AS delta,
      CASE WHEN own_n = 0 OR cohort_n = 0 THEN -1.0 ELSE greatest(-1.0, {_D} - sqrt(({_P1} - {_L1}) * ({_P1} - {_L1}) + ({_U2} - {_P2}) * ({_U2} - {_P2}))) END AS lower,
      CASE WHEN own_n = 0 OR cohort_n = 0 THEN 1.0 ELSE least(1.0, {_D} + sqrt(({_U1} - {_P1}) * ({_U1} - {_P1}) + ({_P2} - {_L2}) * ({_P2} - {_L2}))) END AS upper FROM g),
  diff AS (SELECT *, CASE WHEN NOT empty AND (lower > 0 OR upper < 0) AND abs(delta) >= 0.3 THEN CASE WHEN upper < 0 THEN 'gap' ELSE 'strength' END
      WHEN NOT empty AND NOT (lower > 0 OR upper < 0) AND {_U1} <= 0.2 AND {_U2} <= 0.2 THEN 'general' ELSE 'inconclusive' END AS typology FROM x)"""


def _log_table(k: str) -> str:
    choose = lambda n, r: f"(lgamma({n} + 1.0) - lgamma(({r}) + 1.0) - lgamma(({n}) - ({r}) + 1.0))"
    return f"{choose('own_n', k)} + {choose('cohort_n', f'own_s + cohort_s - {k}')} - {choose('(own_n + cohort_n)', 'own_s + cohort_s')}"


_FDR = f"""{_DIFF}, tables AS (SELECT *, unnest(range(greatest(0, own_s + cohort_s - cohort_n), least(own_n, own_s + cohort_s) + 1)) AS k FROM diff),
  logs AS (SELECT puzzle_id, {_log_table('k')} AS l, {_log_table('own_s')} AS given FROM tables),
  fisher AS (SELECT puzzle_id, least(1.0, sum(exp(l)) FILTER (WHERE l <= given + 1e-7)) AS p FROM logs GROUP BY 1),
  found AS (SELECT puzzle_id, p, row_number() OVER (ORDER BY p, puzzle_id) AS k, count(*) OVER () AS m FROM diff JOIN fisher USING (puzzle_id) WHERE typology IN ('gap', 'strength')),
  kept AS (SELECT puzzle_id, k <= coalesce(max(CASE WHEN p <= k * 0.1 / m THEN k END) OVER (), 0) AS survived FROM found),
  classified AS (SELECT diff.*, p, coalesce(survived, true) AS survived, CASE WHEN coalesce(survived, true) THEN typology ELSE 'inconclusive' END AS final
    FROM diff LEFT JOIN fisher USING (puzzle_id) LEFT JOIN kept USING (puzzle_id))"""


def _budgets(spark, d):
    terms = puzzles(spark, d).select("puzzle_id", F.col("hard_kill_consecutive_identical").alias("identical"), "tool_call_budget")
    return attempts(spark, d).select("attempt_id", "puzzle_id").join(terms, "puzzle_id").drop("puzzle_id")


def _gate(spark, d):
    facts = trace.redundancy(traces(spark, d))
    out = trials.gate(trials.outcomes(attempts(spark, d), facts, puzzles(spark, d)), puzzles(spark, d))
    flat = out.withColumn("failed", F.array_join("failed", "|")).drop("unknown")
    return rounded(flat.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in ("net", "value", "adjusted")}), 6)


def _e_values(spark, d):
    rows = catalog.evidence(log(spark, d))
    return rows.select("puzzle_id", "model_id", "runs", "n", F.round("log_up", 6).alias("log_up"), F.round("log_down", 6).alias("log_down"),
                       (F.col("e_saturated") >= 20).alias("saturated"), (F.col("e_fallen") >= 20).alias("fallen"))


def _aggregate(spark, d):
    return catalog.aggregate(log(spark, d), GENERATOR).select("puzzle_id", "own_s", "own_n", "cohort_s", "cohort_n", "content_hash", "runs",
                                                   F.col("panel.fairness").alias("fairness"), F.col("panel.meets_quorum").alias("quorum"))


def _blobs(spark, d):
    kept, blobs = trace.spill(traces(spark, d), 60)
    return kept.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("uses")).join(blobs, "digest").select("digest", "uses", F.length("content").alias("chars"))


QUERIES = {
    "b28_solved": lambda s, d: trials.judged(attempts(s, d)).select("attempt_id", "solved", "novel"),
    "d70_puzzle_history": lambda s, d: rounded(trials.puzzle_history(attempts(s, d))),
    "d73_model_profile": lambda s, d: rounded(trials.model_profile(attempts(s, d)), 6),
    "d74_roll_up": lambda s, d: trials.roll_up(attempts(s, d)),
    "d75_attempt_view": lambda s, d: trials.attempt_view(attempts(s, d)).withColumn("penalties", F.array_join("penalties", "|")),
    "d77_arm_divergence": lambda s, d: rounded(trials.arm_divergence(attempts(s, d))),
    "b32_gate": _gate,
    "e123_numbered": lambda s, d: trace.numbered(traces(s, d)).select("attempt_id", "seq", "place", "kind"),
    "e124_since": lambda s, d: trace.since(traces(s, d), 10).select("attempt_id", "seq", "kind"),
    "e125_first_halt": lambda s, d: trace.first_halt(traces(s, d), _budgets(s, d)),
    "d119_redundancy": lambda s, d: rounded(trace.redundancy(traces(s, d))),
    "h187_path_sets": lambda s, d: trace.path_sets(traces(s, d)),
    "a17_blob_spill": _blobs,
    "a12_runs": lambda s, d: catalog.runs(log(s, d)).select("seq", "run_id", "puzzle_id", "model_id"),
    "d78_aggregate": _aggregate,
    "d81_min_k": lambda s, d: catalog.min_k(log(s, d)),
    "d82_series": lambda s, d: catalog.series(log(s, d), FRONTIER),
    "d83_evidence": _e_values,
    "b46_differences": lambda s, d: rounded(catalog.differences(catalog.aggregate(log(s, d), GENERATOR)).select("puzzle_id", "delta", "lower", "upper", "resolvable", "typology")),
    "e122_classified": lambda s, d: rounded(catalog.classified(catalog.aggregate(log(s, d), GENERATOR)).select("puzzle_id", "p", "typology", "survived"), 8),
    "h172_run_ids": lambda s, d: log(s, d).select("seq", catalog.run_id().alias("run_id")),
}

SQL = {
    "b28_solved": f"WITH {A} SELECT attempt_id, solved, novel FROM a",
    "d70_puzzle_history": f"""WITH {A}, h AS (SELECT puzzle_id, count(*) AS n, count(*) FILTER (WHERE solved) AS n_solved FROM a GROUP BY 1)
      SELECT puzzle_id, n, n_solved, {R('n_solved::DOUBLE / n')} AS solve_rate, {R('pow(n_solved::DOUBLE / n, 3)')} AS pass_hat_k, {R(_WL)} AS wilson_lower, {R(_WU)} AS wilson_upper,
        {_WL} >= 0.1 AND {_WU} <= 0.9 AS candidate FROM h""",
    "d73_model_profile": f"""WITH {A} SELECT model, count(*) AS n, round(avg(CAST(solved AS INT)::DOUBLE), 6) AS solve_rate, round(avg(CAST(novel AS INT)::DOUBLE), 6) AS novelty_rate,
        round(sum(coalesce(wall_time, 0.0)) / count(*), 6) AS mean_latency FROM a GROUP BY 1""",
    "d74_roll_up": f"""WITH {A} SELECT puzzle_id, model, grouping(puzzle_id, model)::BIGINT AS grouping, count(*) AS n, count(*) FILTER (WHERE solved) AS n_solved, count(*) FILTER (WHERE novel) AS n_novel
        FROM a GROUP BY GROUPING SETS ((puzzle_id), (model), ())""",
    "d75_attempt_view": f"""WITH {A}, v AS (SELECT *, coalesce({_flag("o['metadata']", 'gate_passed')}, false) AS g FROM a)
      SELECT attempt_id, puzzle_id, framing_arm, g AS gate_passed, g AND coalesce(terminated_by, 'completed') = 'completed' AS solved, coalesce(terminated_by, 'completed') AS ended, '' AS penalties FROM v""",
    "d77_arm_divergence": f"""WITH {A}, v AS (SELECT puzzle_id, avg(CAST(solved AS INT)::DOUBLE) FILTER (WHERE framing_arm = 'self_referential') AS x,
        avg(CAST(solved AS INT)::DOUBLE) FILTER (WHERE framing_arm = 'neutral') AS y FROM a GROUP BY 1)
      SELECT puzzle_id, {R('x')} AS rate_a, {R('y')} AS rate_b, {R('abs(x - y)')} AS gap, abs(x - y) > 0 AS diverges FROM v WHERE x IS NOT NULL AND y IS NOT NULL""",
    "b32_gate": f"""WITH {_OUT} SELECT attempt_id, puzzle_id, failed, round(eleg, 6) AS elegance, round(nov, 6) AS novelty, round(pen, 6) AS penalties, round(q + minor, 6) AS adjusted,
        round(q + eleg + nov + pen, 6) AS net, failed = '' AS gate_passed, CASE WHEN failed = '' THEN round(q + eleg + nov + pen, 6) ELSE 0.0 END AS value FROM g""",
    "e123_numbered": f"WITH {T} SELECT attempt_id, seq, (row_number() OVER (PARTITION BY attempt_id ORDER BY seq) - 1)::BIGINT AS place, kind FROM t",
    "e124_since": f"WITH {T} SELECT attempt_id, seq, kind FROM t WHERE seq >= 10",
    "e125_first_halt": f"""WITH {C}, b AS (SELECT attempt_id, hard_kill_consecutive_identical AS identical, tool_call_budget FROM attempts JOIN puzzles USING (puzzle_id)),
      m AS (SELECT *, CAST(sig IS DISTINCT FROM lag(sig) OVER (PARTITION BY attempt_id ORDER BY seq) AS INT) AS moved FROM c),
      i AS (SELECT *, sum(moved) OVER (PARTITION BY attempt_id ORDER BY seq) AS island, row_number() OVER (PARTITION BY attempt_id ORDER BY seq) AS place FROM m),
      k AS (SELECT *, row_number() OVER (PARTITION BY attempt_id, island ORDER BY seq) AS length FROM i),
      h AS (SELECT attempt_id, seq, CASE WHEN length >= identical THEN 'hard_kill' WHEN place > tool_call_budget THEN 'budget' END AS reason FROM k JOIN b USING (attempt_id))
      SELECT attempt_id, min(seq) AS seq, arg_min(reason, seq) AS reason FROM h WHERE reason IS NOT NULL GROUP BY 1""",
    "d119_redundancy": f"WITH {_RED} SELECT attempt_id, tool_calls, redundant, {R('tcrr')} AS tcrr FROM red",
    "h187_path_sets": f"WITH {C} SELECT attempt_id, path, count(*) AS reads, count(*) AS touches FROM c WHERE path IS NOT NULL AND path <> '' GROUP BY 1, 2",
    "a17_blob_spill": f"""WITH {T}, x AS (SELECT coalesce(json_extract_string(payload, '$.content'), json_extract_string(payload, '$.message')) AS content FROM t)
      SELECT sha256(content) AS digest, count(*) AS uses, length(min(content))::INT AS chars FROM x WHERE length(content) >= 60 GROUP BY 1""",
    "a12_runs": f"WITH {L} SELECT seq, run_id, puzzle_id, model_id FROM r",
    "d78_aggregate": f"WITH {_AGG} SELECT puzzle_id, own_s, own_n, cohort_s, cohort_n, content_hash, runs, fairness, quorum FROM g LEFT JOIN pn USING (puzzle_id)",
    "d81_min_k": f"WITH {L} SELECT puzzle_id, coalesce(arg_max(min_k, seq), 10) AS min_k FROM r GROUP BY 1",
    "d82_series": f"""WITH {L} SELECT puzzle_id, model_id, count(*) AS runs, sum(successes)::BIGINT AS s, sum(n)::BIGINT AS n, min(seq) AS first_seq,
        regexp_matches(lower(model_id), '405b|x1|large|deep|claude|qwen3-coder|deepseek|glm|kimi|gpt-oss|minimax|nemotron') AS frontier FROM r GROUP BY 1, 2""",
    "d83_evidence": f"""WITH {L}, e AS (SELECT puzzle_id, model_id, count(*) AS runs, sum(n)::BIGINT AS n, sum(successes * ln(0.97 / 0.9) + (n - successes) * ln(0.03 / 0.1)) AS u,
        sum((n - successes) * ln(0.5 / 0.25) + successes * ln(0.5 / 0.75)) AS w FROM r GROUP BY 1, 2)
      SELECT puzzle_id, model_id, runs, n, round(u, 6) + 0.0 AS log_up, round(w, 6) + 0.0 AS log_down, exp(least(u, 700)) >= 20 AS saturated, exp(least(w, 700)) >= 20 AS fallen FROM e""",
    "b46_differences": f"WITH {_DIFF} SELECT puzzle_id, {R('delta')} AS delta, {R('lower')} AS lower, {R('upper')} AS upper, {R('(upper - lower) / 2')} AS resolvable, typology FROM diff",
    "e122_classified": f"WITH {_FDR} SELECT puzzle_id, round(p, 8) + 0.0 AS p, final AS typology, survived FROM classified",
    "h172_run_ids": "SELECT seq, substr(sha256(puzzle_content_hash || chr(0) || model_id || chr(0) || started_at || chr(0) || nonce), 1, 16) AS run_id FROM catalog_runs",
}
