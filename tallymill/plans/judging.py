"""Queries over judgments, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions.stats import Z95
from tallymill.operators import judges
from tallymill.session import table

DIGITS = 9


def rounded(df, digits: int = DIGITS):
    """df with its doubles rounded, so that engines that sum in another order agree."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(expression: str) -> str:
    return f"(round({expression}, {DIGITS}) + 0.0)"


def pearson(x: str, y: str) -> str:
    """SQL for Pearson's r that is 0 where a side is constant."""
    return f"coalesce(CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN 0.0 ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 0.0)"


def _rows(spark, d):
    return judges.records(table(spark, d, "judgments"))


J = """j AS (SELECT DISTINCT ON (seq) *, CAST(coalesce(correct, predicted IS NOT DISTINCT FROM gold) AS INT)::DOUBLE AS ok,
  CASE WHEN difficulty > 0 THEN difficulty ELSE 1.0 END AS w FROM judgments)"""
_KAPPA = """c AS (SELECT model_id, predicted, gold, count(*) AS n FROM j GROUP BY 1, 2, 3),
  s AS (SELECT model_id, label, sum(p)::DOUBLE AS p, sum(g)::DOUBLE AS g FROM (
      SELECT model_id, predicted AS label, n AS p, 0 AS g FROM c UNION ALL SELECT model_id, gold, 0, n FROM c) GROUP BY 1, 2),
  e AS (SELECT model_id, sum(p * g) AS pg FROM s GROUP BY 1),
  k AS (SELECT model_id, sum(n)::DOUBLE AS m, sum(CASE WHEN predicted IS NOT DISTINCT FROM gold THEN n ELSE 0 END)::DOUBLE AS same FROM c GROUP BY 1),
  kappa AS (SELECT model_id, CASE WHEN pg / (m * m) >= 1 THEN 1.0 ELSE (same / m - pg / (m * m)) / (1 - pg / (m * m)) END AS kappa FROM k JOIN e USING (model_id))"""
_ACC = f"""a AS (SELECT model_id, count(*) AS n, avg(ok) AS accuracy, sum(w * ok) / sum(w) AS weighted_accuracy,
    {pearson('predicted::DOUBLE', 'gold::DOUBLE')} AS r FROM j GROUP BY 1)"""
_ITEMS = """i AS (SELECT model_id, item_id, arg_min(w, seq) AS w, count(*) AS n, min(predicted) AS low, max(predicted) AS high FROM j GROUP BY 1, 2),
  st AS (SELECT model_id, count(*) AS n_items, pow(sum(w), 2) / sum(w * w) AS n_eff,
    coalesce(1 - sum(CASE WHEN n >= 2 AND low IS DISTINCT FROM high THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN n >= 2 THEN 1.0 ELSE 0 END), 0), 1.0) AS consistency,
    sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END)::BIGINT AS repeated FROM i GROUP BY 1)"""
_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
_BIN = " + ".join(f"CAST(confidence >= CAST('{e!r}' AS DOUBLE) AS INT)" for e in _EDGES)
_ECE = f"""b AS (SELECT model_id, {_BIN} AS bin, count(*) AS n, avg(ok) AS acc, avg(confidence) AS conf FROM j WHERE confidence IS NOT NULL GROUP BY 1, 2),
  ece AS (SELECT model_id, sum(abs(acc - conf) * n) / sum(n) AS ece FROM b GROUP BY 1)"""
_POS = """f AS (SELECT model_id, item_id, position, arg_min(predicted, seq) AS v FROM j WHERE position IS NOT NULL GROUP BY 1, 2, 3),
  fi AS (SELECT model_id, item_id, count(*) AS n, min(v) AS low, max(v) AS high FROM f GROUP BY 1, 2),
  pos AS (SELECT model_id, avg(CAST(low IS DISTINCT FROM high AS INT)::DOUBLE) AS position_bias FROM fi WHERE n >= 2 GROUP BY 1)"""
_OTHER = f"""o AS (SELECT model_id, abs({pearson("(CASE WHEN predicted - gold IS NOT NULL THEN answer_len END)", "(CASE WHEN answer_len IS NOT NULL THEN (predicted - gold)::DOUBLE END)")}) AS verbosity_bias,
    coalesce(avg(ok) FILTER (WHERE lower(trim(judge_family)) = lower(trim(judged_family)))
      - avg(ok) FILTER (WHERE lower(trim(judge_family)) <> lower(trim(judged_family))), 0.0) AS family_delta FROM j GROUP BY 1)"""
_N, _S = "greatest(1.0, round_even(n_eff, 0))", "least(greatest(1.0, round_even(n_eff, 0)), greatest(0.0, round_even(weighted_accuracy * greatest(1.0, round_even(n_eff, 0)), 0)))"
_P = f"({_S} / {_N})"
_HALF = f"{Z95!r} * sqrt({_P} * (1 - {_P}) / {_N} + {Z95 ** 2!r} / (4 * {_N} * {_N})) / (1 + {Z95 ** 2!r} / {_N})"
_MID = f"({_P} + {Z95 ** 2!r} / (2 * {_N})) / (1 + {Z95 ** 2!r} / {_N})"
_MEASURED = f"""WITH {J}, {_KAPPA}, {_ACC}, {_ITEMS}, {_ECE}, {_POS}, {_OTHER},
  m AS (SELECT *, greatest(0.0, {_MID} - {_HALF}) AS acc_lower, least(1.0, {_MID} + {_HALF}) AS acc_upper,
      greatest(coalesce(position_bias, 0.0), verbosity_bias, abs(family_delta)) AS max_bias,
      (kappa - 0.8) / sqrt(0.8 * 0.2 / n_items) AS kappa_z
    FROM a JOIN kappa USING (model_id) JOIN st USING (model_id) LEFT JOIN ece USING (model_id) LEFT JOIN pos USING (model_id) JOIN o USING (model_id))"""


def _quality(acc: str, ceiling: str = "0.15") -> str:
    base = f"least(1.0, greatest(0.0, 0.5 * {acc} + 0.3 * greatest(0.0, r) + 0.2 * consistency))"
    return f"greatest(0.0, least(1.0, {base} * (1 / (1 + coalesce(greatest(0.0, ece - {ceiling}), 0.0))) * greatest(0.0, 1 - max_bias)))"


def _seat(accuracy_floor="0.5", agreement="0.8", quality="0.55", ceiling="0.15", margin="1.96 * sqrt(0.16 / greatest(1, n_items))") -> str:
    hard = f"(acc_lower > {accuracy_floor} AND r >= {agreement} AND kappa >= 0.8 - ({margin}))"
    return (f"CASE WHEN NOT {hard} OR {_quality('acc_upper', ceiling)} < {quality} THEN 'reject' "
            f"WHEN {_quality('acc_lower', ceiling)} >= {quality} THEN 'seat' ELSE 'screen' END")


_SE, _KSE = "greatest(0.001, (acc_upper - acc_lower) / 2)", "greatest(0.001, sqrt(0.16 / greatest(1, n_items)))"
_MOVES = [_seat(**{k: f"({v} {sign} {_SE})"}) for k, v in (("accuracy_floor", 0.5), ("agreement", 0.8), ("quality", 0.55), ("ceiling", 0.15)) for sign in "+-"]
_MOVES += [_seat(margin=f"1.96 * {_KSE} {sign} {_KSE}") for sign in "+-"] + [_seat(), _seat()]

_MATRIX = f"{J}, g AS (SELECT model_id, item_id, avg(ok) > 0.5 AS correct FROM j GROUP BY 1, 2)"
_ERRORS = f"{J}, v AS (SELECT model_id, item_id, avg((predicted - gold)::DOUBLE) AS error FROM j GROUP BY 1, 2)"
_RHO = f"""{_ERRORS}, rho AS (SELECT a.model_id AS a, b.model_id AS b, count(*) AS n, {pearson('a.error', 'b.error')} AS rho
  FROM v a JOIN v b ON a.item_id = b.item_id AND a.model_id < b.model_id WHERE a.error IS NOT NULL AND b.error IS NOT NULL GROUP BY 1, 2)"""
_SCREEN = f"""{_MATRIX}, h AS (SELECT item_id, count(*) AS k FROM g GROUP BY 1),
  x AS (SELECT g.model_id, g.item_id, CAST(correct AS INT)::DOUBLE AS x FROM g JOIN h USING (item_id) WHERE k = (SELECT count(DISTINCT model_id) FROM g)),
  t AS (SELECT *, sum(x) OVER (PARTITION BY model_id) - x AS rest FROM x),
  q AS (SELECT item_id, var_pop(x) AS variance, {pearson('x', 'rest')} AS r FROM t GROUP BY 1),
  screened AS (SELECT item_id, variance, r, CASE WHEN variance <= 0 THEN 'saturated' WHEN r < 0.1 THEN 'low_discrimination' ELSE 'kept' END AS label FROM q
    UNION ALL SELECT item_id, NULL, NULL, 'ragged' FROM h WHERE k <> (SELECT count(DISTINCT model_id) FROM g))"""
_LAST = f"{J}, l AS (SELECT model_id, item_id, arg_max(predicted, seq) AS verdict FROM j GROUP BY 1, 2)"
_FOLDS = f"""{_LAST}, c AS (SELECT *, count(*) OVER (PARTITION BY item_id, verdict) AS same, count(*) OVER (PARTITION BY item_id) AS total FROM l WHERE verdict IS NOT NULL),
  d AS (SELECT a.model_id AS judge, b.model_id AS held, CAST(a.verdict = b.verdict AS INT) - (b.same - 1 - CAST(a.verdict = b.verdict AS INT)) / (b.total - 2)::DOUBLE AS d
    FROM c a JOIN c b ON a.item_id = b.item_id AND a.model_id <> b.model_id WHERE b.total >= 3)"""


def _profiles(spark, d):
    return judges.decide(judges.measure(_rows(spark, d)))


def _panel(spark, d):
    rows = _rows(spark, d)
    # these judges err alike less than a panel's limit, so a lower one is set
    return rounded(judges.compose_panel(judges.decide(judges.measure(rows)), judges.error_correlation(judges.error_vectors(rows)), 0.12, 3))


def _t_tail(t: str, v: str) -> str:
    """SQL for the chance that Student's t with a whole number v of degrees of freedom exceeds t."""
    odd = f"(2 / pi()) * (atan({t} / sqrt({v})) + CASE WHEN {v} = 1 THEN 0 ELSE {t} / sqrt({v} + {t} * {t}) * list_sum(list_transform(range(0, ({v} - 1) // 2), lambda i: exp(lgamma(i + 1.0) + lgamma(1.5) - lgamma(i + 1.5)) * pow({v} / ({v} + {t} * {t}), i + 0.5))) END)"
    even = f"{t} / sqrt({v} + {t} * {t}) * list_sum(list_transform(range(0, {v} // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1.0)) * pow({v} / ({v} + {t} * {t}), i::DOUBLE)))"
    return f"(1 - CASE WHEN {v} % 2 = 1 THEN {odd} ELSE {even} END) / 2"


def _votes(spark, d):
    """Per item the verdict with most weight; at equal weight the one cast first."""
    rows = _rows(spark, d)
    weights = judges.decide(judges.measure(rows)).select("model_id", "weight")
    votes = rows.groupBy("model_id", "item_id").agg(F.max_by("predicted", "seq").alias("v"), F.max("seq").alias("seq")).join(weights, "model_id")
    per = votes.where("v IS NOT NULL").groupBy("item_id", "v").agg(F.sum("weight").alias("w"), F.min("seq").alias("first"), F.count("*").alias("votes"))
    total = per.groupBy("item_id").agg(F.max_by("v", F.struct(F.round("w", 12), -F.col("first"))).alias("verdict"), F.max("w").alias("top"), F.sum("w").alias("w"), F.sum("votes").alias("votes"))
    margin = F.try_divide(F.col("top") * 2 - F.col("w"), F.col("w"))
    return rounded(total.select("item_id", "verdict", "votes", margin.alias("margin"), (F.coalesce(margin, F.lit(0.0)) <= 0.5).alias("escalate")))


QUERIES = {
    "d85_accuracy": lambda s, d: rounded(judges.accuracy(_rows(s, d))),
    "d94_item_stability": lambda s, d: rounded(judges.item_stability(_rows(s, d))),
    "d95_calibration_error": lambda s, d: rounded(judges.calibration_error(_rows(s, d))),
    "d96_position_bias": lambda s, d: rounded(judges.position_bias(_rows(s, d))),
    "d97_verbosity_family_bias": lambda s, d: rounded(judges.other_bias(_rows(s, d))),
    "d107_measure": lambda s, d: rounded(judges.measure(_rows(s, d))),
    "b48_seat_decision": lambda s, d: rounded(_profiles(s, d).select("model_id", "quality", "quality_low", "quality_high", "seat", "review", "weight")),
    "d108_perturbation": lambda s, d: rounded(judges.perturbation(judges.measure(_rows(s, d)))),
    "d101_grade_matrix": lambda s, d: judges.grade_matrix(_rows(s, d)),
    "d99_error_vectors": lambda s, d: rounded(judges.error_vectors(_rows(s, d))),
    "d100_error_correlation": lambda s, d: rounded(judges.error_correlation(judges.error_vectors(_rows(s, d)))),
    "f136_redundant_pairs": lambda s, d: rounded(judges.redundant_pairs(judges.error_correlation(judges.error_vectors(_rows(s, d))), 0.05)),
    "b56_diverse": lambda s, d: judges.is_diverse(judges.error_correlation(judges.error_vectors(_rows(s, d)))),
    "d111_item_screen": lambda s, d: rounded(judges.screen_items(judges.grade_matrix(_rows(s, d)))),
    "g141_shared_items": lambda s, d: judges.screen_items(judges.grade_matrix(_rows(s, d))).where("label <> 'ragged'").select("item_id"),
    "d104_screen_report": lambda s, d: judges.screen_items(judges.grade_matrix(_rows(s, d))).groupBy("label").agg(F.count("*").alias("n")),
    "d91_jury_omega": lambda s, d: rounded(judges.jury_omega(judges.last_verdicts(_rows(s, d)))),
    "d92_alt_test_folds": lambda s, d: rounded(judges.alt_test_folds(judges.last_verdicts(_rows(s, d)))),
    "d92_alt_test": lambda s, d: rounded(judges.alt_test(judges.last_verdicts(_rows(s, d)))),
    # the loss is flat around high temperatures: two digits are what a search of it can tell
    "d106_temperatures": lambda s, d: rounded(judges.temperatures(_rows(s, d)).withColumn("temperature", F.round("temperature", 2)), 4),
    "e133_compose_panel": _panel,
    "d117_weighted_vote": _votes,
}

_M = _MEASURED + " SELECT "
_WEIGHT = f"CASE {_seat()} WHEN 'reject' THEN 0.0 WHEN 'screen' THEN greatest(0.001, least(1.0, 0.5 * {_quality('weighted_accuracy')})) ELSE greatest(0.001, least(1.0, {_quality('weighted_accuracy')})) END"
SQL = {
    "d85_accuracy": f"WITH {J}, {_KAPPA}, {_ACC} SELECT model_id, n, {R('accuracy')} AS accuracy, {R('weighted_accuracy')} AS weighted_accuracy, {R('r')} AS r, {R('kappa')} AS kappa FROM a JOIN kappa USING (model_id)",
    "d94_item_stability": f"WITH {J}, {_ITEMS} SELECT model_id, n_items, {R('n_eff')} AS n_eff, {R('consistency')} AS consistency, repeated FROM st",
    "d95_calibration_error": f"WITH {J}, {_ECE} SELECT model_id, {R('ece')} AS ece FROM ece",
    "d96_position_bias": f"WITH {J}, {_POS} SELECT model_id, {R('position_bias')} AS position_bias FROM pos",
    "d97_verbosity_family_bias": f"WITH {J}, {_OTHER} SELECT model_id, {R('verbosity_bias')} AS verbosity_bias, {R('family_delta')} AS family_delta FROM o",
    "d107_measure": _M + "model_id, n, n_items, repeated, " + ", ".join(f"{R(c)} AS {c}" for c in ("accuracy", "weighted_accuracy", "r", "kappa", "n_eff", "consistency", "ece", "position_bias", "verbosity_bias", "family_delta", "acc_lower", "acc_upper", "max_bias", "kappa_z")) + " FROM m",
    "b48_seat_decision": _M + f"model_id, {R(_quality('weighted_accuracy'))} AS quality, {R(_quality('acc_lower'))} AS quality_low, {R(_quality('acc_upper'))} AS quality_high, {_seat()} AS seat, kappa_z > 1 AS review, "
    + R(f"CASE {_seat()} WHEN 'reject' THEN 0.0 WHEN 'screen' THEN greatest(0.001, least(1.0, 0.5 * {_quality('weighted_accuracy')})) ELSE greatest(0.001, least(1.0, {_quality('weighted_accuracy')})) END") + " AS weight FROM m",
    "d108_perturbation": _M + f"model_id, {_seat()} AS baseline, " + R("(" + " + ".join(f"CAST({m} <> {_seat()} AS INT)" for m in _MOVES) + ") / 12.0") + " AS flip_rate FROM m",
    "d101_grade_matrix": f"WITH {_MATRIX} SELECT model_id, item_id, correct FROM g",
    "d99_error_vectors": f"WITH {_ERRORS} SELECT model_id, item_id, {R('error')} AS error FROM v",
    "d100_error_correlation": f"WITH {_RHO} SELECT a, b, n, {R('rho')} AS rho FROM rho",
    "f136_redundant_pairs": f"WITH {_RHO} SELECT a, b, n, {R('rho')} AS rho FROM rho WHERE abs(rho) >= 0.05",
    "b56_diverse": f"WITH {_RHO} SELECT coalesce(bool_and(abs(rho) < 0.25), true) AS diverse FROM rho",
    "d111_item_screen": f"WITH {_SCREEN} SELECT item_id, {R('variance')} AS variance, {R('r')} AS r, label FROM screened",
    "g141_shared_items": f"WITH {_SCREEN} SELECT item_id FROM screened WHERE label <> 'ragged'",
    "d104_screen_report": f"WITH {_SCREEN} SELECT label, count(*) AS n FROM screened GROUP BY 1",
    "d91_jury_omega": f"""WITH {_LAST}, p AS (SELECT a.model_id AS judge, b.model_id AS held, avg(CAST(a.verdict IS NOT DISTINCT FROM b.verdict AS INT)::DOUBLE) AS m
        FROM l a JOIN l b ON a.item_id = b.item_id AND a.model_id <> b.model_id GROUP BY 1, 2),
      t AS (SELECT *, sum(m) OVER (PARTITION BY held) AS total, count(*) OVER (PARTITION BY held) AS k FROM p)
      SELECT judge AS model_id, {R('avg(CAST(m >= (total - m) / (k - 1) - 1e-12 AS INT)::DOUBLE)')} AS omega, count(*) AS folds FROM t WHERE k >= 2 GROUP BY 1""",
    "d117_weighted_vote": f"""{_MEASURED}, wt AS (SELECT model_id, {_WEIGHT} AS weight FROM m),
      vt AS (SELECT model_id, item_id, arg_max(predicted, seq) AS v, max(seq) AS seq FROM j GROUP BY 1, 2),
      pv AS (SELECT item_id, v, sum(weight) AS w, min(seq) AS f, count(*) AS votes FROM vt JOIN wt USING (model_id) WHERE v IS NOT NULL GROUP BY 1, 2),
      rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(w, 12) DESC, f) AS k FROM pv),
      tot AS (SELECT item_id, max(v) FILTER (WHERE k = 1) AS verdict, sum(votes)::BIGINT AS votes, CASE WHEN sum(w) = 0 THEN NULL ELSE (2 * max(w) - sum(w)) / sum(w) END AS margin FROM rk GROUP BY 1)
      SELECT item_id, verdict, votes, {R('margin')} AS margin, coalesce(margin, 0.0) <= 0.5 AS escalate FROM tot""",
    "d92_alt_test_folds": f"WITH {_FOLDS} SELECT judge, held, count(*) AS n, {R('avg(d)')} AS mean, {R('stddev_samp(d)')} AS sd FROM d GROUP BY 1, 2 HAVING count(*) >= 2",
    "d92_alt_test": f"""WITH {_FOLDS}, fo AS (SELECT judge, held, count(*) AS n, avg(d) AS mean, coalesce(stddev_samp(d), 0.0) AS sd FROM d GROUP BY 1, 2 HAVING count(*) >= 2),
      te AS (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE (mean + 0.1) / (sd / sqrt(n)) END AS t, (n - 1)::BIGINT AS v FROM fo),
      pv AS (SELECT judge, held, CASE WHEN sd = 0 THEN CASE WHEN mean > -0.1 THEN 0.0 ELSE 1.0 END ELSE {_t_tail('t', 'v')} END AS p FROM te),
      rk AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY judge) AS m FROM pv WINDOW w AS (PARTITION BY judge ORDER BY p, held)),
      sc AS (SELECT *, list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i)) AS c FROM rk),
      ps AS (SELECT *, k <= coalesce(max(CASE WHEN p <= k::DOUBLE / m * (0.05::DOUBLE / c) THEN k END) OVER (PARTITION BY judge), 0) AS reject FROM sc)
      SELECT judge AS model_id, {R('avg(CAST(reject AS INT)::DOUBLE)')} AS omega FROM ps GROUP BY 1""",
    "e133_compose_panel": f"""WITH RECURSIVE {_MEASURED.split("WITH ", 1)[1]}, se AS (SELECT model_id, {_seat()} AS seat, {_WEIGHT} AS weight FROM m),
      {_RHO.removeprefix(f"{J}, ")},
      cl AS (SELECT a, b, rho FROM rho WHERE abs(rho) >= 0.12 UNION ALL SELECT b, a, rho FROM rho WHERE abs(rho) >= 0.12),
      cm AS (SELECT a, list(b) AS bs FROM cl GROUP BY 1),
      od AS (SELECT model_id, row_number() OVER (ORDER BY weight DESC, model_id) AS k FROM se WHERE seat = 'seat'),
      sq AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS chosen, NULL::VARCHAR AS model_id, NULL::VARCHAR AS first
        UNION ALL SELECT k, CASE WHEN hit IS NULL THEN list_append(chosen, model_id) ELSE chosen END, model_id, hit FROM (
          SELECT od.k, sq.chosen, od.model_id, list_filter(sq.chosen, lambda c: list_contains(coalesce(bs, []), c))[1] AS hit FROM sq JOIN od ON od.k = sq.k + 1 LEFT JOIN cm ON cm.a = od.model_id))
      SELECT se.model_id, CASE WHEN seat <> 'seat' THEN 'not_seated' WHEN first IS NULL THEN 'seat' ELSE 'redundant' END AS status, first AS kept, {R('cl.rho')} AS rho,
        (SELECT len(chosen) >= 3 FROM sq ORDER BY k DESC LIMIT 1) AS meets_quorum
      FROM se LEFT JOIN sq USING (model_id) LEFT JOIN cl ON cl.a = se.model_id AND cl.b = first""",
}
