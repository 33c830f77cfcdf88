"""Queries over items, labels, model output and votes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import exact, ids, text
from tallymill.operators import items, judges, labels, votes
from tallymill.plans.judging import _SCREEN, J, R, rounded
from tallymill.plans.trials import attempts, log
from tallymill.session import table


def _t(name):
    return lambda spark, d: table(spark, d, name)


bank, human, pairs = _t("calibration_items"), _t("human_labels"), _t("screening_pairs")
ORDER = ["small", "mid", "frontier"]


def _judged(s, d):
    return judges.records(table(s, d, "judgments"))


def _item_votes(s, d):
    return _judged(s, d).select("item_id", F.when(F.col("predicted") == 1, "A").otherwise("B").alias("choice"))


def _outcomes(s, d):
    """What the judges' majority says of each tier's expectation: the item's expectation where most judged it right, else its contrary."""
    right = _judged(s, d).groupBy("item_id").agg((F.avg("is_correct") > 0.5).alias("right"))
    return items.expectations(bank(s, d)).join(right, "item_id").select("item_id", "tier", (F.col("expected") == F.col("right")).alias("passed"))


def _exact(s, d):
    counts = log(s, d).where("n > 0").groupBy("successes", "n").agg(F.count("*").alias("runs"))
    ci = exact.clopper_pearson_ci(F.col("successes").cast("double"), F.col("n").cast("double"), F.lit(0.95))
    return rounded(counts.withColumn("ci", ci).select("successes", "n", "runs", F.col("ci")[0].alias("lower"), F.col("ci")[1].alias("upper")), 8)


def _read_pairs(s, d):
    said = text.choice(text.without_control(F.col("raw")), F.col("gold"))
    return pairs(s, d).select("pair_id", said.alias("said"), text.as_number(said).alias("number"), (said == F.col("gold")).alias("right"),
                              text.spec_model(F.col("spec")).alias("model"), text.spec_family(F.col("spec")).alias("family"),
                              text.routed_model(F.col("spec"), "router:").alias("routed"), text.is_alias(F.col("spec")).alias("alias"))


_TICKS = """o AS (SELECT id AS item_id, category, unnest(map_keys(expected_pass)) AS tier, unnest(map_values(expected_pass)) AS expected FROM calibration_items),
  g AS (SELECT item_id, avg(ok) > 0.5 AS "right" FROM j GROUP BY 1),
  r AS (SELECT o.item_id, category, tier, expected = "right" AS passed, list_position(['small', 'mid', 'frontier'], tier) AS rank FROM o JOIN g USING (item_id)),
  inv AS (SELECT a.item_id, a.category, a.tier || '<' || b.tier AS detail FROM r a JOIN r b ON a.item_id = b.item_id AND a.passed AND NOT b.passed AND a.rank < b.rank),
  viol AS (SELECT item_id, category, 'trivial_failed' AS kind, tier AS detail, false AS soft FROM r WHERE category = 'known_trivial' AND NOT passed
    UNION ALL SELECT item_id, category, 'impossible_passed', tier, false FROM r WHERE category = 'known_impossible' AND passed
    UNION ALL SELECT item_id, category, 'not_monotone', detail, category = 'difficulty_anchor' FROM inv WHERE category IN ('known_diagnostic', 'difficulty_anchor')
    UNION ALL SELECT id, category, 'no_outcome', '', false FROM calibration_items WHERE id NOT IN (SELECT item_id FROM r))"""
_LAB = r"""u0 AS (SELECT campaign_id, item_id, lower(regexp_replace(annotator, '^\s+|\s+$', '', 'g')) AS who, tier, labelled_at,
      CASE WHEN upper(regexp_replace(verdict, '[^A-Za-z]', '', 'g')) IN ('A', 'PASS') THEN 1 WHEN upper(regexp_replace(verdict, '[^A-Za-z]', '', 'g')) IN ('B', 'FAIL') THEN 0 ELSE -1 END AS pred
    FROM human_labels WHERE annotator IS NOT NULL),
  u1 AS (SELECT *, max(tier) OVER (PARTITION BY campaign_id, item_id, who) AS best, row_number() OVER (PARTITION BY campaign_id, item_id, who ORDER BY labelled_at DESC NULLS LAST, pred DESC) AS k FROM u0),
  u AS (SELECT campaign_id, item_id, who, best AS tier, pred FROM u1 WHERE k = 1 AND pred >= 0),
  ia AS (SELECT campaign_id, item_id, count(*) AS votes, greatest(sum(pred), count(*) - sum(pred))::DOUBLE / count(*) AS agreement, sum(pred)::DOUBLE AS a, (count(*) - sum(pred))::DOUBLE AS b FROM u GROUP BY 1, 2)"""
_REP = f"""{_LAB}, w AS (SELECT campaign_id, who, min(CASE tier WHEN 'expert' THEN 0.2 WHEN 'skilled' THEN 0.15 WHEN 'crowd' THEN 0.1 END)::DOUBLE AS eps FROM u GROUP BY 1, 2),
  w2 AS (SELECT campaign_id, count(*) AS annotators, min(eps) AS eps FROM w GROUP BY 1),
  i2 AS (SELECT campaign_id, count(*) AS items, count(*) FILTER (WHERE agreement < 0.67) AS disputed FROM ia GROUP BY 1),
  al AS (SELECT campaign_id, CASE WHEN sum(a) * sum(b) = 0 THEN 1.0 ELSE 1 - (sum(a) + sum(b) - 1) * sum(2 * a * b / (a + b - 1)) / (2 * sum(a) * sum(b)) END AS alpha FROM ia WHERE a + b >= 2 GROUP BY 1)"""

QUERIES = {
    "g142_duplicate_ids": lambda s, d: items.duplicate_ids(log(s, d).where("run_id IS NOT NULL").select(F.col("run_id").alias("id"))),
    "c12_expectations": lambda s, d: items.expectations(bank(s, d)),
    "b60_violations": lambda s, d: items.violations(_outcomes(s, d), bank(s, d), ORDER),
    "e131_inversions": lambda s, d: items.inversions(items.ranked(_outcomes(s, d), bank(s, d), ORDER)),
    "d114_group_summary": lambda s, d: items.group_summary(_outcomes(s, d), bank(s, d), ORDER),
    "b58_key_status": lambda s, d: items.key_status(_item_votes(s, d), bank(s, d)),
    "d113_curated": lambda s, d: items.curate(judges.screen_items(judges.grade_matrix(_judged(s, d))), items.key_status(_item_votes(s, d), bank(s, d))),
    "e134_split": lambda s, d: items.split_inventory(bank(s, d).select("id"), "round one"),
    "a5_usable_labels": lambda s, d: labels.usable(human(s, d)),
    "a5_item_agreement": lambda s, d: rounded(labels.item_agreement(labels.usable(human(s, d)))),
    "d93_campaign_report": lambda s, d: rounded(labels.campaign_report(human(s, d))),
    "h165_read_pairs": _read_pairs,
    "h176_canonical": lambda s, d: table(s, d, "trace_events").select("attempt_id", "seq", ids.canonical_json("payload").alias("canonical")).distinct(),
    "i198_clopper_pearson": _exact,
    "d115_majority": lambda s, d: votes.majority(_judged(s, d), "item_id", "predicted"),
    "d115_median": lambda s, d: rounded(votes.median(_judged(s, d), "item_id", "confidence")),
    "d115_weighted_mean": lambda s, d: rounded(votes.weighted_mean(_judged(s, d).withColumn("w", F.coalesce("difficulty", F.lit(1.0))), "item_id", "confidence", "w")),
    "d116_strict_majority": lambda s, d: _judged(s, d).groupBy("item_id").agg(votes.strict_majority(F.col("correct")).alias("novel")),
    "d118_histogram": lambda s, d: votes.histogram(_judged(s, d), "item_id", "predicted"),
    "b57_veto": lambda s, d: _judged(s, d).groupBy("item_id").agg(votes.veto(F.col("predicted") == 0, F.col("confidence"), 0.99).alias("vetoed")),
    "h161_models": lambda s, d: attempts(s, d).select("model").distinct().select(
        "model", text.local_model(F.col("model")).alias("local"), text.routed_model(F.col("model")).alias("routed"), text.is_alias(F.col("model")).alias("alias")),
}

SQL = {
    "g142_duplicate_ids": "SELECT run_id AS id, count(*) AS n FROM catalog_runs WHERE run_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "c12_expectations": "SELECT id AS item_id, category, unnest(map_keys(expected_pass)) AS tier, unnest(map_values(expected_pass)) AS expected FROM calibration_items",
    "b60_violations": f"WITH {J}, {_TICKS} SELECT item_id, category, kind, detail, soft FROM viol",
    "e131_inversions": f"WITH {J}, {_TICKS} SELECT item_id, category, split_part(detail, '<', 1) AS weaker, split_part(detail, '<', 2) AS stronger FROM inv",
    "d114_group_summary": f"""WITH {J}, {_TICKS} SELECT category, any_value(n) AS items, count(kind) FILTER (WHERE NOT soft) AS violations FROM
        (SELECT category, count(*) AS n FROM calibration_items GROUP BY 1) c LEFT JOIN viol USING (category) GROUP BY 1""",
    "b58_key_status": f"""WITH {J}, v AS (SELECT item_id, count(*) AS votes, min(predicted) AS lo, max(predicted) AS hi FROM j GROUP BY 1)
      SELECT id AS item_id, coalesce(votes, 0) AS votes, CASE WHEN coalesce(votes, 0) < 2 THEN 'not_verified' WHEN coalesce(lo, 0) <> coalesce(hi, 0) THEN 'ambiguous'
        WHEN CASE WHEN lo = 1 THEN 'A' ELSE 'B' END <> upper(trim(gold)) THEN 'mislabeled' ELSE 'defensible' END AS status FROM calibration_items LEFT JOIN v ON id = item_id""",
    "d113_curated": f"""WITH {_SCREEN}, v AS (SELECT item_id, count(*) AS votes, min(coalesce(predicted, 0)) AS lo, max(coalesce(predicted, 0)) AS hi FROM j GROUP BY 1)
      SELECT item_id, CASE WHEN label <> 'kept' THEN label WHEN coalesce(votes, 0) < 2 THEN 'kept_not_verified' WHEN lo <> hi THEN 'ambiguous'
        WHEN CASE WHEN lo = 1 THEN 'A' ELSE 'B' END <> upper(trim(gold)) THEN 'mislabeled' ELSE 'kept' END AS outcome
      FROM screened LEFT JOIN v USING (item_id) LEFT JOIN calibration_items ON id = item_id""",
    "e134_split": """WITH h AS (SELECT id, row_number() OVER (ORDER BY sha256('round one' || chr(0) || id), id) - 1 AS place, count(*) OVER () AS n FROM calibration_items)
      SELECT id, place, CASE WHEN place < n * 0.6 THEN 'calibration' WHEN place < n * 0.8 THEN 'dev' WHEN place < n * 0.9 THEN 'validation' ELSE 'private_test' END AS part FROM h""",
    "a5_usable_labels": f"WITH {_LAB} SELECT campaign_id, item_id, who, tier, pred FROM u",
    "a5_item_agreement": f"WITH {_LAB} SELECT campaign_id, item_id, votes, {R('agreement')} AS agreement, agreement < 0.67 AS disputed FROM ia",
    "d93_campaign_report": f"""WITH {_REP} SELECT campaign_id, annotators, items, {R('alpha')} AS alpha, {R('CASE WHEN alpha < 0.667 AND eps > 0.1 THEN 0.1 ELSE eps END')} AS epsilon, disputed,
        annotators >= 3 AND items >= 30 AS enough FROM w2 JOIN i2 USING (campaign_id) LEFT JOIN al USING (campaign_id)""",
    "h165_read_pairs": r"""WITH s AS (SELECT *, CASE WHEN upper(gold) IN ('A', 'B') THEN nullif(regexp_extract(raw, '(?:^|[^\p{L}\p{N}\p{M}_])([AB])(?:$|[^\p{L}\p{N}\p{M}_])', 1), '') ELSE nullif(upper(regexp_extract(raw, '(?i)\b(PASS|FAIL)\b', 1)), '') END AS said FROM screening_pairs)
      SELECT pair_id, said, CASE WHEN said IN ('PASS', 'A') THEN 1 ELSE 0 END AS number, said = gold AS "right", regexp_replace(spec, '@[^@]*$', '') AS model,
        nullif(trim(regexp_extract(spec, '@([^@]*)$', 1)), '') AS family,
        regexp_replace(regexp_replace(CASE WHEN starts_with(lower(trim(spec)), 'router:') THEN substr(lower(trim(spec)), 8) ELSE lower(trim(coalesce(spec, ''))) END, '(:free|:nitro|:floor|:extended|:thinking|:online|:beta)$', ''), '-\d{8}\b', '', 'g') AS routed,
        NOT regexp_matches(spec, '[0-9]') AS alias FROM s""",
    "d115_majority": f"""WITH {J}, c AS (SELECT item_id, predicted, count(*) AS n, min(seq) AS f FROM j WHERE predicted IS NOT NULL GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) AS r FROM c) SELECT item_id, predicted, n FROM k WHERE r = 1""",
    "d115_median": f"WITH {J} SELECT item_id, {R('quantile_cont(confidence, 0.5)')} AS median FROM j WHERE confidence IS NOT NULL GROUP BY 1",
    "d115_weighted_mean": f"WITH {J} SELECT item_id, {R('sum(confidence * coalesce(difficulty, 1.0)) / sum(coalesce(difficulty, 1.0))')} AS mean FROM j WHERE confidence IS NOT NULL GROUP BY 1",
    "d116_strict_majority": f"WITH {J} SELECT item_id, coalesce(count_if(correct) * 2 > count(correct), false) AS novel FROM j GROUP BY 1",
    "d118_histogram": f"WITH {J} SELECT item_id, predicted, count(*) AS n FROM j GROUP BY 1, 2",
    "b57_veto": f"WITH {J} SELECT item_id, coalesce(bool_or(predicted = 0 AND coalesce(confidence >= 0.99, true)), false) AS vetoed FROM j GROUP BY 1",
    "h161_models": r"""SELECT DISTINCT model, regexp_replace(replace(trim(coalesce(model, '')), ':latest', ''), '(-cloud|:cloud)$', '') AS local,
      regexp_replace(regexp_replace(lower(trim(coalesce(model, ''))), '(:free|:nitro|:floor|:extended|:thinking|:online|:beta)$', ''), '-\d{8}\b', '', 'g') AS routed, NOT regexp_matches(model, '[0-9]') AS alias FROM attempts""",
}
