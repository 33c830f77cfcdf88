"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tallymill.llm import consensus, leaks, packing, pairs, reading, runs
from tallymill.session import table

QUERIES = {
    "p3_found": lambda spark, d: runs.repeats(table(spark, d, "trace_events")),
    "p3_collapsed": lambda spark, d: runs.collapse_runs(table(spark, d, "trace_events")),
    "p4_found": lambda spark, d: consensus.contested(table(spark, d, "human_labels")),
    "p4_annotators": lambda spark, d: consensus.consensus(table(spark, d, "human_labels"))[1],
    "p4_alpha": lambda spark, d: consensus.alpha(consensus.standing_votes(table(spark, d, "human_labels"))),
    "p7_found": lambda spark, d: leaks.leaked(table(spark, d, "documents"), table(spark, d, "calibration_items")),
    "p5_found": lambda spark, d: pairs.defects(table(spark, d, "screening_pairs")),
    "p8_found": lambda spark, d: reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_grades")),
    "p6_pack": lambda spark, d: packing.pack(packing.token_sizes(table(spark, d, "documents"))),
    "p6_fill": lambda spark, d: packing.fill_report(packing.pack(packing.token_sizes(table(spark, d, "documents")))),
}

_VOTES = r"""
  WITH v AS (SELECT campaign_id, item_id, lower(regexp_replace(annotator, '^\s+|\s+$', '', 'g')) AS who, labelled_at,
      CASE WHEN lower(regexp_replace(verdict, '[^A-Za-z]', '', 'g')) IN ('a', 'pass') THEN 1
           WHEN lower(regexp_replace(verdict, '[^A-Za-z]', '', 'g')) IN ('b', 'fail') THEN 0
           WHEN verdict IS NULL AND pred IN (0, 1) THEN pred ELSE -1 END AS vote
    FROM human_labels WHERE annotator IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, item_id, who ORDER BY labelled_at DESC NULLS LAST, vote DESC) AS k FROM v),
  i AS (SELECT campaign_id, item_id, sum(vote)::DOUBLE AS a, (count(*) - sum(vote))::DOUBLE AS b FROM r WHERE k = 1 AND vote >= 0
        GROUP BY 1, 2 HAVING count(*) >= 2),
  t AS (SELECT count(*) AS n_items, sum(2 * a * b / (a + b - 1)) AS apart, sum(a) AS ones, sum(b) AS zeros FROM i)
"""

SQL = {
    "p4_alpha": _VOTES + "SELECT n_items, CASE WHEN ones * zeros = 0 THEN 1.0 ELSE 1 - (ones + zeros - 1) * apart / (2 * ones * zeros) END AS alpha FROM t",
}
