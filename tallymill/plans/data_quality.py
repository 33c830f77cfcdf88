"""Queries and their SQL for redelivered and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import dedup, nested
from tallymill.session import table

_BLANK = r"^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$"


def _fold(column: str) -> str:
    return f"lower(regexp_replace({column}, '{_BLANK}', '', 'g'))"


_KEYS = f"""
    {_fold('puzzle_content_hash')} AS kh, {_fold('model_id')} AS km, {_fold('nonce')} AS kn,
    epoch_us(CAST(replace(substr(s, 1, 19), 'T', ' ') AS TIMESTAMP))
      + CAST(rpad(coalesce(nullif(regexp_extract(s, '\\.([0-9]{{1,6}})', 1), ''), '0'), 6, '0') AS BIGINT)
      - CASE WHEN regexp_matches(substr(s, 20), '[+-][0-9]{{2}}:?[0-9]{{2}}$')
             THEN (CASE WHEN regexp_extract(s, '([+-])[0-9]{{2}}:?[0-9]{{2}}$', 1) = '-' THEN -1 ELSE 1 END)
                * (CAST(regexp_extract(s, '[+-]([0-9]{{2}}):?[0-9]{{2}}$', 1) AS BIGINT) * 3600
                 + CAST(regexp_extract(s, '[+-][0-9]{{2}}:?([0-9]{{2}})$', 1) AS BIGINT) * 60) * 1000000
             ELSE 0 END AS kt"""

_DELIVERED = f"""
  WITH a AS (SELECT *, upper(regexp_replace(started_at, '{_BLANK}', '', 'g')) AS s FROM catalog_runs),
  k AS (SELECT *, {_KEYS} FROM a),
  g AS (SELECT *, min(seq) OVER (PARTITION BY kh, km, kn, kt) AS kept FROM k)
"""
#: SQL of the runs of the log, each once, as catalog.runs has them.
RUNS = f"""ra AS (SELECT *, upper(regexp_replace(started_at, '{_BLANK}', '', 'g')) AS s FROM catalog_runs WHERE kind = 'run'),
  rk AS (SELECT *, {_KEYS} FROM ra),
  rw AS (SELECT * EXCLUDE (s, kh, km, kn, kt), min(seq) OVER (PARTITION BY kh, km, kn, kt) AS kept,
      kh IS NOT NULL AND km IS NOT NULL AND kn IS NOT NULL AND s IS NOT NULL AS whole FROM rk),
  rn AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS nth FROM rw WHERE NOT whole),
  r AS (SELECT * EXCLUDE (whole, kept) FROM rw WHERE whole AND seq = kept
    UNION ALL SELECT * EXCLUDE (whole, kept, nth) FROM rn WHERE run_id IS NULL OR nth = 1)"""

QUERIES = {
    "p1_found": lambda spark, d: dedup.surplus(table(spark, d, "catalog_runs")),
    "p1_once": lambda spark, d: dedup.exactly_once(table(spark, d, "catalog_runs")).select(
        "seq", "puzzle_id", "model_id", "nonce", "n", "successes"
    ),
    "p1_batches": lambda spark, d: _batches(table(spark, d, "catalog_runs")),
    "p2_found": lambda spark, d: nested.child_cases(nested.flatten_reports(table(spark, d, "raw_reports"))),
    "p2_tables": lambda spark, d: nested.flatten_reports(table(spark, d, "raw_reports")).drop("members"),
    "p2_schema": lambda spark, d: nested.infer_schema(table(spark, d, "raw_reports")).withColumn(
        "types", F.array_join("types", "|")
    ),
}


def _batches(runs):
    """What the batches of the log's second half add to its first half."""
    number = F.substring(F.trim(F.col("batch_id")), -6, 6).try_cast("int")
    first = F.coalesce(number % 2 == 0, F.lit(False))  # a batch without a number comes with the second half
    return dedup.accept_batch(runs.where(first), runs.where(~first)).select("seq", "batch_id", "nonce")


SQL = {
    "p1_found": _DELIVERED + "SELECT kept AS kept_seq, seq AS dup_seq FROM g WHERE seq <> kept",
    "p1_once": _DELIVERED + "SELECT seq, puzzle_id, model_id, nonce, n, successes FROM g WHERE seq = kept",
    "p1_batches": _DELIVERED
    + """SELECT min(seq) AS seq, arg_min(batch_id, seq) AS batch_id, arg_min(nonce, seq) AS nonce FROM k GROUP BY kh, km, kn, kt
         HAVING bool_and(coalesce(TRY_CAST(right(trim(batch_id), 6) AS INT) % 2 <> 0, true))""",
}
