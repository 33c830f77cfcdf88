from tallymill.operators import dedup

SCHEMA = "seq BIGINT, puzzle_content_hash STRING, model_id STRING, started_at STRING, nonce STRING, Key_0 STRING"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], SCHEMA)


SAME = [
    (3, "AB", "m-1", "2025-01-01T10:00:00Z", "n1"),
    (1, " ab\n", "M-1", "2025-01-01T12:00:00+02:00", "N1 "),
    (2, "ab", "m-1", "2025-01-01 11:00:00.000+0100", "\tn1"),
    (4, "ab", "m-1", "2025-01-01T10:00:01Z", "n1"),
    (5, "ab", "m-1", "2025-01-01T10:00:00.000001Z", "n1"),
]


def test_spellings_of_one_record(spark):
    got = {tuple(r) for r in dedup.surplus(rows(spark, SAME)).collect()}
    assert got == {(1, 2), (1, 3)}
    assert sorted(r.seq for r in dedup.exactly_once(rows(spark, SAME)).collect()) == [1, 4, 5]


def test_columns_stay_as_they_are(spark):
    df = rows(spark, SAME)
    assert dedup.exactly_once(df).columns == df.columns


def test_nulls_match_nothing(spark):
    df = rows(spark, [(1, None, "m", "2025-01-01T00:00:00Z", "n"), (2, None, "m", "2025-01-01T00:00:00Z", "n"), (None, "a", "m", "2025-01-01T00:00:00Z", "n")])
    assert dedup.surplus(df).count() == 0
    assert dedup.exactly_once(df).count() == 3


def test_unreadable_time_is_compared_as_text(spark):
    df = rows(spark, [(1, "a", "m", "soon", "n"), (2, "a", "m", " SOON", "n"), (3, "a", "m", "later", "n")])
    assert [tuple(r) for r in dedup.surplus(df).collect()] == [(1, 2)]


def test_equal_rows_ties_and_empty(spark):
    df = rows(spark, [(7, "a", "m", "2025-01-01T00:00:00Z", "n")] * 3)
    assert dedup.exactly_once(df).count() == 1
    assert dedup.surplus(df).count() == 0
    assert dedup.surplus(df.limit(0)).count() == 0 and dedup.exactly_once(df.limit(0)).count() == 0


def test_hot_record_is_salted(spark):
    df = spark.range(5000).selectExpr("id AS seq", "'h' AS puzzle_content_hash", "'m' AS model_id", "'2025-01-01T00:00:00Z' AS started_at",
                                      "IF(id % 2 = 0, 'hot', CAST(id AS STRING)) AS nonce")
    import tallymill.skew as skew

    kept, skew_rows = dedup.surplus(df), None
    assert kept.count() == 2499 and kept.agg({"kept_seq": "max"}).first()[0] == 0
    facts = df.groupBy("nonce").agg({"seq": "min", "*": "count"}).toDF("nonce", "first", "n")
    spread = skew.spread_join(df, facts, ["nonce"], "n", df["seq"], hot_rows=100, max_hot=2, salts=8)
    assert spread.count() == 5000 and skew_rows is None


def test_new_batch_against_stored(spark):
    stored = rows(spark, SAME[:1])
    batch = rows(spark, [*SAME, (9, "zz", "m", "2025-01-01T00:00:00Z", "n"), (8, "ZZ", "m", "2025-01-01T00:00:00Z", "n")])
    assert sorted(r.seq for r in dedup.accept_batch(stored, batch).collect()) == [4, 5, 8]
