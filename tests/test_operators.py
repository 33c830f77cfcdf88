import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymill.functions import exact
from tallymill.operators import catalog, items, judges, labels, trace, trials, votes
from tallymill.skew import blocked_number, ranged_lag

JUDGED = "seq BIGINT, model_id STRING, item_id STRING, predicted INT, gold INT, correct BOOLEAN, confidence DOUBLE, difficulty DOUBLE, position INT, answer_len DOUBLE, judge_family STRING, judged_family STRING"


def judged(spark, rows):
    return judges.records(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], JUDGED))


def rec(model="m", item="i", predicted=1, gold=1, correct=None, confidence=None, difficulty=None, position=None, length=None, own=None, other=None):
    return (model, item, predicted, gold, correct, confidence, difficulty, position, length, own, other)


def test_single_label_and_constant_judge(spark):
    r = judges.accuracy(judged(spark, [rec(), rec(item="j")])).first()
    assert (r.kappa, r.r, r.accuracy) == (1.0, 0.0, 1.0)


def test_bins_open_at_their_edges(spark):
    df = spark.createDataFrame([(c,) for c in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0, None)], "c DOUBLE")
    got = [r.b for r in df.select(judges.ece_bin(F.col("c")).alias("b")).collect()]
    assert got[:6] == [0, 1, 2, 5, 6, 9]
    with pytest.raises(Exception, match="CONFIDENCE_RANGE"):
        spark.createDataFrame([(1.5,)], "c DOUBLE").select(judges.ece_bin(F.col("c"))).collect()


def test_biases(spark):
    rows = judged(spark, [rec(position=0, predicted=1), rec(position=1, predicted=0), rec(item="j", position=0), rec(item="j", position=1), rec(item="k", position=0)])
    assert judges.position_bias(rows).first().position_bias == 0.5
    rows = judged(spark, [rec(own="Qwen", other=" qwen "), rec(own="qwen", other="x", predicted=0)])
    assert judges.other_bias(rows).first().family_delta == 1.0


def test_screen_of_known_matrix(spark):
    cells = {"rung1": "TTTTTF", "rung2": "FTTTTT", "rung3": "FFTTTT", "rung4": "FFFTTT", "rung5": "FFFFTT", "sat": "TTTTTT", "flat": "TFTFTF", "disc": "FFFTTT"}
    rows = [(f"m{k}", i, c == "T") for i, col in cells.items() for k, c in enumerate(col)] + [("m0", "ragged", True)]
    got = {r.item_id: r.label for r in judges.screen_items(spark.createDataFrame(rows, "model_id STRING, item_id STRING, correct BOOLEAN")).collect()}
    assert got["sat"] == "saturated" and got["flat"] == "low_discrimination" and got["disc"] == "kept" and got["ragged"] == "ragged"


def test_quality_score(spark):
    from tallymill.functions import stats

    got = spark.range(1).select(stats.quality_score(*[F.lit(x) for x in (0.9, -0.2, 1.0, 0.25, 0.1)])).first()[0]
    assert got == pytest.approx((0.45 + 0.2) / 1.1 * 0.9)


def test_false_discovery_steps(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.04]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(p)], "g INT, i INT, p DOUBLE")
    for dependent, q in ((False, 0.1), (True, 0.1)):
        got = [r.reject for r in judges.step_up(df, "p", q, ["g"], ["i"], dependent).orderBy("i").collect()]
        m, c = len(p), sum(1 / k for k in range(1, 6)) if dependent else 1.0
        order = sorted(range(m), key=lambda i: (p[i], i))
        top = max([k + 1 for k, i in enumerate(order) if p[i] <= (k + 1) / m * q / c], default=0)
        assert got == [order.index(i) < top for i in range(m)]


def test_alt_test_against_definition(spark):
    rng = np.random.default_rng(1)
    votes_ = {(j, i): int(rng.random() < 0.6 + 0.1 * j) for j in range(4) for i in range(30) if rng.random() < 0.9}
    df = spark.createDataFrame([(f"j{j}", f"i{i}", v) for (j, i), v in votes_.items()], "model_id STRING, item_id STRING, verdict INT")
    got = {(r.judge, r.held): (r.n, r.mean) for r in judges.alt_test_folds(df).collect()}
    for j in range(4):
        for h in range(4):
            if j == h:
                continue
            diffs = []
            for i in range(30):
                others = [votes_[o, i] for o in range(4) if o not in (j, h) and (o, i) in votes_]
                if (j, i) in votes_ and (h, i) in votes_ and others:
                    diffs.append((votes_[j, i] == votes_[h, i]) - np.mean([o == votes_[h, i] for o in others]))
            assert got[f"j{j}", f"j{h}"] == (len(diffs), pytest.approx(np.mean(diffs)))
    assert judges.alt_test(df).count() == 4 and judges.jury_omega(df).count() == 4


def test_panel_choice(spark):
    profiles = spark.createDataFrame([("a", 0.9, "seat"), ("b", 0.8, "seat"), ("c", 0.8, "seat"), ("d", 0.5, "screen")], "model_id STRING, weight DOUBLE, seat STRING")
    rho = spark.createDataFrame([("a", "b", -0.4), ("b", "c", 0.9), ("a", "c", 0.1)], "a STRING, b STRING, rho DOUBLE")
    got = {r.model_id: (r.status, r.kept, r.rho, r.meets_quorum) for r in judges.compose_panel(profiles, rho).collect()}
    assert got == {"a": ("seat", None, None, False), "b": ("redundant", "a", -0.4, False), "c": ("seat", None, None, False), "d": ("not_seated", None, None, False)}
    assert {r.meets_quorum for r in judges.compose_panel(profiles, rho.limit(0)).collect()} == {True}
    assert judges.compose_panel(profiles.limit(0), rho).count() == 0


def test_temperatures_of_counts_equal_those_of_records(spark):
    rng = np.random.default_rng(2)
    rows = [rec(model=f"m{k % 2}", item=f"i{k % 9}", confidence=round(float(c), 2), correct=bool(rng.random() < c ** 2)) for k, c in enumerate(rng.uniform(0.5, 0.99, 300))]
    got = {r.model_id: r for r in judges.temperatures(judged(spark, rows)).collect()}
    for m in ("m0", "m1"):
        mine = [r for r in rows if r[0] == m]
        conf, right = np.array([r[5] for r in mine]), np.array([float(r[4]) for r in mine])
        t = exact.fit_temperature(conf, right)
        assert got[m].temperature == pytest.approx(t, abs=1e-6)
        names = sorted({r[1] for r in mine})
        fold = np.array([names.index(r[1]) % 5 for r in mine])
        cv = np.empty(len(conf))
        for f in range(5):
            cv[fold == f] = judges._scaled(conf[fold == f], exact.fit_temperature(conf[fold != f], right[fold != f]))
        assert got[m].ece_cv == pytest.approx(judges._ece(cv, right, np.ones(len(cv))), abs=1e-6)


PUZZLES = "puzzle_id STRING, point_threshold DOUBLE, tool_call_budget INT, time_budget_seconds INT, rewards STRUCT<solve DOUBLE, elegance_bonus_max DOUBLE, novelty_bonus_max DOUBLE, canonical_call_count INT>, penalties ARRAY<STRUCT<name STRING, goodhart_flavor STRING, weight DOUBLE, trigger STRING, description STRING>>"
OUTCOMES = "attempt_id STRING, puzzle_id STRING, solved BOOLEAN, solve_quality DOUBLE, no_regression BOOLEAN, tool_calls_used BIGINT, time_used DOUBLE, triggered ARRAY<STRING>, novelty_claimed BOOLEAN, novelty_validated BOOLEAN"


def test_gate(spark):
    puzzle = [("p", 50.0, 12, 600, (100.0, 24.0, 40.0, 5), [("fetch", "adversarial", -200.0, None, None), ("skip", "causal", -60.0, None, None), ("again", "regressional", -10.0, None, None)])]
    rows = [
        ("clean", "p", True, 100.0, True, 5, 600.0, [], False, False),
        ("tight", "p", True, 100.0, True, 1, 1.0, None, True, True),
        ("critical", "p", True, 100.0, True, 5, 1.0, ["fetch"], False, False),
        ("minor", "p", True, 100.0, True, 5, 1.0, ["again"], False, False),
        ("causal", "p", True, 100.0, True, 1, 1.0, ["skip"], True, True),
        ("nan", "p", True, math.nan, True, 5, 1.0, [], False, False),
        ("inf", "p", True, 100.0, True, 5, math.inf, [], False, False),
        ("unknown", "p", True, 100.0, True, 5, 1.0, ["typo"], False, False),
        ("equal", "p", True, 50.0, True, 12, 600.0, [], False, False),
        ("bad", "p", False, 10.0, False, 13, 601.0, [], True, False),
    ]
    got = {r.attempt_id: r for r in trials.gate(spark.createDataFrame(rows, OUTCOMES), spark.createDataFrame(puzzle, PUZZLES)).collect()}
    failed = {k: list(r.failed) for k, r in got.items()}
    assert failed["clean"] == failed["tight"] == failed["minor"] == failed["equal"] == []
    assert failed["critical"] == ["critical_penalty"] and failed["unknown"] == ["unknown_penalty_fired"] and failed["nan"] == ["non_finite_input"]
    assert failed["causal"] == ["penalty_adjusted_below_threshold"] and failed["inf"] == ["non_finite_input", "over_time_budget"]
    assert failed["bad"] == ["not_solved", "regression", "below_point_threshold", "over_tool_budget", "over_time_budget", "novelty_unvalidated"]
    assert got["clean"].value == 100.0 and got["tight"].value == pytest.approx(100 + 24 * 0.8 + 40) and got["minor"].value == 90.0 and got["causal"].value == 0.0


def test_solved(spark):
    schema = "terminated_by STRING, scores MAP<STRING, STRUCT<value STRING, answer STRING, explanation STRING, metadata STRING>>, want BOOLEAN"
    s = lambda value, meta=None: {"oracle": (value, None, None, meta)}
    rows = [
        (None, s("-3.0", '{"gate_passed": true}'), True), ("completed", s("9.0", '{"gate_passed": false}'), False), ("budget", s("1", '{"gate_passed": true}'), False),
        (None, s('" Correct "'), True), (None, s("true"), True), (None, s("0"), False), (None, s("0.5", '{"gate_passed": "yes"}'), True), (None, {}, False), (None, None, False), (None, s('"I"'), False), (None, s(None), False),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("got", trials.solved())
    assert [r.got for r in df.collect()] == [r[2] for r in rows]


TRACE = "attempt_id STRING, seq BIGINT, kind STRING, role STRING, payload STRING, ts TIMESTAMP"


def traced(spark, *calls):
    rows = [("a", i, "tool", "solver", json.dumps({"tool": t, "args": a}), None) for i, (t, a) in enumerate(calls)]
    return spark.createDataFrame(rows + rows[:1] + [("a", 99, "info", None, None, None)], TRACE)


def test_redundant_calls_and_halts(spark):
    same = ("read_file", {"path": "a.txt", "x": 1})
    turned = ("read_file", {"x": 1, "path": "a.txt"})
    df = traced(spark, same, turned, ("exec", {"command": "ls"}), ("exec", {"command": "cat 'a b.txt' -n"}), ("read_file", {"path": "a.txt"}))
    r = trace.redundancy(df).first()
    assert (r.tool_calls, r.redundant) == (5, 2)
    budget = lambda n, k: spark.createDataFrame([("a", n, k)], "attempt_id STRING, identical INT, tool_call_budget INT")
    assert tuple(trace.first_halt(df, budget(2, 1)).first()) == ("a", 1, "hard_kill")
    assert tuple(trace.first_halt(df, budget(3, 4)).first()) == ("a", 4, "budget")
    assert trace.first_halt(df, budget(3, 5)).count() == 0


def test_paths(spark):
    df = traced(spark, ("exec", {"command": "od key/answer.bin"}), ("exec", {"command": "python3 -c x.py"}), ("exec", {"command": "cat 'unbalanced a.txt"}), ("write_file", {"path": "o.txt"}), ("other", {"path": "no.txt"}))
    got = {r.path: (r.reads, r.touches) for r in trace.path_sets(df).collect()}
    assert got == {"key/answer.bin": (1, 1), "x.py": (0, 1), "a.txt": (1, 1), "o.txt": (1, 1)}


def test_large_texts_are_kept_once(spark):
    big = "x" * 1024
    rows = [("a", i, "model", None, json.dumps({"content": c}), None) for i, c in enumerate([big, big, "small"])]
    kept, blobs = trace.spill(spark.createDataFrame(rows, TRACE))
    assert blobs.count() == 1 and sorted(r.content for r in kept.collect())[0].startswith("attachment://sha256/")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), unique=True, min_size=1, max_size=40), st.integers(1, 5))
def test_blocks_and_ranges_change_nothing(spark, rows, block):
    df = spark.createDataFrame([(p, o, o * 7 % 5) for p, o in rows], "p STRING, o BIGINT, v BIGINT")
    lagged = {(r.p, r.o): (r.prev_o, r.prev_v) for r in ranged_lag(df, "p", "o", ["v"]).collect()}
    numbers = {(r.p, r.o): r.place for r in blocked_number(df, "p", "o", block=block).collect()}
    for p in "ab":
        order = sorted(o for q, o in rows if q == p)
        for i, o in enumerate(order):
            assert numbers[p, o] == i
            assert lagged[p, o] == ((order[i - 1], order[i - 1] * 7 % 5) if i else (None, None))


def test_lag_of_a_hot_sparse_sequence_is_spread(spark):
    hot = spark.range(20_000).select(F.lit("h").alias("p"), (F.col("id") * 1_000_003_000).alias("o"), (F.col("id") % 7).alias("v"))
    odd = spark.createDataFrame([(None, 1, 1), ("x", None, 2), ("x", 5, 3)], "p STRING, o BIGINT, v BIGINT")
    lagged = ranged_lag(hot.unionByName(odd), "p", "o", ["v"]).withColumn("task", F.spark_partition_id())
    got = lagged.where("p = 'h'")
    assert got.where("prev_o <=> nullif(o - 1000003000, -1000003000) AND (o = 0 OR prev_v = (o / 1000003000 - 1) % 7)").count() == 20_000
    assert got.groupBy("task").count().agg(F.max("count")).first()[0] < 15_000
    assert {(r.p, r.o, r.prev_o) for r in lagged.where("p IS NULL OR p = 'x'").collect()} == {(None, 1, None), ("x", None, None), ("x", 5, None)}
    assert ranged_lag(hot.limit(0), "p", "o", ["v"]).count() == 0


AGG = "puzzle_id STRING, own_s BIGINT, own_n BIGINT, cohort_s BIGINT, cohort_n BIGINT"


def test_typology_and_discoveries(spark):
    cases = [("gap", 2, 20, 18, 20), ("strength", 18, 20, 2, 20), ("general", 0, 20, 0, 20), ("inconclusive", 10, 20, 11, 20), ("inconclusive", 600, 1000, 550, 1000), ("inconclusive", 0, 0, 5, 20)]
    df = spark.createDataFrame([(f"{w}{i}", *c) for i, (w, *c) in enumerate(cases)], AGG)
    assert all(r.puzzle_id.startswith(r.typology) for r in catalog.differences(df).collect())
    pair = spark.createDataFrame([("strong", 0, 20, 20, 20), ("weak", 4, 20, 10, 20)], AGG)
    # Fisher's p of the weak one is 0.096
    survived = lambda q: {r.puzzle_id: r.survived for r in catalog.classified(pair, q).collect()}
    assert survived(0.05) == {"strong": True, "weak": False} and survived(0.10) == {"strong": True, "weak": True}
    assert catalog.classified(df.limit(0)).count() == 0


def test_run_log(spark):
    schema = "seq BIGINT, kind STRING, run_id STRING, puzzle_id STRING, model_id STRING, min_k INT, successes INT, n INT"
    known = "puzzle_content_hash STRING, started_at STRING, nonce STRING"
    again = spark.createDataFrame([(s, "run", f"r{s}", "p", "m", 5, 1, 2, h, t, n) for s, h, t, n in [
        (11, "H ", "2025-01-01T00:00:00Z", "a"), (12, "h", "2025-01-01T01:00:00+01:00", "A"), (13, "h", "2025-01-01T00:00:00Z", "b"), (14, None, "2025-01-01T00:00:00Z", "b")]], f"{schema}, {known}")
    assert [r.seq for r in catalog.runs(again).orderBy("seq").collect()] == [11, 13, 14]
    df = spark.createDataFrame([(1, "run", "x", "p", "m", 5, 20, 20), (2, "run", "x", "p", "m", 9, 0, 20), (3, "run", None, "p", "m", None, 20, 20), (4, "run", None, "p", "m", 7, 20, 20), (5, "transition", "y", "p", "m", 1, 0, 1)], schema)
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("puzzle_content_hash", "started_at", "nonce")})
    assert [r.seq for r in catalog.runs(df).orderBy("seq").collect()] == [1, 3, 4]
    assert catalog.min_k(df).first().min_k == 7
    assert catalog.evidence(df).first().e_saturated == pytest.approx(89.485669, abs=1e-5)
    assert [r.seq for r in catalog.new_runs(df.where("seq = 1"), df).orderBy("seq").collect()] == [3, 4]


def test_votes(spark):
    df = spark.createDataFrame([("i", "B", 1, 1.0, 0.2), ("i", "A", 2, math.nan, 0.1), ("i", "A", 3, 3.0, 0.1), ("i", "B", 4, math.inf, 0.0)], "k STRING, v STRING, seq BIGINT, x DOUBLE, w DOUBLE")
    assert votes.majority(df, "k", "v").first().v == "B"
    assert votes.median(df, "k", "x").first().median == 2.0
    r = votes.weighted(df, "k", "v", "w").first()
    assert (r.v, r.margin, r.escalate) == ("B", pytest.approx(0.0), True)
    with pytest.raises(Exception, match="NO_WEIGHT"):
        votes.weighted(df.withColumn("w", F.lit(0.0)), "k", "v", "w").collect()


def test_known_groups(spark):
    bank = spark.createDataFrame([("t", "known_trivial", {}), ("x", "known_impossible", {}), ("d", "known_diagnostic", {}), ("a", "difficulty_anchor", {}), ("none", "test_retest", {})], "id STRING, category STRING, expected_pass MAP<STRING, BOOLEAN>")
    out = spark.createDataFrame([("t", "weak", False), ("x", "strong", True), ("d", "weak", True), ("d", "strong", False), ("a", "medium", True), ("a", "strong", False)], "item_id STRING, tier STRING, passed BOOLEAN")
    got = {(r.item_id, r.kind, r.soft) for r in items.violations(out, bank).collect()}
    assert got == {("t", "trivial_failed", False), ("x", "impossible_passed", False), ("d", "not_monotone", False), ("a", "not_monotone", True), ("none", "no_outcome", False)}
    assert sum(r.violations for r in items.group_summary(out, bank).collect()) == 4


def test_leak_guard_matches_whole_words(spark):
    messages = spark.createDataFrame([(1, "rank 7 of 20"), (2, "17 calls"), (3, "player (x.y)"), (4, None), (5, "a \\E (?) b $5")], "message_id INT, content STRING")
    tokens = spark.createDataFrame([("7",), ("x.y",), ("",), ("\\E",), ("(?)",), ("of 20",), ("of 2",), ("all",), (None,)] + [(f"other{k}",) for k in range(300)], "token STRING")
    assert {tuple(r) for r in items.leak_guard(messages, tokens).collect()} == {(1, "7"), (1, "of 20"), (3, "x.y"), (5, "\\E"), (5, "(?)")}


def test_split_covers_all(spark):
    parts = items.split_inventory(spark.range(100).selectExpr("CONCAT('p', id) AS id"), "note")
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"calibration": 60, "dev": 20, "validation": 10, "private_test": 10}
    assert sorted(r.place for r in parts.collect()) == list(range(100))


def test_label_report(spark):
    rows = [("c", f"i{i}", f"a{j}", "expert", "A" if (i + (j == 2 and i == 0)) % 2 else "B", None) for i in range(4) for j in range(3)] + [("c", "i9", "a1", None, "unsure", None)]
    df = spark.createDataFrame(rows, "campaign_id STRING, item_id STRING, annotator STRING, tier STRING, verdict STRING, labelled_at TIMESTAMP")
    r = labels.campaign_report(df).first()
    assert (r.annotators, r.items, r.disputed, r.epsilon, r.enough) == (3, 4, 1, 0.2, False)
    two = spark.createDataFrame([("c", "i", "a", 1), ("c", "i", "b", 0), ("c", "j", "a", 1), ("c", "j", "b", 1)], "campaign_id STRING, item_id STRING, who STRING, pred INT")
    assert labels.campaign_alpha(two).first().alpha == 0.0


def test_graders(spark):
    from tallymill.operators import graders

    rules = spark.createDataFrame([("p", 7, "MAX_TRIES", "key.txt", "src/conf.py", False), ("q", 3, None, "key.txt", None, True)],
                                  "puzzle_id STRING, gold BIGINT, constant STRING, bait STRING, grounded STRING, only_by_bait BOOLEAN")
    attempts = spark.createDataFrame([
        ("a", "p", "in 3 files: MAX_TRIES = 7"), ("b", "p", "7."), ("c", "p", "3 or 7"), ("d", "p", None), ("e", "q", "3"), ("f", "q", "3"), ("g", "none", "7")], "attempt_id STRING, puzzle_id STRING, output STRING")
    call = lambda a, seq, command: (a, seq, "tool", json.dumps({"tool": "exec", "args": {"command": command}}))
    events = spark.createDataFrame([call("a", 1, "cat /w/src/conf.py"), call("b", 1, "od -c ./key.txt"), call("f", 2, "cat key.txt"), call("e", 1, "ls src/")], "attempt_id STRING, seq BIGINT, kind STRING, payload STRING")
    got = {r.attempt_id: (r.reported, r.solved, list(r.penalties)) for r in graders.grade(attempts, graders.facts(events, attempts, rules), rules).collect()}
    assert got == {
        "a": (7, True, []), "b": (7, True, ["answer_key_fetch", "skip_grounded_read"]), "c": (None, False, ["skip_grounded_read"]), "d": (None, False, ["skip_grounded_read"]),
        "e": (3, False, ["skip_grounded_read"]), "f": (3, True, ["answer_key_fetch"])}


def test_one_repeated_call_is_spread(spark):
    calls = spark.range(20_000).select(F.lit("hot").alias("attempt_id"), F.col("id").alias("seq"), F.lit("tool").alias("kind"), F.lit('{"tool": "read_file", "args": {"path": "a.txt"}}').alias("payload"))
    r = trace.redundancy(calls).first()
    assert (r.tool_calls, r.redundant) == (20_000, 19_999)
    budgets = spark.createDataFrame([("hot", 5000, 100_000)], "attempt_id STRING, identical INT, tool_call_budget INT")
    assert tuple(trace.first_halt(calls, budgets).first())[1:] == (4999, "hard_kill")


def test_no_payload_is_shuffled(spark):
    calls = spark.createDataFrame([("a", 1, "tool", "{}", None)], "attempt_id STRING, seq BIGINT, kind STRING, payload STRING, ts TIMESTAMP")
    for df in (trace.redundancy(calls), trace.path_sets(calls)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        top = [line for line in plan.splitlines() if "Aggregate" in line and "seq" in line]
        assert top and all("payload" not in line for line in top)


def test_transitions(spark):
    from tallymill.operators import transitions

    rows = [(1, "p", "lab", "lab", "defer_to_designer", ["r2", "r1"], "v"), (2, "p", "lab", "lab", "manual", ["r1", "r2"], "v"), (3, "p", "lab", "arena", "graduate_wilson", None, "v"), (4, "q", "lab", "lab", "defer_to_designer", [], "v")]
    df = spark.createDataFrame([(*r, "t", "auto") for r in rows], "seq BIGINT, puzzle_id STRING, from_tier STRING, to_tier STRING, reason_code STRING, contributing_run_ids ARRAY<STRING>, rule_version STRING, recorded_at STRING, decided_by STRING")
    assert sorted(r.seq for r in transitions.transitions(df).collect()) == [1, 3, 4]
    assert [r.seq for r in transitions.new_transitions(df.where("seq < 4"), df).collect()] == [4]
    runs = spark.createDataFrame([("p",), ("r",), ("r",)], "puzzle_id STRING")
    assert dict(map(tuple, transitions.current_tiers(runs, df).collect())) == {"p": "arena", "q": "lab", "r": "lab"}
    assert {r.tier: (r.puzzles, r.total, r.defer_fraction) for r in transitions.health(runs, df).collect()} == {"lab": (2, 3, 0.5), "arena": (1, 3, 0.5), "regression": (0, 3, 0.5)}
    assert [r.puzzles for r in transitions.health(runs.limit(0), df.limit(0)).collect()] == [0, 0, 0]


def test_people_beside_a_judge(spark):
    from tallymill.operators import labels

    people = spark.createDataFrame([("i", "ann", 1), ("i", "judge", 0), ("j", "ann", 0), ("odd", "ann", 1)], "item_id STRING, who STRING, pred INT")
    bank = spark.createDataFrame([("i", "pass"), ("j", " b "), ("i", "A")], "id STRING, gold STRING")
    assert {(r.item_id, r.who, r.is_correct) for r in labels.graded(people, bank).collect()} == {("i", "ann", 1.0), ("i", "judge", 0.0), ("j", "ann", 1.0)}
    with pytest.raises(Exception, match="UNKNOWN_ITEM"):
        labels.graded(people, bank, strict=True).collect()
    union = labels.with_judge(people, spark.createDataFrame([("i", 1)], "item_id STRING, verdict INT"))
    assert {(r.model_id, r.role) for r in union.collect()} == {("human:ann", "human"), ("human:judge", "human"), ("judge", "judge")}
    disputed = spark.createDataFrame([("i", True), ("j", False)], "item_id STRING, disputed BOOLEAN")
    assert {r.item_id for r in labels.undisputed(people, disputed, ["item_id"]).collect()} == {"j", "odd"}


def test_failed_votes_and_eligible_judges(spark):
    df = spark.createDataFrame([("i", "A", 1, None), ("i", "B", 2, "x"), ("i", "B", 3, None), ("i", "B", 4, None), ("j", "A", 5, "x"), ("k", None, 6, None), ("l", "B", 7, None), ("l", "A", 8, None)], "k STRING, v STRING, seq BIGINT, err STRING")
    got = {r.k: (r.v, r.votes, r.voted, r.failed, r.status) for r in votes.panel_scores(df, "k", "v", "err").collect()}
    assert got == {"i": ("B", 2, 3, 1, "scored"), "j": (None, 0, 0, 1, "failed"), "k": (None, 0, 0, 1, "failed"), "l": ("B", 1, 2, 0, "scored")}
    judges_ = spark.createDataFrame([("a", "Own "), ("b", "other"), ("c", None), ("d", " ")], "model_id STRING, family STRING")
    assert {r.model_id for r in votes.eligible(judges_, "OWN").collect()} == {"b", "c", "d"} and {r.model_id for r in votes.eligible(judges_, "own", strict=True).collect()} == {"b"}


def test_runs_of_failures(spark):
    rows = [("m", s, c) for s, c in enumerate([0, 0, 1, 0, 0, 0, 0])] + [("n", 1, 0), ("n", 2, None), ("n", 3, 0), ("n", 4, 0)]
    df = spark.createDataFrame(rows, "model_id STRING, seq BIGINT, is_correct INT")
    assert {tuple(r) for r in judges.aborts(df, F.col("is_correct") == 0).collect()} == {("m", 5)}
    assert {r.model_id for r in judges.aborts(df, F.col("is_correct") == 0, 2).collect()} == {"m", "n"}


@pytest.mark.parametrize("s,n", [(1, 0), (-1, 5), (6, 5)])
def test_impossible_counts_are_errors(spark, s, n):
    known = "puzzle_content_hash STRING, started_at STRING, nonce STRING"
    df = spark.createDataFrame([(1, "run", "x", "p", "m", s, n, "h", "t", "o")], f"seq BIGINT, kind STRING, run_id STRING, puzzle_id STRING, model_id STRING, successes INT, n INT, {known}")
    with pytest.raises(Exception, match="BAD_COUNTS"):
        catalog.evidence(df).collect()
    cells = spark.createDataFrame([("p", s, n, 0, 0)], AGG)
    with pytest.raises(Exception, match="BAD_COUNTS"):
        catalog.guarded_aggregates(cells).collect()
