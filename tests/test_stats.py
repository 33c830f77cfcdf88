import math

import pytest
from pyspark.sql import functions as F

from tallymill.functions import exact, ids, stats, text
from tallymill.operators import items


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_intervals(spark):
    lower, upper = one(spark, *stats.wilson(F.lit(5), F.lit(20)))
    assert (lower, upper) == pytest.approx((0.1118617014, 0.4687008776), abs=1e-9)
    assert one(spark, *stats.wilson(F.lit(0), F.lit(0))) == (0.0, 1.0)
    assert one(spark, *stats.wilson(F.lit(0), F.lit(20)))[1] == pytest.approx(0.1611251581, abs=1e-9)
    low, high, d = one(spark, *stats.newcombe(F.lit(3), F.lit(20), F.lit(15), F.lit(20)))
    assert (low, high, d) == pytest.approx((-0.7691568837, -0.2965100125, -0.6), abs=1e-9)
    with pytest.raises(Exception, match="BAD_COUNTS"):
        one(spark, *stats.wilson_strict(F.lit(3), F.lit(0)))


def test_band_and_powers(spark):
    got = one(spark, stats.graduates(F.lit(5), F.lit(20)), stats.graduates(F.lit(0), F.lit(20)), stats.graduates(F.lit(20), F.lit(20)), stats.pass_hat_k(F.lit(1), F.lit(2), 3), stats.pass_hat_k(F.lit(0), F.lit(0), 3))
    assert got == (True, False, False, 0.125, 0.0)


def test_e_values(spark):
    e = [one(spark, stats.guarded_exp(k * stats.log_e(F.lit(20), F.lit(20), 0.9, 0.97)))[0] for k in (1, 2, 3, 600)]
    assert e[:3] == pytest.approx([4.472852, 20.006402, 89.485669], abs=1e-5) and e[3] == math.inf


def test_exact_tests():
    assert exact.fisher(3, 20, 15, 20) == pytest.approx(0.000328418715999, rel=1e-9)
    assert exact.mcnemar(0, 0) == 1.0 and exact.mcnemar(1, 9) == pytest.approx(22 / 1024)
    low, high = exact.clopper_pearson(0, 10)
    assert low == 0.0 and high == pytest.approx(1 - 0.025 ** 0.1, abs=1e-12)
    assert exact.t_pvalue(10, 0.5, 1.0, 0.0) == pytest.approx(0.0741, abs=2e-4)
    assert exact.t_pvalue(1, 0.5, 1.0, 0.0) == 1.0 and exact.t_pvalue(3, 0.5, 0.0, 0.0) == 0.0
    assert exact.conformal_coverage(10, 0.01) == (1.0, 1.0, 1.0)
    assert exact.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_udfs_keep_nulls(spark):
    df = spark.createDataFrame([(3.0, 20.0, 15.0, 20.0), (None, 20.0, 1.0, 2.0)], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    got = [r.p for r in df.select(exact.fisher_p("a", "b", "c", "d").alias("p")).collect()]
    assert got[0] == pytest.approx(0.000328418715999) and got[1] is None


def test_temperature_finds_the_scale():
    import numpy as np

    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 20000)
    right = rng.random(20000) < 1 / (1 + np.exp(-z / 2))
    assert exact.fit_temperature(1 / (1 + np.exp(-z)), right) == pytest.approx(2.0, abs=0.15)
    assert exact.fit_temperature(np.array([0.9, 0.8]), np.array([1.0, 1.0])) == 1.0


def test_reading_output(spark):
    df = spark.createDataFrame([
        ("I say fail, then PASS", "x", "FAIL"), ("a B and A", "A", "B"), ("是A。 then B", "b", "B"), ("nothing", "A", None), (None, "A", None)], "t STRING, g STRING, want STRING")
    assert all(r.got == r.want for r in df.withColumn("got", text.choice(F.col("t"), F.col("g"))).collect())
    t = F.lit("<|start|>assistant<|channel|>analysis<|message|>hm<|end|><|channel|>final<|message|> B <|return|>")
    assert one(spark, text.without_control(t), text.without_control(F.lit(" as it is ")), text.without_control(F.lit("<|start|>a<|message|>x<|end|>"))) == ("B", " as it is ", "x")
    assert one(spark, text.local_model(F.lit("glm-5:cloud")), text.routed_model(F.lit("openrouter:cohere/north-20260617:free")), text.spec_family(F.lit("a@b@c")), text.spec_model(F.lit("a@b@c"))) == ("glm-5", "cohere/north", "c", "a@b")
    assert one(spark, text.family_mismatch(F.lit("google"), F.lit("qwen")), text.family_mismatch(F.lit("new"), F.lit("qwen"))) == (True, False)
    logp = lambda s: text.first_logprob(F.lit(s))
    assert one(spark, logp('{"logprobs": [{"logprob": -0.5}]}'), logp('{"message": {"logprobs": [{"logprob": true}]}}'), logp('{"choices": [{"logprobs": {"content": [{"logprob": -2}]}}]}')) == (-0.5, None, -2.0)
    calls = text.tool_calls(F.lit('{"message": {"tool_calls": [{"function": {"name": "exec", "arguments": "{\\"command\\": \\"ls\\"}"}}, {"function": {"arguments": {}}}]}}'))
    assert [tuple(c) for c in one(spark, calls)[0]] == [("exec", '{"command": "ls"}')]
    act = one(spark, text.action(F.lit("thinking\nACTION write_file a.txt ::: hi ::: there\nFINAL 7")), text.action(F.lit("final 7<|end|>")), text.action(F.lit("no")))
    assert tuple(act[0]) == ("write_file", "a.txt", "hi ::: there") and tuple(act[1])[:2] == ("FINAL", "7") and act[2] is None


def test_ids(spark):
    import hashlib

    want = hashlib.sha256(b"a\x00b\x00x,y").hexdigest()[:16]
    assert one(spark, ids.stable_id(F.lit("a"), F.lit("b"), ids.listed(F.array(F.lit("y"), F.lit("x")))))[0] == want
    df = spark.createDataFrame([('{"b": 1, "a": null}',), ("no",), (None,), ('{"a": NaN}',)], "t STRING")
    assert [r.c for r in df.select(ids.canonical_json("t").alias("c")).collect()] == ['{"a":null,"b":1}', None, None, None]
    df = spark.createDataFrame([(v,) for v in ("2026.06", "v01", "v1.", " ", "x", "2026.09", "v1.9", "r99", "n" + "9" * 40)], "v STRING")
    assert [r[0] for r in df.select(ids.next_version(F.col("v"))).collect()] == ["2026.07", "v02", "v1.+1", "v1", "x+1", "2026.10", "v1.10", "r100", "n" + "9" * 40 + "+1"]
    whole = hashlib.sha256(b'{"judge_prompts":{"a":"p"},"thresholds":{},"weights":{"x":1,"y":2.5}}').hexdigest()
    assert one(spark, ids.bundle_hash(F.lit('{"y": 2.5, "x": 1}'), F.lit("{}"), F.lit('{"a": "p"}')))[0] == whole


def test_sensitivity_and_powers():
    got = items.sobol_total(lambda x: 3 * x[0] + 0 * x[1], {"a": (0, 1), "b": (0, 1)}, 1000)
    assert got["a"] == pytest.approx(1, abs=0.1) and got["b"] == 0
    assert [items.nearest_power_of_two(n) for n in (1, 3, 5, 6, 7, 1000)] == [1, 2, 4, 4, 8, 1024]
    with pytest.raises(ValueError):
        items.sobol_total(lambda x: x[0] * float("nan"), {"a": (0, 1)})
