"""Quality of judges from their judgments: accuracy, agreement, calibration, bias, correlation of errors.

Judgments are one row per (model, item, run, position). A record delivered again has the same seq and
counts once. Everything is a sum over records, items or shared items, so hot models and items are
combined before any shuffle. Pairs of judges are formed on (model, item) rows, which an item has at most one of per
judge; no pair of records is ever formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import exact, stats
from tallymill.session import cut
from tallymill.skew import blocked_number, lookback

ECE_BINS = 10
#: Ranges of p that are ranked apart.
BH_BLOCKS = 4096
#: Mean errors of two judges correlate too much from here on.
RHO_LIMIT = 0.25


def records(judgments: DataFrame) -> DataFrame:
    """The judgments, each seq once, with is_correct: the flag, else whether predicted equals gold (null equals null)."""
    right = F.coalesce("correct", F.col("predicted").eqNullSafe(F.col("gold")))
    return judgments.dropDuplicates(["seq"]).withColumn("is_correct", right.cast("double"))


def _folded(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def _kappa(rows: DataFrame, key: str) -> DataFrame:
    """(key, kappa): Cohen's kappa from the marginals of predicted and gold; 1 where there is one label only."""
    cells = rows.groupBy(key, "predicted", "gold").agg(F.count("*").alias("n"))
    sides = cells.select(key, F.explode(F.array(
        F.struct(F.col("predicted").alias("label"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("g")),
        F.struct(F.col("gold").alias("label"), F.lit(0).cast("bigint").alias("p"), F.col("n").alias("g")),
    )).alias("side"))
    chance = sides.groupBy(key, "side.label").agg(F.sum("side.p").alias("p"), F.sum("side.g").alias("g"))
    chance = chance.groupBy(key).agg(F.sum(F.col("p").cast("double") * F.col("g")).alias("pg"))
    agree = cells.groupBy(key).agg(
        F.sum("n").cast("double").alias("m"), F.sum(F.when(F.col("predicted").eqNullSafe(F.col("gold")), F.col("n")).otherwise(0)).alias("same")
    )
    po, pe = F.col("same") / F.col("m"), F.col("pg") / (F.col("m") * F.col("m"))
    return agree.join(chance, key).select(key, F.when(pe >= 1, 1.0).otherwise((po - pe) / F.when(pe < 1, 1 - pe)).alias("kappa"))


def accuracy(rows: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, n, accuracy, weighted_accuracy, r, kappa): per-record accuracy, plain and by difficulty, and agreement."""
    w = F.when(F.col("difficulty") > 0, F.col("difficulty")).otherwise(1.0)
    base = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg("is_correct").alias("accuracy"),
        (F.sum(w * F.col("is_correct")) / F.sum(w)).alias("weighted_accuracy"),
        stats.safe_r(F.col("predicted").cast("double"), F.col("gold").cast("double")).alias("r"),
    )
    return base.join(_kappa(rows, key), key)


def item_stability(rows: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, n_items, n_eff, consistency, repeated): items, Kish's effective number of them, and the share of
    repeated items with one verdict (1 if none is repeated)."""
    w = F.when(F.col("difficulty") > 0, F.col("difficulty")).otherwise(1.0)
    items = rows.groupBy(key, "item_id").agg(
        F.min_by(w, "seq").alias("w"), F.count("*").alias("n"), F.min("predicted").alias("low"), F.max("predicted").alias("high")
    )
    again = F.col("n") >= 2
    moved = F.sum(F.when(again & ~F.col("low").eqNullSafe(F.col("high")), 1.0).otherwise(0.0))
    total = F.sum(F.when(again, 1.0).otherwise(0.0))
    return items.groupBy(key).agg(
        F.count("*").alias("n_items"),
        (F.pow(F.sum("w"), F.lit(2.0)) / F.sum(F.col("w") * F.col("w"))).alias("n_eff"),
        F.coalesce(1 - F.try_divide(moved, total), F.lit(1.0)).alias("consistency"),
        total.cast("bigint").alias("repeated"),
    )


def ece_bin(confidence: Column, bins: int = ECE_BINS) -> Column:
    """0-based bin of equal width; an edge i * (1 / bins), as computed in doubles, opens its bin."""
    bin_no = sum(((confidence >= e).cast("int") for e in np.linspace(0, 1, bins + 1)[1:-1].tolist()), F.lit(0))
    return stats.guarded((confidence < 0) | (confidence > 1) | F.isnan(confidence), "CONFIDENCE_RANGE", bin_no)


def calibration_error(rows: DataFrame, key: str = "model_id", confidence: str = "confidence", bins: int = ECE_BINS) -> DataFrame:
    """(key, ece): expected calibration error of the records that carry a confidence."""
    binned = rows.where(F.col(confidence).isNotNull()).groupBy(key, ece_bin(F.col(confidence), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("is_correct").alias("acc"), F.avg(confidence).alias("conf")
    )
    return binned.groupBy(key).agg((F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("n")) / F.sum("n")).alias("ece"))


def position_bias(rows: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, position_bias): share of items judged at two or more positions whose first verdicts differ."""
    first = rows.where("position IS NOT NULL").groupBy(key, "item_id", "position").agg(F.min_by("predicted", "seq").alias("verdict"))
    items = first.groupBy(key, "item_id").agg(F.count("*").alias("n"), F.min("verdict").alias("low"), F.max("verdict").alias("high"))
    flips = F.avg((~F.col("low").eqNullSafe(F.col("high"))).cast("double"))
    return items.where("n >= 2").groupBy(key).agg(flips.alias("position_bias"))


def other_bias(rows: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, verbosity_bias, family_delta): |r| of length and signed error; accuracy on the own family minus that on others."""
    error = (F.col("predicted") - F.col("gold")).cast("double")
    long = F.when(F.col("answer_len").isNotNull(), error)
    same = _folded("judge_family") == _folded("judged_family")
    mean = lambda flag: F.avg(F.when(flag, F.col("is_correct")))
    return rows.groupBy(key).agg(
        F.abs(stats.safe_r(F.when(error.isNotNull(), F.col("answer_len")), long)).alias("verbosity_bias"),
        F.coalesce(mean(same) - mean(~same), F.lit(0.0)).alias("family_delta"),
    )


def measure(rows: DataFrame, human_kappa: float = 0.8) -> DataFrame:
    """All metrics of each judge, joined on the judge: what seat decisions read.

    The records, free of copies, are written once: each metric needs other columns, so Spark could not reuse the shuffle
    that finds the copies, and would repeat it for every metric.
    """
    rows = cut(rows.select(
        "seq", "model_id", "item_id", "predicted", "gold", "is_correct", "confidence", "difficulty", "position", "answer_len", "judge_family", "judged_family"
    ))
    out = accuracy(rows).join(item_stability(rows), "model_id").join(calibration_error(rows), "model_id", "left")
    out = out.join(position_bias(rows), "model_id", "left").join(other_bias(rows), "model_id")
    lower, upper = stats.accuracy_wilson(F.col("weighted_accuracy"), F.col("n_eff"))
    bias = F.greatest(F.coalesce("position_bias", F.lit(0.0)), F.col("verbosity_bias"), F.abs("family_delta"))
    out = out.withColumns({"acc_lower": lower, "acc_upper": upper, "max_bias": bias})
    return out.withColumn("kappa_z", stats.kappa_z(F.col("kappa"), F.lit(human_kappa), F.col("n_items")))


#: Thresholds of a seat decision: value, and whether it is read on the scale of accuracy.
GATES = {"accuracy_floor": 0.50, "agreement_r": 0.80, "quality_floor": 0.55, "omega_floor": 0.50, "ece_ceiling": 0.15}
REVIEW_Z = 1.0


def decide(measured: DataFrame, human_kappa: float = 0.8, margin: Column | None = None, gates: dict[str, Column] | None = None) -> DataFrame:
    """measured with quality, its interval, seat, review and weight. gates and margin may be columns of measured."""
    g = {k: F.lit(v) for k, v in GATES.items()} | (gates or {})
    if margin is None:
        margin = 1.96 * F.sqrt(F.lit(human_kappa * (1 - human_kappa)) / F.greatest(F.lit(1), F.col("n_items")))
    at = lambda acc: stats.quality_score(acc, F.col("r"), F.col("consistency"), F.col("ece"), F.col("max_bias"), g["ece_ceiling"])
    hard = (F.col("acc_lower") > g["accuracy_floor"]) & (F.col("r") >= g["agreement_r"]) & (F.col("kappa") >= F.lit(human_kappa) - margin)
    omega = F.col("omega") if "omega" in measured.columns else F.lit(None).cast("double")
    low, high = at(F.col("acc_lower")), at(F.col("acc_upper"))
    seat = (
        F.when(~hard | (high < g["quality_floor"]), "reject")
        .when((low >= g["quality_floor"]) & (omega.isNull() | (omega >= g["omega_floor"])), "seat")
        .otherwise("screen")
    )
    out = measured.withColumns({"quality": at(F.col("weighted_accuracy")), "quality_low": low, "quality_high": high, "seat": seat})
    weight = F.greatest(F.lit(1e-3), F.least(F.lit(1.0), F.when(F.col("seat") == "screen", 0.5).otherwise(1.0) * F.col("quality")))
    return out.withColumns({"review": F.col("kappa_z") > REVIEW_Z, "weight": F.when(F.col("seat") == "reject", 0.0).otherwise(weight)})


def perturbation(measured: DataFrame, human_kappa: float = 0.8, jitter: float = 1.0) -> DataFrame:
    """(model_id, baseline, flip_rate): how often the seat changes when each of six thresholds moves by one
    standard error up and down. The twelve variants are a literal array exploded per judge."""
    base = decide(measured, human_kappa).withColumnRenamed("seat", "baseline")
    acc_se = F.greatest(F.lit(1e-3), (F.col("acc_upper") - F.col("acc_lower")) / 2)
    kappa_se = F.greatest(F.lit(1e-3), F.sqrt(F.lit(human_kappa * (1 - human_kappa)) / F.greatest(F.lit(1), F.col("n_items"))))
    names = [*GATES, "margin"]
    moves = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(d)).alias("d")) for k in names for d in (1, -1)]))
    moved = base.drop("quality", "quality_low", "quality_high", "review", "weight").withColumn("move", moves)
    step = lambda k, se: F.when(F.col("move.k") == k, F.col("move.d") * jitter * se).otherwise(0.0)
    gates = {k: F.lit(v) + step(k, acc_se) for k, v in GATES.items()}
    margin = F.when(F.col("move.k") == "margin", 1.96 * kappa_se + step("margin", kappa_se)).otherwise(
        1.96 * F.sqrt(F.lit(human_kappa * (1 - human_kappa)) / F.greatest(F.lit(1), F.col("n_items")))
    )
    again = decide(moved, human_kappa, margin, gates)
    return again.groupBy("model_id").agg(
        F.first("baseline").alias("baseline"), F.avg((F.col("seat") != F.col("baseline")).cast("double")).alias("flip_rate")
    )


def grade_matrix(rows: DataFrame) -> DataFrame:
    """(model_id, item_id, correct): strict majority over reruns; a tie is a failure."""
    return rows.groupBy("model_id", "item_id").agg((F.avg("is_correct") > 0.5).alias("correct"))


def error_vectors(rows: DataFrame) -> DataFrame:
    """(model_id, item_id, error): mean signed error of each judge on each item."""
    return rows.groupBy("model_id", "item_id").agg(F.avg((F.col("predicted") - F.col("gold")).cast("double")).alias("error"))


def error_correlation(errors: DataFrame) -> DataFrame:
    """(a, b, n, rho) of each two judges a < b over the items both judged."""
    a = errors.select("item_id", F.col("model_id").alias("a"), F.col("error").alias("x"))
    b = errors.select("item_id", F.col("model_id").alias("b"), F.col("error").alias("y"))
    both = a.join(b, "item_id").where("a < b AND x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), stats.safe_r(F.col("x"), F.col("y")).alias("rho"))


def redundant_pairs(correlations: DataFrame, limit: float = RHO_LIMIT) -> DataFrame:
    """The pairs whose errors correlate too much, strongest first; equal ones by name."""
    return correlations.where(F.abs("rho") >= limit).orderBy(F.desc(F.abs("rho")), "a", "b")


def is_diverse(correlations: DataFrame, limit: float = RHO_LIMIT) -> DataFrame:
    """(diverse): whether no pair's errors correlate too much; true for no pairs."""
    return correlations.agg(F.coalesce(F.every(F.abs("rho") < limit), F.lit(True)).alias("diverse"))


def compose_panel(profiles: DataFrame, correlations: DataFrame, limit: float = RHO_LIMIT, quorum: int = 3) -> DataFrame:
    """(model_id, status, kept, rho, meets_quorum): greedy choice of seated judges of profiles(model_id, weight, seat), best weight first, then by name: each must
    correlate less than limit with all chosen before; a redundant one names the first chosen it doesn't. Pairs without correlation count as unrelated.

    The choice is serial over one panel's candidates, who are folded as one array; only their clashing pairs come beside them, never records.
    """
    clash = correlations.where(F.abs("rho") >= limit).select("a", "b", "rho")
    both = clash.unionByName(clash.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    of = both.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "rho"))).alias("clashes"))
    seated = profiles.where("seat = 'seat'").select("model_id", "weight").join(of, F.col("a") == F.col("model_id"), "left").drop("a")
    listed = seated.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "model_id", F.coalesce("clashes", F.create_map().cast("map<string,double>")).alias("clashes"))),
                                     lambda x, y: F.when(x["w"] < y["w"], -1).when(x["w"] > y["w"], 1).when(x["model_id"] < y["model_id"], -1).when(x["model_id"] > y["model_id"], 1).otherwise(0)).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<struct<model_id:string,kept:string,rho:double>>").alias("out"))

    def choose(acc, x):
        first = F.get(F.filter(acc["kept"], lambda c: F.map_contains_key(x["clashes"], c)), F.lit(0))
        return F.struct(
            F.when(first.isNull(), F.concat(acc["kept"], F.array(x["model_id"]))).otherwise(acc["kept"]).alias("kept"),
            F.concat(acc["out"], F.array(F.struct(x["model_id"].alias("model_id"), first.alias("kept"), F.try_element_at(x["clashes"], first).alias("rho")))).alias("out"),
        )

    folded = listed.select(F.aggregate("all", start, choose).alias("f"))
    chosen = folded.select(F.explode("f.out").alias("o"), (F.size("f.kept") >= quorum).alias("meets_quorum"))
    status = F.when(F.col("seat") != "seat", "not_seated").when(F.col("kept").isNull(), "seat").otherwise("redundant")
    rows = profiles.select("model_id", "seat").join(chosen.select("o.*"), "model_id", "left")
    meets = folded.select(F.size("f.kept") >= quorum).scalar()
    return rows.select("model_id", status.alias("status"), "kept", "rho", F.coalesce(meets, F.lit(False)).alias("meets_quorum"))


def aborts(rows: DataFrame, failed: Column, in_a_row: int = 3) -> DataFrame:
    """(model_id, seq): where each judge's run would have been given up, the last of the first so many records in a row, in order of seq, that failed.
    (model_id, seq) must be unique."""
    numbered = blocked_number(rows.select("model_id", "seq", failed.cast("int").alias("failed")), "model_id", "seq")
    back = lookback(numbered.fillna(0, ["failed"]), "model_id", "place", "failed", in_a_row - 1)
    streak = (F.col("failed") == 1) & (F.aggregate("before", F.lit(0), lambda a, x: a + x) == in_a_row - 1)
    return back.where(streak).groupBy("model_id").agg(F.min("seq").alias("seq"))


def last_verdicts(rows: DataFrame) -> DataFrame:
    """(model_id, item_id, verdict): each judge's last record on an item."""
    return rows.groupBy("model_id", "item_id").agg(F.max_by("predicted", "seq").alias("verdict"))


def jury_omega(verdicts: DataFrame) -> DataFrame:
    """(model_id, omega, folds): the share of peers with whom a judge agrees at least as often as the other peers
    do on average. One pass over pairs of judges per item; the mean of the others is a sum less one term."""
    a = verdicts.select("item_id", F.col("model_id").alias("judge"), F.col("verdict").alias("v"))
    b = verdicts.select("item_id", F.col("model_id").alias("held"), F.col("verdict").alias("w"))
    match = a.join(b, "item_id").where("judge <> held").groupBy("judge", "held").agg(F.avg(F.col("v").eqNullSafe(F.col("w")).cast("double")).alias("m"))
    peers = Window.partitionBy("held")
    rest = match.withColumns({"total": F.sum("m").over(peers), "k": F.count("*").over(peers)}).where("k >= 2")
    win = (F.col("m") >= (F.col("total") - F.col("m")) / (F.col("k") - 1) - 1e-12).cast("double")
    return rest.groupBy(F.col("judge").alias("model_id")).agg(F.avg(win).alias("omega"), F.count("*").alias("folds"))


def alt_test_folds(verdicts: DataFrame) -> DataFrame:
    """(judge, held, n, mean, sd) of the paired differences: whether the judge agrees with the held-out one, less the
    share of the others who do; counts per (item, verdict) give that share."""
    values = Window.partitionBy("item_id", "verdict")
    counted = verdicts.where("verdict IS NOT NULL").withColumns(
        {"same": F.count("*").over(values), "all": F.count("*").over(Window.partitionBy("item_id"))}
    )
    held = counted.select("item_id", F.col("model_id").alias("held"), F.col("verdict").alias("w"), "same", "all")
    judge = counted.select("item_id", F.col("model_id").alias("judge"), F.col("verdict").alias("v"))
    agrees = (F.col("v") == F.col("w")).cast("double")
    both = judge.join(held, "item_id").where((F.col("judge") != F.col("held")) & (F.col("all") >= 3))
    diff = both.select("judge", "held", (agrees - (F.col("same") - 1 - agrees) / (F.col("all") - 2)).alias("d"))
    return diff.groupBy("judge", "held").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).where("n >= 2")


def step_up(rows: DataFrame, p: str, q: float, part: list[str], order: list[str], dependent: bool = False) -> DataFrame:
    """rows with `reject`: false discovery control within each part, by Benjamini and Hochberg, or, for dependent tests,
    Benjamini and Yekutieli. Ties keep the order given."""
    by = Window.partitionBy(*part)
    k = F.row_number().over(by.orderBy(p, *order))
    m = F.count("*").over(by)
    ranked = rows.withColumns({"k": k, "m": m})
    scale = F.lit(1.0)
    if dependent:
        scale = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    passed = F.max(F.when(F.col(p) <= F.col("k") / F.col("m") * (q / scale), F.col("k"))).over(by)
    return ranked.withColumn("reject", F.coalesce(F.col("k") <= passed, F.lit(False))).drop("k", "m")


def step_up_by_counts(rows: DataFrame, p: str, q: float, among: Column | None = None) -> DataFrame:
    """rows with `reject`: Benjamini and Hochberg's control over the rows of `among`, equal p alike.

    No row is ranked in one task: distinct values of p are counted, their running counts added up over ranges of p
    that are windowed apart, and the largest p that passes is one number.
    """
    some = rows.where(among) if among is not None else rows
    counts = some.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"))
    # values up to q in ranges of q / BH_BLOCKS; the last range has all others, which can't pass
    block = F.least(F.lit(BH_BLOCKS), F.floor(F.col("p") / (q / BH_BLOCKS))).alias("block")
    blocked = counts.select("p", "n", block)
    sizes = blocked.groupBy("block").agg(F.sum("n").alias("size"))
    before = sizes.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = sizes.agg(F.sum("size")).scalar()
    low = blocked.where(F.col("p") <= q)
    rank = F.sum("n").over(Window.partitionBy("block").orderBy("p")) + F.col("before")
    limit = low.join(F.broadcast(before), "block").withColumn("k", rank).where(F.col("p") <= F.col("k") / total * q).agg(F.max("p")).scalar()
    return rows.withColumn("reject", F.coalesce(F.col(p) <= limit, F.lit(False)))


def alt_test(verdicts: DataFrame, epsilon: float = 0.1, q: float = 0.05) -> DataFrame:
    """(model_id, omega): share of held-out peers against whom a judge is no more than epsilon worse, after control
    of false discoveries."""
    folds = alt_test_folds(verdicts)
    tested = folds.withColumn("p", exact.t_p(F.col("n").cast("double"), F.col("mean"), F.coalesce("sd", F.lit(0.0)), F.lit(-epsilon)))
    marked = step_up(tested, "p", q, ["judge"], ["held"], dependent=True)
    return marked.groupBy(F.col("judge").alias("model_id")).agg(F.avg(F.col("reject").cast("double")).alias("omega"))


def screen_items(matrix: DataFrame, min_variance: float = 0.0, min_r: float = 0.1) -> DataFrame:
    """(item_id, variance, r, label) of each item: kept, saturated, low_discrimination, or ragged where not all
    judges have it. r is the correlation with the judge's score on the other shared items."""
    judges = matrix.select("model_id").distinct().count()
    cells = matrix.withColumn("x", F.col("correct").cast("double"))
    have = cells.groupBy("item_id").agg(F.count("*").alias("k"))
    shared = cells.join(have.where(F.col("k") == judges).select("item_id"), "item_id")
    totals = shared.groupBy("model_id").agg(F.sum("x").alias("total"))
    rest = shared.join(totals, "model_id").withColumn("rest", F.col("total") - F.col("x"))
    measured = rest.groupBy("item_id").agg(F.var_pop("x").alias("variance"), stats.safe_r(F.col("x"), F.col("rest")).alias("r"))
    label = F.when(F.col("variance") <= min_variance, "saturated").when(F.col("r") < min_r, "low_discrimination").otherwise("kept")
    ragged = have.where(F.col("k") != judges).select("item_id", F.lit(None).cast("double").alias("variance"), F.lit(None).cast("double").alias("r"), F.lit("ragged").alias("label"))
    return measured.withColumn("label", label).unionByName(ragged)


def folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """(model_id, item_id, fold): a judge's items with confidence, in order of their ids, dealt out to k folds; reruns of an item stay together."""
    some = rows.where("confidence IS NOT NULL").select("model_id", "item_id").distinct()
    return some.withColumn("fold", ((F.row_number().over(Window.partitionBy("model_id").orderBy("item_id")) - 1) % k).cast("bigint"))


#: Confidences are told apart to so many parts of one.
CONFIDENCES = 100_000


def temperatures(rows: DataFrame, k: int = 5) -> DataFrame:
    """(model_id, temperature, ece_raw, ece_scaled, ece_cv): the temperature fitted to all of a judge's records, the calibration error without and with it, and
    that with temperatures fitted to the other folds.

    Records are first counted by (judge, fold, confidence, correctness), confidences to CONFIDENCES parts, so a judge is at most
    2 * k * CONFIDENCES weighted points, however many records it has. A judge with one item has no other folds and takes its own temperature.
    """

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        conf, right = batch["confidence"].to_numpy(float), batch["is_correct"].to_numpy(float)
        w, fold = batch["n"].to_numpy(float), batch["fold"].to_numpy(int)
        t = exact.fit_temperature(conf, right, w)
        scaled_cv = np.empty(len(conf))
        for f in np.unique(fold):
            mine = fold == f
            tf = t if mine.all() else exact.fit_temperature(conf[~mine], right[~mine], w[~mine])
            scaled_cv[mine] = _scaled(conf[mine], tf)
        return pd.DataFrame([(batch["model_id"].iloc[0], t, _ece(conf, right, w), _ece(_scaled(conf, t), right, w), _ece(scaled_cv, right, w))],
                            columns=["model_id", "temperature", "ece_raw", "ece_scaled", "ece_cv"])

    items = rows.where("confidence IS NOT NULL").select("model_id", "item_id").distinct()
    per = items.groupBy("model_id").agg(F.count("*").alias("items"))
    # folds of fewer items than folds are as many as there are items, two at least
    dealt = folds(rows, k).join(per, "model_id").withColumn("fold", F.col("fold") % F.greatest(F.lit(2), F.least(F.lit(k), F.col("items"))))
    counted = rows.where("confidence IS NOT NULL").join(dealt, ["model_id", "item_id"]).groupBy(
        "model_id", "fold", F.round(F.col("confidence") * CONFIDENCES).alias("part"), "is_correct"
    ).agg(F.count("*").alias("n")).select("model_id", "fold", (F.col("part") / CONFIDENCES).alias("confidence"), "is_correct", "n")
    return counted.groupBy("model_id").applyInPandas(fit, "model_id STRING, temperature DOUBLE, ece_raw DOUBLE, ece_scaled DOUBLE, ece_cv DOUBLE")


def _scaled(conf: np.ndarray, t: float) -> np.ndarray:
    p = np.clip(conf, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-np.log(p / (1 - p)) / t))


def _ece(conf: np.ndarray, right: np.ndarray, weight: np.ndarray, bins: int = ECE_BINS) -> float:
    at = np.digitize(conf, np.linspace(0, 1, bins + 1)[1:-1])
    n = np.bincount(at, weight, bins)
    acc, mean = np.bincount(at, weight * right, bins), np.bincount(at, weight * conf, bins)
    return float(np.abs(acc - mean).sum() / n.sum())
