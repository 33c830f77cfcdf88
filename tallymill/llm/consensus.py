"""Consensus from several annotators' labels, with an agreement measure and a reliability per annotator.

Method: latent ability and difficulty (Whitehill et al., 2009). The probability that annotator i's
vote on item j is right is sigmoid(a_i * b_j), with ability a_i (negative: worse than chance) and
ease b_j > 0. Expectation-maximisation alternates the label posteriors and eases, which follow from the abilities
item by item, with one Newton step of the gradient for the abilities, under normal priors, until no ability moves by
more than TOLERANCE. Chance-corrected agreement is Krippendorff's alpha over (item, value) counts.

The votes are written once, an item's in one row. Up to PEOPLE annotators (counted) their abilities are broadcast, and a round is
one scan of that table that sends a sum per annotator and partition; an item then has no more votes than there are
annotators, so no row is unbounded. With more annotators, a round is two joins of the votes with the parameter tables, where
hot annotators and items are salted.

Defined results: an annotator's last label on an item stands (a null time counts as earliest; at equal times a
vote stands before an abstention, then A/PASS before B/FAIL); what isn't A, B, PASS or FAIL after
folding is an abstention, and so is a null verdict with null pred; repeated rows change nothing;
annotator ids ignore letter case and surrounding white space; rows without annotator are left out; null campaign or item ids form their own
group; a posterior of exactly one half gives the more frequent vote, then 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators.dedup import folded
from tallymill.session import cut
from tallymill.skew import MAX_HOT, SALTS

#: The search ends when no ability moves by more than this; ROUNDS only guards against a search that doesn't end.
TOLERANCE = 1e-3
ROUNDS = 200
#: Up to so many annotators, their abilities (8 bytes each) are broadcast.
PEOPLE = 200_000
#: Newton steps for an item's ease at most.
EASE_STEPS = 40
#: Mean and variance of the priors of ability and log ease.
ABILITY = (1.0, 1.0)
LOG_EASE = (0.0, 0.25)


def standing_votes(labels: DataFrame) -> DataFrame:
    """(campaign_id, item_id, who, pred): each annotator's last label on an item, abstentions left out."""
    word = F.lower(F.regexp_replace("verdict", "[^A-Za-z]", ""))
    vote = (
        F.when(word.isin("a", "pass"), 1)
        .when(word.isin("b", "fail"), 0)
        .when(F.col("verdict").isNull() & F.col("pred").isin(0, 1), F.col("pred"))
        .otherwise(-1)
    )
    rows = labels.select("campaign_id", "item_id", folded(F.col("annotator")).alias("who"), "labelled_at", vote.alias("vote"))
    last = rows.where("who IS NOT NULL").groupBy("campaign_id", "item_id", "who").agg(
        F.max(F.struct("labelled_at", "vote")).getField("vote").alias("pred")
    )
    return last.where("pred >= 0")


def _sigmoid(x):
    return 1.0 / (1.0 + F.exp(-x))


def _salted(votes: DataFrame, sizes: DataFrame, key: str, other: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """votes with a salt for hot keys, and per key the number of copies its parameters need."""
    hot = sizes.where(F.col("n") >= hot_rows).orderBy(F.desc("n"), key).limit(MAX_HOT).select(key, F.lit(SALTS).alias("copies"))
    salt = F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")
    tagged = votes.join(F.broadcast(hot), key, "left").withColumn(f"salt_{key}", salt).drop("copies")
    return tagged, sizes.join(F.broadcast(hot), key, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))


def _spread(params: DataFrame, key: str) -> DataFrame:
    return params.withColumn(f"salt_{key}", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies", "n")


def _fit_joined(votes: DataFrame, people: DataFrame, rounds: int, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """The same for any number of annotators; an item's ease takes one step a round, and the search ends by the same test."""
    votes, people = _salted(votes, people, "who", "item", hot_rows)
    votes, items = _salted(votes, votes.groupBy("item").agg(F.count("*").alias("n")), "item", "who", hot_rows)
    votes = cut(votes)
    people = cut(people.withColumn("ability", F.lit(ABILITY[0])))
    items = cut(items.withColumn("log_ease", F.lit(LOG_EASE[0])))
    known = cut(votes.join(_spread(people, "who"), ["who", "salt_who"]))
    for _ in range(rounds):
        # E step and ease: the posterior needs the sums of signed abilities only, and the gradient is linear in it
        eased = known.join(_spread(items.select("item", "copies", "n", "log_ease"), "item"), ["item", "salt_item"])
        b = F.exp("log_ease")
        right = _sigmoid(F.col("ability") * b)
        sums = eased.groupBy("item").agg(
            F.sum(F.col("y") * F.col("ability")).alias("s"),
            F.sum(F.when(F.col("y") > 0, F.col("ability")).otherwise(0.0)).alias("for_1"),
            F.sum(F.when(F.col("y") < 0, F.col("ability")).otherwise(0.0)).alias("for_0"),
            F.sum(right * F.col("ability")).alias("expected"),
            F.sum(F.col("ability") ** 2 * right * (1 - right)).alias("info"),
        )
        post = _sigmoid(b * F.col("s"))
        gradient = b * (post * F.col("for_1") + (1 - post) * F.col("for_0") - F.col("expected")) - F.col("log_ease") / LOG_EASE[1]
        step = gradient / (b**2 * F.col("info") + 1 / LOG_EASE[1])
        eases = items.select("item", "copies", "n", "log_ease").join(sums, "item")
        items = cut(eases.select(
            "item", "copies", "n", post.alias("post"),
            (F.col("log_ease") + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), step))).alias("log_ease"),
        ))
        # M step of the abilities
        judged = known.join(_spread(items, "item"), ["item", "salt_item"])
        right = _sigmoid(F.col("ability") * F.exp("log_ease"))
        agrees = F.when(F.col("y") > 0, F.col("post")).otherwise(1 - F.col("post"))
        sums = judged.groupBy("who").agg(
            F.sum((agrees - right) * F.exp("log_ease")).alias("g"),
            F.sum(F.exp(2 * F.col("log_ease")) * right * (1 - right)).alias("h"),
        )
        step = (F.col("g") - (F.col("ability") - ABILITY[0]) / ABILITY[1]) / (F.col("h") + 1 / ABILITY[1])
        moved = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)).alias("moved")
        stepped = cut(people.join(sums, "who").select("who", "copies", "n", (F.col("ability") + moved).alias("ability"), moved))
        people = stepped.drop("moved")
        if stepped.agg(F.max(F.abs("moved"))).first()[0] < TOLERANCE:
            break
        known = votes.join(_spread(people, "who"), ["who", "salt_who"])
    return items.select("item", "post", "log_ease", "n"), people.select("who", "ability", "n")


def eased(ability: np.ndarray, y: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of 1, log ease) of n items, from the abilities, votes (1 or -1) and items of their votes."""
    total = lambda w: np.bincount(item, w, n)
    s, for_1, for_0 = total(y * ability), total(ability * (y > 0)), total(ability * (y < 0))
    log_ease = np.full(n, LOG_EASE[0])
    for _ in range(EASE_STEPS):
        b = np.exp(log_ease)
        post = 1 / (1 + np.exp(-b * s))
        right = 1 / (1 + np.exp(-ability * b[item]))
        slope = b * (post * for_1 + (1 - post) * for_0 - total(right * ability)) - (log_ease - LOG_EASE[0]) / LOG_EASE[1]
        step = np.clip(slope / (b**2 * total(ability**2 * right * (1 - right)) + 1 / LOG_EASE[1]), -0.5, 0.5)
        log_ease = log_ease + step
        if not n or np.abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-np.exp(log_ease) * s)), log_ease


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(annotator, vote, item) of each vote of some items."""
    sizes = batch["votes"].str.len().to_numpy(dtype=np.int64)
    # a vote is kept as its annotator's number, shifted, and the vote
    votes = np.concatenate([np.asarray(v, dtype=np.int64) for v in batch["votes"]]) if len(batch) else np.zeros(0, dtype=np.int64)
    return votes >> 1, np.where(votes & 1, 1.0, -1.0), np.repeat(np.arange(len(batch)), sizes)


def _fit_broadcast(votes: DataFrame, people: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    spark = votes.sparkSession
    known = people.orderBy("who").toPandas()
    numbers = spark.createDataFrame(pd.DataFrame({"who": known["who"], "no": np.arange(len(known), dtype=np.int64)}), "who STRING, no BIGINT")
    coded = votes.join(F.broadcast(numbers), "who").select("item", (F.col("no") * 2 + (F.col("y") > 0).cast("bigint")).alias("vote"))
    table = cut(coded.groupBy("item").agg(F.collect_list("vote").alias("votes")))
    ability = np.full(len(known), ABILITY[0])

    def sums(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = shared.value
            g, h = np.zeros(len(at)), np.zeros(len(at))
            for batch in batches:
                who, y, item = _flat(batch)
                post, log_ease = eased(at[who], y, item, len(batch))
                b = np.exp(log_ease)[item]
                right = 1 / (1 + np.exp(-at[who] * b))
                g += np.bincount(who, (np.where(y > 0, post[item], 1 - post[item]) - right) * b, len(at))
                h += np.bincount(who, b**2 * right * (1 - right), len(at))
            some = np.nonzero(h)[0]
            yield pd.DataFrame({"no": some, "g": g[some], "h": h[some]})

        return table.select("votes").mapInPandas(run, "no BIGINT, g DOUBLE, h DOUBLE").groupBy("no").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(ability)
        got = sums(shared).toPandas()
        shared.unpersist()
        g, h = np.zeros(len(ability)), np.zeros(len(ability))
        g[got["no"]], h[got["no"]] = got["g"], got["h"]
        step = np.clip((g - (ability - ABILITY[0]) / ABILITY[1]) / (h + 1 / ABILITY[1]), -1.0, 1.0)
        ability = ability + step
        if not len(step) or np.abs(step).max() < TOLERANCE:
            break
    last = spark.sparkContext.broadcast(ability)

    def posteriors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            who, y, item = _flat(batch)
            post, log_ease = eased(last.value[who], y, item, len(batch))
            yield pd.DataFrame({"item": batch["item"], "post": post, "log_ease": log_ease, "n": np.bincount(item, minlength=len(batch))})

    items = table.mapInPandas(posteriors, "item STRING, post DOUBLE, log_ease DOUBLE, n BIGINT")
    return items, spark.createDataFrame(known.assign(ability=ability)[["who", "ability", "n"]], "who STRING, ability DOUBLE, n BIGINT")


def fit(votes: DataFrame, rounds: int = ROUNDS, hot_rows: int = 50_000, people_bound: int = PEOPLE) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) of votes(item, who, pred), one per item and annotator: items have post, the probability of 1, log_ease and n,
    their votes; annotators have ability and n."""
    votes = votes.select("item", "who", F.when(F.col("pred") == 1, 1.0).otherwise(-1.0).alias("y"))
    people = cut(votes.groupBy("who").agg(F.count("*").alias("n")))
    if people.count() <= people_bound:
        return _fit_broadcast(votes, people, rounds)
    return _fit_joined(votes, people, rounds, hot_rows)


def _item_key():
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.concat(part("campaign_id"), F.lit("\u0001"), part("item_id"))


def consensus(labels: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(items, annotators): per item the consensus pred, its posterior, votes for each value and the raw
    agreement; per annotator the ability, its accuracy on an item of middle ease, and the number of votes."""
    votes = cut(standing_votes(labels).withColumn("item", _item_key()))
    items, people = fit(votes.select("item", "who", "pred"), rounds)
    counts = votes.groupBy("item", "campaign_id", "item_id").agg(
        F.sum("pred").alias("n_1"), F.sum(1 - F.col("pred")).alias("n_0")
    )
    pred = (
        F.when(F.col("post") > 0.5, 1).when(F.col("post") < 0.5, 0).when(F.col("n_1") >= F.col("n_0"), 1).otherwise(0)
    )
    n = F.col("n_1") + F.col("n_0")
    pairs = F.col("n_1") * (F.col("n_1") - 1) + F.col("n_0") * (F.col("n_0") - 1)
    per_item = counts.join(items.drop("n"), "item").select(
        "campaign_id", "item_id", pred.cast("int").alias("pred"), "post", F.exp("log_ease").alias("ease"), "n_1", "n_0",
        F.when(n > 1, pairs / (n * (n - 1))).alias("agreement"),
    )
    per_person = people.select("who", "ability", _sigmoid(F.col("ability")).alias("accuracy"), "n")
    return per_item, per_person


def alpha(votes: DataFrame) -> DataFrame:
    """(n_items, alpha): Krippendorff's nominal alpha of votes(campaign_id, item_id, who, pred); 1 if only one value occurs."""
    item = votes.groupBy("campaign_id", "item_id").agg(
        F.sum(F.col("pred").cast("double")).alias("a"), F.sum(1.0 - F.col("pred")).alias("b")
    ).where("a + b >= 2")
    total = item.agg(
        F.count("*").alias("n_items"),
        F.coalesce(F.sum(2 * F.col("a") * F.col("b") / (F.col("a") + F.col("b") - 1)), F.lit(0.0)).alias("apart"),
        F.coalesce(F.sum("a"), F.lit(0.0)).alias("ones"),
        F.coalesce(F.sum("b"), F.lit(0.0)).alias("zeros"),
    )
    n = F.col("ones") + F.col("zeros")
    chance = 2 * F.col("ones") * F.col("zeros")
    return total.select("n_items", F.when(chance == 0, 1.0).otherwise(1 - (n - 1) * F.col("apart") / chance).alias("alpha"))


def contested(labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(campaign_id, item_id, pred) of the items on which standing votes differ."""
    items, _ = consensus(labels, rounds)
    return items.where("n_1 > 0 AND n_0 > 0").select("campaign_id", "item_id", "pred")
