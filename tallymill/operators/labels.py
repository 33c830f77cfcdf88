"""Human labels: usable verdicts, agreement, disputed items, tolerance of substitution per campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators.dedup import folded

#: Tolerance by annotators' tier, and the floors below which items are disputed and agreement is poor.
EPSILON = {"expert": 0.20, "skilled": 0.15, "crowd": 0.10}
DISPUTED_BELOW, POOR_BELOW, FEW_ITEMS, MIN_ANNOTATORS = 0.67, 0.667, 30, 3


def usable(labels: DataFrame) -> DataFrame:
    """(campaign_id, item_id, who, tier, pred): each annotator's last label on an item, markers of doubt left out.
    The tier is the annotator's best known one on that item."""
    word = F.upper(F.regexp_replace("verdict", "[^A-Za-z]", ""))
    pred = F.when(word.isin("A", "PASS"), 1).when(word.isin("B", "FAIL"), 0)
    rows = labels.where("annotator IS NOT NULL").select("campaign_id", "item_id", folded(F.col("annotator")).alias("who"), "tier", "labelled_at", pred.alias("pred"))
    last = rows.groupBy("campaign_id", "item_id", "who").agg(
        F.max(F.struct("labelled_at", F.coalesce("pred", F.lit(-1)).alias("pred"))).getField("pred").alias("pred"), F.max("tier").alias("tier")
    )
    return last.where("pred >= 0")


def item_agreement(votes: DataFrame) -> DataFrame:
    """(campaign_id, item_id, votes, agreement, disputed): the share of the more frequent verdict."""
    counts = votes.groupBy("campaign_id", "item_id").agg(F.count("*").alias("votes"), F.sum("pred").alias("ones"))
    share = F.greatest(F.col("ones"), F.col("votes") - F.col("ones")) / F.col("votes")
    return counts.select("campaign_id", "item_id", "votes", share.alias("agreement"), (share < DISPUTED_BELOW).alias("disputed"))


def campaign_alpha(votes: DataFrame) -> DataFrame:
    """(campaign_id, alpha): Krippendorff's nominal alpha from counts per (item, verdict); no pairs of labels are formed."""
    items = votes.groupBy("campaign_id", "item_id").agg(F.sum(F.col("pred").cast("double")).alias("a"), F.sum(1.0 - F.col("pred")).alias("b")).where("a + b >= 2")
    sums = items.groupBy("campaign_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(2 * F.col("a") * F.col("b") / (F.col("a") + F.col("b") - 1)).alias("apart"))
    chance = 2 * F.col("a") * F.col("b")
    return sums.select("campaign_id", F.when(chance == 0, 1.0).otherwise(1 - (F.col("a") + F.col("b") - 1) * F.col("apart") / F.when(chance != 0, chance)).alias("alpha"))


def campaign_report(labels: DataFrame) -> DataFrame:
    """Per campaign: annotators, labelled items, alpha, tolerance (the least of the tiers', 0.10 where agreement is poor), disputed items,
    and whether it has enough of both."""
    votes = usable(labels)
    table = F.create_map(*[F.lit(x) for pair in EPSILON.items() for x in pair])
    who = votes.groupBy("campaign_id", "who").agg(F.min(F.try_element_at(table, F.col("tier"))).alias("eps"))
    who = who.groupBy("campaign_id").agg(F.count("*").alias("annotators"), F.min("eps").alias("eps"))
    items = item_agreement(votes).groupBy("campaign_id").agg(F.count("*").alias("items"), F.count_if("disputed").alias("disputed"))
    out = who.join(items, "campaign_id").join(campaign_alpha(votes), "campaign_id", "left")
    epsilon = F.when((F.col("alpha") < POOR_BELOW) & (F.col("eps") > 0.1), 0.1).otherwise(F.col("eps"))
    return out.select("campaign_id", "annotators", "items", "alpha", epsilon.alias("epsilon"), "disputed",
                      ((F.col("annotators") >= MIN_ANNOTATORS) & (F.col("items") >= FEW_ITEMS)).alias("enough"))


def graded(votes: DataFrame, bank: DataFrame, strict: bool = False) -> DataFrame:
    """votes of known items with their gold (1 for A or PASS, else 0) and whether they meet it, in the form of judgments. An item the
    bank doesn't have is an error in strict mode, else its votes are left out."""
    gold = F.when(F.upper(F.trim("gold")).isin("A", "PASS"), 1).otherwise(0)
    keyed = bank.where("id IS NOT NULL").groupBy(F.col("id").alias("item_id")).agg(F.min(gold).alias("gold"))
    rows = votes.join(keyed, "item_id", "left" if strict else "inner")
    if strict:
        rows = rows.withColumn("gold", F.when(F.col("gold").isNull(), F.raise_error(F.lit("UNKNOWN_ITEM")).cast("int")).otherwise(F.col("gold")))
    return rows.withColumn("is_correct", (F.col("pred") == F.col("gold")).cast("double"))


def with_judge(humans: DataFrame, judge: DataFrame) -> DataFrame:
    """(item_id, model_id, verdict, role): the people's votes(item_id, who, pred) beside one judge's verdicts(item_id, verdict), whose id is 'judge'.

    The roles keep a person called judge apart.
    """
    people = humans.select("item_id", F.concat(F.lit("human:"), F.col("who")).alias("model_id"), F.col("pred").alias("verdict"), F.lit("human").alias("role"))
    return people.unionByName(judge.select("item_id", F.lit("judge").alias("model_id"), F.col("verdict"), F.lit("judge").alias("role")))


def undisputed(votes: DataFrame, agreement: DataFrame, keys: list[str]) -> DataFrame:
    """votes on items that aren't disputed; items without agreement stay."""
    return votes.join(agreement.where("disputed").select(*keys).distinct(), keys, "left_anti")
