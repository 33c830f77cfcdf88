"""Calibration items: known groups, monotone ability, ambiguous keys, curation, deterministic splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of tiers, weakest first.
RANKS = {"weak": 0, "medium": 1, "strong": 2}
#: The parts an inventory is split into.
SPLITS = {"calibration": 0.60, "dev": 0.20, "validation": 0.10, "private_test": 0.10}


def duplicate_ids(items: DataFrame) -> DataFrame:
    """(id, n) of the ids that stand more than once."""
    return items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def expectations(items: DataFrame) -> DataFrame:
    """(item_id, category, tier, expected): the map of expectations, one row each."""
    return items.select(F.col("id").alias("item_id"), "category", F.explode("expected_pass").alias("tier", "expected"))


def ranked(outcomes: DataFrame, items: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """outcomes(item_id, tier, passed) with category and rank: by the order given, weakest first, else by RANKS, else by whether the
    tier was expected to pass."""
    table = {t: i for i, t in enumerate(order)} if order else RANKS
    lookup = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("tier"))
    both = outcomes.join(items.select(F.col("id").alias("item_id"), "category", "expected_pass"), "item_id", "left")
    hope = F.try_element_at("expected_pass", F.col("tier"))
    guess = F.lit(None).cast("int") if order else F.when(hope, 100).when(~hope, -100)
    return both.withColumn("rank", F.coalesce(lookup, guess)).drop("expected_pass")


def inversions(rows: DataFrame) -> DataFrame:
    """(item_id, category, weaker, stronger): a weaker tier passed and a stronger one failed. An item has one row per tier."""
    a = rows.where("passed AND rank IS NOT NULL").select("item_id", "category", F.col("tier").alias("weaker"), F.col("rank").alias("low"))
    b = rows.where("NOT passed AND rank IS NOT NULL").select("item_id", F.col("tier").alias("stronger"), F.col("rank").alias("high"))
    return a.join(b, "item_id").where("low < high").drop("low", "high")


def violations(outcomes: DataFrame, items: DataFrame, order: Sequence[str] | None = None, strict_anchors: bool = False) -> DataFrame:
    """(item_id, category, kind, detail, soft): breaches of what each category promises, and items without any outcome."""
    rows = ranked(outcomes, items, order)
    made = lambda df, kind, detail, soft=False: df.select("item_id", "category", F.lit(kind).alias("kind"), detail.alias("detail"), F.lit(soft).alias("soft"))
    trivial = made(rows.where("category = 'known_trivial' AND NOT passed"), "trivial_failed", F.col("tier"))
    impossible = made(rows.where("category = 'known_impossible' AND passed"), "impossible_passed", F.col("tier"))
    turned = inversions(rows.where("category IN ('known_diagnostic', 'difficulty_anchor')"))
    pair = F.concat_ws("<", "weaker", "stronger")
    diagnostic = made(turned.where("category = 'known_diagnostic'"), "not_monotone", pair)
    anchor = made(turned.where("category = 'difficulty_anchor'"), "not_monotone", pair, not strict_anchors)
    seen = outcomes.select("item_id").distinct()
    missing = items.select(F.col("id").alias("item_id"), "category").join(seen, "item_id", "left_anti")
    return trivial.unionByName(impossible).unionByName(diagnostic).unionByName(anchor).unionByName(made(missing, "no_outcome", F.lit("")))


def group_summary(outcomes: DataFrame, items: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """(category, items, violations): hard breaches per category, missing outcomes among them."""
    bad = violations(outcomes, items, order).where("NOT soft").groupBy("category").agg(F.count("*").alias("violations"))
    return items.groupBy("category").agg(F.count("*").alias("items")).join(bad, "category", "left").withColumn(
        "violations", F.coalesce("violations", F.lit(0)).cast("bigint")
    )


def key_status(votes: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, votes, status): whether the verifiers' votes(item_id, choice) give an item a defensible key."""
    said = F.upper(F.trim("choice"))
    cast = votes.where(F.trim("choice") != "").groupBy("item_id").agg(
        F.count("*").alias("votes"), F.min(said).alias("low"), F.max(said).alias("high")
    )
    both = items.select(F.col("id").alias("item_id"), F.upper(F.trim("gold")).alias("gold")).join(cast, "item_id", "left")
    status = (
        F.when(F.coalesce("votes", F.lit(0)) < 2, "not_verified").when(F.col("low") != F.col("high"), "ambiguous")
        .when(F.col("low") != F.col("gold"), "mislabeled").otherwise("defensible")
    )
    return both.select("item_id", F.coalesce("votes", F.lit(0)).alias("votes"), status.alias("status"))


def curate(screened: DataFrame, statuses: DataFrame) -> DataFrame:
    """(item_id, outcome): screened(item_id, label) items that are kept, or why they aren't."""
    both = screened.join(statuses, "item_id", "left")
    gone = F.col("status").isin("ambiguous", "mislabeled")
    kept = F.when(gone, F.col("status")).when(F.coalesce("status", F.lit("not_verified")) == "not_verified", "kept_not_verified").otherwise("kept")
    return both.select("item_id", F.when(F.col("label") == "kept", kept).otherwise(F.col("label")).alias("outcome"))


def kept_pool(pool: DataFrame, curated: DataFrame) -> DataFrame:
    """The pool's items that a curation kept, as they stand in the pool."""
    return pool.join(curated.where("outcome IN ('kept', 'kept_not_verified')").select(F.col("item_id").alias("id")), "id", "left_semi").select(*pool.columns)


def write_bank(items: DataFrame, path: str) -> None:
    """Writes items as a bank of JSON lines that read_items reads again; members that are null are left out."""
    items.write.mode("overwrite").json(path)


def split_inventory(ids: DataFrame, note: str, column: str = "id") -> DataFrame:
    """(id, place, part): a deterministic split by the hash of note and id, sized by largest remainders.

    Hashes are spread evenly, so ids are numbered by hash prefix: counts per prefix first, then places within each.
    """
    key = F.sha2(F.concat(F.lit(note + "\u0000"), F.col(column)), 256)
    keyed = ids.select(F.col(column).alias("id"), key.alias("hash")).withColumn("prefix", F.substring("hash", 1, 3))
    sizes = keyed.groupBy("prefix").agg(F.count("*").alias("size"))
    # 4096 prefixes at most, whatever the inventory
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    inside = F.row_number().over(Window.partitionBy("prefix").orderBy("hash", "id")) - 1
    places = keyed.withColumn("inside", inside).join(F.broadcast(starts.select("prefix", "start")), "prefix")
    exact = {k: f * total for k, f in SPLITS.items()}
    counts = {k: int(v) for k, v in exact.items()}
    by_rest = sorted(SPLITS, key=lambda k: (exact[k] - counts[k], list(SPLITS).index(k)), reverse=True)
    for k in by_rest[: total - sum(counts.values())]:
        counts[k] += 1
    part, end = F.lit(None).cast("string"), 0
    for k, n in counts.items():
        end += n
        part = F.coalesce(part, F.when(F.col("place") < end, k))
    return places.withColumn("place", F.col("inside") + F.col("start")).select("id", "place", part.alias("part"))


def sobol_total(objective: Callable[[np.ndarray], np.ndarray], bounds: dict[str, tuple[float, float]], n: int = 256, seed: int = 0) -> dict[str, float]:
    """Total effect of each parameter by Jansen's estimator over two sample matrices; n is taken to the nearest
    power of two. A result that isn't finite is an error."""
    names, lows, highs = list(bounds), *np.array(list(bounds.values()), dtype=float).T
    if not (highs > lows).all():
        raise ValueError("DEGENERATE_BOUND")
    rng = np.random.default_rng(seed)
    size = nearest_power_of_two(n)
    a, b = (lows + (highs - lows) * rng.random((size, len(names))) for _ in range(2))

    def at(x: np.ndarray) -> np.ndarray:
        out = np.asarray(objective(x.T), dtype=float)
        if not np.isfinite(out).all():
            raise ValueError("NONFINITE_OBJECTIVE")
        return out

    fa = at(a)
    variance = np.var(np.concatenate([fa, at(b)]))
    out = {}
    for i, name in enumerate(names):
        mixed = a.copy()
        mixed[:, i] = b[:, i]
        out[name] = max(0.0, float(((fa - at(mixed)) ** 2).mean() / (2 * variance))) if variance > 0 else 0.0
    return out


def nearest_power_of_two(n: int) -> int:
    """The nearest power of two, the lower of two equally near."""
    low = 1 << (max(1, n).bit_length() - 1)
    return low if n - low <= 2 * low - n else 2 * low


def leak_guard(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(message_id, token): tokens(token) that stand as whole words, or runs of words and marks, in messages(message_id, content).

    Any number of tokens: a token is found by a join on its first word with the words of the messages, each message's once, and then looked for in
    the texts that have it. A token without any word is looked for by its own characters in a join on nothing but the first of them.
    """
    first = lambda text: F.coalesce(F.nullif(F.regexp_extract(text, r"(?U)\w+", 0), F.lit("")), F.substring(F.trim(text), 1, 1))
    known = tokens.where("trim(token) <> ''").select("token").distinct().withColumn("word", first(F.col("token")))
    pieces = F.array_union(F.regexp_extract_all("content", F.lit(r"(?U)(\w+)"), 1), F.regexp_extract_all("content", F.lit(r"(?U)([^\w\s])"), 1))
    rows = messages.where("content IS NOT NULL").select("message_id", "content", F.explode(F.array_distinct(pieces)).alias("word"))
    near = rows.join(known, "word").where(F.contains("content", "token"))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace("token", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return near.where(F.regexp_like("content", quoted)).select("message_id", "token").distinct()
