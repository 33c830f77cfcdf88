"""Reading and writing the documents that evaluations keep as JSON, text or YAML.

Documents are read with a fixed schema, so nothing is inferred. A guard is part of the value it guards, so pruning can't remove it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import text

PUZZLE = (
    "puzzle_id STRING, created_at STRING, source_url STRING, capability_aspect STRING, puzzle_class STRING, catalog_tier STRING, "
    "point_threshold DOUBLE, time_budget_seconds INT, tool_call_budget INT, min_k INT, "
    "rewards STRUCT<solve: DOUBLE, elegance_bonus_max: DOUBLE, novelty_bonus_max: DOUBLE, canonical_call_count: INT>, "
    "penalties ARRAY<STRUCT<name: STRING, goodhart_flavor: STRING, weight: DOUBLE, trigger: STRING, description: STRING>>, "
    "hard_kill_consecutive_identical INT, novelty_validation_panel STRING"
)
ITEM = (
    "id STRING, category STRING, construct STRING, confound_controlled STRING, prompt STRING, gold STRING, difficulty DOUBLE, "
    "discrimination DOUBLE, expected_pass MAP<STRING, BOOLEAN>, metadata STRING"
)
PANEL = (
    "schema_version INT, seats ARRAY<STRUCT<model_id: STRING, reliability_weight: DOUBLE, family: STRING, review_flag: BOOLEAN>>, "
    "submodular BOOLEAN, meets_quorum BOOLEAN, escalate BOOLEAN, not_seated ARRAY<STRING>, "
    "dropped_redundant ARRAY<STRUCT<dropped: STRING, kept: STRING, rho: DOUBLE>>, threshold DOUBLE, min_judges INT, notes ARRAY<STRING>"
)
#: Limits of file sizes in bytes, categories of items, and the fields of a frozen system's record.
META_BYTES, PROMPT_BYTES, ITEM_BYTES = 1 << 20, 4 << 20, 16 << 20
CATEGORIES = ("known_trivial", "known_impossible", "known_diagnostic", "difficulty_anchor", "test_retest")
PANEL_VERSION = 1


def fails(bad: Column, code: str, value: Column) -> Column:
    """value, or an error where bad holds."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(code))).otherwise(value)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]+$", "")


def read_puzzles(spark: SparkSession, root: str) -> DataFrame:
    """The puzzles below root, one folder each: meta.json joined with its prompt. Grading material in other files is not opened."""
    size = F.col("_metadata.file_size")
    meta = spark.read.schema(PUZZLE).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/meta.json").select(
        "*", _folder(F.col("_metadata.file_path")).alias("folder"), size.alias("bytes")
    )
    prompt = spark.read.text([f"{root}/*/prompt*"], wholetext=True).select(
        fails(size > PROMPT_BYTES, "PROMPT_TOO_LARGE", F.col("value")).alias("prompt"), _folder(F.col("_metadata.file_path")).alias("folder")
    )
    solve = F.col("rewards.solve")
    over = (F.col("rewards.elegance_bonus_max") > 0.3 * solve) | (F.col("rewards.novelty_bonus_max") > 0.5 * solve)
    checked = fails(F.col("bytes") > META_BYTES, "META_TOO_LARGE", fails(F.col("puzzle_id").isNull(), "NO_PUZZLE_ID", fails(over, "REWARD_BOUND", F.col("puzzle_id"))))
    return meta.withColumn("puzzle_id", checked).join(prompt, "folder", "left").drop("folder", "bytes")


def read_items(spark: SparkSession, *paths: str) -> DataFrame:
    """Item banks: each file one object, an array of them, or one a line; unknown members, missing ids and unknown categories are errors."""
    raw = spark.read.text(list(paths), wholetext=True).select(
        fails(F.col("_metadata.file_size") > ITEM_BYTES, "BANK_TOO_LARGE", F.trim("value")).alias("value")
    )
    # within a document, objects that follow each other have a comma between them
    apart = F.regexp_replace("value", r"\}\s*\n\s*\{", "},{")
    whole = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), apart, F.lit("]")))
    one = raw.select(F.explode(F.from_json(whole, "ARRAY<STRING>", {"mode": "FAILFAST"})).alias("one"))
    known = F.array(*[F.lit(c.strip().split(" ")[0]) for c in ITEM.replace(", BOOLEAN", "").split(",")])
    unknown = F.size(F.array_except(F.json_object_keys("one"), known)) > 0
    item = F.from_json(fails(unknown, "UNKNOWN_MEMBER", F.col("one")), ITEM)
    rows = one.select(item.alias("i")).select("i.*")
    bad = F.col("id").isNull() | F.col("gold").isNull() | F.col("prompt").isNull()
    return rows.withColumn("id", fails(bad, "MISSING_MEMBER", fails(~F.col("category").isin(*CATEGORIES), "BAD_CATEGORY", F.col("id"))))


def read_human_labels(spark: SparkSession, *paths: str) -> DataFrame:
    """(item_id, annotator, tier, verdict): label files, nested by item and annotator, as rows."""
    raw = spark.read.text(list(paths), wholetext=True)
    body = F.from_json("value", "annotators MAP<STRING, STRUCT<tier: STRING>>, labels MAP<STRING, MAP<STRING, STRING>>", {"mode": "FAILFAST"})
    items = raw.select(body.alias("b")).select("b.annotators", F.explode("b.labels").alias("item_id", "votes"))
    rows = items.select("annotators", "item_id", F.explode("votes").alias("annotator", "verdict"))
    tier = F.try_element_at("annotators", F.col("annotator"))["tier"]
    known = fails(~F.coalesce(tier.isin("expert", "skilled", "crowd"), F.lit(False)), "BAD_ANNOTATOR", tier)
    return rows.select("item_id", "annotator", known.alias("tier"), "verdict")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A seated panel; a schema newer than PANEL_VERSION is an error."""
    rows = spark.read.schema(PANEL).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("schema_version", fails(F.col("schema_version") > PANEL_VERSION, "NEWER_SCHEMA", F.col("schema_version")))


def write_panel(panel: DataFrame, path: str) -> None:
    """One small document: a single file is intended."""
    panel.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_frozen_system(record: DataFrame, path: str, pinned: tuple[str, ...] = ("model", "model_id")) -> None:
    """Writes the record of a frozen system, rows (key, value), as flat lines that read_frozen_system reads again. A value of a pinned key that names
    no version is an error, and so is a key with a colon or a white space at its ends, or a value of several lines."""
    alias = F.col("key").isin(*pinned) & text.is_alias(F.col("value"))
    odd = F.col("key").rlike(r"^\s|\s$|:|^#|^$") | F.col("value").rlike(r"[\r\n]")
    quoted = F.concat(F.lit('"'), F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = fails(alias, "ALIAS_NOT_PINNED", fails(odd, "BAD_LINE", F.concat(F.col("key"), F.lit(": "), F.coalesce(quoted, F.lit('""')))))
    record.select(line.alias("value")).write.mode("overwrite").text(path)


def read_frozen_system(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the flat lines of a record of a frozen system; indented lines, lines without colon and repeated keys are errors."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT ltrim(value) LIKE '#%'")
    bad = F.col("value").rlike(r"^\s") | ~F.col("value").contains(":")
    line = fails(bad, "BAD_LINE", F.col("value"))
    value = F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
    quoted = F.regexp_extract(value, r'^"(.*)"$', 1)
    plain = F.when(value.rlike(r'^".*"$'), F.regexp_replace(F.regexp_replace(quoted, r'\\"', '"'), r"\\\\", r"\\")).otherwise(value)
    rows = lines.select(F.trim(F.regexp_extract(line, "^([^:]*):", 1)).alias("key"), plain.alias("value"))
    once = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return once.select(fails(F.col("n") > 1, "DUPLICATE_KEY", F.col("key")).alias("key"), "value")


def folder_hashes(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(folder, content_hash): 16 hex digits over the named files of each folder below root, in the order given; a missing
    file counts as empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.withColumn("rel", F.regexp_extract("path", "^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/([^/]+)/(.*)$", 2)).withColumn(
        "folder", F.regexp_extract("path", "^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/([^/]+)/(.*)$", 1)
    ).where(F.col("rel").isin(*names))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("rel"))
    part = F.concat(F.encode("rel", "utf-8"), F.unhex(F.lit("00")), F.col("content"), F.unhex(F.lit("00")))
    # a folder has as many parts as there are names
    parts = rows.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), part.alias("p")))).alias("parts"))
    whole = F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["p"]))
    return parts.select("folder", F.substring(F.sha2(whole, 256), 1, 16).alias("content_hash"))


def evaluation_log(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """(attempt_id, place, document): JSON lines of a log for another harness, a head with place -1 and then an attempt's events by seq, each its own
    row, so that no attempt, however long, is one. Written sorted by (attempt_id, place), it is the log."""
    head = F.struct(
        F.struct("model", "puzzle_id").alias("eval"), F.struct("framing_arm").alias("plan"), F.struct("terminated_by", "wall_time", "error").alias("stats"),
        F.struct("attempt_id", "output", "scores").alias("sample"),
    )
    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias("document")
    heads = attempts.select("attempt_id", F.lit(-1).cast("bigint").alias("place"), as_json(head))
    known = events.where("seq IS NOT NULL").join(attempts.select("attempt_id").distinct(), "attempt_id", "left_semi")
    return heads.unionByName(known.select("attempt_id", F.col("seq").cast("bigint").alias("place"), as_json(F.struct("seq", "kind", "role", "payload"))))
