"""Checks that are part of the value they guard, so that column pruning can't remove them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallymill.skew import blocked_number

SCHEMA_VERSION = 1


def known_schema(version: Column, newest: int = SCHEMA_VERSION) -> Column:
    """A schema version given as text or number; an error where it is no whole number or newer than known."""
    number = version.cast("string").try_cast("int")
    return F.when(number <= newest, number).otherwise(F.raise_error(F.lit("UNKNOWN_SCHEMA")).cast("int"))


def versioned(old_label: Column, old_hash: Column, new_label: Column, new_hash: Column) -> Column:
    """'same' or 'changed'; an error where a label and the content it stands for don't change together."""
    same_label, same_hash = old_label == new_label, old_hash == new_hash
    torn = F.raise_error(F.when(same_label, F.lit("CONTENT_CHANGED_UNDER_LABEL")).otherwise(F.lit("LABEL_CHANGED_WITHOUT_CONTENT"))).cast("string")
    return F.when(same_label != same_hash, torn).otherwise(F.when(same_hash, "same").otherwise("changed"))


def within_budget(queries: DataFrame, budget: int, owner: str, order: str = "seq") -> DataFrame:
    """queries with place, 1, 2 ... along order, and allowed: the first `budget` of an owner's queries are.

    (owner, order) must be unique and order a whole number: an owner's queries are numbered in blocks, however many there are.
    """
    numbered = blocked_number(queries, owner, order, "place")
    return numbered.withColumn("place", F.col("place") + 1).withColumn("allowed", F.col("place") <= budget)


def tier_map(document: Column) -> Column:
    """JSON text of an object from tier to boolean as map<string, boolean>; an error for anything else. Null stays null."""
    doc = F.try_parse_json(document)
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    kinds = F.map_values(F.from_json(document, "MAP<STRING, STRING>"))
    sound = is_object & F.forall(kinds, lambda v: F.coalesce(v.isin("true", "false"), F.lit(False))) & ~F.array_contains(F.map_keys(F.from_json(document, "MAP<STRING, STRING>")), "")
    # a text "true" is no boolean
    sound = sound & ~document.rlike(r':\s*"')
    good = F.from_json(document, "MAP<STRING, BOOLEAN>")
    return F.when(document.isNull(), None).when(sound, good).otherwise(F.raise_error(F.lit("BAD_TIER_MAP")).cast("map<string,boolean>"))


def is_number(document: Column) -> Column:
    """Whether JSON text is a number; a boolean is none."""
    kind = F.schema_of_variant(F.try_parse_json(document))
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))


def number(document: Column) -> Column:
    """JSON text of a number as double; null for null, an error for anything else."""
    value = F.try_variant_get(F.try_parse_json(document), "$", "double")
    return F.when(document.isNull() | (document == "null"), None).when(is_number(document), value).otherwise(F.raise_error(F.lit("NOT_A_NUMBER")).cast("double"))


@F.pandas_udf(ArrayType(StringType()))
def string_leaves(document: pd.Series) -> pd.Series:
    """All texts that stand as values in a JSON document, in order, numbers as texts; text that isn't JSON is one leaf."""

    def leaves(text):
        if text is None:
            return None
        try:
            stack, out = [json.loads(text)], []
        except (ValueError, RecursionError):
            return [text]
        while stack:
            value = stack.pop()
            if isinstance(value, dict):
                stack.extend(reversed(list(value.values())))
            elif isinstance(value, list):
                stack.extend(reversed(value))
            elif isinstance(value, str):
                out.append(value)
            elif value is not None and not isinstance(value, bool):
                out.append(json.dumps(value))
        return [x for x in out if x]

    return document.map(leaves)


def task_export(puzzles: DataFrame, prompts: DataFrame) -> DataFrame:
    """(puzzle_id, task): each puzzle with its prompt(puzzle_id, prompt) as a task for another harness: repeats and limits."""
    task = F.struct(
        F.col("puzzle_id").alias("name"), F.array(F.struct(F.col("prompt").alias("input"))).alias("dataset"), F.col("min_k").alias("epochs"),
        F.col("time_budget_seconds").alias("time_limit"), F.col("tool_call_budget").alias("message_limit"), F.struct("puzzle_class", "capability_aspect").alias("metadata"),
    )
    return puzzles.join(prompts, "puzzle_id", "left").select("puzzle_id", task.alias("task"))
