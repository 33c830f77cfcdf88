"""Deeply nested semi-structured reports as related flat tables.

Method: a schema is inferred and merged over all bodies: which members hold arrays of objects, what fields their entries have, and
which objects are maps, whose keys are data. By it each body is taken apart, recursively: each level of arrays, and of objects that
stand for such a level (a map by key, or one entry alone), becomes a child table, named by its member, whose rows carry their
surrogate key, the parent's, and their ordinal; scalars and plain sub-objects become columns of the row they belong to. An
array that was not foreseen becomes a table like any other.

The schema is merged by member name, so a level is known at whatever depth and in whatever wrapping it stands, and an object kept alone is told from
a map by the fields that the entries of the same member have in other bodies. Bodies have no fixed schema and nest to unknown depth, also
as JSON inside strings: from_json needs one schema and variant_explode one join per level, so the exploding runs as one pass of
Arrow batches; bodies aren't shuffled before the final distinct, unless the schema is too large to be broadcast: then each is joined with its part of it.

Defined results: a null, empty or invalid body (also NaN, or nesting beyond Python's limit) gives no
rows; blank lines and a byte-order mark around a body don't count; repeated rows give the same
keys; an object's repeated member counts once, with its last value; children without key are kept in the
flat tables, but are no cases; a whole number of 4000 digits or more is kept as text.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import cut
from tallymill.skew import spread_join

#: The mapping of the three kinds of cases: under which member their entries stand, the entry's own key, and the members that name its parent.
CASES = {"per_item": ("per_item", "id", ("spec",)), "findings": ("finding", "claim", ("question", "claim"))}
LABELS, ITEM, ANNOTATOR, VERDICT, VOTES = "labels", "item_id", ("annotator", "annotator_id"), "verdict", ("verdicts", "labels", "votes")
#: Members that name an entry of any other table, the first that is there.
NAMES = ("id", "spec", "question", "claim", ITEM)
#: A merged schema whose names have up to so many characters, counted, is broadcast whole; of a larger one each body gets the part it asks for.
SCHEMA_CHARS = 4_000_000
#: What a fact of the schema counts besides its names.
FACT_CHARS = 50
#: From so many rows on a batch of names that bodies ask for is handed on.
ASKED_ROWS = 100_000
#: Objects with more members than this over all bodies are named maps in what infer_schema shows.
MAX_FIELDS = 64
AROUND = " \t\r\n\f\v\u00a0\u2028\u2029\u200b\ufeff"

ROWS = (
    "report_id BIGINT, branch STRING, row_id BIGINT, parent_row_id BIGINT, ordinal BIGINT, "
    "parent_key STRING, child_key STRING, is_case BOOLEAN, members STRING"
)
FACTS = "member STRING, fact STRING, field STRING"
ASKED = "digest STRING, member STRING, field STRING"
PATHS = "path STRING, type STRING, n BIGINT"


def _reject(name: str):
    raise ValueError(name)


def _whole(digits: str):
    return int(digits) if len(digits) < 4000 else digits


def decoded(text: str | None):
    """(True, value) of valid JSON, else (False, None)."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text.strip(AROUND), parse_constant=_reject, parse_int=_whole)
    except (ValueError, RecursionError):
        return False, None


def opened(value):
    """value, or the object or array that a string of JSON holds, also one that is quoted again."""
    inner = value
    while isinstance(inner, str) and inner.strip(AROUND)[:1] in ("{", "[", '"'):
        ok, inner = decoded(inner)
        if not ok:
            return value
    return inner if isinstance(inner, (dict, list)) else value


def _text(value) -> str | None:
    """A key in text form; characters that UTF-8 can't carry become '?'."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode("utf-8")


class Merged:
    """The schema merged over all bodies, or the part of it that one body asks for: fields of the entries of each member that holds arrays of objects, and
    the members that hold maps."""

    def __init__(self, fields: dict[str, set[str]], maps: set[str]):
        self.fields, self.maps = fields, maps


    @staticmethod
    def of(facts) -> Merged:
        """From rows of FACTS."""
        fields: dict[str, set[str]] = {}
        for member, fact, field in facts:
            if fact != "map":
                fields.setdefault(member, set()).update([field] if fact == "field" else [])
        return Merged(fields, {member for member, fact, _ in facts if fact == "map"})


def _facts(root, out: set) -> None:
    """Adds what a body shows of each member: (member, 'list'), (member, 'field', name) of its arrays' entries, (member, 'map')."""
    stack = [(root, "")]
    while stack:
        value, member = stack.pop()
        value = opened(value)
        if isinstance(value, list):
            for entry in map(opened, value):
                if isinstance(entry, dict):
                    out.add((member, "list", ""))
                    out.update((member, "field", k) for k in entry if k.isidentifier())
                    stack.extend((v, k if k.isidentifier() else "*") for k, v in entry.items())
                elif isinstance(entry, list):
                    stack.append((entry, member))
        elif isinstance(value, dict):
            if any(not k.isidentifier() for k in value):
                out.add((member, "map", ""))
            stack.extend((v, k if k.isidentifier() else "*") for k, v in value.items())


def _in_schema(name: str) -> bool:
    """Whether a schema can have the name: others are data keys, and count as '*'."""
    return name.isidentifier() or name in ("", "*")


def _asked(root) -> set[tuple[str, str]]:
    """The (member, field) that taking a body apart can look up in the schema: of each object kept under a member, the member (field ''), the names of the
    object's members, and these as fields."""
    out: set = set()
    stack = [(root, None)]
    while stack:
        value, member = stack.pop()
        value = opened(value)
        if isinstance(value, list):
            stack.extend((v, None) for v in value)
        elif isinstance(value, dict):
            if member is not None and _in_schema(member):
                names = [k for k in value if _in_schema(k)]
                out.update((k, "") for k in (member, *names))
                out.update((member, k) for k in names)
            stack.extend((v, k) for k, v in value.items())
    return out


def schema_facts(df: DataFrame, body_col: str = "body") -> DataFrame:
    """The schema merged over all bodies of df, whole, one row per fact: (member, 'list' | 'map', '') and (member, 'field', name)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: set = set()
            for body in batch["body"]:
                ok, root = decoded(body)
                if ok:
                    _facts(root, out)
            yield pd.DataFrame([(_text(m), f, _text(k)) for m, f, k in out], columns=["member", "fact", "field"])

    return df.select(F.col(body_col).cast("string").alias("body")).where("body IS NOT NULL").mapInPandas(run, FACTS).distinct()


def parts_of_schema(source: DataFrame, facts: DataFrame) -> DataFrame:
    """source(report_id, body) with schema: the facts that a body asks for, as JSON, null where there are none. Names that many bodies ask for, and bodies of
    many copies, are salted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, body in zip(batch["digest"], batch["body"]):
                ok, root = decoded(body)
                rows.extend((digest, m, k) for m, k in (_asked(root) if ok else ()))
                if len(rows) >= ASKED_ROWS:
                    yield pd.DataFrame(rows, columns=["digest", "member", "field"])
                    rows = []
            yield pd.DataFrame(rows, columns=["digest", "member", "field"])

    keyed = source.withColumn("digest", F.md5("body"))
    asked = keyed.select("digest", "body").mapInPandas(run, ASKED)
    # one row for each name, of a member with both kinds of facts; also for names that are in no schema, which may be hot
    named = facts.groupBy("member", "field").agg(F.array_sort(F.collect_set("fact")).alias("kinds"))
    sizes = asked.groupBy("member", "field").agg(F.count("*").alias("n_asked"))
    known = spread_join(asked, cut(named.join(sizes, ["member", "field"], "right")), ["member", "field"], "n_asked", F.col("digest")).where("kinds IS NOT NULL")
    # no more than a body has names
    parts = known.groupBy("digest").agg(F.to_json(F.collect_set(F.struct("member", "kinds", "field"))).alias("schema"))
    copies = keyed.groupBy("digest").agg(F.count("*").alias("n_copies"))
    parts = cut(parts.join(copies, "digest"))
    return spread_join(keyed, parts, ["digest"], "n_copies", F.col("report_id"), "left").select("report_id", "body", "schema")


def _entries(value, key: str, fields: set[str]):
    """(ordinal, own key, entry) of a child level in any of its shapes: list, map by key, or one entry alone, which has the level's key or its fields."""
    value = opened(value)
    if isinstance(value, dict):
        if key in value or ((fields - {key}) & value.keys() and not all(isinstance(v, dict) for v in value.values())):
            value = [value]
        else:
            for i, (name, entry) in enumerate(value.items()):
                entry = opened(entry)
                if isinstance(entry, dict):
                    yield i, entry.get(key, name), entry
            return
    if isinstance(value, list):
        for i, entry in enumerate(value):
            entry = opened(entry)
            if isinstance(entry, dict):
                yield i, entry.get(key), entry
            elif isinstance(entry, list):
                for _, own, inner in _entries(entry, key, fields):
                    yield i, own, inner
            elif isinstance(entry, str) and key == "claim":
                yield i, entry, {}
    elif isinstance(value, str) and key == "claim":
        yield 0, value, {}


def _votes(value):
    """(annotator, verdict) of one item's labels, kept as a map or as a list."""
    value = opened(value)
    if isinstance(value, dict):
        for annotator, verdict in value.items():
            verdict = opened(verdict)
            yield annotator, verdict.get(VERDICT) if isinstance(verdict, dict) else verdict
    elif isinstance(value, list):
        for entry in map(opened, value):
            if isinstance(entry, dict):
                named = next((entry[k] for k in ANNOTATOR if k in entry), entry)
                if named is entry:
                    yield from _votes(entry)
                else:
                    yield named, entry.get(VERDICT)


def _items(value):
    """(ordinal, item id, votes) of a labels member, kept as a map or as a list."""
    value = opened(value)
    if isinstance(value, dict):
        if ITEM in value:
            value = [value]
        else:
            for i, (item, votes) in enumerate(value.items()):
                yield i, item, list(_votes(votes))
            return
    if isinstance(value, list):
        for i, entry in enumerate(map(opened, value)):
            if not isinstance(entry, dict):
                continue
            if ITEM not in entry:
                for item, votes in entry.items():
                    yield i, item, list(_votes(votes))
            elif ANNOTATOR[0] in entry:
                yield i, entry[ITEM], [(entry[ANNOTATOR[0]], entry.get(VERDICT))]
            else:
                inner = next((entry[k] for k in VOTES if k in entry), None)
                yield i, entry[ITEM], list(_votes(inner))


def _is_level(value) -> bool:
    return isinstance(value, list) and any(isinstance(opened(v), (dict, list)) for v in value)


class _Shredder:
    """The rows of one body's flat tables."""

    def __init__(self, report_id, digest: int, schema: Merged):
        self.report_id, self.schema = report_id, schema
        self.base = f"{report_id}\0{digest}\0"
        self.rows: list[list] = []
        self.columns: list[dict] = []

    def add(self, branch, parent, ordinal, parent_key, key, case, columns) -> int:
        above = None if parent is None else self.rows[parent][2]
        row_id = xxhash.xxh64_intdigest(f"{self.base}{len(self.rows)}") - (1 << 63)
        self.rows.append([self.report_id, branch, row_id, above, ordinal, _text(parent_key), _text(key), case])
        self.columns.append(columns)
        return len(self.rows) - 1

    def shred(self, root) -> list[tuple]:
        self.add("report", None, 0, None, None, False, {})
        # (value, the row it belongs to, whether the row stands for the value itself, the name it was kept under, a prefix of its columns' names)
        stack = [(root, 0, isinstance(root, dict), None, "")]
        while stack:
            value, row, own, name, prefix = stack.pop()
            value = opened(value)
            if isinstance(value, list):
                stack.extend((v, row, False, None, prefix) for v in value)
            elif isinstance(value, dict):
                # an object that holds cases is a row of its own
                if not own and any(m in value for m in CASES):
                    row, own, prefix = self.add("object", row, 0, None, name, False, {}), True, ""
                for member, inner in value.items():
                    stack.extend(self._member(value, row, own, name, prefix, member, opened(inner)))
        return [(*r, _text(json.dumps(c, ensure_ascii=False))) for r, c in zip(self.rows, self.columns)]

    def _member(self, value, row, own, name, prefix, member, inner):
        """Adds the rows and columns of one member, and gives what is to be taken apart next."""
        if member in CASES:
            branch, key, parents = CASES[member]
            entry_of_its_own = self.rows[row][1] == branch
            above = next((value[k] for k in parents if k in value), None if entry_of_its_own else name)
            if not entry_of_its_own and self.rows[row][6] is None:
                self.rows[row][6] = _text(above)
            for ordinal, child, entry in _entries(inner, key, self.schema.fields.get(member, set())):
                at = self.add(branch, row, ordinal, above, child, child is not None, {})
                yield entry, at, True, None, ""
        elif member == LABELS:
            for ordinal, item, votes in _items(inner):
                at = self.add("item", row, ordinal, None, item, False, {})
                for i, (annotator, verdict) in enumerate(votes):
                    case = verdict is not None and annotator is not None and item is not None
                    self.add("label", at, i, item, annotator, case, {VERDICT: None if isinstance(verdict, (dict, list)) else verdict})
        elif _is_level(inner) or (isinstance(inner, dict) and member in self.schema.fields):
            yield from self._level(row, member, inner)
        elif isinstance(inner, dict) and (member in self.schema.maps or any(not k.isidentifier() for k in inner)):
            for i, (key, entry) in enumerate(inner.items()):
                entry = opened(entry)
                if isinstance(entry, (dict, list)):
                    at = self.add(member, row, i, None, key, False, {})
                    yield entry, at, isinstance(entry, dict), key, ""
                else:
                    self.columns[row][f"{prefix}{member}.{key}"] = entry
        elif isinstance(inner, dict):
            yield inner, row, False, member, f"{prefix}{member}."
        else:
            self.columns[row][f"{prefix}{member}"] = inner

    def _level(self, row, member, inner):
        """The rows of a child table: an array's entries, those of a map by key, or one entry alone."""
        if isinstance(inner, dict):
            # a map has objects only, under keys that aren't known as fields or levels
            known = self.schema.fields[member] | self.schema.fields.keys() | CASES.keys() | {LABELS}
            alone = bool(known & inner.keys()) or not all(isinstance(opened(v), dict) for v in inner.values())
            entries = [(None, inner)] if alone else list(inner.items())
        else:
            entries = [(None, v) for v in inner]
        for i, (key, entry) in enumerate(entries):
            entry = opened(entry)
            named = key
            if isinstance(entry, dict) and key is None:
                named = next((entry[k] for k in NAMES if k in entry and not isinstance(entry[k], (dict, list))), None)
            at = self.add(member, row, i, None, named, False, {} if isinstance(entry, (dict, list)) else {"value": entry})
            if isinstance(entry, (dict, list)):
                yield entry, at, isinstance(entry, dict), key, ""


def shred(report_id, body: str | None, schema: Merged) -> list[tuple]:
    """All rows of one body's flat tables."""
    ok, root = decoded(body)
    if not ok:
        return []
    return _Shredder(report_id, xxhash.xxh64_intdigest(body.encode("utf-8", "replace")), schema).shred(root)


def flatten_reports(df: DataFrame, id_col: str = "report_id", body_col: str = "body", schema_chars: int = SCHEMA_CHARS) -> DataFrame:
    """The flat tables of all bodies, told apart by branch: report, per_item, item, label, finding, and one for each other level, named by its member.

    row_id is the surrogate key, a hash of report, body and place; parent_row_id the parent's. The schema is used whole, however many members and fields it
    has: broadcast up to schema_chars characters (counted), joined to the bodies that ask for it beyond.
    """
    source = df.select(F.col(id_col).cast("bigint").alias("report_id"), F.col(body_col).cast("string").alias("body")).where("report_id IS NOT NULL AND body IS NOT NULL")
    facts = cut(schema_facts(source))
    chars = facts.agg(F.sum(F.char_length("member") + F.char_length("field") + F.lit(FACT_CHARS))).first()[0] or 0
    whole = chars <= schema_chars
    shared = df.sparkSession.sparkContext.broadcast(Merged.of(facts.collect()) if whole else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ROWS.split(", ")]
        for batch in batches:
            if whole:
                schemas = itertools.repeat(shared.value)
            else:
                schemas = (Merged.of([(p["member"], kind, p["field"]) for p in json.loads(s or "[]") for kind in p["kinds"]]) for s in batch["schema"])
            rows = [r for i, b, schema in zip(batch["report_id"], batch["body"], schemas) for r in shred(i, b, schema)]
            out = pd.DataFrame(rows, columns=names)
            out["parent_row_id"] = pd.array([r[3] for r in rows], dtype="Int64")
            yield out

    return (source if whole else parts_of_schema(source, facts)).mapInPandas(run, ROWS)


def flat_table(flat: DataFrame, branch: str) -> DataFrame:
    """One of the flat tables, with its scalar members as a map."""
    rows = flat.where(F.col("branch") == branch)
    return rows.withColumn("members", F.from_json("members", "MAP<STRING,STRING>"))


def child_cases(flat: DataFrame) -> DataFrame:
    """The distinct children that have a key."""
    return flat.where("is_case").select("report_id", "branch", "parent_key", "child_key").distinct()


def infer_schema(df: DataFrame, body_col: str = "body", max_fields: int = MAX_FIELDS) -> DataFrame:
    """(path, types, n, kind): the schema merged over all bodies.

    Members whose names aren't plain words, and objects with more than max_fields members over all
    bodies, count as maps: their keys are data and become '*'.
    """

    def paths(value, path, out):
        stack = [(value, path)]
        while stack:
            value, path = stack.pop()
            value = opened(value)
            kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "long", float: "double"}.get(type(value), "null")
            out[path, kind] = out.get((path, kind), 0) + 1
            if kind == "object":
                stack.extend((v, f"{path}.{k if k.isidentifier() else '*'}") for k, v in value.items())
            elif kind == "array":
                stack.extend((v, f"{path}[]") for v in value)

    def run(batches):
        for batch in batches:
            out: dict = {}
            for body in batch["body"]:
                ok, root = decoded(body)
                if ok:
                    paths(root, "$", out)
            yield pd.DataFrame([(_text(p), t, n) for (p, t), n in out.items()], columns=["path", "type", "n"])

    counts = df.select(F.col(body_col).cast("string").alias("body")).where("body IS NOT NULL").mapInPandas(run, PATHS)
    merged = counts.groupBy("path").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("n")
    )  # seven types at most
    parents = merged.select(F.regexp_extract("path", r"^(.*)\.[^.\[\]]+$", 1).alias("path")).groupBy("path").agg(F.count("*").alias("fields"))
    kind = (
        F.when((F.col("fields") > max_fields) | F.col("path").endswith("*"), "map entry")
        .when(F.array_contains("types", "array"), "child table")
        .when(F.array_contains("types", "object"), "struct")
        .otherwise("column")
    )
    return merged.join(parents, "path", "left").select("path", "types", "n", kind.alias("kind"))
