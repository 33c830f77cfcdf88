"""Reading model output and model names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variants a router appends to a served model id.
VARIANTS = (":free", ":nitro", ":floor", ":extended", ":thinking", ":online", ":beta")
#: Vendors and family names, and the family they belong to.
FAMILIES = {
    "deepseek": "deepseek", "qwen": "qwen", "mistral": "mistral", "mistralai": "mistral", "google": "google", "gemini": "google",
    "openai": "openai", "gpt": "openai", "anthropic": "anthropic", "claude": "anthropic", "meta-llama": "meta", "meta": "meta",
    "llama": "meta", "x-ai": "xai", "xai": "xai", "grok": "xai", "cohere": "cohere", "nvidia": "nvidia", "nemotron": "nvidia",
    "microsoft": "microsoft", "phi": "microsoft",
}
#: How a control token begins and ends, and the tokens and the channel that say where an answer stands.
OPEN, CLOSE, CHANNEL, MESSAGE, FINAL = "<|", "|>", "channel", "message", "final"


def _found(text: Column) -> Column:
    return F.when(text != "", text)


def verdict(text: Column) -> Column:
    """The first PASS or FAIL, in any letter case."""
    return _found(F.upper(F.regexp_extract(text, r"(?iU)\b(PASS|FAIL)\b", 1)))


def choice(text: Column, gold: Column) -> Column:
    """The first A or B standing alone where gold is one of them, else the verdict; capitals only."""
    return F.when(F.upper(gold).isin("A", "B"), _found(F.regexp_extract(text, r"(?U)\b([AB])\b", 1))).otherwise(verdict(text))


def as_number(answer: Column) -> Column:
    """1 for PASS or A, else 0, also for null."""
    return F.when(answer.isin("PASS", "A"), 1).otherwise(0)


def local_model(name: Column) -> Column:
    """A served model's name without :latest and one cloud suffix."""
    return F.regexp_replace(F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit(":latest"), F.lit("")), r"(-cloud|:cloud)$", "")


def routed_model(name: Column, prefix: str = "openrouter:") -> Column:
    """A routed model's id without prefix, one variant and a date of eight digits."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    bare = F.when(low.startswith(prefix), F.right(low, F.length(low) - len(prefix))).otherwise(low)
    return F.regexp_replace(F.regexp_replace(bare, "(" + "|".join(VARIANTS) + ")$", ""), r"-\d{8}\b", "")


def family(name: Column) -> Column:
    return F.lower(F.trim(name))


def canonical_family(name: Column) -> Column:
    """The family that a vendor or family name belongs to; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.try_element_at(table, family(name))


def family_mismatch(vendor: Column, declared: Column) -> Column:
    """Whether both names are known and belong to different families."""
    return F.coalesce(canonical_family(vendor) != canonical_family(declared), F.lit(False))


def spec_model(spec: Column) -> Column:
    """A spec up to its last @."""
    return F.regexp_replace(spec, "@[^@]*$", "")


def spec_family(spec: Column) -> Column:
    """What stands after a spec's last @, if anything does."""
    return _found(F.trim(F.regexp_extract(spec, "@([^@]*)$", 1)))


def is_alias(model: Column) -> Column:
    """Whether a model id pins no version: it has no digit."""
    return ~model.rlike("[0-9]")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_control(text: Column) -> Column:
    """Model text without leaked control tokens: the last final channel's message, else what follows the last message
    mark, else all but the tokens; text without tokens stays as it is.

    The text is parted at the tokens; a part is a token's name and what stands between it and the next one.
    """
    parts = F.split(text, r"<\|(?=[^|>]*\|>)")
    named = F.transform(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), lambda x: F.struct(
        F.substring_index(x, CLOSE, 1).alias("token"), F.substring(x, F.locate(CLOSE, x) + len(CLOSE), F.length(x)).alias("said")))
    before = lambda i: F.get(named, i - 1)
    answers = F.filter(named, lambda x, i: (x["token"] == MESSAGE) & (before(i)["token"] == CHANNEL) & (_trimmed(before(i)["said"]) == FINAL))
    # a message's rest is told by the number of messages before it
    last = F.aggregate(named, F.array().cast("array<string>"), lambda kept, x: F.when(x["token"] == MESSAGE, F.array(x["said"])).otherwise(F.concat(kept, F.array(x["said"]))))
    has_message = F.exists(named, lambda x: x["token"] == MESSAGE)
    rest = F.when(has_message, F.array_join(last, "")).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(last, "")))
    return F.when(F.size(parts) <= 1, text).otherwise(_trimmed(F.coalesce(F.try_element_at(answers, F.lit(-1))["said"], rest)))


def assistant_text(response: Column) -> Column:
    """The text of a JSON response: its message's content, else its response member, else empty."""
    return F.coalesce(F.get_json_object(response, "$.message.content"), F.get_json_object(response, "$.response"), F.lit(""))


def _number(document: Column, path: str) -> Column:
    v = F.try_variant_get(document, path, "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def first_logprob(response: Column) -> Column:
    """The first token's log probability in any of three shapes of response; booleans are no numbers."""
    doc = F.try_parse_json(response)
    has = lambda path: F.try_variant_get(doc, path, "variant").isNotNull()
    return (
        F.when(has("$.logprobs[0]"), _number(doc, "$.logprobs[0].logprob"))
        .when(has("$.message.logprobs[0]"), _number(doc, "$.message.logprobs[0].logprob"))
        .otherwise(_number(doc, "$.choices[0].logprobs.content[0].logprob"))
    )


def probability(logprob: Column) -> Column:
    """exp of a log probability, within [0, 1]; null stays null."""
    return F.when(logprob.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(logprob))))


def tool_calls(response: Column) -> Column:
    """A response's native tool calls as array<struct<name, arguments>>; arguments are JSON text of an object, {} otherwise."""
    raw = F.from_json(F.get_json_object(response, "$.message.tool_calls"), "ARRAY<STRUCT<function: STRING>>")
    one = lambda c: F.struct(F.get_json_object(c["function"], "$.name").alias("name"), F.get_json_object(c["function"], "$.arguments").alias("arguments"))
    named = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<struct<function:string>>")), one), lambda c: c["name"].isNotNull() & (c["name"] != ""))
    is_object = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return F.transform(named, lambda c: F.struct(c["name"].alias("name"), F.when(is_object(c["arguments"]), c["arguments"]).otherwise("{}").alias("arguments")))


def action(text: Column) -> Column:
    """struct<verb, operand, content> of the first line that starts with FINAL, or with ACTION and a known verb."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)<\|.*", ""), r"^\s+|\s+$", ""))
    known = r"^(?i)(FINAL|ACTION\s*(read_file|exec|write_file)\s+\S)"
    line = F.try_element_at(F.filter(lines, lambda x: x.rlike(known)), F.lit(1))
    final = F.upper(line).startswith("FINAL")
    verb = F.when(final, "FINAL").otherwise(F.lower(F.regexp_extract(line, r"^(?i)ACTION\s*(\w+)", 1)))
    rest = F.when(final, F.regexp_extract(line, r"^(?i)FINAL\s*(.*)$", 1)).otherwise(F.regexp_extract(line, r"^(?i)ACTION\s*\w+\s+(.*)$", 1))
    is_write = verb == "write_file"
    operand = F.when(is_write, F.trim(F.regexp_extract(rest, r"^(.*?)(:::|$)", 1))).otherwise(rest)
    content = F.when(is_write, F.trim(F.regexp_extract(rest, r":::(.*)$", 1)))
    return F.when(line.isNotNull(), F.struct(verb.alias("verb"), operand.alias("operand"), content.alias("content")))


#: Names models give to the three verbs and to a final answer.
VERBS = {
    "read_file": ("read_file", "read", "readfile", "open", "cat"),
    "exec": ("exec", "run", "shell", "bash", "command", "sh"),
    "write_file": ("write_file", "write", "writefile", "save"),
    "FINAL": ("final_answer", "final", "answer", "finish", "submit", "done"),
}


def native_verb(name: Column) -> Column:
    """The verb that a native tool name stands for, null for unknown ones."""
    table = F.create_map(*[F.lit(x) for verb, names in VERBS.items() for n in names for x in (n, verb)])
    return F.try_element_at(table, F.lower(F.trim(name)))


#: Names models give to the operands of the verbs, the first that isn't empty counts.
OPERANDS = {
    "read_file": {"path": ("path", "file", "filename")},
    "exec": {"command": ("command", "cmd", "script")},
    "write_file": {"path": ("path", "file", "filename"), "content": ("content", "text")},
    "FINAL": {"answer": ("answer", "final", "text", "value")},
}


def native_action(name: Column, arguments: Column) -> Column:
    """struct<verb, operand, content> of a native tool call whose arguments are JSON text; null for unknown names and for verbs without the
    operand they need (a final answer may be empty)."""
    first = lambda names: F.coalesce(*[_found(F.get_json_object(arguments, f"$.{n}")) for n in names])
    verb = native_verb(name)
    pick = lambda member: F.coalesce(*[F.when(verb == v, first(of[member])) for v, of in OPERANDS.items() if member in of])
    operand = F.coalesce(pick("path"), pick("command"), F.when(verb == "FINAL", F.coalesce(pick("answer"), F.lit(""))))
    content = F.when(verb == "write_file", F.coalesce(pick("content"), F.lit("")))
    return F.when(operand.isNotNull(), F.struct(verb.alias("verb"), operand.alias("operand"), content.alias("content")))
