"""Broken prompt and response pairs: each defective pair with its type of defect.

Method: a response is split into clauses, a linear-chain conditional random field tags each clause as
answer, refusal, echo, foreign, unfinished, or as nothing said, and the share of text that each tag covers decides the pair's defect. No
rule stands beside the field: what is known of a clause enters as a feature, whose weight is learned.

No labels come with the data, so the field is trained on sequences whose tags are known by
construction, made from a bounded sample of rows (TRAIN_ROWS): complete responses in the asked
language (answer); prompts or their parts given back (echo); responses to prompts of another language, or in
another script (foreign); complete responses cut short (unfinished); layout, empty structures and words for nothing, put together by
rule (nothing). Refusals are short responses that end properly, hold
no choice, name none of the persons, repeat nothing of the prompt and were marked as unparsed; their wording is learned. parsed and err are known to
mislead and take no part in tagging.

Defined results: rows with result DROPPED and null pair ids give no rows; a null or blank raw, or one
of which all clauses say nothing, is 'empty'; with a null
prompt neither echo nor language can be told; a repeated pair_id gives the smallest defect name; one defect a pair, in
the order empty, echo, refusal, truncated, language; whole texts are used, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.crf import Crf
from tallymill.llm.language import LATIN_LANGUAGES, asked_language, detect, scores

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished", "nothing")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, NOTHING = range(len(TAGS))
#: Rows sampled for training, by hash of pair_id, of those whose texts have at most TRAIN_CHARS characters; more rows in the table don't make
#: the driver read more. All rows and whole texts are tagged.
TRAIN_ROWS = 3000
TRAIN_CHARS = 4000
HASHED = 1024
#: Sequences a step of training looks at, and steps.
BATCH, STEPS = 256, 360
#: Refusals are rare among the sampled rows: each counts so many times.
REFUSAL_COPIES = 6
#: Words beside the repeated prompt that add nothing of substance, at most.
ECHO_WORDS = 8

#: Words that introduce a choice.
CHOICE_WORDS = r"answer|choice|choose|verdict|final answer|option|respuesta|elijo|opción|antwort|wähle|resposta|escolho|réponse|choisis|risposta|scelgo|winner"
#: Words for nothing, and what stands around an answer or nothing.
NO_WORDS = "n/a na none null nil nan undefined empty no answer response output".split()
FRAMES = ("{}", "`{}`", '"{}"', "<answer>{}</answer>", "Answer: {}", "Response: {}", '{{"answer": "{}"}}', '{{"answer": {}}}', "```\n{}\n```", "```json\n{}\n```", "({})", "**{}**", "[{}]", "{}.")
EMPTIES = ("", "N/A", "null", "None", "nil", "NaN", "undefined", "empty", "no answer", "no response", "n/a", "...", "-", "{}", "[]", "null\nnull", "[null]")
THINK = re.compile(r"<(think|thinking|reasoning|scratchpad)>.*?</\1>", re.S | re.I)
_LETTER = r"[\[(\"'*_`]*\b[AB]\b[\])\"'*_`.]*"
_CHOICE = re.compile(
    rf"(?:\b(?:{CHOICE_WORDS})\b[^\n.]{{0,25}}?[\s:=\"'*]+{_LETTER}(?!\w))|(?:\b[AB]\b is (?:right|correct|the))|(?:^\s*{_LETTER}\s*$)|(?:(?<=[.!?:])\s+{_LETTER}\s*$)|<answer>\s*[AB]\s*</answer>|^\s*{_LETTER}\s*[:,-]",
    re.M | re.I,
)
_OPEN_CHOICE = re.compile(rf"(?:^|[\s*\[(\"'`:>]){_LETTER}\s*(?:</answer>)?\s*`*\s*$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)\]*]*\s+|(?<=[。！？।])\s*|\n+")
_SAID = re.compile(r"^\s*(?:user|human|question|prompt|you)?\s*(?:said|asked|wrote)?\s*[–—:>-]+\s*", re.I)
_ENDS = ".!?…。！？।"
_CLOSERS = "\"'”»’)]}*_` \t\r\n"
_TOKEN = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​‌‍⁠﻿]")


def _without_thoughts(raw: str) -> str:
    text = _INVISIBLE.sub("", raw)
    return THINK.sub(" ", text) if "</" in text else text


def clauses(raw: str) -> list[str]:
    """The clauses of a response in order; each keeps its end mark. Pieces without letters and digits count only where there is nothing else."""
    pieces = [c.strip() for c in _SPLIT.split(_without_thoughts(raw)) if c and not c.isspace()]
    return [c for c in pieces if any(x.isalnum() for x in c)] or pieces


def unclosed(raw: str) -> bool:
    """Whether a structure that the response opened isn't closed."""
    text = raw.strip()
    if text.startswith(("{", "[")) and not re.match(r"\[[AB]\]", text):
        try:
            json.loads(text)
            return False
        except (ValueError, RecursionError):
            return text[-1:] not in "}]" or text.count("{") > text.count("}")
    low = text.lower()
    return text.count("```") % 2 == 1 or any(low.count(f"<{tag}>") > low.count(f"</{tag}>") for tag in ("answer", "think", "thinking", "final"))


def _ended(clause: str) -> bool:
    """Whether a last clause ends like a sentence, a choice or a bare name."""
    if clause.rstrip(_CLOSERS)[-1:] in _ENDS:
        return True
    if _OPEN_CHOICE.search(clause):
        return True
    if clause.rstrip()[-1:] in "}":
        return True
    return False


_NO_WORDS = frozenset(NO_WORDS) | frozenset("a json text xml final think thinking choice".split())


def _hashed(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "replace"))


_remembered = functools.lru_cache(maxsize=300_000)(_hashed)


def _hash(word: str) -> int:
    """Words of usual length are hashed once."""
    return _remembered(word) if len(word) <= 40 else _hashed(word)


class Prompt:
    """What a response's clauses are compared with."""

    def __init__(self, prompt: str | None):
        text = prompt or ""
        words = _TOKEN.findall(text.lower())
        self.known = set(words)
        self.twos, self.threes = set(zip(words, words[1:])), set(zip(words, words[1:], words[2:]))
        self.flat = f" {' '.join(words)} "
        self.names = {w.lower() for w in re.findall(r"\b[A-Z][a-z]{3,}\b", text)}
        self.asked = asked_language(text) if text else None


_read = functools.lru_cache(maxsize=512)(Prompt)


def _prompt(prompt: str | None) -> Prompt:
    """A prompt of usual length, which many responses may answer, is read once."""
    return _read(prompt) if prompt is None or len(prompt) <= 4000 else Prompt(prompt)


N_DENSE = 25
#: The feature that says that a clause stands in the prompt word for word.
WHOLE = 3


def features(prompt: str | Prompt | None, raw: str) -> Iterator[tuple[str, list[float], list[int]]]:
    """(clause, dense features, hashed words) of each clause of a response."""
    parts = clauses(raw)
    ask = prompt if isinstance(prompt, Prompt) else _prompt(prompt)
    names, asked, latin = ask.names, ask.asked, ask.asked in LATIN_LANGUAGES
    is_known, is_two, is_three = ask.known.__contains__, ask.twos.__contains__, ask.threes.__contains__
    broken = unclosed(raw)
    for i, part in enumerate(parts):
        low = part.lower()
        words = _TOKEN.findall(low)
        n_words = len(words)
        said = " ".join(words)
        within = f" {said} " in ask.flat
        inside = sum(map(is_three, zip(words, words[1:], words[2:]))) / (n_words - 2) if n_words > 2 else float(n_words > 0 and within)
        two = sum(map(is_two, zip(words, words[1:]))) / (n_words - 1) if n_words > 1 else 0.0
        by, n = scores(part, [w for w in words if w.isalpha()])
        script = latin and any(k not in LATIN_LANGUAGES for k in by)
        own = by.get(asked, 0.0) if asked else 0.0
        rest = max([v for k, v in by.items() if k != asked], default=0.0) if asked else 0.0
        last = i == len(parts) - 1
        ended = _ended(part) or (len(parts) == 1 and n_words <= 2)
        choice = ("a" in words or "b" in words) and bool(_CHOICE.search(part))  # all forms of a choice have the letter as a word
        whole = n_words >= 3 and within
        if n_words >= 3 and not whole and (spoken := _SAID.match(low)):
            bare = " ".join(_TOKEN.findall(low[spoken.end() :]))
            whole = bool(bare) and f" {bare} " in ask.flat
        empty_words = sum(map(_NO_WORDS.__contains__, words))
        named = names.intersection(words)
        ids = ["#" if w.isdigit() else w for w in words]
        if named:
            ids = ["@" if w in named else w for w in ids]
        ids = list(map(_hash, ids))
        yield part, [
            1.0,
            inside,
            inside > 0.8 and n_words >= 4,
            whole,
            part[:1] in "\"'“«>" or "“" in part or "«" in part,
            min(3.0, 6 * max(0.0, rest - own)) if n >= 3 or script else 0.0,
            min(3.0, 6 * max(0.0, own - rest)) if n >= 3 else 0.0,
            script,
            n < 3,
            last,
            last and not ended,
            last and broken,
            last and ended,
            choice,
            n_words <= 2,
            min(1.0, n_words / 30),
            bool(named),
            i == 0,
            sum(map(is_known, words)) / max(1, n_words),
            two,
            two > 0.6 and n_words >= 4,
            not words,
            empty_words == n_words,
            empty_words == n_words and not choice,
            whole and not choice,
        ], list({h % HASHED for h in ids}.union([(x * 31 + y) % HASHED for x, y in zip(ids, ids[1:])]))


def _matrix(dense: list[list[float]], hashed: list[list[int]]) -> np.ndarray:
    X = np.zeros((len(dense), N_DENSE + HASHED), dtype=np.float32)
    if len(X):
        X[:, :N_DENSE] = dense
        rows = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
        X[rows, np.fromiter((N_DENSE + h for hs in hashed for h in hs), dtype=np.int64, count=len(rows))] = 0.5
    return X


def _sound(prompt: str, raw: str) -> bool:
    """Whether a row can stand for complete answers: it ends with a choice, in the asked language, without echo."""
    parts = clauses(raw)
    if not parts or unclosed(raw) or not _CHOICE.search(raw) or not (_OPEN_CHOICE.search(parts[-1]) or _ended(parts[-1])):
        return False
    asked, spoken = asked_language(prompt), detect(raw)
    return spoken is None or asked is None or spoken == asked


def training_set(rows: list[tuple], seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, tags, lengths) of sequences with known tags, made of rows (prompt, raw, result)."""
    rng = np.random.default_rng(seed)
    dense: list[list[float]] = []
    hashed: list[list[int]] = []
    tags: list[int] = []
    lengths: list[int] = []

    def add(prompt, raw, tag, last=None, n_first=0, first=ECHO):
        made = list(features(prompt, raw))
        if made:
            of = [first] * min(n_first, len(made)) + [tag] * max(0, len(made) - n_first)
            # what an answer quotes of its prompt is given back like an echo; the verdict tells the two apart
            of = [ECHO if t == ANSWER and m[1][WHOLE] and len(_TOKEN.findall(m[0])) >= 4 else t for t, m in zip(of, made)]
            if last is not None:
                of[-1] = last
            dense.extend(m[1] for m in made)
            hashed.extend(m[2] for m in made)
            tags.extend(of)
            lengths.append(len(made))

    rows = [(p, r, s) for p, r, s in rows if p and r and r.strip()]
    sound = [(p, r) for p, r, _ in rows if _sound(p, r)]
    by_language: dict[str, list[str]] = {}
    for p, _ in sound:
        by_language.setdefault(asked_language(p) or "", []).append(p)
    for p, r in sound:
        add(p, r, ANSWER)
        if r.lstrip()[:1] in "{[`<" and len(r) > 40:
            short = r[: int(rng.integers(20, len(r) - 1))].rstrip()
            if unclosed(short):
                add(p, short, ANSWER, UNFINISHED)
        draw = rng.random()
        if draw < 0.25:
            parts = clauses(r)
            if len(parts[-1]) > 8 or len(parts) > 1:
                cut = int(rng.integers(max(1, len(r) // 5), max(2, len(r) - 1)))
                short = r[:cut].rstrip()
                if clauses(short) and (unclosed(short) or not _ended(clauses(short)[-1])):
                    add(p, short, ANSWER, UNFINISHED)
        elif draw < 0.45:
            others = [k for k in by_language if k and k != (detect(r) or "")]
            if others and len(_TOKEN.findall(r)) > 5:
                q = by_language[others[int(rng.integers(len(others)))]]
                of = q[int(rng.integers(len(q)))]
                add(of, r, FOREIGN)
                short = r[: int(rng.integers(max(1, len(r) // 3), len(r)))].rstrip()
                if rng.random() < 0.25 and clauses(short) and (unclosed(short) or not _ended(clauses(short)[-1])):
                    add(of, short, FOREIGN, UNFINISHED)
        elif draw < 0.65:
            parts = clauses(p)
            lo = int(rng.integers(len(parts))) if rng.random() < 0.5 else 0
            hi = int(rng.integers(lo, len(parts))) + 1 if rng.random() < 0.5 else len(parts)
            if lo + 1 == hi and rng.random() < 0.5:
                parts, lo, hi = parts[lo:hi] * 3, 0, 3
            mark = "\n> " if rng.random() < 0.15 else "\n" if rng.random() < 0.5 else " "
            given = mark.join(parts[lo:hi])
            if rng.random() < 0.2:
                given = " ".join(w for w in given.split(" ") if rng.random() > 0.12)
            if rng.random() < 0.15:
                given = given.lower()
            if len(_TOKEN.findall(given)) >= 4:
                add(p, ("User said – " if rng.random() < 0.3 else mark.strip("\n")) + given, ECHO)
                if rng.random() < 0.3:
                    add(p, given + "\n" + r, ANSWER, n_first=len(clauses(given)))
        elif draw < 0.75:
            frame, said = FRAMES[int(rng.integers(len(FRAMES)))], EMPTIES[int(rng.integers(len(EMPTIES)))]
            nothing = frame.format(said)
            add(p, nothing.upper() if rng.random() < 0.2 else nothing.lower() if rng.random() < 0.3 else nothing, NOTHING)
            if rng.random() < 0.3:
                add(p, nothing + "\n" + r, ANSWER, n_first=len(clauses(nothing)), first=NOTHING)
    for p, r, result in rows:
        parts, asked = clauses(r), asked_language(p)
        by, _ = scores(r)
        if asked in LATIN_LANGUAGES and max(by, key=by.get, default=asked) not in LATIN_LANGUAGES:
            add(p, r, FOREIGN)
            continue
        if result != "UNPARSED" or not 0 < len(parts) <= 3 or _CHOICE.search(r) or unclosed(r) or not _ended(parts[-1]):
            continue
        ask = Prompt(p)
        words = _TOKEN.findall(r.lower())
        inside = np.mean([g in ask.threes for g in zip(words, words[1:], words[2:])] or [1])
        if inside < 0.3 and len(words) >= 4 and not ask.names & set(words):
            for _ in range(REFUSAL_COPIES):
                add(p, r, REFUSAL)
    return _matrix(dense, hashed), np.array(tags, dtype=np.int64), np.array(lengths, dtype=np.int64)


def train(pairs: DataFrame, n_rows: int = TRAIN_ROWS, steps: int = STEPS) -> Crf:
    """The field, from at most n_rows rows picked by the hash of their pair_id. The sample is one task's input, and only the weights come to the driver."""
    picked = (
        pairs.where(f"length(raw) <= {TRAIN_CHARS} AND length(prompt) <= {TRAIN_CHARS} AND result IS DISTINCT FROM 'DROPPED'")
        .select("pair_id", "prompt", "raw", "result")
        .orderBy(F.xxhash64("pair_id"), "prompt", "raw")
        .limit(n_rows)
        .select("prompt", "raw", "result")
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(p, r, None if pd.isna(s) else s) for b in batches for p, r, s in zip(b["prompt"], b["raw"], b["result"])]
        X, tags, lengths = training_set(rows)
        if len(X):
            field = Crf(N_DENSE + HASHED, len(TAGS))
            field.fit(X, tags, lengths, -(-steps // -(-len(lengths) // BATCH)), batch=BATCH)
            yield pd.DataFrame({"weights": [field.W.tobytes()], "transitions": [field.T.tobytes()]})

    field = Crf(N_DENSE + HASHED, len(TAGS))
    for row in picked.coalesce(1).mapInPandas(fit, "weights BINARY, transitions BINARY").collect():
        field.W = np.frombuffer(row["weights"]).reshape(field.W.shape)
        field.T = np.frombuffer(row["transitions"]).reshape(field.T.shape)
    return field


def verdict(parts: list[str], tags: np.ndarray) -> str | None:
    """The defect that the tags' coverage of a response amounts to, or None."""
    said = tags != NOTHING
    if not len(parts) or not said.any():
        return "empty"
    size = np.array([len(p) for p in parts], dtype=float) * said
    cover = np.bincount(tags, size, len(TAGS)) / size.sum()
    own = [p for p, t in zip(parts, tags) if t == ANSWER]
    chosen = any(_CHOICE.search(p) for p in own)
    if cover[ECHO] > 0.5 and not chosen and sum(len(_TOKEN.findall(p)) for p in own) <= ECHO_WORDS:
        return "echo"
    if cover[REFUSAL] > 0 and not (chosen or cover[ANSWER] > 0.5) and cover[REFUSAL] >= cover[FOREIGN]:
        return "refusal"
    if tags[-1] == UNFINISHED:
        return "truncated"
    if cover[FOREIGN] > 0.5:
        return "language"
    return None


def tagged_defects(field: Crf, ids: list, prompts: list, raws: list) -> list[tuple]:
    """(pair_id, defect) of the defective ones among some pairs."""
    dense_W, hashed_W = field.W[:N_DENSE], 0.5 * field.W[N_DENSE:]
    parts: list[list[str]] = []
    rows, words = [], []
    E = []

    def score():
        if rows:
            at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            flat = np.fromiter((h for w in words for h in w), dtype=np.int64, count=at[-1])
            sums = np.concatenate([np.zeros((1, len(TAGS))), np.cumsum(hashed_W[flat], axis=0)])
            E.append(np.array(rows, dtype=float) @ dense_W + sums[at[1:]] - sums[at[:-1]])
            rows.clear()
            words.clear()

    for prompt, raw in zip(prompts, raws):
        text = None if raw is None or pd.isna(raw) else raw
        mine = []
        for part, row, hashed in features(None if prompt is None or pd.isna(prompt) else prompt, text) if text else ():
            mine.append(part)
            rows.append(row)
            words.append(hashed)
            if len(rows) >= 4096:
                score()
        parts.append(mine)
    score()
    lengths = np.array([len(m) for m in parts], dtype=np.int64)
    some = np.nonzero(lengths)[0]
    tags = field.decode(np.concatenate(E), lengths[some]) if len(some) else np.zeros(0, dtype=np.int64)
    at, out = 0, []
    for pair, mine in zip(ids, parts):
        defect = verdict(mine, tags[at : at + len(mine)])
        at += len(mine)
        if defect:
            out.append((pair, defect))
    return out


def defects(pairs: DataFrame, n_rows: int = TRAIN_ROWS, field: Crf | None = None) -> DataFrame:
    """(pair_id, defect) of the defective pairs, by a field that is given (Crf.load) or else trained on a sample of these pairs."""
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(field or train(pairs, n_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                some = batch.iloc[lo : lo + 500]
                rows = tagged_defects(shared.value, some["pair_id"].tolist(), some["prompt"].tolist(), some["raw"].tolist())
                yield pd.DataFrame(rows, columns=["pair_id", "defect"])

    rows = pairs.where("pair_id IS NOT NULL AND result IS DISTINCT FROM 'DROPPED'").select("pair_id", "prompt", "raw")
    found = rows.mapInPandas(run, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, defect STRING")
    return found.groupBy("pair_id").agg(F.min("defect").alias("defect"))
