"""Reading level of each document, on the scale of a sample's grades.

Method: a Rasch-style latent model links documents' levels t with words' difficulties. The chance that a
word of a document at level t is w is exp(a_w + b_w * t - A(t)): a word is likeliest where A'(t) = b_w,
which is the level it belongs to, and a document's estimated level is the t at which the
mean b of its words equals A'(t). Documents and words are estimated in turn: levels of all documents
given the words (one map over the corpus), then the words given all levels (one partial aggregation), until the words' slopes stand still; graded documents are held at their grade, which fixes the scale. Words are
hashed to BUCKETS buckets, so the word parameters that are broadcast and collected have a fixed size, whatever
the vocabulary. At last, cuts between levels are set on the graded documents.

Defined results: only running English prose counts (tallymill.llm.prose); a document with fewer than
MIN_WORDS words of it gives no row, nor do a null id and a null or empty text; grades that are null, outside LOW to HIGH or of unknown
documents are left out, several grades of a document are averaged; a repeated id gives its lowest level; without any
grades all documents get the same level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.prose import english_words
from tallymill.session import cut

MIN_WORDS = 80
BUCKETS = 1 << 17
#: The search ends when words' slopes move by less than this share of their size on average, each word counted as often as it occurs; ROUNDS only
#: guards against one that doesn't end.
TOLERANCE = 0.08
ROUNDS = 30
LOW, HIGH = 1, 4
#: Levels at which A is tabulated, and slopes between which a word's lies.
GRID = np.linspace(LOW - 0.5, HIGH + 0.5, 41)
SLOPES = np.linspace(-14, 14, 561)
#: A word is taken to occur so many times more, at the mean level.
PRIOR = 2.0
BINS = 160
COLUMNS = "doc_id {id}, n_words BIGINT, buckets BINARY, counts BINARY"


def buckets(words: list[str], memory: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the words that consist of letters."""
    memory = {} if memory is None else memory
    ids = []
    for w in words:
        b = memory.get(w)
        if b is None:
            b = memory[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "replace")) % BUCKETS if w.replace("-", "").replace("'", "").isalpha() else -1
        if b >= 0:
            ids.append(b)
    return np.unique(np.array(ids, dtype=np.int32), return_counts=True)


def word_counts(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, buckets, counts) of the documents with enough prose."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, int] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = english_words(text)
                if len(words) >= min_words:
                    if len(memory) > 500_000:
                        memory.clear()
                    b, n = buckets(words, memory)
                    rows.append((doc_id, len(words), b.tobytes(), n.astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "buckets", "counts"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = documents.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text")
    return source.mapInPandas(run, COLUMNS.format(id=kind))


class Words:
    """Intercepts and slopes of all buckets, and the tabulated A and A'."""

    def __init__(self, slopes: np.ndarray, tilt: np.ndarray, log_norm: np.ndarray):
        self.slopes, self.tilt, self.log_norm = slopes.astype(np.float32), tilt, log_norm

    def level(self, mean_slope: np.ndarray) -> np.ndarray:
        """The levels at which A' equals the documents' mean slopes."""
        return np.interp(mean_slope, self.tilt, GRID)


def solve(occurrences: np.ndarray, levels: np.ndarray, tokens: np.ndarray, rounds: int = 25) -> Words:
    """Word parameters from each bucket's occurrences, the sum of levels they occurred at, and the
    corpus's tokens by level of GRID."""
    mean = float(tokens @ GRID / max(1.0, tokens.sum()))
    where = (levels + PRIOR * mean) / (occurrences + PRIOR)
    used = occurrences > 0
    weight = tokens + 1e-9
    log_norm = np.zeros(len(GRID))
    slopes = np.zeros(len(occurrences))
    tilt = np.zeros(len(GRID))
    for _ in range(rounds):
        z = SLOPES[:, None] * (GRID - mean)[None, :] - log_norm[None, :]
        w = np.exp(z - z.max(axis=1, keepdims=True)) * weight
        reached = (w @ GRID) / w.sum(axis=1)
        slopes = np.where(used, np.interp(where, np.maximum.accumulate(reached), SLOPES), 0.0)
        # intercepts: the expected occurrences equal the observed ones
        at = np.clip(np.round((slopes[used] - SLOPES[0]) / (SLOPES[1] - SLOPES[0])).astype(int), 0, len(SLOPES) - 1)
        total = np.log(w.sum(axis=1)) + z.max(axis=1)
        mass = np.log(occurrences[used]) - total[at]
        by_slope = np.bincount(at, np.exp(np.clip(mass, -700, 700)), len(SLOPES))
        terms = np.log(np.maximum(by_slope, 1e-300))[None, :] + SLOPES[None, :] * (GRID - mean)[:, None]
        top = terms.max(axis=1, keepdims=True)
        e = np.exp(terms - top)
        log_norm = 0.5 * log_norm + 0.5 * (top[:, 0] + np.log(e.sum(axis=1)))
        tilt = (e @ SLOPES) / e.sum(axis=1)
    return Words(slopes, np.maximum.accumulate(tilt), log_norm)


def _means(batch: pd.DataFrame, slopes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    b = [np.frombuffer(x, dtype=np.int32) for x in batch["buckets"]]
    n = [np.frombuffer(x, dtype=np.int32) for x in batch["counts"]]
    mean = np.array([slopes[i] @ k / max(1, k.sum()) for i, k in zip(b, n)], dtype=float)
    return mean, b, n


def _tally(graded: DataFrame, words: Words | None, only_graded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrences, sums of levels) of each bucket and tokens by level: per partition, then summed."""
    shared = None if words is None else graded.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, levels, tokens = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(GRID))
        for batch in batches:
            slopes = np.zeros(BUCKETS, dtype=np.float32) if shared is None else shared.value.slopes
            mean, b, n = _means(batch, slopes)
            level = batch["grade"].to_numpy(dtype=float, na_value=np.nan)
            if shared is not None:
                level = np.where(np.isnan(level), shared.value.level(mean), level)
            for t, i, k in zip(level, b, n):
                if not np.isnan(t) and len(i):
                    seen[i] += k
                    levels[i] += k * t
                    tokens[int(np.abs(GRID - t).argmin())] += k.sum()
        used = np.nonzero(seen)[0]
        grid = np.nonzero(tokens)[0]
        yield pd.DataFrame({
            "bucket": np.concatenate([used, -1 - grid]).astype(np.int64),
            "n": np.concatenate([seen[used], tokens[grid]]),
            "levels": np.concatenate([levels[used], np.zeros(len(grid))]),
        })

    rows = graded.where("grade IS NOT NULL") if only_graded else graded
    parts = rows.select("buckets", "counts", "grade").mapInPandas(run, "bucket BIGINT, n DOUBLE, levels DOUBLE")
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("levels").alias("levels")).toPandas()
    seen, levels, tokens = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(GRID))
    bucket = sums["bucket"].to_numpy(dtype=np.int64)
    word = bucket >= 0
    seen[bucket[word]], levels[bucket[word]] = sums["n"][word], sums["levels"][word]
    tokens[-1 - bucket[~word]] = sums["n"][~word]
    return seen, levels, tokens


def _levels(graded: DataFrame, words: Words) -> DataFrame:
    shared = graded.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mean, _, _ = _means(batch, shared.value.slopes)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "theta": shared.value.level(mean), "grade": batch["grade"]})

    kind = graded.schema["doc_id"].dataType.simpleString()
    return graded.select("doc_id", "buckets", "counts", "grade").mapInPandas(run, f"doc_id {kind}, theta DOUBLE, grade DOUBLE")


def cuts(histogram: np.ndarray) -> np.ndarray:
    """Cuts between levels that bring thetas closest to grades; histogram: documents by (theta bin, level)."""
    edges = np.linspace(GRID[0], GRID[-1], BINS + 1)
    out = []
    for level in range(LOW, HIGH):
        below, above = histogram[:, : level - LOW + 1].sum(axis=1), histogram[:, level - LOW + 1 :].sum(axis=1)
        # errors of a cut at edge i: higher grades below it, lower grades above it
        errors = np.concatenate([[0], np.cumsum(above)]) + below.sum() - np.concatenate([[0], np.cumsum(below)])
        best = np.nonzero(errors == errors.min())[0]
        out.append(edges[best].mean() if histogram.sum() and len(best) <= BINS else level + 0.5)
    return np.maximum.accumulate(np.array(out))


def fit(documents: DataFrame, grades: DataFrame, rounds: int = ROUNDS, min_words: int = MIN_WORDS) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, theta, grade), cuts): latent levels of all documents with enough prose."""
    given = grades.where(F.col("grade").between(LOW, HIGH) & F.col("doc_id").isNotNull())
    given = given.groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    corpus = cut(word_counts(documents, min_words).join(given, "doc_id", "left"))
    words = solve(*_tally(corpus, None, True))
    for _ in range(rounds):
        sums = _tally(corpus, words, False)
        before, words = words, solve(*sums)
        if np.abs(words.slopes - before.slopes) @ sums[0] <= TOLERANCE * (np.abs(words.slopes) @ sums[0]):
            break
    thetas = _levels(corpus, words)
    width = (GRID[-1] - GRID[0]) / BINS
    place = F.least(F.lit(BINS - 1), F.floor((F.col("theta") - float(GRID[0])) / width)).cast("int")
    counted = thetas.where("grade IS NOT NULL").groupBy(place.alias("bin"), F.round("grade").cast("int").alias("level")).count().collect()
    histogram = np.zeros((BINS, HIGH - LOW + 1))
    for r in counted:
        histogram[r["bin"], r["level"] - LOW] += r["count"]
    return thetas, cuts(histogram)


def reading_levels(documents: DataFrame, grades: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, reading_level) of each document with enough running English prose."""
    thetas, between = fit(documents, grades, rounds)
    level = F.lit(LOW)
    for c in between:
        level = level + (F.col("theta") > float(c)).cast("int")
    return thetas.groupBy("doc_id").agg(F.min(level).cast("int").alias("reading_level"))
