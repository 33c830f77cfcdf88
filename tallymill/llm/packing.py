"""Filling fixed-capacity containers with documents, sized in tokens of a public tokenizer.

Method: swap-based local search. Bins are first filled best-fit by falling size; then documents of the
emptiest bins are moved to, exchanged one for one, or two for one, with documents of other underfull bins whenever that
raises the sum of squared fills, until bins run empty or no exchange helps. Each accepted step
raises that sum, so the search ends.

The corpus is spread by the hash of the document id over groups of about GROUP documents, each small enough for one
task whatever the corpus, source or number of like sizes; bins that stay below FULL are opened again
and their documents grouped anew by another hash, so that what the groups leave over meets.

Defined results: null and empty texts and null ids have no tokens to place and get no row; a document larger than a container is cut into
pieces of the capacity and a remainder, and no other document is divided; a repeated id counts once, with its
longest text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import cut

CAPACITY = 2048
GROUP = 8_000
#: Bins filled less are opened again while there is more than one group: the higher, the less is left unused and the more is placed twice.
FULL = 0.995
#: Tasks of a round at most; a task has one group, or a few on end where there are more.
TASKS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that parts a text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLACED = "doc_id {id}, piece BIGINT, bin_id BIGINT, tokens BIGINT"

_ENCODINGS: dict = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a text; special tokens' strings are ordinary text.

    The tokenizer's own splitter overflows its stack on runs of a million blanks; such texts are split by the same
    pattern in another library, which gives the same tokens.
    """
    known = encoding(path)
    try:
        return len(known.encode_ordinary(text))
    except BaseException as error:  # the library's panic is no Exception
        if type(error).__name__ != "PanicException":
            raise
    import regex

    return sum(len(known._encode_single_piece(piece.encode("utf-8", "replace"))) for piece in regex.findall(PATTERN, text))


def token_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of the documents that have any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [count_tokens(t, path) for t in batch["text"]]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = documents.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text")
    return source.mapInPandas(run, f"doc_id {kind}, tokens BIGINT").groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")


class Bins:
    """Bins of sizes, each kept sorted, with the exchanges of the local search."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[tuple[int, int]]] = []
        self.free: list[int] = []
        self._best_fit()

    def _best_fit(self) -> None:
        spaces: list[tuple[int, int]] = []
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            s = self.sizes[i]
            at = bisect.bisect_left(spaces, (s, -1))
            if at == len(spaces):
                self.bins.append([])
                self.free.append(self.capacity)
                b = len(self.bins) - 1
            else:
                _, b = spaces.pop(at)
            bisect.insort(self.bins[b], (s, i))
            self.free[b] -= s
            if self.free[b]:
                bisect.insort(spaces, (self.free[b], b))

    def least(self) -> int:
        """No packing has fewer bins."""
        return math.ceil(sum(self.sizes) / self.capacity)

    def _take(self, b: int, item: tuple[int, int]) -> None:
        self.bins[b].remove(item)
        self.free[b] += item[0]

    def _put(self, b: int, item: tuple[int, int]) -> None:
        bisect.insort(self.bins[b], item)
        self.free[b] -= item[0]

    def _exchange(self, y: int, out: list[tuple[int, int]], x: int, back: list[tuple[int, int]]) -> None:
        for item in out:
            self._take(y, item)
        for item in back:
            self._take(x, item)
        for item in out:
            self._put(x, item)
        for item in back:
            self._put(y, item)

    def _offers(self, y: int):
        """What bin y may give: single documents and pairs, largest first.

        Documents of one size are alike, so one of each size stands for all, and two for pairs of equal ones: all there is to try, and of
        different sizes a bin holds few, as they add up to its capacity.
        """
        docs: list[tuple[int, int]] = []
        for item in reversed(self.bins[y]):
            if len(docs) < 2 or docs[-2][0] != item[0]:
                docs.append(item)
        single = [d for k, d in enumerate(docs) if not k or docs[k - 1][0] != d[0]]
        for a in single:
            yield [a]
        tried = set()
        for k, a in enumerate(docs):
            for b in docs[k + 1 :]:
                if a[0] + b[0] not in tried:
                    tried.add(a[0] + b[0])
                    yield [a, b]

    def _step(self, y: int, others: list[int]) -> bool:
        """One move or exchange out of bin y that raises the squared fills; False if there is none."""
        fill_y = self.capacity - self.free[y]
        for out in self._offers(y):
            given = sum(s for s, _ in out)
            best = None
            for x in others:
                if x == y or not self.free[x] or not self.bins[x]:
                    continue
                room = self.free[x]
                if given <= room:
                    gain, back = given, []
                else:
                    at = bisect.bisect_left(self.bins[x], (given - room, -1))
                    if at == len(self.bins[x]) or self.bins[x][at][0] >= given:
                        continue
                    back = [self.bins[x][at]]
                    gain = given - back[0][0]
                # (fx + g)^2 + (fy - g)^2 > fx^2 + fy^2
                if self.capacity - room + gain > fill_y and (best is None or room - gain < best[0]):
                    best = (room - gain, x, back)
                    if best[0] == 0:
                        break
            if best is not None:
                self._exchange(y, out, best[1], best[2])
                return True
        return False

    def search(self) -> Bins:
        """Empties bins one after another, the emptiest first, as long as the number of bins isn't the least."""
        least, stuck = self.least(), set()
        while True:
            used = [b for b in range(len(self.bins)) if self.bins[b]]
            if len(used) <= least:
                return self
            open_ = [b for b in used if b not in stuck and self.free[b]]
            if not open_:
                return self
            y = max(open_, key=lambda b: (self.free[b], -b))
            others = sorted((b for b in used if self.free[b]), key=lambda b: (self.free[b], b))
            while self.bins[y] and self._step(y, others):
                stuck.clear()  # what was stuck before may move now
            if self.bins[y]:
                stuck.add(y)


def _filler(capacity: int, base: int, least_fill: float):
    """What fills the bins of one group; bins below least_fill get the id 0."""

    def fill(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["doc_id", "piece"], kind="stable")
        found = Bins(batch["tokens"].tolist(), capacity).search()
        of = [0] * len(batch)
        for b, docs in enumerate(found.bins):
            if capacity - found.free[b] >= least_fill:
                for _, i in docs:
                    of[i] = base + (int(batch["place"].iloc[0]) << 24) + b
        return pd.DataFrame({"doc_id": batch["doc_id"], "piece": batch["piece"], "bin_id": of, "tokens": batch["tokens"]})

    return fill


def _by_group(fill):
    """fill for each group among a task's rows: a few groups of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            for _, some in pd.concat(rows, ignore_index=True).groupby("place"):
                yield fill(some.reset_index(drop=True))

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, group: int = GROUP, full: float = FULL) -> DataFrame:
    """(doc_id, piece, bin_id, tokens) for sizes(doc_id, tokens). Rounds go on until what is left fits one group, or no round leaves less."""
    whole = F.floor(F.col("tokens") / capacity)
    cutup = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1)))).select(
        "doc_id", "piece", F.when(F.col("piece") < whole, capacity).otherwise(F.col("tokens") - whole * capacity).cast("bigint").alias("tokens")
    )
    pieces = cut(cutup)
    schema = PLACED.format(id=sizes.schema["doc_id"].dataType.simpleString())
    # a piece that fills a container needs no search; its bin is named by a hash of what it is
    alone = pieces.where(F.col("tokens") == capacity).select(
        "doc_id", "piece", F.monotonically_increasing_id().alias("bin_id"), "tokens"
    )
    placed = [alone]
    left = pieces.where(F.col("tokens") < capacity)
    before = None
    for r in itertools.count():
        n = left.count()
        if not n:
            break
        groups = max(1, round(n / group))
        last = groups == 1 or before == n
        before = n
        # bins of round r lie beyond those of the pieces that stand alone and of earlier rounds
        base = -((r + 1) << 56)
        tasks = min(groups, TASKS)
        spread = left.withColumn("place", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(groups)))
        # each group goes to the task of its number, so that small groups aren't put together in one
        numbered = spread.repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int"))
        done = cut(numbered.mapInPandas(_by_group(_filler(capacity, base, full * capacity if not last else 0)), schema))
        placed.append(done.where("bin_id <> 0"))
        if last:
            break
        left = done.where("bin_id = 0").drop("bin_id")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bins, tokens, unused share, largest bin) of an assignment."""
    bins = placed.groupBy("bin_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return bins.agg(
        F.count("*").alias("bins"),
        F.sum("tokens").alias("tokens"),
        (1 - F.sum("tokens") / (F.count("*") * F.lit(float(capacity)))).alias("unused"),
        F.max("tokens").alias("fullest"),
        F.max("pieces").alias("most_pieces"),
    )
