"""Evaluation texts leaking into training text: every document that contains a passage of a test item.

Method: CGK embedding (Chakraborty, Goldenberg, Koucky, 2016). Windows of item size, WINDOW tokens, the shortest a
passage can be, are taken from items and documents; a random walk maps each to a longer sequence such that few edits
become few differing places. Repeated sampling of places (bit-sampling LSH) gives keys; a document and an item that
share any key are a candidate, and no further filter stands between the keys and the check. Each candidate is verified
exactly by edit distance over words: from every run of equal words the furthest-reaching alignments are
followed in both directions (Landau and Vishkin's diagonals), where a changed, an added or a missing word costs
one edit, however many tokens it has.

Before embedding, windows without any SEED consecutive tokens of some item are passed over: among the words of a
passage with one edit in ten, SEED in a row are always untouched, so this loses nothing.

Items whose prompts sum up to at most BROADCAST_CHARS (counted, not estimated) are broadcast as one index and the corpus is
scanned once, without any shuffle. A larger bank goes the other way: its keys become a table, the corpus is scanned
once against a bitmap of fixed size, and the keys of what is left are joined with the bank's.

Defined results: a passage is a leak when it has at least MIN_WORDS consecutive words of the prompt (words as white
space parts them), in order, with at most one edit to ten of them, and its first and last word are the item's; null
or empty texts, items with fewer words, and null ids give no rows; repeated rows give the same pair once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.textnorm import plain, runs_of_letters, words
from tallymill.session import cut

MIN_WORDS = 20
#: One edit to so many words of a passage.
ONE_IN = 10
#: Consecutive words that some edits always leave untouched: 18 of 20 words in three parts, 27 of 30 in four.
SEED = 6
#: A longer passage holds a shorter one that is a leak by itself and has no more edits than this.
EDITS = 5
#: Tokens of a window and places of its embedding: a walk of even odds leaves the window after about two places a token.
WINDOW = 20
PLACES = 2 * WINDOW
#: Embeddings, samplings of each, and places per sampling; see README for the recall they give.
EMBEDDINGS = 8
SAMPLINGS = 6
SAMPLED = 5
#: A bank with more characters of prompts than this isn't broadcast.
BROADCAST_CHARS = 4_000_000
#: Bits of the bitmap that stands for a larger bank's runs of SEED tokens: 16 MB, whatever the bank's size.
BITMAP_BITS = 1 << 27
#: Texts are handled together up to so many characters.
CHUNK_CHARS = 3_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each hash that depend on the seed."""
    h = (h ^ np.uint64(0xD6E8FEB86659FD93 * (seed + 1) % 2**64)) * _ODD
    h ^= h >> np.uint64(32)
    h *= _EVEN
    return h ^ (h >> np.uint64(29))


def token_hash(token: str) -> int:
    """Never 0, which stands for a token that no item has."""
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace")) or 1


def gram_hashes(h: np.ndarray) -> np.ndarray:
    """One hash for each run of SEED tokens."""
    n = len(h) - SEED + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for k in range(1, SEED):
        out *= _ODD
        out ^= out >> np.uint64(31)
        out += h[k : k + n]
    return out * _EVEN


_SAMPLES = [[np.sort(np.random.default_rng(100 * r + s).choice(PLACES, SAMPLED, replace=False)) for s in range(SAMPLINGS)] for r in range(EMBEDDINGS)]


def window_keys(windows: np.ndarray) -> Iterator[np.ndarray]:
    """For each embedding and sampling, the keys of windows of token hashes."""
    n = len(windows)
    padded = np.zeros((n, PLACES + 1), dtype=np.uint64)
    padded[:, :WINDOW] = windows
    flat, base = padded.ravel(), np.arange(n, dtype=np.int64) * (PLACES + 1)
    for r in range(EMBEDDINGS):
        bits = _mixed(flat, r)
        spot, steps = base.copy(), np.empty((PLACES, n), dtype=np.uint64)
        for j in range(PLACES):
            steps[j] = flat[spot]
            spot += ((bits[spot] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
        for s, sample in enumerate(_SAMPLES[r]):
            key = np.full(n, r * SAMPLINGS + s + 1, dtype=np.uint64)
            for j in sample:
                key = (key ^ steps[j]) * _ODD
                key ^= key >> np.uint64(29)
            yield key


class Words:
    """A text as token hashes, with the white-space word each token belongs to."""

    def __init__(self, text: str, hashed=None):
        hashed = hashed or token_hash
        pieces = [p for p in map(runs_of_letters, plain(text).split()) if p]
        self.tokens = [hashed(t) for p in pieces for t in p]
        #: for each token, where its word begins and ends; and how many words begin before a token
        self.begin, self.end, self.before = [], [], []
        at = 0
        for k, p in enumerate(pieces):
            self.begin += [at] * len(p)
            self.end += [at + len(p)] * len(p)
            self.before += [k] * len(p)
            at += len(p)
        self.before.append(len(pieces))
        self.n_words = len(pieces)


def _forward(a: Words, b: Words, p: int, q: int) -> list[int]:
    """For each number of edits, the furthest token of a that an alignment from (p, q) on reaches with a match at its end."""
    A, B, n, m = a.tokens, b.tokens, len(a.tokens), len(b.tokens)
    reach, front = [], {q - p: p}
    best = p
    for _ in range(EDITS + 1):
        slid = {}
        for d, x in front.items():
            y, start = x + d, x
            while x < n and y < m and A[x] == B[y]:
                x += 1
                y += 1
            if x > start and x > best:
                best = x
            slid[d] = x
        reach.append(best)
        front = {}
        for d, x in slid.items():
            y = x + d
            if x >= n:
                continue
            past_a = a.end[x]
            past_b = b.end[y] if y < m else y
            for x2, y2 in ((past_a, past_b), (past_a, y), (x, past_b)):
                if x2 > front.get(y2 - x2, -1):
                    front[y2 - x2] = x2
    return reach


def _backward(a: Words, b: Words, p: int, q: int) -> list[int]:
    """The same to the left: the furthest token of a, where matches begin, for the tokens before (p, q)."""
    A, B = a.tokens, b.tokens
    reach, front = [], {q - p: p}
    best = p
    for _ in range(EDITS + 1):
        slid = {}
        for d, x in front.items():
            y, start = x + d, x
            while x > 0 and y > 0 and A[x - 1] == B[y - 1]:
                x -= 1
                y -= 1
            if x < start and x < best:
                best = x
            slid[d] = x
        reach.append(best)
        front = {}
        for d, x in slid.items():
            y = x + d
            if x <= 0:
                continue
            past_a = a.begin[x - 1]
            past_b = b.begin[y - 1] if y > 0 else y
            for x2, y2 in ((past_a, past_b), (past_a, y), (x, past_b)):
                if x2 < front.get(y2 - x2, 1 << 60):
                    front[y2 - x2] = x2
    return reach


def _whole_words(a: Words, lo: int, hi: int) -> int:
    """Words of a that lie wholly in its tokens lo to hi."""
    if lo < len(a.tokens) and lo > a.begin[lo]:
        lo = a.end[lo]
    if 0 < hi < a.end[hi - 1]:
        hi = a.begin[hi - 1]
    return a.before[hi] - a.before[lo] if hi > lo else 0


def has_passage(item: Words, doc: Words, runs: list[tuple[int, int]]) -> bool:
    """Whether the document has a passage of the item that goes through one of the runs (item token, document token)."""
    for p, q in runs:
        right, left = _forward(item, doc, p, q), _backward(item, doc, p, q)
        for e1, lo in enumerate(left):
            for e2 in range(len(right) - e1):
                n = _whole_words(item, lo, right[e2])
                if n >= MIN_WORDS and n >= ONE_IN * (e1 + e2):
                    return True
    return False


class Bank:
    """Items by id, with the places of their runs of SEED tokens."""

    def __init__(self, items: list[tuple[str, str]], hashed=None):
        self.ids = [i for i, _ in items]
        self.items = [Words(prompt, hashed) for _, prompt in items]
        self.grams = []
        for w in self.items:
            g = gram_hashes(np.array(w.tokens, dtype=np.uint64))
            order = np.argsort(g, kind="stable")
            self.grams.append((g[order], order))

    def verified(self, item: int, doc: Words, places: np.ndarray, grams: np.ndarray) -> bool:
        """Whether the document leaks the item; places: where its known runs are, grams: their hashes."""
        table, order = self.grams[item]
        first, last = np.searchsorted(table, grams, "left"), np.searchsorted(table, grams, "right")
        size = last - first
        hit = np.nonzero(size)[0]
        if not len(hit):
            return False
        size = size[hit]
        spread = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        p = order[np.repeat(first[hit], size) + spread]
        q = np.repeat(places[hit], size)
        both = set(zip(p.tolist(), q.tolist()))
        # one start for each run of equal tokens
        starts = [(x, y) for x, y in sorted(both) if (x - 1, y - 1) not in both]
        return has_passage(self.items[item], doc, starts)


class Index:
    """The windows of a bank of items, by their sampled keys."""

    def __init__(self, items: list[tuple[str, str]]):
        items = sorted(items)
        self.vocabulary: dict[str, int] = {}

        def known(token: str) -> int:
            return self.vocabulary.setdefault(token, token_hash(token))

        self.bank = Bank(items, known)
        self.ids = self.bank.ids
        self.seeds = np.unique(np.concatenate([g for g, _ in self.bank.grams] or [np.empty(0, dtype=np.uint64)]))
        self.bits = max(16, int(np.ceil(np.log2(64 * len(self.seeds) + 1))))
        self.bitmap = np.zeros(1 << self.bits, dtype=bool)
        self.bitmap[self._slot(self.seeds)] = True
        tokens = [np.array(w.tokens, dtype=np.uint64) for w in self.bank.items]
        starts = [(k, p) for k, t in enumerate(tokens) for p in range(len(t) - WINDOW + 1)]
        self.tables = []
        if starts:
            windows = np.stack([tokens[k][p : p + WINDOW] for k, p in starts])
            item = np.array([k for k, _ in starts], dtype=np.int32)
            for keys in window_keys(windows):
                order = np.argsort(keys, kind="stable")  # of equal keys, the items stay in order
                key, of = keys[order], item[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
                self.tables.append((key[new], of[new]))

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - self.bits)).astype(np.int64)

    def seed_places(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the stream's runs of SEED tokens that some item has."""
        grams = gram_hashes(stream)
        at = np.nonzero(self.bitmap[self._slot(grams)])[0]
        if not len(at) or not len(self.seeds):
            return at[:0], grams[:0]
        some = grams[at]
        near = np.minimum(np.searchsorted(self.seeds, some), len(self.seeds) - 1)
        at = at[self.seeds[near] == some]
        return at, grams[at]

    def candidates(self, stream: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) that share a key; no window goes over one of bounds, where documents begin."""
        starts = window_starts(len(stream), bounds, places)
        n, found = len(self.ids), [np.empty(0, dtype=np.int64)]
        for lo in range(0, len(starts), 20_000):
            some = starts[lo : lo + 20_000]
            doc = np.searchsorted(bounds, some, "right") - 1
            for keys, (table, item) in zip(window_keys(stream[some[:, None] + np.arange(WINDOW)]), self.tables):
                first = np.searchsorted(table, keys, "left")
                hit = np.nonzero(table[np.minimum(first, len(table) - 1)] == keys)[0]
                if not len(hit):
                    continue
                # equal keys of one document count once
                pairs = np.unique(doc[hit] * len(table) + first[hit])
                first = pairs % len(table)
                size = np.searchsorted(table, table[first], "right") - first
                spread = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found.append(np.unique(np.repeat(pairs // len(table), size) * n + item[np.repeat(first, size) + spread]))
        pairs = np.unique(np.concatenate(found))
        return list(zip((pairs // max(1, n)).tolist(), (pairs % max(1, n)).tolist()))

    def leaks(self, doc_ids, texts) -> list[tuple]:
        """(doc_id, item_id) of the texts, handled as one stream of tokens."""
        get = self.vocabulary.get
        parts, bounds, at = [], [], 0
        for text in texts:
            ids = [get(w, 0) for w in words(text)]
            parts.append(np.array(ids, dtype=np.uint64))
            bounds.append(at)
            at += len(ids) + 1
        stream = np.zeros(at, dtype=np.uint64)
        for lo, ids in zip(bounds, parts):
            stream[lo : lo + len(ids)] = ids
        bounds_ = np.array(bounds)
        places, grams = self.seed_places(stream)
        found, of_doc, doc_words = set(), -1, None
        for d, k in self.candidates(stream, bounds_, places):
            if d != of_doc:
                of_doc, doc_words = d, Words(texts[d], lambda t: get(t, 0))
                a, b = np.searchsorted(places, [bounds[d], bounds[d] + len(parts[d])])
            if self.bank.verified(k, doc_words, places[a:b] - bounds[d], grams[a:b]):
                found.add((doc_ids[d], self.ids[k]))
        return list(found)


def window_starts(n: int, bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a known run and lie in one document."""
    if n < WINDOW or not len(places):
        return np.empty(0, dtype=np.int64)
    some = np.zeros(n + 1, dtype=np.int64)
    np.add.at(some, np.maximum(0, places - (WINDOW - SEED)), 1)
    np.add.at(some, places + 1, -1)
    starts = np.nonzero(np.cumsum(some)[: n - WINDOW + 1])[0]
    return starts[np.searchsorted(bounds, starts, "right") == np.searchsorted(bounds, starts + WINDOW - 1, "right")]


_INDEXES: dict[int, Index] = {}


def _index(items: list[tuple[str, str]]) -> Index:
    """The bank's index, built once per Python worker."""
    key = xxhash.xxh64_intdigest(repr(items).encode("utf-8", "replace"))
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items)
    return _INDEXES[key]


def _chunks(batch: pd.DataFrame, column: str = "text") -> Iterator[pd.DataFrame]:
    ends = np.cumsum([len(t) for t in batch[column]]) // CHUNK_CHARS
    for chunk in np.unique(ends):
        yield batch.iloc[np.searchsorted(ends, chunk, "left") : np.searchsorted(ends, chunk, "right")]


def _by_broadcast(docs: DataFrame, asked: DataFrame, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.collect()])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(shared.value)
        for batch in batches:
            for some in _chunks(batch):
                yield pd.DataFrame(index.leaks(some["doc_id"].tolist(), some["text"].tolist()), columns=["doc_id", "item_id"])

    return docs.mapInPandas(scan, schema)


def _stream(text: str) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.array([seen.get(w) or seen.setdefault(w, token_hash(w)) for w in words(text)], dtype=np.uint64)


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams % np.uint64(BITMAP_BITS)).astype(np.int64)


def _distinct_keys(windows: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(list(window_keys(windows)))).view(np.int64) if len(windows) else np.empty(0, dtype=np.int64)


def _bank_bitmap(asked: DataFrame) -> np.ndarray:
    """One bit for each hash of a run of SEED tokens of the bank, put together in parts of equal size."""
    n_parts = 256
    size = BITMAP_BITS // 8 // n_parts

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
        for batch in batches:
            for prompt in batch["prompt"]:
                slots = _slots(gram_hashes(_stream(prompt)))
                np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        for k in range(n_parts):
            part = bits[k * size : (k + 1) * size]
            if part.any():
                yield pd.DataFrame({"part": [k], "bits": [part.tobytes()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "bits": [whole.tobytes()]})

    parts = asked.select("prompt").mapInPandas(mark, "part INT, bits BINARY").groupBy("part").applyInPandas(merge, "part INT, bits BINARY")
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _by_keys(docs: DataFrame, asked: DataFrame, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_bank_bitmap(asked))
    kind = schema.split(",")[0].split(" ", 1)[1]

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                stream = _stream(text)
                slots = _slots(gram_hashes(stream))
                places = np.nonzero((shared.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)[0]
                starts = window_starts(len(stream), np.zeros(1, dtype=np.int64), places)
                for lo in range(0, len(starts), 20_000):
                    keys = _distinct_keys(stream[starts[lo : lo + 20_000, None] + np.arange(WINDOW)])
                    yield pd.DataFrame({"sampled": keys, "doc_id": doc})

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, prompt in zip(batch["id"], batch["prompt"]):
                stream = _stream(prompt)
                starts = np.arange(max(0, len(stream) - WINDOW + 1))
                yield pd.DataFrame({"sampled": _distinct_keys(stream[starts[:, None] + np.arange(WINDOW)]), "item_id": item})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, words_of, places, grams = None, None, None, None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if row.text != text:
                    text, words_of = row.text, Words(row.text)
                    grams = gram_hashes(np.array(words_of.tokens, dtype=np.uint64))
                    places = np.arange(len(grams))
                if Bank([(row.item_id, row.prompt)]).verified(0, words_of, places, grams):
                    found.append((row.doc_id, row.item_id))
            yield pd.DataFrame(found, columns=["doc_id", "item_id"])

    keyed = docs.mapInPandas(of_docs, f"sampled BIGINT, doc_id {kind}")
    bank = asked.mapInPandas(of_items, "sampled BIGINT, item_id STRING")
    pairs = cut(keyed.join(bank, "sampled").select("doc_id", "item_id").distinct())
    full = pairs.join(asked.select(F.col("id").alias("item_id"), "prompt"), "item_id").join(docs, "doc_id")
    return full.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInPandas(check, schema)


def leaked(documents: DataFrame, items: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id) for documents(doc_id, text) and items(id, prompt)."""
    docs = documents.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text")
    asked = items.where("id IS NOT NULL AND length(prompt) > 0").select("id", "prompt").distinct()
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id STRING"
    size = asked.agg(F.coalesce(F.sum(F.length("prompt") + F.length("id")), F.lit(0))).first()[0]
    way = _by_broadcast if size <= broadcast_chars else _by_keys
    return way(docs, asked, schema).distinct()
