import random

import pytest

from tallymill.llm import leaks, textnorm

WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("", "r", "st", "nd")]


def item(seed, n=60):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(rng.randint(1, 9)) for _ in range(n)]


ITEMS = {f"i{k}": item(k) for k in range(40)}


def found(spark, docs, items=None):
    texts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id BIGINT, text STRING, item_id STRING")
    bank = spark.createDataFrame([(k, " ".join(v) if v is not None else None) for k, v in (items or ITEMS).items()], "id STRING, prompt STRING")
    return {tuple(r) for r in leaks.leaked(texts, bank).collect()}


def test_words_of_dirty_text():
    dirty = "Th<b>e</b> \u043e<i>\u0445</i> c\u200bat **d**og, ware-\nhouse<br>\ufb01ne &amp; 09:58"
    assert textnorm.words(dirty) == ["the", "ox", "cat", "dog", "warehouse", "fine", "09", "58"]
    assert textnorm.words("со­de <b>w</b>ent") == ["code", "went"]
    assert textnorm.words("a__b__ _c_ `d`") == textnorm.words("ab c d")


def test_passage_lengths_and_changes(spark):
    w = ITEMS["i3"]
    swap = lambda ws, *at: [x if k not in at else "zzz" for k, x in enumerate(ws)]
    filler = "some other words of no interest here "
    docs = [
        filler + " ".join(w[5:25]) + " " + filler,            # 20 words
        " ".join(w[5:24]) + " " + filler,                      # 19 words
        filler + " ".join(swap(w[0:20], 4, 15)),               # 2 of 20 differ
        filler + " ".join(swap(w[0:20], 4, 9, 15)),            # 3 of 20 differ
        filler + " ".join(swap(w[0:30], 4, 14, 24)),           # 3 of 30 differ
        " ".join(w).upper().replace(" ", ",\n> "),             # layout
        None, "", " ".join(reversed(w)),
        " ".join(w[0:10]) + " " + filler + " ".join(w[10:20]),  # not consecutive
        " ".join(ITEMS["i5"][:20] + w[:20]),                   # two items
    ]
    assert found(spark, docs) == {(0, "i3"), (2, "i3"), (4, "i3"), (5, "i3"), (10, "i5"), (10, "i3")}


def edits_of(piece, doc):
    """The fewest word edits between the item's words and a stretch of the document, which begin and end alike; brute force."""
    best = []
    for start in (k for k, w in enumerate(doc) if w == piece[0]):
        row = list(range(len(doc) - start + 1))
        for i, w in enumerate(piece, 1):
            above, row = row, [i] + [0] * (len(doc) - start)
            for j in range(1, len(row)):
                row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (w != doc[start + j - 1]))
        best += [row[j] for j in range(1, len(row)) if doc[start + j - 1] == piece[-1]]
    return min(best, default=len(piece))


def brute_force(docs, items):
    """All (document, item) by the definition alone: every stretch of 20 to 49 words of an item against the whole document."""
    out = set()
    for d, text in enumerate(docs):
        words = text.split()
        for k, item in items.items():
            if len(set(words) & set(item)) < 10:
                continue
            for n in range(20, 50):
                if any(edits_of(item[i : i + n], words) <= n // 10 for i in range(len(item) - n + 1)):
                    out.add((d, k))
                    break
    return out


def changed(rng, piece, kinds, n_edits):
    """piece with edits inside it; no two of them touch."""
    for at in sorted(rng.sample(range(1, len(piece) - 1, 2), n_edits), reverse=True):
        kind = rng.choice(kinds)
        if kind == "drop":
            del piece[at]
        elif kind == "add":
            piece.insert(at, "more")
        else:
            piece[at] = kind
    return piece


@pytest.mark.parametrize("kinds", [["changed"], ["well-known", "09:58"], ["state-of-the-art"], ["add"], ["drop"], ["changed", "09:58", "state-of-the-art", "add", "drop"]])
@pytest.mark.parametrize("n", [22, 24, 30, 38, 45])
def test_recall_by_kind_of_edit(kinds, n):
    rng = random.Random(n)
    index = leaks.Index([(k, " ".join(v)) for k, v in ITEMS.items()])
    docs, want = [], []
    for d in range(40):
        k = rng.choice(list(ITEMS))
        start = rng.randrange(len(ITEMS[k]) - n + 1)
        piece = changed(rng, list(ITEMS[k][start : start + n]), kinds, 1 if n < 30 else n // 10)
        pad = lambda: [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]
        docs.append(" ".join(pad() + piece + pad()))
        want.append((d, k))
    got = set(index.leaks(list(range(40)), docs))
    assert len(got & set(want)) >= 39


@pytest.mark.parametrize("seed", range(4))
def test_same_as_brute_force(seed):
    rng = random.Random(seed)
    items = {k: v[:46] for k, v in list(ITEMS.items())[:6]}
    index = leaks.Index([(k, " ".join(v)) for k, v in items.items()])
    docs = []
    for _ in range(14):
        k = rng.choice(list(items))
        n = rng.randint(17, 46)
        start = rng.randrange(len(items[k]) - n + 1)
        piece = changed(rng, list(items[k][start : start + n]), ["changed", "add", "drop"], rng.randint(0, 5))
        docs.append(" ".join([rng.choice(WORDS) for _ in range(8)] + piece + [rng.choice(WORDS) for _ in range(8)]))
    assert set(index.leaks(list(range(len(docs))), docs)) == brute_force(docs, items)


def test_precision_on_planted_passages(spark):
    rng = random.Random(9)
    docs, want = [], set()
    for d in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 120))]
        if d % 2:
            k = f"i{rng.randrange(40)}"
            n = rng.randint(20, 40)
            start = rng.randrange(60 - n + 1)
            piece = list(ITEMS[k][start : start + n])
            for at in rng.sample(range(1, n - 1), n // 10):
                piece[at] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = piece
            want.add((d, k))
        docs.append(" ".join(words))
    got = found(spark, docs)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_punctuation_parts_no_words(spark):
    w = ITEMS["i2"][:22]
    docs = [" ".join(w[:10]) + " " + "-".join(w[10:14]) + " " + ", ".join(w[14:]), " ".join(w[:8]) + " lamp-post " + " ".join(w[9:])]
    assert found(spark, docs) == {(0, "i2"), (1, "i2")}


def test_large_banks_go_by_keys(spark):
    rng = random.Random(3)
    docs = [" ".join(changed(rng, list(v[: 30 + k % 20]), ["changed", "09:58", "add", "drop"], k % 4) + [rng.choice(WORDS) for _ in range(50)]) for k, v in enumerate(ITEMS.values())]
    docs += ["", None, "short", " ".join(ITEMS["i1"][:19])]
    texts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id BIGINT, text STRING, item_id STRING")
    bank = spark.createDataFrame([(k, " ".join(v)) for k, v in ITEMS.items()] + [(None, "x"), ("none", None), ("i1", " ".join(ITEMS["i1"]))], "id STRING, prompt STRING")
    way = lambda limit: {tuple(r) for r in leaks.leaked(texts, bank, limit).collect()}
    assert way(0) == way(10**9) and len(way(0)) >= 38
    assert leaks.leaked(texts.limit(0), bank, 0).count() == 0


def test_short_items_and_empty_tables(spark):
    docs = [" ".join(v) for v in ITEMS.values()]
    assert found(spark, docs) == {(i, f"i{i}") for i in range(40)}
    assert found(spark, docs[:1], {"short": ["a"] * 19, "none": None}) == set()
    texts = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    bank = spark.createDataFrame([], "id STRING, prompt STRING")
    assert leaks.leaked(texts, bank).count() == 0


def test_very_long_text(spark):
    text = "word " * 400_000 + " ".join(ITEMS["i7"]) + " word" * 1000
    assert found(spark, [text]) == {(0, "i7")}
