import random

import pytest

from tallymill.llm import packing


def test_search_reaches_the_least_number():
    rng = random.Random(0)
    for capacity in (10, 100):
        for _ in range(20):
            sizes = []
            for _ in range(12):  # bins that fill exactly
                left = capacity
                while left:
                    s = rng.randint(1, left)
                    sizes.append(s)
                    left -= s
            rng.shuffle(sizes)
            found = packing.Bins(sizes, capacity).search()
            used = [b for b in found.bins if b]
            assert sorted(i for b in used for _, i in b) == list(range(len(sizes)))
            assert all(sum(s for s, _ in b) <= capacity for b in used)
            assert len(used) <= 13


def test_an_exchange_that_best_fit_misses():
    # best fit gives 3+3, 2+2+2, 2; two for one makes room for the last
    found = packing.Bins([3, 3, 2, 2, 2, 2], 7).search()
    assert sorted(sum(s for s, _ in b) for b in found.bins if b) == [7, 7]


def sizes_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, tokens BIGINT")


@pytest.mark.parametrize("group", [50, 10_000])
def test_assignment_is_whole(spark, group):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 7, 30, 100, 333, 100, 100])) for i in range(400)]
    placed = packing.pack(sizes_of(spark, rows), capacity=100, group=group).collect()
    by_doc, by_bin = {}, {}
    for r in placed:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.tokens))
        by_bin[r.bin_id] = by_bin.get(r.bin_id, 0) + r.tokens
    for i, n in rows:
        pieces = sorted(by_doc[i])
        assert sum(t for _, t in pieces) == n and [k for k, _ in pieces] == list(range(len(pieces)))
        assert len(pieces) == 1 if n <= 100 else [t for _, t in pieces] == [100, 100, 100, 33]
    assert max(by_bin.values()) <= 100
    assert len(by_bin) <= -(-sum(n for _, n in rows) // 100) * 1.03 + 2


def test_tokens_of_texts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "a" * 5000), (1, "Hello"), (5, "<|endoftext|>")], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.tokens for r in packing.token_sizes(df).collect()}
    assert got[1] == 2 and set(got) == {1, 4, 5} and got[5] > 1
    assert packing.pack(packing.token_sizes(df.limit(0))).count() == 0
    report = packing.fill_report(packing.pack(packing.token_sizes(df))).first()
    assert report.bins == 1 and report.tokens == sum(got.values())


def test_long_runs_of_blanks():
    text = "Hello" + " " * 1_000_000 + "world"
    pieces = packing.count_tokens(text)
    shorter = packing.count_tokens("Hello" + " " * 1000 + "world")
    assert pieces > shorter > 3
