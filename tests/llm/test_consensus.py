import datetime

import numpy as np
import pytest

from tallymill.llm import consensus

SCHEMA = "campaign_id STRING, item_id STRING, annotator STRING, tier STRING, verdict STRING, pred INT, labelled_at TIMESTAMP, who STRING"
T = lambda s: datetime.datetime(2025, 1, 1, 0, 0, s)


def frame(spark, rows):
    return spark.createDataFrame([(c, i, a, None, v, p, t, "x") for c, i, a, v, p, t in rows], SCHEMA)


def test_standing_votes(spark):
    rows = [("c", "i", "Ann ", "A", 1, T(1)), ("c", "i", "ann", "(fail)", None, T(2)), ("c", "i", "bob", "PASS.", None, T(1)), ("c", "i", "bob", "unsure", None, T(2)),
            ("c", "i", "cy", " b ", None, None), ("c", "i", "dot", "A", None, T(1)), ("c", "i", "dot", "B", None, T(1)), ("c", "i", "eve", None, 1, T(1)), ("c", "i", None, "A", 1, T(1)), (None, "i", "fay", "A", 1, T(1))]
    got = {(r.campaign_id, r.who): r.pred for r in consensus.standing_votes(frame(spark, rows + rows)).collect()}
    assert got == {("c", "ann"): 0, ("c", "cy"): 0, ("c", "dot"): 1, ("c", "eve"): 1, (None, "fay"): 1}


def planted(seed=0, items=300):
    rng = np.random.default_rng(seed)
    skill = {"good": 0.97, "fine": 0.9, "weak": 0.55, "poor": 0.5, "dice": 0.5, "foe": 0.1}
    truth = rng.integers(0, 2, items)
    rows = [("c", f"i{i}", a, "AB"[1 - (truth[i] if rng.random() < p else 1 - truth[i])], None, T(1)) for i in range(items) for a, p in skill.items() if rng.random() < 0.85]
    return truth, skill, rows


def test_reliability_beats_the_majority(spark):
    truth, skill, rows = planted()
    df = frame(spark, rows)
    items, people = consensus.consensus(df)
    pred = {r.item_id: r.pred for r in items.collect()}
    right = np.mean([pred[f"i{i}"] == t for i, t in enumerate(truth) if f"i{i}" in pred])
    count = {}
    for _, i, _, v, _, _ in rows:
        count[i] = count.get(i, 0) + (1 if v == "A" else -1)
    majority = np.mean([(count[f"i{i}"] > 0) == t for i, t in enumerate(truth)])
    assert right > 0.95 and right > majority + 0.1
    ability = {r.who: r.ability for r in people.collect()}
    assert ability["good"] > ability["fine"] > ability["weak"] > ability["foe"] and ability["foe"] < 0


def test_contested_items_only(spark):
    _, _, rows = planted(1, 40)
    rows = [*rows, ("c", "agreed", "good", "A", 1, T(1)), ("c", "agreed", "foe", "A", 1, T(1)), ("c", "single", "foe", "B", 0, T(1))]
    got = {r.item_id for r in consensus.contested(frame(spark, rows)).collect()}
    votes = {}
    for _, i, _, v, _, _ in rows:
        votes.setdefault(i, set()).add(v)
    assert got == {i for i, v in votes.items() if len(v) == 2}


def test_many_annotators_go_by_joins_hot_keys_salted(spark):
    _, _, rows = planted(2, 60)
    votes = consensus.standing_votes(frame(spark, rows)).withColumnRenamed("item_id", "item")
    ways = [consensus.fit(votes), consensus.fit(votes, people_bound=2), consensus.fit(votes, people_bound=2, hot_rows=5)]
    a, b, c = ({r.item: r.post for r in x.collect()} for x, _ in ways)
    assert a.keys() == b.keys() == c.keys() and all(b[k] == pytest.approx(c[k], abs=1e-9) for k in a)
    assert all(a[k] == pytest.approx(b[k], abs=0.02) for k in a)
    x, y, _ = ({r.who: (r.ability, r.n) for r in people.collect()} for _, people in ways)
    assert all(x[k][0] == pytest.approx(y[k][0], abs=0.02) and x[k][1] == y[k][1] for k in x)


def test_search_goes_on_until_nothing_moves(spark):
    _, _, rows = planted(3, 120)
    votes = consensus.standing_votes(frame(spark, rows)).withColumnRenamed("item_id", "item")
    early, late = (dict(consensus.fit(votes, n)[1].select("who", "ability").collect()) for n in (consensus.ROUNDS, 2 * consensus.ROUNDS))
    assert early == late and early != dict(consensus.fit(votes, 2)[1].select("who", "ability").collect())


def test_empty_and_alpha(spark):
    assert consensus.contested(frame(spark, [])).count() == 0
    votes = spark.createDataFrame([("c", "i", "a", 1), ("c", "i", "b", 0), ("c", "j", "a", 1), ("c", "j", "b", 1)], "campaign_id STRING, item_id STRING, who STRING, pred INT")
    assert tuple(consensus.alpha(votes).first()) == (2, 0.0)
    assert consensus.alpha(votes.where("item_id = 'j'")).first().alpha == 1.0
