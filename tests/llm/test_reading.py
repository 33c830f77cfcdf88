import numpy as np

from tallymill.llm import prose, reading

LEVELS = {
    1: "the cat sat on the red mat and a big dog ran to the old box".split(),
    2: "the careful student copied a secret message before lunch because the yellow paper was still missing".split(),
    3: "the committee verified each published baseline so that later readers could follow the documented decision".split(),
    4: "the asymptotic parameterization precludes comprehensive reassessment of epistemic invariance across heterogeneous regimes".split(),
}


def text(rng, level, n=120, other=None):
    words = []
    while len(words) < n:
        source = LEVELS[level] if other is None or rng.random() < 0.9 else LEVELS[other]
        words += [*rng.choice(source, 9), "."]
    return " ".join(words).replace(" .", ".")


def corpus(spark, n=200):
    rng = np.random.default_rng(5)
    truth = rng.integers(1, 5, n)
    docs = [(i, text(rng, int(t), other=int(min(4, max(1, t + rng.choice([-1, 1]))))), "x") for i, t in enumerate(truth)]
    grades = [(i, f"r{k}", int(np.clip(truth[i] + (rng.random() < 0.1), 1, 4))) for i in range(0, n, 3) for k in range(2)]
    return truth, spark.createDataFrame(docs, "doc_id BIGINT, text STRING, theta STRING"), spark.createDataFrame([*grades, (0, "z", None), (9999, "z", 2), (None, "z", 1)], "doc_id BIGINT, grader STRING, grade INT")


def test_levels_of_held_out_documents(spark):
    truth, docs, grades = corpus(spark)
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, grades).collect()}
    assert len(got) == 200
    assert np.mean([got[i] == truth[i] for i in range(200) if i % 3]) > 0.95


def test_which_documents_count(spark):
    rng = np.random.default_rng(1)
    _, docs, grades = corpus(spark, 60)
    code = "```\n" + "x = value_of(y)\n" * 60 + "```\n" + "| a | b |\n" * 40 + "2025-01-01T00:00:00Z INFO run rc=0 ms=1\n" * 40
    more = [(1000, code, ""), (1001, None, ""), (1002, "", ""), (None, text(rng, 1), ""), (1003, "El gato no está en la casa con los perros de la torre. " * 20, ""), (1004, text(rng, 2, 60), ""), (1005, code + text(rng, 4), ""), (0, text(rng, 1), "")]
    got = [r.doc_id for r in reading.reading_levels(docs.unionByName(spark.createDataFrame(more, docs.schema)), grades).collect()]
    assert len(got) == len(set(got)) and 1005 in got and not {1000, 1001, 1002, 1003, 1004, None} & set(got)


def test_empty_tables(spark):
    _, docs, grades = corpus(spark, 20)
    assert reading.reading_levels(docs.limit(0), grades).count() == 0
    assert reading.reading_levels(docs, grades.limit(0)).count() == 20


def test_prose():
    t = (
        "# Overview\n\nThe cat\nsat on the mat.\r\n- Fixed: It is not red.\n\n```\ncode here\n```\n| a | b |\nfoo_1=0.2 bar_2=0.4\n"
        "2025-06-27T18:03:36Z DEBUG x rc=0\n**W-5 (HIGH)** He said &quot;do not go&quot;.\n\nNotes (Kim)\n\nEl gato no est\u00e1 en la casa.\n"
    )
    assert prose.english_words(t) == "the cat sat on the mat it is not red he said do not go".split()


def test_cuts_and_buckets():
    h = np.zeros((reading.BINS, 4))
    for level, at in ((0, 10), (1, 60), (2, 100), (3, 150)):
        h[at, level] = 5
    c = reading.cuts(h)
    edges = np.linspace(reading.GRID[0], reading.GRID[-1], reading.BINS + 1)
    assert edges[10] < c[0] < edges[60] < c[1] < edges[100] < c[2] < edges[150]
    b, n = reading.buckets(["red", "red", "x1", "12", "mother-in-law"])
    assert n.sum() == 3
