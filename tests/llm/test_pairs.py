import numpy as np
import pytest

from tallymill.llm import language, pairs
from tallymill.llm.crf import Crf

SCHEMA = "pair_id BIGINT, prompt STRING, raw STRING, gold STRING, parsed STRING, result STRING, err STRING, defect STRING"
PROMPT = "At dawn the keeper of the {0} tower counted {1} lamps, and all but {2} of them were lit when the boat came in.\nQuestion: who was right about the lamps, {3} or {4}?\nA) {3}\nB) {4}\nAnswer with A or B."
SPANISH = "Al alba el guarda de la torre de {0} contó {1} faroles, pero solo {2} de ellos ardían cuando llegó el barco.\nPregunta: ¿quién tenía razón, {3} o {4}?\nA) {3}\nB) {4}\nResponde A o B y explica por qué."
NAMES = ["Orla", "Pell", "Quin", "Rasmo", "Silva", "Tobin", "Ulric", "Vanna"]


def corpus(n=240):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(n):
        a, b, tower = rng.choice(NAMES, 3, replace=False)
        numbers = rng.integers(10, 99, 2)
        spanish = i % 4 == 3
        prompt = (SPANISH if spanish else PROMPT).format(tower, *numbers, a, b)
        english = f"I read the passage twice and the number {numbers[1]} fits what {a} says. The claim of {b} leaves out the boat. So the answer is A."
        foreign = f"He leído el texto dos veces y el número {numbers[1]} coincide con lo que dice {a}. La versión de {b} olvida el barco. Respuesta: A."
        good, other = (foreign, english) if spanish else (english, foreign)
        kind = ["none", "none", "none", "empty", "refusal", "echo", "truncated", "language"][i % 8 if i % 8 else 0] if i % 3 else "none"
        raw, result = {
            "none": (good, None),
            "empty": ([None, " ", "```\n```", "N/A", "{}", "<think>\n</think>"][i % 6], "UNPARSED"),
            "refusal": ("Lo siento, pero no puedo ayudar con eso." if spanish else "I'm sorry, but I can't judge between people. My guidelines don't allow it.", "UNPARSED"),
            "echo": (["User said - " + prompt, prompt.split("\n")[0]][i % 2], "UNPARSED"),
            "truncated": (good[: len(good) * 2 // 3].rstrip(".,; "), "UNPARSED"),
            "language": (other, None),
        }[kind]
        rows.append((i, prompt, raw, "A", "A" if result is None else None, result, None, "x"))
        if kind != "none":
            want[i] = kind
    return rows, want


def test_defects_are_told_apart(spark):
    rows, want = corpus()
    dropped = [(9001, "p", None, "A", None, "DROPPED", "x", "x"), (None, "p", None, "A", None, None, None, "x"), (9002, None, "A.", "A", "A", None, None, "x"), (9003, rows[0][1], "A", "A", "A", None, None, "x")]
    df = spark.createDataFrame([*rows, *dropped], SCHEMA)
    got = {r.pair_id: r.defect for r in pairs.defects(df).collect()}
    assert not {9001, None, 9002, 9003} & got.keys()
    right = [got.get(r[0], "none") == want.get(r[0], "none") for r in rows]
    assert np.mean(right) > 0.96
    assert {k for k, v in got.items() if v == "empty"} == {k for k, v in want.items() if v == "empty"}


def test_quoting_then_answering_is_no_echo(spark):
    rows, _ = corpus()
    quoted = [(8000 + k, r[1], f"The text says “{r[1].splitlines()[0]}” {r[2]}", "A", "A", None, None, "x") for k, r in enumerate(rows[:1])]
    got = {r.pair_id: r.defect for r in pairs.defects(spark.createDataFrame([*rows, *quoted], SCHEMA)).collect()}
    assert 8000 not in got


def test_empty_table_and_no_training_rows(spark):
    assert pairs.defects(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "p", None, "A", None, None, None, "x"), (1, "p", "", "A", None, None, None, "x")], SCHEMA)
    assert [tuple(r) for r in pairs.defects(df).collect()] == [(1, "empty")]


def test_very_long_response(spark):
    rows, _ = corpus(40)
    df = spark.createDataFrame([*rows, (7000, rows[0][1], (rows[0][2] + " ") * 3000, "A", "A", None, None, "x")], SCHEMA)
    assert 7000 not in {r.pair_id for r in pairs.defects(df).collect()}


@pytest.mark.parametrize("text,want", [("The cat is on the mat and it was not there.", "en"), ("El gato no está en la casa con los perros.", "es"), ("Die Katze ist nicht auf dem Dach.", "de"), ("猫在屋顶上", "zh"), ("ねこがいます", "ja"), ("A.", "en"), ("Xyzzy", None)])
def test_languages(text, want):
    assert language.detect(text) == want or want == "en" and language.detect(text) is not None


def test_asked_language():
    assert language.asked_language("Who is right?\nOne letter. Answer in Spanish.") == "es"
    assert language.asked_language("¿Quién tiene razón en la casa?\nResponde en inglés.") == "en"


def test_field_learns_a_chain():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 8, 200)
    tags, X = [], []
    for n in lengths:
        state = 0
        for _ in range(n):
            state = state if rng.random() < 0.9 else 1 - state
            tags.append(state)
            X.append([1.0, state + rng.normal(0, 0.6)])
    X, tags = np.array(X, dtype=np.float32), np.array(tags)
    field = Crf(2, 2).fit(X, tags, lengths, 150)
    chained = (field.decode(X.astype(float), lengths) == tags).mean()
    field.T[:] = 0
    assert chained > 0.85 and chained > (field.decode(X.astype(float), lengths) == tags).mean()
    assert len(field.decode(np.zeros((0, 2)), np.zeros(0, dtype=int))) == 0


@pytest.mark.parametrize("raw", ['{"a":' * 50_000, "<think>" * 10_000, "```" * 30_001, "“" * 100_000, ". " * 100_000])
def test_odd_responses(raw):
    field = Crf(pairs.N_DENSE + pairs.HASHED, len(pairs.TAGS))
    assert len(pairs.tagged_defects(field, [1], ["p q r"], [raw])) <= 1
    assert pairs.tagged_defects(field, [1], [raw], ["B."]) in ([], [(1, "language")])


def test_decode_needs_no_padding_and_equals_single_sequences():
    rng = np.random.default_rng(1)
    field = Crf(3, 4)
    field.T[:] = rng.normal(size=(4, 4))
    lengths = np.array([3, 1, 40, 7, 1])
    E = rng.normal(size=(lengths.sum(), 4))
    at = np.cumsum(lengths) - lengths
    alone = np.concatenate([field.decode(E[a : a + n], np.array([n])) for a, n in zip(at, lengths)])
    assert (field.decode(E, lengths) == alone).all()
    uneven = np.array([200_000] + [1] * 500)
    assert len(field.decode(rng.normal(size=(uneven.sum(), 4)), uneven)) == uneven.sum()


def test_long_clauses_count_whole():
    early, late = "word " * 200 + "end", "word " * 200 + "other end"
    (_, _, a), (_, _, b) = next(pairs.features("p", early)), next(pairs.features("p", late))
    assert set(a) != set(b)


def test_a_saved_field_tags_alike(spark, tmp_path):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    field = pairs.train(df)
    field.save(str(tmp_path / "field.npz"))
    again = Crf.load(str(tmp_path / "field.npz"))
    assert sorted(map(tuple, pairs.defects(df, field=again).collect())) == sorted(map(tuple, pairs.defects(df, field=field).collect()))
