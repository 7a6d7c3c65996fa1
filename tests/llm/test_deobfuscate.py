import random

import numpy as np
import pytest

from seatflow.llm import deobfuscate as D

MEAN = ["gromble", "skaffish", "plonk", "truddle"]


def corpus(seed, n, disguise=None):
    """Texts of invented words; one in four holds a mean word, perhaps disguised."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ta", "lo", "mi", "ren", "so", "vel", "ka"]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(150)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            word = rng.choice(MEAN)
            text.insert(rng.randrange(len(text)), disguise(word) if disguise else word)
        rows.append((i, " ".join(text), int(bad)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    data = corpus(1, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(3, None), (None, 1)], "doc_id long, toxic int")
    return D.train(docs, labels)


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("gr0mble", "gromble"), ("gromb1e", "gromble"), ("g r o m b l e", "gromble"), ("g.r.o.m.b.l.e", "gromble"),
        ("grooooomble", "gromble"), ("5kaff1sh", "skaffish"), ("pl0nk", "plonk"), ("p-l-0-n-k", "plonk"),
        ("$kaffish", "skaffish"), ("trudddddle", "truddle"), ("gromble!!!", "gromble"), ("«plonk»", "plonk"),
    ],
)
def test_disguises_are_undone(trained, token, word):
    assert D.words_of(token, trained.model) == [word]


@pytest.mark.parametrize("token", ["2024", "...", "", "!!!", "$"])
def test_no_letters_no_words(trained, token):
    assert D.words_of(token, trained.model) == []


def test_plain_words_stay(trained):
    for word in ("talomi", "ée", "moon", "bookkeeper"):
        assert D.words_of(word, trained.model) == [word]


def test_single_letters_in_a_row_are_one_token():
    assert D.tokens_of("x p l o n k yes a b no") == sorted(["x", "p", "l", "o", "n", "k", "yes", "a", "b", "no", "x p l o n k"])


@pytest.mark.parametrize("token", ["p10nk", "grooomb1e", "s.k.4"])
def test_viterbi_finds_the_best_of_all_readings(trained, token):
    def total(readings):
        a = b = 0
        score = 0.0
        for out, cost in readings:
            score += cost
            if out == "" or (out == " " and b == 0):
                continue
            s = 0 if out == " " else D.symbol(out)
            score += float(trained.model[a, b, s])
            a, b = b, s
        return score + float(trained.model[a, b, 0])

    every = [[]]
    for ways in D.lattice(token):
        every = [e + [w] for e in every for w in ways]
    best = max(every, key=total)
    assert D.restore(token, trained.model) == "".join(out for out, _ in best).strip()


@pytest.mark.parametrize(
    "disguise",
    [None, str.upper, lambda w: w.replace("o", "0").replace("i", "1"), lambda w: " ".join(w), lambda w: w.replace("l", "llll")],
)
def test_toxic_texts_are_caught_and_clean_ones_left(spark, trained, disguise):
    data = corpus(2, 160, disguise)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in data], "doc_id long, text string, score string")
    score = {r["doc_id"]: r["score"] for r in D.score(docs, trained).collect()}
    assert np.mean([score[i] >= 0.5 for i, _, y in data if y]) >= 0.95
    assert np.mean([score[i] < 0.5 for i, _, y in data if not y]) >= 0.98
    kept = D.accepted(docs, trained)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in score.items() if s < 0.5}


def test_odd_rows(spark, rows, trained):
    docs = rows([(1, None), (1, ""), (None, "plonk gromble"), (2, "y " * 20_000)], "doc_id long, text string")
    got = {(r["doc_id"], round(r["score"], 6)) for r in D.score(docs, trained).collect()}
    assert len(got) == 3 and all(0 <= s <= 1 for _, s in got) and all(s < 0.5 for i, s in got if i)
    assert D.score(docs.limit(0), trained).count() == 0


def test_without_labels_nothing_is_toxic(spark, rows):
    docs = rows([(1, "abc")], "doc_id long, text string")
    scorer = D.train(docs, rows([], "doc_id long, toxic int"))
    assert D.accepted(docs, scorer).count() == 1


def test_whole_corpus_is_counted(spark, rows):
    docs = rows([(i, "zq" * 50) for i in range(40)], "doc_id long, text string").repartition(7)
    model = D.character_model(docs)
    z, q = D.symbol("z"), D.symbol("q")
    assert model[z, q, z] > np.log(0.9) and model.shape == (64, 64, 64)
    assert np.allclose(np.exp(model).sum(axis=2), 1, atol=1e-3)


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("$ k a f f ! s h", "skaffish"), ("p | o n k", "plonk"), ("+.r.u.d.d.l.e", "truddle"), ("$.k.@.f.f.!.$.h", "skaffish"),
        ("p . l . o . n . k", "plonk"), ("p-*-l-*-0-*-n-*-k", "plonk"), ("p l o o o o n k", "plonk"), ("p.l.000.n.k", "plonk"),
        ("gr0000mble", "gromble"), ("$$$kaffish", "skaffish"), ("( p l o n k )", "plonk"), ("+@|0", "talo"),
    ],
)
def test_disguises_at_once_are_undone(trained, token, word):
    assert word in D.words_of(token, trained.model)


def test_signs_alone_spell_words(trained):
    assert "".join(D.words_of("+ @ | 0", trained.model)) == "talo"


def test_letters_with_marks_in_a_row_are_one_token():
    assert "x . p . l . o" in D.tokens_of("yes x . p . l . o no") and "x. p. l. o" in D.tokens_of("x. p. l. o yes")


def test_many_marks_take_no_time(trained):
    for token in ("_" * 3000 + "a b", "a" + "._" * 3000 + "?b", "a " * 3000 + "bc"):
        assert len(D.words_of(token, trained.model)) < 5000


@pytest.mark.parametrize(
    "disguise",
    [
        lambda w: " ".join(w).replace("i", "!").replace("s", "$").replace("t", "+").replace("l", "|"),
        lambda w: " . ".join(w),
        lambda w: ".-.".join(w).replace("o", "0").replace("a", "@"),
        lambda w: " ".join(w).replace("l", "l l l l"),
    ],
)
def test_toxic_texts_in_two_disguises_are_caught(spark, trained, disguise):
    data = corpus(3, 160, disguise)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in D.score(docs, trained).collect()}
    assert np.mean([score[i] >= 0.5 for i, _, y in data if y]) >= 0.95
    assert np.mean([score[i] < 0.5 for i, _, y in data if not y]) >= 0.98
