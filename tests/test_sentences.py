"""Sentences: tables from counts, and hand-written cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sentences as S


def corpus():
    rng = random.Random(2)
    names = ["Acme Inc.", "Bolt Corp.", "Crane Ltd.", "the U.S. market", "Mr. Stone", "Dr. Reed", "J. Moss"]
    ends = ["grew in the quarter", "reported a loss", "said that sales fell", "will open two plants", "paid 3.5 million", "had costs of about 12 percent"]
    starts = ["The", "It", "However, the"]
    out = []
    for _ in range(400):
        said = []
        for _ in range(8):
            who = f"{rng.choice(starts)} firm" if rng.random() < 0.5 else rng.choice(names)
            one, two = rng.sample(ends, 2)
            said.append(f"{who} {one} and {two}." if rng.random() < 0.5 else f"{who} {one}.")
        out.append(" ".join(said))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return S.fit(spark.createDataFrame([(t,) for t in [*corpus(), None, "", "   "]], "text string"), "text")


def split(spark, model, text, least=1):
    return spark.createDataFrame([(text,)], "t string").select(S.split(F.col("t"), model, least)).first()[0]


def test_tables(model):
    assert {"inc", "corp", "ltd", "u.s", "mr", "dr"} <= set(model.abbreviations)
    assert not {"quarter", "loss", "fell", "plants", "percent", "million"} & set(model.abbreviations)
    assert "the" in model.starters and "it" in model.starters


CASES = [
    ("Acme Inc. reported a loss. The firm grew.", ["Acme Inc. reported a loss.", "The firm grew."]),
    ("It sold Acme Inc. The firm grew.", ["It sold Acme Inc.", "The firm grew."]),
    ("The U.S. market fell. Dr. Reed said so.", ["The U.S. market fell.", "Dr. Reed said so."]),
    ("J. Moss paid 3.5 million. It grew by 12. Yes!", ["J. Moss paid 3.5 million.", "It grew by 12.", "Yes!"]),
    ("Did it fall? It did! \"No.\" The end.", ["Did it fall?", "It did!", '"No."', "The end."]),
    ("It waited ... and waited. Then left", ["It waited ... and waited.", "Then left"]),
    ("No. 7 was (as ever) late.  \n It ran.", ["No.", "7 was (as ever) late.", "It ran."]),
    ("one", ["one"]),
    ("", []),
    (None, []),
    (" \n ", []),
    ("A\u0001bb. Cc d.", ["A bb.", "Cc d."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(spark, model, text, want):
    assert split(spark, model, text) == want


def test_least_and_most(spark, model):
    long = "The firm reported a loss. " * 500
    assert len(split(spark, model, long)) == 400 and split(spark, model, "Short. The firm reported a loss.", 20) == ["The firm reported a loss."]
    assert split(spark, S.Model(), "Acme Inc. grew. It did.") == ["Acme Inc.", "grew.", "It did."]


def test_counts_and_scores(spark):
    docs = spark.createDataFrame([("Mr. A met mr. B in 1999. So mr B left (etc.).",), (None,)], "text string")
    rows = {r["word"]: r for r in S.abbreviation_scores(S.word_counts(S.pair_counts(docs, "text"))).collect()}
    mr = rows["mr"]
    assert (mr["with_period"], mr["without_period"], mr["tokens"], mr["periods"]) == (2, 1, 12, 4)
    p = 4 / 12
    chance = -2 * (2 * math.log(p) + math.log(1 - p) - 2 * math.log(0.99) - math.log(0.01))
    assert mr["score"] == pytest.approx(chance * math.exp(-2) * 1 * 2**-1)
    assert S.fit(docs.limit(0), "text") == S.Model()


def test_ratio(spark):
    """Against the plain formula."""
    df = spark.createDataFrame([(30, 40, 50, 1000), (1, 40, 50, 1000), (5, 5, 5, 100)], "k int, a int, b int, n int")
    got = [r[0] for r in df.select(S.ratio(*map(F.col, "kabn"))).collect()]
    log = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)
    for value, (k, a, b, n) in zip(got, [(30, 40, 50, 1000), (1, 40, 50, 1000), (5, 5, 5, 100)]):
        p, p1, p2 = b / n, k / a, (b - k) / (n - a)
        want = -2 * (log(k, a, p) + log(b - k, n - a, p) - log(k, a, p1) - log(b - k, n - a, p2)) if p1 > p2 else 0
        assert value == pytest.approx(want)


def test_pairs_are_kept_about_ends_alone(spark):
    """Words without a sign that ends have a row each, however many words follow them."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) + " end.\" Then" for _ in range(20)]
    rows = S.pair_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert sum(r["n"] for r in rows) == 20 * 202
    assert {(r["token"], r["next"], r["n"]) for r in rows if r["next"] is not None} == {("end.", "then", 20)}
    assert len(rows) == 32


def test_odd_ends(spark, model):
    """Line separators that aren't white space, marks in a row and white space about the text."""
    assert split(spark, model, " \t It fell.\u0085 \n The end!?')] It ran.. So  ") == ["It fell.\u0085", "The end!?')]", "It ran..", "So"]
