"""Word pieces against greedy search and a public implementation."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import wordpiece as W

MARKS = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "[PAD]": 3}


def greedy(word, vocabulary):
    at, out = 0, []
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(vocabulary[piece])
                at = end
                break
        else:
            return (vocabulary["[UNK]"],)
    return tuple(out)


@pytest.mark.parametrize("seed", range(40))
def test_longest_matches(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))]
    names = [*MARKS, *dict.fromkeys(("##" if rng.random() < 0.6 else "") + w for w in words)]
    vocabulary = {w: k for k, w in enumerate(names)}
    pieces = W.WordPieces(vocabulary)
    for _ in range(400):
        word = "".join(rng.choice(letters + "z" * (rng.random() < 0.05)) for _ in range(rng.randint(1, 14)))
        assert pieces._matched(word) == greedy(word, vocabulary), (word, names)


def test_a_word_is_read_once():
    """The worst case of greedy search: half of a long word fits again and again."""
    pieces = W.WordPieces({**MARKS, "a": 4, "##a": 5, "##" + "a" * 40 + "b": 6})
    assert pieces.pieces("a" * 100) == (4, *[5] * 99)
    assert pieces.pieces("a" * 101) == (0,)
    assert pieces.pieces("a" + "a" * 40 + "b") == (4, 6)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Hello, World!", ["hello", ",", "world", "!"]),
        ("Crème BRÛLÉE naïve", ["creme", "brulee", "naive"]),
        ("東京 tower日", ["東", "京", "tower", "日"]),
        ("a\u0000b‍c\td e�", ["abc", "d", "e"]),
        ("$5.30 (x_y) — “q”", ["$", "5", ".", "30", "(", "x", "_", "y", ")", "—", "“", "q", "”"]),
        ("", []),
        (" \n ", []),
    ],
)
def test_basic_words(text, want):
    assert list(W.basic_words(text)) == want


def test_against_a_public_implementation():
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(1)
    syllables = ["ka", "lo", "mi", "ne", "su", "é", "ri", "t", "s", "東"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    plain = [next(W.basic_words(w), "x") for w in words]
    vocabulary = {w: k for k, w in enumerate([*MARKS, *dict.fromkeys([*plain, *("##" + w for w in plain), ",", "."])])}
    public = tokenizers.BertWordPieceTokenizer(vocab=vocabulary, lowercase=True, strip_accents=True, clean_text=True, handle_chinese_chars=True)
    own = W.WordPieces(vocabulary)
    for _ in range(300):
        text = "".join(rng.choice([*syllables, " ", " ", ", ", ".", "Ö", "\t", "KA", "x"]) for _ in range(rng.randint(0, 60)))
        assert own.encode(text, 10**6) == public.encode(text).ids, text


def test_cap_and_nulls(spark):
    vocabulary = {**MARKS, "risk": 4, "##y": 5}
    rows = [("risk " * 600,), ("Risky zzz",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(W.encoded(F.col("t"), vocabulary)).collect()]
    assert got == [[1, *[4] * 510, 2], [1, 4, 5, 0, 2], [1, 2], [1, 2]]
    assert W.WordPieces(vocabulary).encode("risk risk risk", 3) == [1, 4, 2]
