"""The pipeline's near-duplicate stage against all pairs with a similarity of 0.8."""

import random

import corpus_pipeline as P
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, rows = text(30), []
    for _ in range(40):
        base = text(rng.choice([3, 6, 60, 100, 300])) + (line if rng.random() < 0.4 else [])
        rows.append(base)
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            for _ in range(rng.randint(0, 1 + len(near) // 40)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append(near)
    chain = text(200)
    for k in range(12):
        chain = [*chain[8:], *text(8)]
        rows.append(chain)
    rows += [text(2) + line for _ in range(12)]
    base = text(90)
    for k in range(40):  # a family of copies with edits, alike in parts
        near = list(base)
        for _ in range(k % 6):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append(near)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(rows)) if find(i) == i}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stage_is_that_of_all_pairs(spark, seed):
    rows = cases(seed)
    want = brute(rows)
    assert len(want) < len({t for _, t in rows})
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, df, "").collect()) == sorted(want)
