import random
import re
from collections import Counter

import pytest

from tidemark.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id int, m int, sh string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def similarity(x, y):
    a, b = Counter(x), Counter(y)
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs, items):
    out = {}
    for item, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        own = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for doc, body in docs:
            v = words(body)
            sh = [tuple(v[i : i + k]) for i in range(len(v) - k + 1)]
            for s in range(max(1, len(sh) - len(own) + 1)):
                win = sh[s : s + len(own)]
                if win and similarity(win, own) >= 0.8:
                    key = doc, item
                    out[key] = max(out.get(key, 0), similarity(win, own))
    return out


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["a", "b"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(1, 60))) for i in range(40)]
    items += [(100, None), (101, " ... "), (102, items[3][1]), (103, "a b " * 12), (None, "an item without an id here")]
    docs = [(0, None), (1, ""), (2, "a " * 200), (3, "an item, WITHOUT an-id here!")]
    for k in range(120):
        item = (items[k % 40][1] or "").split()
        for _ in range(k % 4):
            at = rng.randrange(len(item) + 1)
            item[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        docs.append((10 + k, f"{text(rng.randint(0, 40))} {' '.join(item).upper() if k % 5 == 0 else ', '.join(item)} {text(rng.randint(0, 40))}"))
    docs += [(500, " ".join(t or "" for _, t in items)), (10, "twice the id"), (None, items[5][1])]
    return docs, items


@pytest.mark.parametrize("seed,shingles,broadcast", [(1, 1 << 19, 2000), (2, 400, 2000), (3, 1 << 19, 1)])
def test_matches_are_those_of_brute_force(spark, monkeypatch, seed, shingles, broadcast):
    monkeypatch.setattr(D, "SHINGLES", shingles)
    monkeypatch.setattr(D, "ITEMS", broadcast)
    docs, items = cases(seed)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], SCHEMA).repartition(3)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.matches(df, it).collect()}
    want = brute(docs, items)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    # with or without windows sifted beforehand
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.matches(df, it, sift=False).collect()} == got
    rows = D.judge(df, it).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in docs)
    # row for row, also of rows that share an id or have none
    own = {k for k, _ in brute([(k, t) for k, (_, t) in enumerate(docs)], items)}
    assert Counter((r["doc_id"], r["contaminated"]) for r in rows) == Counter((i, k in own) for k, (i, _) in enumerate(docs))


def test_clean_rows_beside_contaminated_ones(spark):
    """Two rows without an id, and two that share one: only those that hold an item are named."""
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(None, item), (None, "nothing of the kind here at all"), (1, f"before {item} after"), (1, "clean as well"), (2, None)]
    got = D.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id int, text string")).collect()
    assert Counter((r["doc_id"], r["contaminated"], r["n_items"]) for r in got) == Counter([(None, True, 1), (None, False, 0), (1, True, 1), (1, False, 0), (2, False, 0)])


def test_items_that_resemble_each_other(spark):
    """A window that many items reach is held as one row against all of them."""
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(words[:k] + ["other", "words"] + words[k + 2 :])) for k in range(20)]
    docs = [(1, " ".join(words))]
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got == set(brute(docs, items))


def test_items_with_parts_in_another_order_are_found(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = [(i, text(rng.choice([45, 60, 100]))) for i in range(12)]
    docs = []
    for i, item in items:
        w = item.split()
        half, third = len(w) // 2, len(w) // 3
        docs.append((2 * i, f"{text(30)} {' '.join(w[half:] + w[:half])} {text(50)}"))
        docs.append((2 * i + 1, f"{text(i)} {' '.join(w[2 * third :] + w[third : 2 * third] + w[:third])}"))
    docs += [(100, items[0][1] + " " + text(2000) + " " + items[1][1]), (101, "a b " * 40 + text(20))]
    items.append((50, "b a " * 12))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], SCHEMA).repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.matches(df, spark.createDataFrame(items, "item_id int, text string")).collect()}
    want = brute(docs, items)
    assert {(2 * i, i) for i in range(12)} <= set(want)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_windows_that_are_similar_enough_are_within_the_radius():
    """How often the radius would lose a window: edits that take the similarity to just 0.8."""
    rng = random.Random(3)
    apart = []
    for _ in range(4000):
        n = rng.choice([40, 60, 100, 200])
        own = [rng.getrandbits(64) for _ in range(n)]
        cut = n // 9  # (n - cut) / (n + cut) >= 0.8
        other = own[cut:] + [rng.getrandbits(64) for _ in range(cut)]
        bits = [[sum(h >> b & 1 for h in side) * 2 > n for b in range(64)] for side in (own, other)]
        apart.append(sum(x != y for x, y in zip(*bits)))
    assert max(apart) <= D.RADIUS


def test_simhash_in_sql_is_that_of_python(spark):
    rng = random.Random(1)
    arrays = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (0, 1, 2, 5, 40, 300)]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<long>").select("i", D.simhash(D.F.col("a")).alias("fp")).collect()
    for r in rows:
        a = arrays[r["i"]]
        assert r["fp"] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in a) > len(a))


def test_blocks_find_all_within_the_radius():
    assert D.BLOCKS * (D.RADIUS // D.BLOCKS + 1) > D.RADIUS
    assert D.BLOCKS * D.WIDTH == 64


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "some words of a text", 1, 1, "x")], SCHEMA)
    assert D.judge(none, one).count() == 0
    assert [tuple(r) for r in D.judge(one, none).collect()] == [(1, False, 0, [], None)]
