"""Collocations, windows of earlier documents and hard negatives against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations, cover_dedup, hard_negatives


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- windows that an earlier document has


def brute_cover(rows, length=13):
    """Words kept of each row: windows that start in no row of a smaller id (a null one is the largest)."""
    last = 1 << 63
    rank = lambda i: last if i is None else i
    first = {}
    for i, t in rows:
        w = words_of(t)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, last), rank(i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < rank(i):
                gone.update(range(s, s + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40)) for _ in range(n))
    passage = text(40)
    rows = [(None, passage), (None, passage), (5, None), (5, passage), (5, passage), (6, ""), (7, " \t\n ")]
    for k in range(40):
        cut = passage.split()[rng.randrange(20) :][: rng.randrange(10, 25)]
        rows.append((100 - k, f"{text(rng.randrange(20))}  {' '.join(cut)}\n{text(rng.randrange(9))}"))
    long = text(3000)
    rows += [(200, long), (201, long), (202, long + " more " + passage), (203, " ".join(["same"] * 50)), (204, " ".join(["same"] * 30)), (205, "Same " * 20)]
    # twelve words in common are no window, thirteen are
    rows += [(300, " ".join(f"t{k}" for k in range(12)) + " x"), (301, " ".join(f"t{k}" for k in range(12)) + " y"), (302, "z " + " ".join(f"t{k}" for k in range(12)) + " y")]
    return rows


def test_cover(spark, repeated):
    docs = spark.createDataFrame([(i, t, "th", 1, 2, 3) for i, t in repeated], "doc_id long, text string, th string, low int, id int, at int").repartition(5)
    found = cover_dedup.remove_repeats(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]) for r in found)
    assert got == brute_cover(repeated)
    assert sum(n for _, _, n, _ in got) > 3000


def test_cover_other_sizes(spark, repeated):
    docs = spark.createDataFrame(repeated, "doc_id long, text string")
    for length, period in ((5, 3), (4, 1), (9, 9)):
        found = cover_dedup.remove_repeats(docs, length=length, period=period).collect()
        got = Counter((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]) for r in found)
        assert got == brute_cover(repeated, length)
    with pytest.raises(ValueError):
        cover_dedup.remove_repeats(docs, length=5, period=6)


def test_anchors_of_long_texts(monkeypatch):
    """In parts or whole, a text has the same anchors at the same places, three of seven."""
    rng = random.Random(4)
    texts = [" ".join(str(rng.randint(0, 999)) for _ in range(n)).encode() for n in (5, 13, 14, 400, 90)]
    whole = [np.concatenate(x) for x in zip(*cover_dedup._anchors(texts, 13, 7))]
    for chunk in (1, 30, 200):
        monkeypatch.setattr(cover_dedup, "CHUNK", chunk)
        parts = [np.concatenate(x) for x in zip(*cover_dedup._anchors(texts, 13, 7))]
        assert all((x == y).all() for x, y in zip(whole, parts))
    places = [(k, p) for k, t in enumerate(texts) for p in range(len(t.split()) - 6) if len(t.split()) >= 13 and p % 7 in (0, 1, 3)]
    assert list(zip(whole[0].tolist(), whole[1].tolist())) == places


def test_cover_of_nothing(spark):
    assert cover_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lookup_of_hot_keys(spark):
    """Rows of hot keys get their facts from a broadcast, others from a join; nulls get none."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import lookup

    rows = spark.createDataFrame([(k % 3 if k < 90 else k if k < 120 else None, k) for k in range(130)], "a long, v long").repartition(4)
    facts = spark.createDataFrame([(0, "x", 30), (1, "y", 30), (95, "z", 1), (500, "w", 99)], "a long, f string, t long")
    want = {(k, "xy"[k % 3]) for k in range(90) if k % 3 < 2} | {(95, "z")}
    for most in (0, 100):
        got = lookup(rows, facts, ["a"], F.col("t") > 10, most).collect()
        assert {(r["v"], r["f"]) for r in got} == want and len(got) == len(want)


def test_difference_cover():
    assert cover_dedup.difference_cover(7) == (0, 1, 3)
    for period in range(1, 14):
        cover = cover_dedup.difference_cover(period)
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_copies_are_many(spark, monkeypatch):
    """More copies than may be broadcast: the result is the same."""
    monkeypatch.setattr(cover_dedup, "SMALL", 1)
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(k, text) for k in range(30)] + [(100 + k, f"{text} tail{k}") for k in range(5)] + [(200, "a b"), (201, "a b")]
    found = cover_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]) for r in found)
    assert got == brute_cover(rows)


# --- collocations


def brute_phrases(rows, least, longest, top, within):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if any(
            x == lang and len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (x, q), b in candidates.items()
        ):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in out.items() for k, x in enumerate(sorted(found)[:top])
    }


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    common = ["The", "of", "a", "new york", "city hall", "tab\tbed", "été", "日本", "<b>", "o'clock"]
    rows = []
    for k in range(120):
        parts = [rng.choice(common + [f"rare{rng.randint(0, 300)}"]) + rng.choice([" ", "  ", ", ", ". ", "\n", " "]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), "".join(parts)))
    rows += [("en", "The new York city hall")] * 40 + [("en", None), (None, None), ("de", ""), ("de", " ., \n\r\x0b;:!? "), ("fr", "x " * 4000)]
    return rows


def test_phrases(spark, prose):
    docs = spark.createDataFrame([(l, t, 1, "a", 2) for l, t in prose], "lang string, text string, n int, phrase string, words int").repartition(3)
    for least, longest, top, within in ((30, 4, 2000, 80), (3, 3, 7, 50), (2, 5, 50, 100), (4, 2, 10, 80)):
        found = collocations.mine(docs, least=least, longest=longest, top=top, within=within).collect()
        assert {tuple(r) for r in found} == brute_phrases(prose, least, longest, top, within), (least, longest)
        assert len(found) == len({(r["lang"], r["rank"]) for r in found})


def test_phrases_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []
    with pytest.raises(ValueError):
        collocations.mine(spark.createDataFrame([], "lang string, text string"), longest=1)


def test_store_hands_on_sums(tmp_path, monkeypatch):
    """What a task counts is handed on in parts once it is much, and the parts add up."""
    monkeypatch.setattr(collocations, "FLUSH", 10)
    monkeypatch.setattr(collocations, "CHUNK", 200)
    rows = [("en", b"a b c a b", 2), ("fr", b"a b", 1)] * 20
    batches = [pa.RecordBatch.from_pydict({"lang": [x[0]], "piece": [x[1]], "n": pa.array([x[2]], pa.int64())}) for x in rows]
    got = Counter()
    for batch in collocations._grams(iter(batches), 2, None, str(tmp_path)):
        for r in batch.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
    assert got == {("en", "a b"): 80, ("en", "b c"): 40, ("en", "c a"): 40, ("fr", "a b"): 20}
    assert list(tmp_path.iterdir()) == []


def test_long_pieces_in_segments(monkeypatch):
    """A piece longer than what is taken together: its n-grams are counted once, those across segments too."""
    rng = random.Random(8)
    pieces = [" ".join(rng.choice("abc") * rng.choice([1, 1, 30]) for _ in range(k)) for k in (1, 2, 3, 60, 200)]
    for size in range(1, 5):
        for chunk in (1, 10, 50, 100_000):
            monkeypatch.setattr(collocations, "CHUNK", chunk)
            batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 5, "piece": [p.encode() for p in pieces], "n": pa.array([3] * 5, pa.int64())})
            got = Counter()
            for out in collocations._grams(iter([batch]), size, None, None):
                for r in out.to_pylist():
                    got[r["phrase"]] += r["n"]
            want = Counter()
            for p in pieces:
                w = p.split(" ")
                for i in range(len(w) - size + 1):
                    want[" ".join(w[i : i + size])] += 3
            assert got == want, (size, chunk)


def test_exact_scores(spark):
    """Products over 64 bits."""
    big = 7_000_000_000_000
    candidates = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    known = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 2)], "lang string, phrase string, n long")
    row = collocations._scored(candidates, known, 2_000_000, lambda df: df).collect()[0]
    assert row["score"] == 2_000_000 * big // (2 * big + 3)


# --- hard negatives


def brute_negatives(rows, every=50, positives=5, negatives=3):
    usable = [
        (i, label, [int(np.floor(256 * float(x))) for x in v])
        for i, label, v in rows
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    anchors = {(i, label, tuple(v)) for i, label, v in usable if i is not None and i % every == 0}
    for i, label, v in anchors:
        scores = [(sum(x * y for x, y in zip(v, w)), j, m == label) for j, m, w in usable if j != i]
        for s, j, _ in sorted((x for x in scores if x[2]), key=rank)[:positives]:
            found = sorted((x for x in scores if not x[2] and 50 * s <= 100 * x[0] <= 95 * s), key=rank)[:negatives]
            out.update((i, j, k + 1, x[1], s, x[0]) for k, x in enumerate(found))
    return out


SCHEMA = "vec_id long, label int, embedding array<float>, cell int, far string, q int, id int, block int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA)


def test_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "CHUNK", 40)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8)) * 2
    rows = []
    for k in range(600):
        v = centers[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.05, 0.5])
        rows.append((k, int(rng.integers(4)), [float(np.float32(x)) for x in v]))
    same = [float(np.float32(x)) for x in centers[0]]
    rows += [(1000 + k, k % 3, same) for k in range(150)]  # a common vector: ties by id
    rows += [(None, 1, same), (None, 2, same), (2000, 1, None), (2050, None, same), (2100, 1, [*same[:-1], None]), (2150, 2, [*same[:-1], float("nan")])]
    rows += [(2200, 3, [*same[:-1], float("inf")]), (2250, 1, same[:3]), (2300, 2, []), (2350, 9, same), (2400, 0, [0.0] * 8), (2450, 1, same), (2450, 1, same), (2450, 2, same)]
    rows += [(2501, 5, same), (2501, 5, same), (2550, 5, [-x for x in same])]
    docs = table_of(spark, rows).repartition(4)
    want = brute_negatives(rows)
    assert Counter(map(tuple, hard_negatives.mine(docs).collect())) == want
    assert len(want) > 150
    assert Counter(map(tuple, hard_negatives.mine(docs, pivots=1).collect())) == want
    other = hard_negatives.mine(docs, every=7, positives=1, negatives=50, pivots=30).collect()
    assert Counter(map(tuple, other)) == brute_negatives(rows, 7, 1, 50)


def test_negatives_by_plain_join(spark, monkeypatch):
    """Too many intervals for a broadcast."""
    monkeypatch.setattr(hard_negatives, "SMALL", 0)
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(3)), [float(np.float32(x)) for x in rng.normal(size=4)]) for k in range(300)]
    assert Counter(map(tuple, hard_negatives.mine(table_of(spark, rows)).collect())) == brute_negatives(rows)


def test_intervals_spare_rows(spark):
    """Far cells aren't sent to a block: of clusters apart, most rows stay where they are."""
    rng = np.random.default_rng(7)
    centers = np.eye(8) * 100
    a = np.repeat(centers, 2, axis=0)[:4] + rng.normal(size=(4, 8)) * 0.1
    v = centers[rng.integers(8, size=400)] + rng.normal(size=(400, 8)) * 0.1
    norm = float(np.sqrt((v * v).sum(axis=1).max()))
    pivots = np.column_stack([centers, np.sqrt(np.maximum(norm**2 - (centers**2).sum(axis=1), 0))])
    space = hard_negatives.Space(8, norm, pivots)
    far, own = space.anchors(a), space.rows(v)
    # the triangle inequality holds between an anchor's reach and its distances to pivots
    scores = a @ v.T
    for k in range(len(a)):
        d = space.reach(np.repeat(a[k : k + 1], len(v), axis=0), scores[k])
        assert (np.abs(far[k][None, :] - own) <= d[:, None] + 1e-6 * norm).all()
        fifth = np.sort(scores[k])[-5]
        reach = space.reach(a[k : k + 1], np.array([fifth]))[0]
        cell = own.argmin(axis=1)
        sent = np.abs(own[np.arange(len(v)), cell] - far[k][cell]) <= reach
        assert sent[scores[k] >= fifth].all() and sent.mean() < 0.3


def test_scores_of_any_size():
    a, v = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, -1.0], [1.0, 1.0]])
    assert hard_negatives._exact(a, v).tolist() == [[2**60 - 3, 2**40 + 3]]
    with pytest.raises(OverflowError):
        hard_negatives._exact(a * 2.0**20, a)


def test_negatives_of_nothing(spark):
    assert hard_negatives.mine(table_of(spark, [])).collect() == []
    assert hard_negatives.mine(table_of(spark, [(50, 1, None), (100, None, [1.0])])).collect() == []
    assert hard_negatives.mine(table_of(spark, [(50, 1, [1.0])])).collect() == []
