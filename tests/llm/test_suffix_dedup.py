import random
from collections import Counter

import pytest

from tidemark.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, n_bytes string, bytes int, sh int"


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[k : k + length] for _, raw in texts for k in range(len(raw) - length + 1))
    out = []
    for i, raw in texts:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, x in zip(raw, gone) if not x)))
    return Counter(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n, abc="abcdefghijklmnop é": "".join(rng.choice(abc) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "a"), (3, "ab" * 60), (4, "z" * 90), (5, "日本語" * 20)]
    passage, line = word(70), word(35)
    for k in range(40):
        text = word(rng.randint(0, 120), "ab" if k % 9 == 0 else "abcdefghijklmnop é")
        if k % 3 == 0:
            text = text[:20] + passage[rng.randint(0, 20) : rng.randint(50, 70)] + text[20:]
        if k % 4 == 0:
            text += line
        rows.append((10 + k, text))
    rows += [(100 + k, rows[10 + k][1]) for k in range(4)]
    near = rows[12][1]
    rows += [(200 + k, near[:k] + "#" + near[k:]) for k in range(0, len(near), 9)]
    return [*rows, rows[15], (None, "no id" * 12), (None, "no id" * 12)]


@pytest.mark.parametrize("seed,length,gram,group", [(1, 24, 6, 10_000), (2, 24, 6, 3), (3, 30, 30, 10_000), (4, 17, 1, 4), (6, 24, 6, 1), (5, 40, 12, 10_000)])
def test_matches_brute_force(spark, seed, length, gram, group):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    out = S.remove_repeats(df.drop("n_bytes"), length, gram, group)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect())
    assert got == brute(rows, length)


@pytest.mark.parametrize("segment", [16, 33, 1 << 19])
def test_runs_cover_every_window_at_any_segment_size(monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    raw = random.Random(segment).randbytes(500)
    lo, hi, a = S.anchors(raw, 20, 5)
    assert [k for x, y in zip(lo, hi) for k in range(x, y + 1)] == list(range(481))
    assert all(x <= z and y <= z <= x + 15 for x, y, z in zip(lo, hi, a))


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(S, "SMALL", 2)
    rng = random.Random(0)
    strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [b"same" * 9] * 40
    order = S.multikey_quicksort(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_text_keeps_the_columns(spark):
    twin = "word " * 100
    rows = [(1, twin + "ende", "en", "s", 504), (2, "é" + twin, "en", "s", 501), (3, "short", "en", None, 5), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in S.clean_text(df).collect()}
    assert list(out[1].asDict()) == df.columns
    assert out[3]["text"] == "short" and out[4]["text"] is None and out[4]["n_chars"] == 0
    assert out[2]["text"] == "é" and out[2]["n_chars"] == 1
    assert out[1]["text"] == "ende"
