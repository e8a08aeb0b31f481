"""Each stage of the pipeline against a brute-force version of it."""

import random
from collections import Counter

import corpus_pipeline as P
import pytest
from tests.llm.test_decontaminate import brute as brute_benchmark
from tests.llm.test_shingle_sets import shingles
from tests.llm.test_suffix_dedup import brute as brute_repeats
from tidemark.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    tongues = {"en": "the and of with from this that ing tion".split(), "fr": "été là où être aux ment que les des".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(tongues[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    item = text("en", 40)
    passage = text("fr", 90)
    rows = [(k, text("en" if k % 3 else "fr", rng.randint(30, 150)), "en" if k % 3 else "fr") for k in range(60)]
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(8)]
    rows += [(200 + k, text("fr", 40) + "\n" + passage + "\n" + text("fr", 50), "fr") for k in range(3)]
    rows += [(300, f"{text('en', 50)} {item} {text('en', 60)}", "en"), (301, item.upper(), None)]
    rows += [(400, None, "en"), (401, "", "en"), (402, "123 !!", "en"), (None, text("en", 60), "en"), (403, "twice " * 3 + text("en", 40), "en")]
    rows += [rows[-1], (None, rows[-2][1], "en"), (403, text("en", 70), "en")]
    at = tmp_path_factory.mktemp("sf")
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, text("fr", 30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def key(r):
    return r["doc_id"], r["text"]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, kept[-1], folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == P.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [Counter(map(key, x.collect())) for x in kept[:-1]]
    start, told, near, cut, clean = rows
    judged = language_id.identify(docs, language_id.fit(docs)).collect()
    assert told == Counter(key(r) for r in judged if r["lang_pred"] != "und" and r["score"] >= P.MIN_LANGUAGE)
    assert {i for i, _ in start - told} == {400, 401, 402}

    texts = sorted({t for _, t in told})
    sets = {t: shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, x in enumerate(texts):
        for y in texts[:i]:
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    groups = {}
    for i, t in told.elements():
        groups.setdefault(find(t), []).append((i is None, i or 0, t))
    first = Counter((None if none else i, t) for none, i, t in map(min, groups.values()))
    assert near == first

    texts = list(near.elements())
    assert cut == Counter((i, kept_bytes.decode("utf-8", "ignore")) for i, _, _, _, kept_bytes in brute_repeats(texts, P.PASSAGE).elements())
    assert sum(len(t) for _, t in cut) < sum(len(t) for _, t in near)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {t for t, _ in brute_benchmark([(t, t) for _, t in cut], items)}
    assert hit and clean == Counter({k: n for k, n in cut.items() if k[1] not in hit})
    pieces = kept[-1].collect()
    whole = Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert whole == Counter(i for i, _ in clean.elements())
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


def test_clean_rows_that_share_an_id_with_a_leak_stay(spark, folder):
    item = next(r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["item_id"] == 0)
    rows = [(None, f"some words {item} and more", "en", "s", 1), (None, "a clean text of its own", "en", "s", 1), (7, item, "en", "s", 1), (7, "another clean text here", "en", "s", 1)]
    out = P.remove_benchmark(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    assert {key(r) for r in out} == {(None, "a clean text of its own"), (7, "another clean text here")}


def test_empty_documents(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0
