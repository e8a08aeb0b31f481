"""Tables of a corpus that are longer than an expression takes: every entry counts, none is dropped."""

from pyspark.sql import functions as F

from tests.test_sentences import CASES, corpus
from tidemark.functions import sentences as S


def test_long_tables_cut_as_lists_do(spark):
    docs = spark.createDataFrame([(t,) for t in [*corpus(), None, ""]], "text string")
    lists, tables = S.fit(docs, "text"), S.fit(docs, "text", most=1)
    assert len(lists.abbreviations) > 1 and not lists.tables and tables.tables
    assert {r["word"] for r in tables.tables.abbreviations.collect()} == set(lists.abbreviations)
    assert {(r["word"], r["next"]) for r in tables.tables.collocations.collect()} == set(lists.collocations)
    assert {r["next"] for r in tables.tables.starters.collect()} == set(lists.starters)
    # the same text twice, and one of many sentences
    texts = [t for t, _ in CASES] + [CASES[0][0], " ".join(corpus())]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").repartition(3)
    got = {r["id"]: r["sentences"] for r in S.with_sentences(rows, "text", tables, 1, 2_000_000_000).collect()}
    want = {r["id"]: r["sentences"] for r in rows.select("id", S.split(F.col("text"), lists, 1, 2_000_000_000).alias("sentences")).collect()}
    assert got == want and all(got[k] == s for k, (_, s) in enumerate(CASES)) and len(got) == len(texts)
    assert len(got[len(texts) - 1]) > 2000


def test_more_starters_than_the_limit(spark):
    """With the limit as it is: each of 5200 words that begin sentences ends the one before it, the last as the first."""
    words = ["Q" + "".join(chr(97 + int(d)) for d in f"{k:04d}") for k in range(S.MOST + 200)]
    texts = ["Yes! " + " ".join(f"{w} there told us what they had seen there." for w in words[k : k + 100] for _ in range(10)) for k in range(0, len(words), 100)]
    model = S.fit(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    assert {r["next"] for r in model.tables.starters.collect()} == {w.lower() for w in words}
    rows = spark.createDataFrame([(w, f"It was J. {w} left.") for w in [*words, "Qzzzz"]], "word string, text string")
    got = {r["word"]: r["sentences"] for r in S.with_sentences(rows, "text", model, 1).collect()}
    assert got == {w: ["It was J.", f"{w} left."] for w in words} | {"Qzzzz": ["It was J. Qzzzz left."]}
