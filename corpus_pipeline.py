"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, packing, simhash_dedup, suffix_dedup
from tidemark.llm.common import HOT, checkpoint, small, split_join, table, written
from tidemark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least mean probability of the language found; clean texts are above 0.7, and chance is one over the languages.
MIN_LANGUAGE = 0.35
#: Bytes of a passage that may not occur twice: fifty words of three letters with the spaces between.
PASSAGE = 200
#: Parts that rows with one text are dealt into where they meet what is known of the text.
SALT = 64


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those whose language can't be told, go.

    The model learns from the stage's own labelled rows.
    """
    found = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE)
    return found.where(known).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays.

    That is the row with the group's smallest id, and of rows that share this
    id the smallest. Rows without an id come after all others. A number made
    from its text stands for a row, so that equal texts share one.
    """
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    found = simhash_dedup.similar_groups(named, "_text")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    ids = written(named.groupBy("_text", rank.alias("_rank")).agg(F.count("*").alias("_n")))
    rows = ids.agg(F.sum("_n").alias("n")).collect()[0]["n"] or 0
    sizes = ids.groupBy("_text").agg((F.sum("_n") > rows / HOT).alias("_hot"))
    texts = written(sizes.join(found.withColumnRenamed("id", "_text"), "_text"))
    ids = written(split_join(ids, texts, ["_text"], F.col("_hot")).drop("_hot"))
    groups = ids.groupBy("group").agg(F.min("_rank").alias("_least"), F.sum("_n").alias("_rows"))
    # only groups of several rows need a choice
    groups = written(groups.where("_rows > 1"))
    ids = written(split_join(ids, groups, ["group"], F.col("_rows") > rows / HOT).withColumn("_best", F.col("_rank") == F.col("_least")))
    rivals = small(written(ids.where("_best").groupBy("group").agg(F.sum("_n").alias("_rivals")).where("_rivals > 1")))
    ids = ids.join(rivals, "group", "left").withColumn("_several", F.col("_best") & F.col("_rivals").isNotNull())
    ids = written(ids.where("not _best or _several").select("_text", F.col("_rank.id").alias("_id"), "group", "_several"))
    here = named.withColumn("_doc", F.col("doc_id"))
    same = lambda x: (F.col("_text") == x["_of"]) & F.col("_doc").eqNullSafe(x["_id"])
    others = small(ids.withColumnRenamed("_text", "_of"))
    single = here.join(others, same(others), "left_anti").select(*COLUMNS)
    several = small(ids.withColumnRenamed("_text", "_of").where("_several"))
    best = here.join(several, same(several)).groupBy("group").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return single.unionByName(best.select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE`` bytes and more that occur twice are cut from the texts; every document stays."""
    return suffix_dedup.clean_text(docs.select(*COLUMNS), length=PASSAGE)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, whatever their ids.

    A number made from the text stands for a row, so equal texts go together.
    """
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"), F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("_salt"))
    links = decontaminate.matches(named, table(spark, sf_dir, "benchmark"), id_col="_text")
    hit = checkpoint(links.select(F.col("doc_id").alias("_text")).distinct())
    hit = hit.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return named.join(hit, ["_text", "_salt"], "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), length=2048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", remove_benchmark),
    ("packing", pack),
]

#: A trained model, fingerprints and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
