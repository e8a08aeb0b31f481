"""The queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_format,
    collocations,
    cover_dedup,
    decontaminate,
    hard_negatives,
    language_id,
    license_scan,
    packing,
    quality_rules,
    sharding,
    simhash_dedup,
    suffix_dedup,
    url_filter,
)
from tidemark.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: a quarter of all ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(more)))


def _op2_sql() -> str:
    length = lambda x: f"length(regexp_replace({x}, '{chat_format.CONTROL_PATTERN}', 'XX', 'g'))"
    marks = len(chat_format.BEGIN + chat_format.SAYS + chat_format.END)
    return f"""
        WITH turns AS (
            SELECT conv_id, turn, role AS r, text AS t FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        ordered AS (
            SELECT conv_id, coalesce(r, '') AS role, coalesce(t, '') AS text,
                   row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS k
            FROM turns),
        joined AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS everything,
                   coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS said,
                   sum({length("role")} + {length("text")} + {marks + 1}) - 1 AS formatted
            FROM ordered GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(said) AS loss_chars,
               sha256(said) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
        FROM joined"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "first_sentence",
    )


#: Verdict, and host/path.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad, for the labels that templates are judged by, if its own html has three runs of junk marks or more."""
    pages = table(spark, sf_dir, "pages")
    labels = pages.select("page_id", (F.regexp_count("html", F.lit(r"\*{3}|#{3}|%{3}")) >= 3).alias("bad"))
    return url_filter.judge(pages.select("page_id", "url"), URL_RULES, labels)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item; those that aren't named hold none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).where("contaminated")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = sharding.shard(rows, ["doc_id", "size", "text_crc32"], n_shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, length=400)
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", digest, F.col("kept_text").alias("text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_rules.judge(docs, model).drop("text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=1)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def _op11_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces)" for k in range(1, 5)
    )
    return rf"""
        WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
        split AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM texts),
        pieces AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM split),
        f AS (SELECT lang, phrase, count(*) AS n FROM ({grams}) GROUP BY lang, phrase HAVING count(*) >= 30),
        totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
        candidates AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE contains(phrase, ' ')),
        cuts AS (SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM candidates),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a) // (x.n + y.n) AS score
            FROM cuts c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
        worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS most
            FROM (SELECT lang, w, a, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, a, unnest(range(2, len(w))) AS k FROM candidates))
            GROUP BY ALL),
        kept AS (
            SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
            WHERE i.most IS NULL OR 100 * i.most < 80 * w.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT r.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000"""


def op12_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cover_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def _op12_sql() -> str:
    return r"""
        WITH texts AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
        windows AS (
            SELECT row, doc_id, i, array_to_string(w[i:i + 12], ' ') AS words
            FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)),
        first AS (SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words),
        gone AS (
            SELECT DISTINCT row, p FROM (
                SELECT row, unnest(range(i, i + 13)) AS p FROM windows JOIN first USING (words) WHERE first_id < coalesce(doc_id, 9223372036854775807))),
        each AS (SELECT row, w[p] AS word, p FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS p FROM texts)),
        kept AS (
            SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words
            FROM each ANTI JOIN gone USING (row, p) GROUP BY row)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (row)"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


def _op13_sql() -> str:
    return """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id,
               p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
        QUALIFY row_number() OVER w <= 3"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_cover_dedup": op12_cover_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Only what DuckDB can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": _op2_sql(),
    "op3_license_scan": license_scan.sql(),
    "op11_collocations": _op11_sql(),
    "op12_cover_dedup": _op12_sql(),
    "op13_hard_negatives": _op13_sql(),
}
