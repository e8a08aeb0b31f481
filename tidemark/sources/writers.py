"""Sinks. An upsert is a plan that gives the new table: target and changes, one row for each key.

Keys are shuffled once; changes are reduced to one row a key before they meet
the target, so a key that changes a million times costs one row.
"""

from __future__ import annotations

import hashlib
import secrets
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def reduced(changes: DataFrame, columns: list[str], keys: list[str], update: list[str], order: str) -> DataFrame:
    """``changes`` with one row for each key: ``_first`` has all other ``columns``, ``_last`` those to ``update``."""
    first = [F.min_by(F.struct(*[c for c in columns if c not in keys]), F.col(order)).alias("_first")]
    last = [F.max_by(F.struct(*update), F.col(order)).alias("_last")] if update else []
    return changes.groupBy(*keys).agg(*first, *last)


def applied(target: DataFrame, one: DataFrame, keys: list[str], update: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``target`` after changes that are ``reduced``."""
    others = [c for c in target.columns if c not in keys]
    old = target.withColumn("_old", F.struct(*others)).select(*keys, "_old")
    joined = old.join(one, keys, "full_outer")
    columns = []
    for c in others:
        kept = F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_first.{c}"))
        if c in update:
            kept = F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(kept)
        if c in keep:
            kept = F.coalesce(kept, F.col(f"_old.{c}"))
        columns.append(kept.alias(c))
    return joined.select(*keys, *columns).select(*target.columns)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], update: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``changes`` applied in the order of column ``order``.

    A new key keeps the first values of its changes, but for ``update`` columns,
    which are those of the last change; a known key has only these replaced.
    A null in columns to ``keep`` replaces nothing.
    """
    return applied(target, reduced(changes, target.columns, keys, update, order), keys, update, keep)


def upsert_companies(target: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """By cik; the ticker of a known company stays. A null sector or code keeps what is known."""
    update = [c for c in ("name", "sector", "sic_code") if c in target.columns]
    return upsert(target, changes, ["cik"], update, order, keep=("sector", "sic_code"))


def upsert_filings(target: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """By accession number; only the text is replaced."""
    return upsert(target, changes, ["accession_number"], ["raw_text"], order)


def upsert_articles(target: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """By url; only the headline is replaced."""
    return upsert(target, changes, ["url"], ["headline"], order)


def insert_links(target: DataFrame, links: DataFrame) -> DataFrame:
    """New (article_id, company_id) pairs are added, known ones ignored."""
    keys = ["article_id", "company_id"]
    return target.select(*keys).unionByName(links.select(*keys).distinct().join(target.select(*keys), keys, "left_anti"))


def upsert_prices(target: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """By company and date; the last write wins in all columns."""
    keys = ["company_id", "date"]
    return upsert(target, changes, keys, [c for c in target.columns if c not in keys], order)


def upsert_explanations(target: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """By alert; no cited ids are null."""
    ids = F.when(F.size("cited_ids") > 0, F.col("cited_ids"))
    return upsert(target, changes.withColumn("cited_ids", ids), ["alert_id"], [c for c in target.columns if c != "alert_id"], order)


def replace_partition(df: DataFrame, path: str, partition: str) -> int:
    """The partitions that ``df`` has are replaced, others stay; the rows written are counted again."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(partition).alias("values"))  # the partitions of one write
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    return _counted(seen, found.where(F.col(partition).isin(list(seen.get["values"]))))


def rebuild(df: DataFrame, path: str) -> int:
    """A table made anew; the rows written are counted again."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return _counted(seen, df.sparkSession.read.schema(df.schema).parquet(path))


def _counted(seen: Observation, found: DataFrame) -> int:
    """What was counted while it was written, against what is there: the plan runs once."""
    n, m = seen.get["n"], found.count()
    if n != m:
        raise RuntimeError(f"{m} rows of {n} were written")
    return m


def valid_key(now: Column) -> Column:
    """Whether an API key may be used at ``now``."""
    return F.coalesce("active", F.lit(False)) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def touch(keys: DataFrame, key_hash: str, now: datetime) -> DataFrame:
    """Keys with the time of last use set on the one that is valid and used."""
    at = F.lit(now)
    used = (F.col("key_hash") == key_hash) & valid_key(at)
    return keys.withColumn("last_used_at", F.when(used, at).otherwise(F.col("last_used_at")))


def prediction_log(scored: DataFrame, model_version: str, backend: str) -> DataFrame:
    """Rows (text, n_tokens, probs map, runtime_ms) as log rows; texts are logged as hashes."""
    return scored.select(
        F.lit(model_version).alias("model_version"),
        F.to_json(F.struct(F.sha2("text", 256).alias("text_sha256"), F.col("n_tokens").alias("token_count"))).alias("input_features"),
        F.element_at("probs", "negative").alias("output_score"),
        F.array_max(F.map_values("probs")).alias("confidence"),
        F.to_json("probs").alias("feature_contributions"),
        "runtime_ms",
        F.lit(backend).alias("inference_backend"),
    )


def demo_key(per_hour: int, ttl: timedelta, now: datetime, prefix: str = "demo_") -> tuple[str, dict]:
    """A random key, and the row to be stored for it (its hash)."""
    raw = prefix + secrets.token_urlsafe(32)
    row = {"key_hash": hashlib.sha256(raw.encode()).hexdigest(), "owner": "demo", "requests_per_hour": per_hour, "created_at": now, "active": True, "expires_at": now + ttl}
    return raw, row


def export_csv(df: DataFrame, path: str, order: list[str] | None = None, digits: dict[str, int] | None = None) -> None:
    """CSV with a header, sorted over all files, some columns rounded half to even."""
    for c, n in (digits or {}).items():
        df = df.withColumn(c, F.bround(c, n))
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def sql_literal(value) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "'{" + ",".join(str(int(x)) for x in value) + "}'"
    return "'" + str(value).replace("'", "''") + "'"


def literal(column: str, kind: str) -> Column:
    """K14, X20 over a column: a value as an SQL literal."""
    c = F.col(column)
    if kind == "boolean":
        out = F.when(c, "TRUE").otherwise("FALSE")
    elif kind.startswith("array"):
        out = F.concat(F.lit("'{"), F.array_join(c.cast("array<string>"), ","), F.lit("}'"))
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        out = c.cast("string")
    else:
        out = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(out)


def sql_statements(df: DataFrame, name: str) -> DataFrame:
    """An insert (``statement``) for each row of a table of any size."""
    values = F.concat_ws(", ", *[literal(c, kind) for c, kind in df.dtypes])
    head = F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES (")
    return df.select(F.concat(head, values, F.lit(") ON CONFLICT DO NOTHING;")).alias("statement"))


def _sequence(name: str, df: DataFrame) -> list[str]:
    return [f"SELECT setval(pg_get_serial_sequence('{name}', 'id'), COALESCE((SELECT MAX(id) FROM {name}), 1));"] if "id" in df.columns else []


def sql_dump_files(tables: list[tuple[str, DataFrame]], path: str) -> list[str]:
    """A folder of text files for each table, to be run in the order of the folders returned; its sequence is set anew last."""
    out = []
    for number, (name, df) in enumerate(tables):
        out.append(f"{path}/{number:02d}_{name}")
        sql_statements(df, name).write.mode("overwrite").text(out[-1])
        if last := _sequence(name, df):
            out.append(f"{path}/{number:02d}_{name}_sequence")
            df.sparkSession.createDataFrame([(x,) for x in last], "statement string").write.mode("overwrite").text(out[-1])
    return out


def sql_dump(tables: list[tuple[str, DataFrame]], limit: int = 100_000):
    """K14 for small tables: their statements one after another. A table over ``limit`` rows is refused; ``sql_dump_files`` takes any."""
    for name, df in tables:
        if df.limit(limit + 1).count() > limit:
            raise ValueError(f"{name} has over {limit} rows; use sql_dump_files")
        for row in sql_statements(df.orderBy(df.columns[0]), name).toLocalIterator():
            yield row["statement"]
        yield from _sequence(name, df)


def set_sectors(companies: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sectors of a small table put in where it knows the ticker."""
    new = sectors.select("ticker", F.col("sector").alias("_new"))
    return companies.join(new, "ticker", "left").withColumn("sector", F.coalesce("_new", "sector")).select(*companies.columns)


def with_sentiment(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Label and score of scored rows put in, and the rows marked as processed."""
    new = scores.select("id", F.col("label").alias("_label"), F.col("negative").alias("_negative"))
    hit = F.col("_label").isNotNull()
    return (
        articles.join(new, "id", "left")
        .withColumn("sentiment_label", F.when(hit, F.col("_label")).otherwise(F.col("sentiment_label")))
        .withColumn("sentiment_score", F.when(hit, F.col("_negative")).otherwise(F.col("sentiment_score")))
        .withColumn("processed", F.col("processed") | hit)
        .select(*articles.columns)
    )


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, ties broken by all columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *df.columns))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
