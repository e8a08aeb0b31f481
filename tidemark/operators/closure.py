"""Parts of tables that are closed under their references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each table its columns that refer to another table's key: {table: {column: (other table, key)}}.
References = dict[str, dict[str, tuple[str, str]]]

#: What refers to what among the stored tables.
STORED: References = {
    "article_companies": {"article_id": ("news_articles", "id"), "company_id": ("companies", "id")},
    "alerts": {"company_id": ("companies", "id")},
    "alert_explanations": {"alert_id": ("alerts", "id")},
    "filings": {"company_id": ("companies", "id")},
    "risk_scores": {"filing_id": ("filings", "id")},
    "filing_labels": {"filing_id": ("filings", "id")},
}


def in_order(tables: list[str], references: References) -> list[str]:
    """``tables`` with those first that others refer to; tables that refer to each other in a circle have no order."""
    out: list[str] = []
    rest = list(tables)
    while rest:
        ready = [t for t in rest if all(o == t or o not in rest for o, _ in references.get(t, {}).values())]
        if not ready:
            raise ValueError(f"{', '.join(rest)} refer to each other")
        out += ready
        rest = [t for t in rest if t not in ready]
    return out


def closed(tables: dict[str, DataFrame], references: References, chosen: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``tables`` (those ``chosen`` in their place) without rows whose references lead nowhere, in the order of references.

    What a row refers to is looked for in the part that is kept, so a row that
    goes takes with it all that refer to it. Null references lead nowhere and
    are allowed. A table that refers to itself keeps rows whose partner is there.
    """
    kept: dict[str, DataFrame] = {}
    for name in in_order(list(tables), references):
        rows = (chosen or {}).get(name, tables[name])
        for column, (other, key) in references.get(name, {}).items():
            if other in tables:
                target = (kept[other] if other != name else rows).select(F.col(key).alias("_key")).distinct()
                whole = rows.where(F.col(column).isNotNull()).join(target, F.col(column) == F.col("_key"), "left_semi")
                rows = whole.unionByName(rows.where(F.col(column).isNull()))
        kept[name] = rows
    return kept


def dangling(tables: dict[str, DataFrame], references: References) -> DataFrame:
    """(table, reference, rows, dangling) for each table and each of its references; a table without any has an empty one."""
    out = []
    for name, rows in tables.items():
        known = [(c, o, k) for c, (o, k) in references.get(name, {}).items() if o in tables]
        for column, other, key in known or [("", "", "")]:
            row = F.struct(F.lit(name).alias("table"), F.lit(column).alias("reference"))
            if column:
                target = tables[other].select(F.col(key).alias("_key")).distinct().withColumn("_there", F.lit(1))
                met = rows.select(F.col(column).alias("_ref")).join(target, F.col("_ref") == F.col("_key"), "left")
                one = met.agg(F.count("*").alias("rows"), F.count(F.when(F.col("_ref").isNotNull() & F.col("_there").isNull(), 1)).alias("dangling"))
            else:
                one = rows.agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("dangling"))
            out.append(one.select(row.alias("of"), "rows", "dangling").select("of.*", "rows", "dangling"))
    return reduce(DataFrame.unionByName, out)
