"""Scans. Each names its columns and types, so that nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A table, with the columns that are wanted."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def jdbc(spark: SparkSession, url: str, table: str, *columns: str, **options: str) -> DataFrame:
    """S01 over JDBC: projections and filters reach the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV with a header; a row that doesn't fit the schema is an error, empty lines are skipped."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars. Order is left to whoever needs it (a window by ticker and date)."""
    return csv(spark, path, schemas.PRICE_CSV)


def news_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily news features."""
    return csv(spark, path, schemas.NEWS_CSV)


def padded_cik(cik: Column) -> Column:
    """Digits with zeros before them, ten at least (longer ones stay whole)."""
    text = F.trim(cik)
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def constituents(raw: DataFrame) -> DataFrame:
    """(ticker, name, sector, cik) from an index's constituents; rows without a ticker go."""
    return raw.select(
        F.upper(F.trim("Symbol")).alias("ticker"), F.trim("Security").alias("name"), F.trim("Sector").alias("sector"), padded_cik(F.col("CIK")).alias("cik")
    ).where("ticker <> ''")


def sector_table(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    """A small literal table ticker, sector."""
    return spark.createDataFrame(sorted(pairs.items()), "ticker string, sector string")


def ticker_to_cik(raw: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object of objects as rows (ticker, cik); of equal tickers the last key wins."""
    kind = "map<string,struct<cik_str:string,ticker:string,title:string>>"
    rows = raw.select(F.posexplode(F.map_values(F.from_json(column, kind))).alias("k", "v"))
    return rows.groupBy(F.upper("v.ticker").alias("ticker")).agg(F.max_by("v.cik_str", "k").alias("cik")).select(
        "ticker", padded_cik(F.col("cik")).alias("cik")
    )


def filings_of(submissions: DataFrame, form: str = "10-K") -> DataFrame:
    """Parallel arrays of a submission history (cik, form, accessionNumber, filingDate, primaryDocument) as rows of one form."""
    zipped = submissions.select("cik", F.inline(F.arrays_zip("form", "accessionNumber", "filingDate", "primaryDocument")))
    clean = F.trim(F.replace(F.col("form"), F.lit("\u00a0"), F.lit(" ")))
    return zipped.where(clean == form).select(
        "cik",
        clean.alias("form_type"),
        F.col("accessionNumber").alias("accession_number"),
        F.to_date("filingDate").alias("filed_date"),
        F.col("primaryDocument").alias("primary_document"),
    )


def filing_url(cik: Column, accession: Column, document: Column, base: str = "https://www.sec.gov/Archives/edgar/data") -> Column:
    """Where a filing's document lies."""
    return F.concat_ws("/", F.lit(base), F.regexp_replace(cik, "^0+", ""), F.replace(accession, F.lit("-"), F.lit("")), document)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """A news feed as JSON lines; what isn't an object gives no row."""
    kind = "id long, url string, headline string, summary string, source string, datetime string"
    rows = spark.read.schema(kind + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def symbol(ticker: Column) -> Column:
    """The market's spelling of a ticker."""
    return F.replace(ticker, F.lit("."), F.lit("-"))


def clean_bars(bars: DataFrame) -> DataFrame:
    """NaN becomes null, and adj_close falls back to close."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    out = bars.withColumns({c: number(c) for c in ("open", "high", "low", "close", "adj_close")})
    return out.withColumn("adj_close", F.coalesce("adj_close", "close"))


def unprocessed(articles: DataFrame) -> DataFrame:
    """Rows not yet scored, whatever the chunk (a stream limits files a trigger instead)."""
    return articles.where(~F.coalesce("processed", F.lit(False)))


def parity_samples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The samples of parity files as rows; an object is a file, or a line if not ``multi_line``."""
    return spark.read.schema(schemas.PARITY).option("multiLine", multi_line).json(path).select(F.inline("samples"))


def bar_counts(bars: DataFrame) -> DataFrame:
    """Tickers and how many bars they have."""
    return bars.groupBy("ticker").agg(F.count("*").alias("bars"))


def by_ticker(companies: DataFrame, ticker: str) -> DataFrame:
    """The company of a ticker, no row if there is none."""
    return companies.where(F.col("ticker") == ticker.upper()).select("id", "name")
