"""The conformed sales fact: one row for each article of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a sales file, in order.
SALES_CSV = T.StructType([T.StructField(n, T.StringType()) for n in ("row_id", "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name", "segment", "country", "city", "state", "postal_code", "region", "product_id", "category", "sub_category", "product_name", "sales")])
MONEY = "decimal(12,2)"


def clean_names(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower case, blanks and hyphens as underscores."""
    return df.toDF(*[c.strip().replace(" ", "_").replace("-", "_").lower() for c in df.columns])


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw text columns of a sales file with a header; types come with ``conform``."""
    return spark.read.schema(SALES_CSV).option("header", True).option("encoding", "UTF-8").csv(path)


def parsed(raw: DataFrame, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """Dates and amounts with their types; what does not parse is null."""
    date = lambda c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"), F.lit(date_format))) if dict(raw.dtypes)[c] == "string" else F.col(c).cast("date")
    return raw.withColumns({"order_date": date("order_date"), "ship_date": date("ship_date"), "sales": F.col("sales").try_cast(MONEY)})


def valid(keep_non_positive: bool = False):
    """Rows that count: an amount above zero (or any amount) and an order date."""
    fine = F.col("sales").isNotNull() & F.col("order_date").isNotNull()
    return fine if keep_non_positive else fine & (F.col("sales") > 0)


def calendar(df: DataFrame) -> DataFrame:
    """Year, quarter, month, ISO week, weekday (1: Sunday) and delivery delay."""
    d = F.col("order_date")
    return df.withColumns({"year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "week": F.weekofyear(d), "day_of_week": F.dayofweek(d), "ship_delay_days": F.datediff("ship_date", "order_date")})


def conform(raw: DataFrame, keep_non_positive: bool = False, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """The fact from raw rows: parsed, filtered, with calendar columns."""
    return calendar(parsed(raw, date_format).filter(valid(keep_non_positive)))


def rejects(raw: DataFrame, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """The rows that ``conform(keep_non_positive=True)`` leaves out."""
    return parsed(raw, date_format).filter(~valid(keep_non_positive=True))


def reject_counts(raw: DataFrame, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """One row: rows read, amounts and dates that fail, rows that stay; one pass."""
    bad = F.col("sales").isNull() | (F.col("sales") <= 0)
    return parsed(raw, date_format).agg(F.count("*").alias("initial_rows"), F.count_if(bad).alias("invalid_sales"), F.count_if(~bad & F.col("order_date").isNull()).alias("invalid_dates"), F.count_if(valid()).alias("final_rows"))


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself; an error if cleaning left nothing."""
    if df.isEmpty():
        raise ValueError("no valid rows left after cleaning")
    return df


def star_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw fact rows from the star schema; only the columns that some measure uses are read."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    names = {"o_orderkey": "order_id", "l_linenumber": "line_number", "o_orderpriority": "ship_mode", "c_custkey": "customer_id", "c_name": "customer_name", "c_mktsegment": "segment", "n_name": "state", "r_name": "region", "p_partkey": "product_id", "p_name": "product_name", "p_type": "category", "p_brand": "sub_category"}
    return joined.select(*[F.col(a).alias(b) for a, b in names.items()], F.col("o_orderdate").cast("date").alias("order_date"), F.col("l_shipdate").cast("date").alias("ship_date"), F.col("l_extendedprice").cast(MONEY).alias("sales"))


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(star_rows(spark, sf_dir))
