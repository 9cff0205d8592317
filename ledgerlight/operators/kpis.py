"""The KPI tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .measures import by, change_pct, measure, share_pct, top, with_previous

PERIOD = ["year", "quarter"]


def region_quarter(s: DataFrame) -> DataFrame:
    return by(s, ["region", *PERIOD], ["sales", "orders", "articles", "basket", "clients"])


def category_year(s: DataFrame) -> DataFrame:
    return by(s, ["region", "category", "year"], ["sales", "articles", "avg_price"])


def top_products(s: DataFrame, n: int = 10) -> DataFrame:
    return top(by(s, ["sub_category"], ["sales", "articles", "avg_price", "clients", "orders"]), n, "sales", "sub_category")


def variation(s: DataFrame) -> DataFrame:
    """Quarters with change to the quarter before, to the same quarter a year before, and to the first quarter."""
    q = with_previous(by(s, PERIOD, ["sales"]), PERIOD, change="qoq_pct")
    q = with_previous(q, ["year"], ["quarter"], previous="previous_year", change="yoy_pct")
    first = F.first("sales").over(Window.orderBy(*PERIOD))
    return q.withColumn("since_first_pct", change_pct(F.col("sales"), first)).withColumn("variation_pct", F.col("qoq_pct"))


def annual(s: DataFrame) -> DataFrame:
    return with_previous(by(s, ["year"], ["sales", "orders", "articles", "basket", "clients", "products"]), ["year"], change="yoy_pct")


def best_region(s: DataFrame) -> DataFrame:
    """Regions by year with their rank; rank 1 is the year's winner."""
    w = Window.partitionBy("year").orderBy(F.desc("sales"), "region")
    return by(s, ["year", "region"], ["sales", "orders"]).withColumn("rank", F.row_number().over(w))


def monthly(s: DataFrame) -> DataFrame:
    """Months with a moving average over three rows, across years."""
    w = Window.orderBy("year", "month").rowsBetween(-2, 0)
    return by(s, ["year", "month"], ["sales", "orders", "basket"]).withColumn("moving_avg_3m", F.round(F.avg("sales").over(w), 2)).withColumn("month_start", F.make_date("year", "month", F.lit(1)))


def segment_year(s: DataFrame) -> DataFrame:
    return by(s, ["segment", "year"], ["sales", "orders", "basket", "clients"])


def ship_modes(s: DataFrame) -> DataFrame:
    return by(s, ["ship_mode", "year"], ["sales", "orders", "avg_delay"])


def top_clients(s: DataFrame, n: int = 10) -> DataFrame:
    return top(by(s, ["customer_id", "customer_name"], ["sales", "orders", "basket", "last_order"]), n, "sales", "customer_id")


def top_states(s: DataFrame, n: int = 15) -> DataFrame:
    return top(by(s, ["state", "region"], ["sales", "orders", "clients"]), n, "sales", "state")


def weekdays(s: DataFrame) -> DataFrame:
    return by(s, ["day_of_week"], ["sales", "orders", "basket"])


def region_matrix(s: DataFrame, years: list[int]) -> DataFrame:
    """Sales of each region by year, one column a year; no sales: 0."""
    return s.groupBy("region").pivot("year", years).agg(measure("sales")).select("region", *[F.coalesce(F.col(str(y)), F.lit(0.0)).alias(f"y{y}") for y in years])


def segment_share(s: DataFrame) -> DataFrame:
    return share_pct(by(s, ["segment"], ["sales"]))


def global_recap(s: DataFrame) -> DataFrame:
    """One row over the whole fact; clients and products are counted exactly."""
    years = annual(s)
    whole = s.agg(*[measure(n) for n in ("sales", "articles", "clients", "products")])
    per_year = years.agg(F.sum("orders").alias("orders"), F.max_by("year", F.struct("sales", -F.col("year"))).alias("best_year"), F.max("sales").alias("best_sales"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("sales", "year").alias("first_sales"), F.max_by("sales", "year").alias("last_sales"))
    winner = top(by(s, ["region"], ["sales"]), 1, "sales", "region").select(F.col("region").alias("best_region"))
    one = whole.crossJoin(per_year).crossJoin(winner)  # one row each
    growth = F.when(F.col("first_year") < F.col("last_year"), change_pct(F.col("last_sales"), F.col("first_sales")))
    return one.select("sales", "orders", "articles", F.round(F.col("sales") / F.col("orders"), 2).alias("basket"), "clients", "products", growth.alias("growth_pct"), F.concat_ws("-", "first_year", "last_year").alias("period"), "best_year", "best_sales", "best_region")


KPI_TABLES = {"region_quarter": region_quarter, "category_year": category_year, "top_products": top_products, "variation": variation, "annual": annual, "best_region": best_region, "monthly": monthly, "segment_year": segment_year, "ship_modes": ship_modes, "top_clients": top_clients, "top_states": top_states, "weekdays": weekdays}
