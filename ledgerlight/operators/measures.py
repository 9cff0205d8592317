"""The one definition of each measure, and grouping by any dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total() -> Column:
    return F.sum("sales").cast("double")


def measure(name: str, digits: int = 2) -> Column:
    """A named aggregate over the sales fact; amounts are exact sums, then rounded."""
    orders, articles = F.countDistinct("order_id"), F.count("*")
    return {
        "sales": F.round(total(), digits),
        "orders": orders,
        "articles": articles,
        "basket": F.round(total() / orders, digits),
        "clients": F.countDistinct("customer_id"),
        "products": F.countDistinct("product_id"),
        "product_names": F.countDistinct("product_name"),
        "avg_price": F.round(total() / articles, digits),
        "avg_delay": F.round(F.avg("ship_delay_days"), 1),
        "last_order": F.max("order_date"),
    }[name].alias(name)


def by(sales: DataFrame, dims: list[str], names: list[str]) -> DataFrame:
    return sales.groupBy(*dims).agg(*[measure(n) for n in names])


def top(df: DataFrame, n: int, by_col: str, *ties: str) -> DataFrame:
    """The first ``n`` rows by ``by_col``, largest first, ties in the order of ``ties``."""
    return df.orderBy(F.desc(by_col), *ties).limit(n)


def change_pct(now: Column, before: Column, digits: int = 2) -> Column:
    """Percentage change; null where there is nothing before or it is not above zero."""
    return F.when(before > 0, F.round((now - before) / before * 100, digits))


def with_previous(df: DataFrame, order: list[str], part: list[str] = (), value: str = "sales", digits: int = 2, previous: str = "previous", change: str = "change_pct") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(previous, F.lag(value).over(w)).withColumn(change, change_pct(F.col(value), F.col(previous), digits))


def share_pct(df: DataFrame, value: str = "sales", part: list[str] = (), digits: int = 2) -> DataFrame:
    """Percentage of the total, over a table that is already aggregated."""
    return df.withColumn("share_pct", F.round(F.col(value) * 100 / F.sum(value).over(Window.partitionBy(*part)), digits))
