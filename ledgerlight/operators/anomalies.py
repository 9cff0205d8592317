"""Same-quarter anomalies against the year before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .measures import by, change_pct
from .scopes import PERIOD, scoped

THRESHOLD = 20.0


def quarter_yoy(s: DataFrame, scope_cols: list[str] = (), digits: int | None = 1) -> DataFrame:
    q = by(s, [*scope_cols, *PERIOD], ["sales"])
    w = Window.partitionBy(*scope_cols, "quarter").orderBy("year")
    q = q.withColumns({"reference_sales": F.lag("sales").over(w), "reference_year": F.lag("year").over(w)})
    change = F.col("sales") - F.col("reference_sales")
    exact = F.when(F.col("reference_sales") > 0, change / F.col("reference_sales") * 100)
    return q.withColumn("variation_pct", change_pct(F.col("sales"), F.col("reference_sales"), digits) if digits is not None else exact)


def _named(df: DataFrame, low: str, high: str) -> DataFrame:
    down = F.col("variation_pct") < 0
    text = F.concat(F.when(down, "Drop of ").otherwise("Rise of "), F.format_number(F.abs("variation_pct"), 1), F.lit("% in Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"))
    return df.withColumns({"level": F.when(down, "ALERT").otherwise("INFO"), "kind": F.when(down, low).otherwise(high), "description": text})


def anomalies(s: DataFrame, year: int | None = None, region: str | None = None, category: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Quarters beyond the threshold, on the rounded change and strictly; the year is filtered after the comparison."""
    q = quarter_yoy(scoped(s, None, region, category)).filter(F.abs("variation_pct") > threshold)
    return _named(q if year is None else q.filter(F.col("year") == year), "drop", "rise").orderBy(F.col("level") != "ALERT", F.desc(F.abs("variation_pct")), *PERIOD)


def consecutive_anomalies(s: DataFrame, scope_cols: list[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Changes at or beyond the threshold, not rounded first, between years that follow each other."""
    q = quarter_yoy(s, scope_cols, None).filter((F.col("year") - F.col("reference_year") == 1) & (F.abs("variation_pct") >= threshold))
    return _named(q, "yoy_drop", "yoy_rise").withColumn("variation_pct", F.round("variation_pct", 1))


def main_anomaly(s: DataFrame) -> DataFrame:
    """One row: the first anomaly, else the quarter with the weakest change, else the one with the lowest sales."""
    found = anomalies(s).withColumn("rank", F.lit(1)).select("rank", *PERIOD, F.when(F.col("level") == "ALERT", 0).otherwise(1).alias("o"), (-F.abs("variation_pct")).alias("key"), F.col("variation_pct").alias("value"))
    w = Window.orderBy(*PERIOD)
    q = by(s, PERIOD, ["sales"]).withColumn("value", change_pct(F.col("sales"), F.lag("sales").over(w)))
    weak = q.filter("value <> 0").select(F.lit(2).alias("rank"), *PERIOD, F.lit(0).alias("o"), F.col("value").alias("key"), "value")
    low = q.select(F.lit(3).alias("rank"), *PERIOD, F.lit(0).alias("o"), F.col("sales").alias("key"), F.col("sales").alias("value"))
    every = found.unionByName(weak).unionByName(low)
    return every.orderBy("rank", "o", "key", *PERIOD).limit(1).select(F.element_at(F.array(F.lit("anomaly"), F.lit("weak_quarter"), F.lit("lowest_sales")), F.col("rank")).alias("source"), *PERIOD, "value")


def level_counts(found: DataFrame, scope_cols: list[str]) -> DataFrame:
    alerts, infos = F.count_if(F.col("level") == "ALERT"), F.count_if(F.col("level") == "INFO")
    mix = F.when(F.col("alerts") > F.col("infos"), "mostly drops").when(F.col("alerts") < F.col("infos"), "mostly rises").otherwise("balanced")
    return found.groupBy(*scope_cols).agg(alerts.alias("alerts"), infos.alias("infos")).withColumn("mix", mix)
