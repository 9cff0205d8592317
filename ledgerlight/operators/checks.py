"""Consistency checks between tables, each one row of the same shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measures import by, change_pct, total

WARN, ERROR = 1.0, 5.0


def compared(name: str, expected: Column, actual: Column, absolute: bool = False, detail: Column | None = None) -> list[Column]:
    """Columns of a check: the gap in percent (or points), ok, warning or error; a null is a warning."""
    gap = F.abs(actual - expected)
    if not absolute:
        gap = F.when(expected == 0, F.when(actual == 0, 0.0).otherwise(100.0)).otherwise(gap / F.abs(expected) * 100)
    gap = F.round(gap.cast("double"), 4)
    status = F.when(gap.isNull(), "warning").when(gap > ERROR, "error").when(gap > WARN, "warning").otherwise("ok")
    return [F.lit(name).alias("name"), status.alias("status"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual"), gap.alias("gap_pct"), (detail if detail is not None else F.lit("")).alias("detail")]


def total_is_sum_of_years(s: DataFrame) -> DataFrame:
    one = s.agg(F.round(total(), 2).alias("e")).crossJoin(by(s, ["year"], ["sales"]).agg(F.round(F.sum("sales"), 2).alias("a")))
    return one.select(*compared("total_years", F.col("e"), F.col("a")))


def years_are_sums_of_regions(annual: DataFrame, region_quarter: DataFrame) -> DataFrame:
    """The worst year of the annual table against the region and quarter table; a missing year counts as nothing."""
    parts = region_quarter.groupBy("year").agg(F.sum("sales").alias("part"))
    gaps = annual.select("year", "sales").join(parts, "year", "left").withColumn("part", F.coalesce("part", F.lit(0.0)))
    gap = F.round(F.abs(F.col("part") - F.col("sales")), 2)
    worst = gaps.agg(F.max_by(F.struct("year", "sales", "part"), F.struct(gap, -F.col("year"))).alias("w"))
    return worst.select(*compared("years_regions", F.round("w.sales", 2), F.round("w.part", 2), detail=F.col("w.year").cast("string")))


def regions_sum_to_total(s: DataFrame) -> DataFrame:
    one = s.agg(F.round(total(), 2).alias("e")).crossJoin(by(s, ["region"], ["sales"]).agg(F.round(F.sum("sales"), 2).alias("a")))
    return one.select(*compared("regions_total", F.col("e"), F.col("a")))


def basket_is_ratio(s: DataFrame) -> DataFrame:
    one = by(s.withColumn("g", F.lit(1)), ["g"], ["sales", "orders", "basket"])
    return one.select(*compared("basket", F.round(F.col("sales") / F.nullif("orders", F.lit(0)), 2), F.col("basket")))


def counts(s: DataFrame) -> DataFrame:
    """No negative amounts (an error), no missing region, category or date (a warning)."""
    n = s.agg(F.count_if(F.col("sales") < 0).cast("double").alias("negative"), F.count_if(F.col("region").isNull() | F.col("category").isNull() | F.col("order_date").isNull()).cast("double").alias("missing"))
    row = lambda name, c, bad: n.select(F.lit(name).alias("name"), F.when(F.col(c) > 0, bad).otherwise("ok").alias("status"), F.lit(0.0).alias("expected"), F.col(c).alias("actual"), F.when(F.col(c) > 0, 100.0).otherwise(0.0).alias("gap_pct"), F.lit("").alias("detail"))
    return row("no_negative", "negative", "error").unionByName(row("no_missing", "missing", "warning"))


def growth_is_recomputed(annual: DataFrame) -> DataFrame:
    """The stored yearly change against one made anew from the sales, in points; the worst year."""
    anew = change_pct(F.col("sales"), F.lag("sales").over(Window.orderBy("year")))
    gaps = annual.withColumn("anew", anew).filter(F.col("anew").isNotNull() | F.col("yoy_pct").isNotNull())
    worst = gaps.agg(F.max_by(F.struct("year", "anew", "yoy_pct"), F.struct(F.coalesce(F.abs(F.col("anew") - F.col("yoy_pct")), F.lit(1e9)), -F.col("year"))).alias("w"))
    return worst.select(*compared("yoy", F.col("w.anew"), F.col("w.yoy_pct"), absolute=True, detail=F.col("w.year").cast("string")))


def all_checks(s: DataFrame, annual: DataFrame, region_quarter: DataFrame) -> DataFrame:
    parts = [total_is_sum_of_years(s), years_are_sums_of_regions(annual, region_quarter), regions_sum_to_total(s), basket_is_ratio(s), counts(s), growth_is_recomputed(annual)]
    return reduce(DataFrame.unionByName, parts)


def rolled_up(checks: DataFrame) -> DataFrame:
    n = {k: F.count_if(F.col("status") == k).alias(f"n_{k}") for k in ("ok", "warning", "error")}
    overall = F.when(F.col("n_error") > 0, "error").when(F.col("n_warning") > 0, "warning").otherwise("ok")
    return checks.agg(*n.values()).withColumn("overall", overall)
