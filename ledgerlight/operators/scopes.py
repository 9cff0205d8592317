"""Questions within a scope: optional year, region and category, and all standard scopes in one pass."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measures import by, change_pct, measure, top, with_previous

PERIOD = ["year", "quarter"]


def scoped(s: DataFrame, year: int | None = None, region: str | None = None, category: str | None = None) -> DataFrame:
    """Rows of the scope. A year is a range of dates, which a scan can skip by; region and category are equalities."""
    conditions = [F.lit(True)]
    if year is not None:
        conditions.append((F.col("order_date") >= F.lit(datetime.date(year, 1, 1))) & (F.col("order_date") < F.lit(datetime.date(year + 1, 1, 1))))
    conditions += [F.col(c) == v for c, v in (("region", region), ("category", category)) if v is not None]
    return s.filter(reduce(Column.__and__, conditions))


def summary(s: DataFrame, year: int | None = None, region: str | None = None, category: str | None = None) -> DataFrame:
    """One row: totals, best region, growth to the year before (or over the scope's own years), change within the year.

    An empty scope gives zeros and nulls.
    """
    here, wide = scoped(s, year, region, category), scoped(s, None, region, category)
    one = here.agg(F.coalesce(F.sum("sales").cast("double"), F.lit(0.0)).alias("total"), *[measure(n) for n in ("orders", "articles", "clients", "product_names")])
    best = top(here.groupBy("region").agg(F.sum("sales").alias("x")), 1, "x", "region").agg(F.max("region").alias("best_region"))
    per_year = wide.groupBy("year").agg(F.sum("sales").cast("double").alias("x"))
    if year is None:
        ends = per_year.agg(F.min_by("x", "year").alias("before"), F.max_by("x", "year").alias("after"), F.count("*").alias("n"))
        growth = ends.select(F.when(F.col("n") > 1, change_pct(F.col("after"), F.col("before"), 1)).alias("growth_pct"))
    else:
        pick = lambda y: F.sum(F.when(F.col("year") == y, F.col("x")))
        growth = per_year.agg(pick(year).alias("after"), pick(year - 1).alias("before")).select(change_pct(F.col("after"), F.col("before"), 1).alias("growth_pct"))
    quarters = here.groupBy(*PERIOD).agg(F.sum("sales").cast("double").alias("x"))
    inner = quarters.agg(F.min_by("x", F.struct(*PERIOD)).alias("a"), F.max_by("x", F.struct(*PERIOD)).alias("z"), F.count("*").alias("n")).select(F.when(F.col("n") > 1, change_pct(F.col("z"), F.col("a"), 1)).alias("within_pct"))
    kind = F.when(F.col("growth_pct").isNotNull(), "yoy" if year is not None else "period").when(F.col("within_pct").isNotNull(), "within_year").otherwise("none")
    row = one.crossJoin(best).crossJoin(growth).crossJoin(inner)  # one row each
    return row.select(F.round("total", 2).alias("sales"), "orders", "articles", F.round(F.col("total") / F.nullif("orders", F.lit(0)), 2).alias("basket"), "clients", "product_names", "best_region", "growth_pct", "within_pct", kind.alias("growth_type"))


def annual_series(s: DataFrame, **scope) -> DataFrame:
    """Years of the scope; the year filter comes first, so a single year has nothing before it."""
    return with_previous(by(scoped(s, **scope), ["year"], ["sales", "orders", "articles", "basket", "clients"]), ["year"], digits=1, change="yoy_pct")


def quarterly_series(s: DataFrame, year_filter: str = "pre", **scope) -> DataFrame:
    """Quarters with change to the one before and running total against the first; ``year_filter="post"`` filters the year last."""
    year = scope.pop("year", None)
    q = with_previous(by(scoped(s, year if year_filter == "pre" else None, **scope), PERIOD, ["sales", "orders"]), PERIOD, digits=1, change="qoq_pct")
    w = Window.orderBy(*PERIOD).rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("cumulative_pct", F.round((F.sum("sales").over(w) / F.nullif(F.first("sales").over(w), F.lit(0.0)) - 1) * 100, 1))
    return q if year is None or year_filter == "pre" else q.filter(F.col("year") == year)


def sub_categories(s: DataFrame, n: int = 10, **scope) -> DataFrame:
    return top(by(scoped(s, **scope), ["sub_category"], ["sales", "orders", "articles", "avg_price"]), n, "sales", "sub_category")


def all_scopes(s: DataFrame) -> DataFrame:
    """Every standard scope at once: whole, each year, each region, each category; ``grouping`` bits name the kind."""
    kind = F.grouping_id()
    sets = s.groupingSets([[], ["year"], ["region"], ["category"]], "year", "region", "category")
    found = sets.agg(kind.alias("kind"), *[measure(n) for n in ("sales", "orders", "articles", "basket", "clients")])
    name = F.when(F.col("kind") == 7, "all").when(F.col("kind") == 3, "year").when(F.col("kind") == 5, "region").otherwise("category")
    return found.select(name.alias("scope_type"), "year", "region", "category", "sales", "orders", "articles", "basket", "clients")


def dashboard(s: DataFrame, found: DataFrame, report: DataFrame, **scope) -> dict[str, DataFrame]:
    """The twelve results of a dashboard for one scope; persist the scoped fact when several are read.

    ``found`` holds the scope's anomalies and ``report`` its report.
    """
    here = scoped(s, **scope)
    make = lambda dims, names: by(here, dims, names)
    return {
        "summary": summary(s, **scope), "annual": annual_series(s, **scope), "quarterly": quarterly_series(s, **scope),
        "regions": make(["region"], ["sales", "orders", "basket"]), "categories": make(["category"], ["sales", "articles"]),
        "sub_categories": sub_categories(s, **scope), "monthly": make(["year", "month"], ["sales", "orders", "basket"]),
        "segments": make(["segment"], ["sales", "orders", "basket", "clients"]),
        "top_products": top(make(["sub_category"], ["sales", "articles", "basket", "clients"]), 10, "sales", "sub_category"),
        "top_clients": top(make(["customer_id", "customer_name"], ["sales", "orders", "basket", "last_order"]), 5, "sales", "customer_id"),
        "anomalies": found, "report": report,
    }


def part_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """``part, n_rows`` of a dashboard."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("part"), "n_rows") for n, df in parts.items()])


def period_extremes(s: DataFrame) -> DataFrame:
    """One row: the year of the largest growth, and how far the first region is ahead of the last."""
    years = with_previous(by(s, ["year"], ["sales"]), ["year"], digits=1, change="yoy_pct")
    best = years.agg(F.max_by("year", F.when(F.col("yoy_pct").isNotNull(), F.struct("yoy_pct", -F.col("year")))).alias("best_growth_year"), F.max("yoy_pct").alias("best_growth_pct"))
    regions = by(s, ["region"], ["sales"])
    ends = regions.agg(F.max_by("region", F.struct("sales", "region")).alias("first_region"), F.min_by("region", F.struct("sales", "region")).alias("last_region"), F.round(F.max("sales") - F.min("sales"), 2).alias("region_gap"))
    return best.crossJoin(ends)  # one row each


def period_deltas(s: DataFrame) -> DataFrame:
    """Year to year change of basket and orders, beside the change over the whole period."""
    y = by(s, ["year"], ["sales", "orders", "basket"])
    w, whole = Window.orderBy("year"), Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda c: change_pct(F.col(c), F.lag(c).over(w), 1).alias(f"{c}_delta_pct")
    over = lambda c: change_pct(F.last(c).over(whole), F.first(c).over(whole), 1).alias(f"{c}_period_pct")
    return y.select("year", *[of(c) for c in ("sales", "orders", "basket")], *[over(c) for c in ("sales", "orders", "basket")])


def variation_buckets(variations: DataFrame, col: str = "qoq_pct") -> DataFrame:
    v = F.col(col)
    return variations.agg(F.count_if(v < -20).alias("severe"), F.count_if((v >= -20) & (v < -2)).alias("moderate"), F.count_if(v >= -2).alias("other"))
