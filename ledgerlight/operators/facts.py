"""Facts of every scope: one row for the whole, each region and each category, and for years and combinations of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import settled
from .measures import change_pct


def trend(growth: Column) -> Column:
    """Six levels of growth over the period."""
    levels = [(50, "strong growth"), (20, "growth"), (5, "slight growth"), (-5, "stable"), (-20, "slight decline")]
    label = F.when(growth.isNull(), None)
    for bound, name in levels:
        label = label.when(growth >= bound, name)
    return label.otherwise("strong decline")


def short_trend(growth: Column) -> Column:
    return F.when(growth > 2, "up").when(growth < -2, "down").otherwise("stable")


def volatility_label(v: Column, bounds: tuple[float, ...] = (10, 20, 30), names: tuple[str, ...] = ("low", "moderate", "high", "very high")) -> Column:
    label = F.when(v.isNull(), None)
    for bound, name in zip(bounds, names):
        label = label.when(v < bound, name)
    return label.otherwise(names[-1])


#: Which scopes facts are made for: the whole, regions and categories; years as well; every combination of the three.
LATTICES = ("basic", "standard", "full")
_REGION, _CATEGORY = 1, 2
FEW_CELLS = 200_000  # so many rows of aggregates are read as one partition: what is built on them needs no exchange


def _names(lattice: str) -> dict[int, list[Column]]:
    """The names of the scopes that a row of year, region and category lies in, by the dimensions that they fix besides the year."""
    if lattice not in LATTICES:
        raise ValueError(f"lattice is one of {LATTICES}")
    region, category = F.concat(F.lit("region:"), "region"), F.concat(F.lit("category:"), "category")
    base = {0: F.lit("all"), _REGION: region, _CATEGORY: category}
    if lattice == "full":
        base[_REGION | _CATEGORY] = F.concat(region, F.lit("|"), category)
    year = F.concat(F.lit("year:"), F.col("year").cast("string"))
    return {k: [name] + ([F.concat(year, F.lit("|"), name) if k else year] if lattice == "full" or (lattice == "standard" and not k) else []) for k, name in base.items()}


def fact_cells(s: DataFrame, lattice: str = "basic") -> DataFrame:
    """The aggregates that facts are made of, a bounded number of rows, written once; the fact is read once.

    ``kind`` is ``time`` (sums by region, category, quarter, month and segment), ``product``
    (by region, category, year and sub-category), or ``orders by year``, ``month`` or
    ``segment``: distinct orders, for the dimensions in ``fixed``. An order's rows meet once,
    as its distinct cells; each then counts once in every scope, so no count is made of
    exploded rows. Year scopes are sums over their year and need no count of their own.
    """
    dims = ["year", "quarter", "month", "region", "category", "segment", "sub_category"]
    lines = s.groupBy("order_id", *dims).agg(F.sum("sales").alias("sales"), F.count("*").alias("articles"))
    orders = lines.groupBy("order_id").agg(F.collect_list(F.struct(*dims, "sales", "articles")).alias("lines"))
    kinds = {n: s.schema[n].dataType for n in dims} | {"sales": lines.schema["sales"].dataType, "articles": T.LongType(), "orders": T.LongType()}

    def row(kind: str, fixed: int, **given: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(fixed).alias("fixed"), *[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    take = lambda x, *names: {n: x[n] for n in names}
    sums = [
        F.transform("lines", lambda x: row("time", -1, **take(x, "region", "category", "year", "quarter", "month", "segment", "sales", "articles"))),
        F.transform("lines", lambda x: row("product", -1, **take(x, "region", "category", "year", "sub_category", "sales", "articles"))),
    ]

    def counted(kind: str, fixed: int) -> Column:
        names = ["region"] * (fixed & _REGION > 0) + ["category"] * (fixed & _CATEGORY > 0) + ["year"] + [kind] * (kind != "year")
        return F.transform("lines", lambda x: row(f"orders by {kind}", fixed, orders=F.when(F.col("order_id").isNull(), 0).otherwise(1), **take(x, *names)))

    counts = [counted(kind, fixed) for fixed in _names(lattice) for kind in ("year", "month", "segment")]
    every = F.concat(*sums, F.array_distinct(F.concat(*counts)))
    keys = ["kind", "fixed", *dims]
    cells = orders.select(F.inline(every)).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("sales", "articles", "orders")])
    cells = settled(cells, "fact-cells")
    return cells.coalesce(1) if cells.count() <= FEW_CELLS else cells


def facts(s: DataFrame, lattice: str = "basic") -> DataFrame:
    """One row a scope: scalars for rules, and the annual, quarterly, monthly, product, segment and region lists they come from.

    Scopes are named ``all``, ``region:ASIA``, ``category:PROMO`` and, as ``lattice`` says,
    ``year:1998`` or ``year:1998|region:ASIA|category:PROMO``. A year's growth is that over
    the year before in the scope without the year, null if there is none; its other changes
    are within the year. The fact is read once. The result, a row for each scope, is written,
    so whatever is built on it reads that alone.
    """
    names = _names(lattice)
    cells = fact_cells(s, lattice)
    every = F.explode(F.array_compact(F.array(*[n for own in names.values() for n in own]))).alias("scope")
    sums = {kind: cells.filter(F.col("kind") == kind).select(every, *[c for c in cells.columns if c not in ("kind", "fixed", "orders")]) for kind in ("time", "product")}
    total = F.sum("sales").cast("double")
    by_scope = lambda *dims: sums["product" if "sub_category" in dims else "time"].groupBy("scope", *dims).agg(F.round(total, 2).alias("sales"), total.alias("full"), F.sum("articles").alias("articles"))
    within = reduce(lambda found, k: found.when(F.col("fixed") == k, F.array(*names[k])), names, F)
    counted = cells.filter("fixed >= 0").select("kind", F.explode(F.array_compact(within)).alias("scope"), "year", "month", "segment", "orders")
    orders = lambda kind, *dims: counted.filter(F.col("kind") == f"orders by {kind}").select("scope", *dims, "orders")

    w = Window.partitionBy("scope").orderBy("year")
    annual = by_scope("year").join(orders("year", "year"), ["scope", "year"]).withColumn("basket", F.round(F.col("full") / F.col("orders"), 2))
    annual = annual.withColumns({"yoy_pct": change_pct(F.col("sales"), F.lag("sales").over(w), 1), "after": F.lag("year").over(w)})
    annual = annual.withColumns({c: change_pct(F.col(d), F.lag(d).over(w), 1) for c, d in (("basket_delta", "basket"), ("orders_delta", "orders"))})
    years = annual.groupBy("scope").agg(
        F.array_sort(F.collect_list(F.struct("year", "sales", "orders", "basket", "yoy_pct"))).alias("annual"),
        F.round(F.sum("sales"), 2).alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n_years"),
        F.min_by("sales", "year").alias("first_sales"), F.max_by("sales", "year").alias("last_sales"),
        F.max_by("year", F.struct("sales", -F.col("year"))).alias("best_year"), F.min_by("year", F.struct("sales", "year")).alias("worst_year"),
        F.count_if(F.col("yoy_pct") > 0).alias("growing_years"),
        F.max_by("basket_delta", "year").alias("basket_delta"), F.max_by("orders_delta", "year").alias("orders_delta"),
    )
    q = by_scope("year", "quarter").withColumn("qoq_pct", change_pct(F.col("sales"), F.lag("sales").over(Window.partitionBy("scope").orderBy("year", "quarter")), 1))
    label = F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"))
    moved = F.col("qoq_pct").isNotNull()
    early = [-F.col("year"), -F.col("quarter")]
    quarters = q.groupBy("scope").agg(
        F.array_sort(F.collect_list(F.struct("year", "quarter", "sales", "qoq_pct"))).alias("quarters"),
        # Without any change to compare, sales decide.
        F.coalesce(F.max_by(label, F.when(moved, F.struct("qoq_pct", *early))), F.max_by(label, F.struct("sales", *early))).alias("best_quarter"), F.max("qoq_pct").alias("best_qoq"),
        F.coalesce(F.min_by(label, F.when(moved, F.struct("qoq_pct", "year", "quarter"))), F.min_by(label, F.struct("sales", "year", "quarter"))).alias("worst_quarter"), F.min("qoq_pct").alias("worst_qoq"),
        F.round(F.sum(F.abs("qoq_pct").cast("decimal(38,1)")).cast("double") / F.count("qoq_pct"), 1).alias("volatility"),
    )
    months = by_scope("year", "month").join(orders("month", "year", "month"), ["scope", "year", "month"]).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("year", "month", "sales", "orders"))).alias("months"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("sales"), "sub_category"))
    best3 = by_scope("sub_category").withColumn("rank", rank).filter("rank <= 3")
    products = best3.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("sub_category").alias("name"), "sales", "articles"))).alias("products"), F.round(F.sum("sales"), 2).alias("top3"), F.max_by("sub_category", -F.col("rank")).alias("top_product"), F.max("sales").alias("top1"))
    segment_orders = orders("segment", "segment").groupBy("scope", "segment").agg(F.sum("orders").alias("orders"))
    segments = by_scope("segment").join(segment_orders, ["scope", "segment"]).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("segment", "sales", "orders"))).alias("segments"), F.max_by("segment", F.struct("sales", "segment")).alias("best_segment"), F.max("sales").alias("segment_sales"))
    regions = by_scope("region").groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("region", "sales"))).alias("region_totals"), F.max_by("region", F.struct("sales", "region")).alias("top_region"), F.max("sales").alias("region_sales"))
    winners = by_scope("year", "region").groupBy("scope", "year").agg(F.min_by(F.struct("region", "sales"), F.struct(-F.col("sales"), "region")).alias("x")).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("year", "x.region", "x.sales"))).alias("regions"))
    # A year scope takes its growth from the same scope without the year.
    sibling = annual.filter("year - after = 1").select(F.col("scope").alias("within"), F.col("year").alias("of_year"), F.col("yoy_pct").alias("year_growth"))
    of_year = F.when(F.col("scope").startswith("year:"), F.regexp_extract("scope", "^year:(-?[0-9]+)", 1).cast("int"))
    rest = F.regexp_replace("scope", r"^year:-?[0-9]+\|?", "")
    years = years.withColumns({"of_year": of_year, "within": F.when(rest == "", "all").otherwise(rest)})
    row = years.join(sibling, ["within", "of_year"], "left")
    for part in (quarters, months, products, segments, regions, winners):
        row = row.join(part, "scope")
    growth = F.when(F.col("n_years") > 1, change_pct(F.col("last_sales"), F.col("first_sales"), 1)).otherwise(F.col("year_growth"))
    row = row.withColumns({"growth_pct": growth, "period": F.when(F.col("of_year").isNotNull(), F.col("first_year").cast("string")).otherwise(F.concat_ws("-", "first_year", "last_year")), "region_share": F.round(F.col("region_sales") * 100 / F.col("total"), 1), "segment_share": F.round(F.col("segment_sales") * 100 / F.col("total"), 1), "top1_share": F.round(F.col("top1") * 100 / F.col("top3"), 1)})
    row = row.withColumns({"trend": trend(F.col("growth_pct")), "short_trend": short_trend(F.col("growth_pct")), "volatility_level": volatility_label(F.col("volatility")), "volatility_short": volatility_label(F.col("volatility"), (15, 30), ("low", "moderate", "high"))})
    return settled(row.drop("within", "of_year", "year_growth"), "facts")
