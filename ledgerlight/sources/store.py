"""The stored sales table: loads in one pass, years replaced as a whole, KPI tables merged from partials.

A load is one scan and one write: rows that parse go to the grain table, partitioned by
year, all others to the rejects of that load with their reason; counts are collected by the
write itself. A load replaces the years that it holds. Partials of those years alone are
made again: sums, which add up, and bitmaps of ids, whose unions count distinct orders,
clients and products over any years without another look at the grain.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.measures import change_pct, top
from .sales import SALES_CSV, calendar, parsed, valid

MALFORMED = "_malformed"
GRAIN = ["order_id", "line_number", "order_date", "quarter", "month", "customer_id", "segment", "region", "category", "sub_category", "product_id", "product_name", "sales"]
#: Partials: their dimensions beside the year, and the ids whose distinct numbers they keep.
PARTIALS = {
    "annual": ([], ["order_id", "customer_id", "product_id"]),
    "region_quarter": (["region", "quarter"], ["order_id", "customer_id"]),
    "monthly": (["month"], ["order_id"]),
    "products": (["sub_category"], ["order_id", "customer_id"]),
}


def read_csv_lines(spark: SparkSession, path: str, schema: T.StructType = SALES_CSV, header: bool = True) -> DataFrame:
    """Text columns of a sales file, with the line itself in ``_malformed`` where it does not have the columns of the file."""
    wide = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    # Without pruning, so that a line's number of columns is seen whatever columns are asked for.
    return spark.read.schema(wide).option("columnPruning", False).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).option("encoding", "UTF-8").csv(path)


def judged(raw: DataFrame, date_format: str = "dd/MM/yyyy", keep_non_positive: bool = True) -> DataFrame:
    """The rows with their types, the calendar, and ``reason`` why one is rejected: malformed, sales or date; null for none."""
    typed = calendar(parsed(raw, date_format))
    broken = F.col(MALFORMED).isNotNull() if MALFORMED in raw.columns else F.lit(False)
    bad_sales = F.col("sales").isNull() if keep_non_positive else F.col("sales").isNull() | (F.col("sales") <= 0)
    return typed.withColumn("reason", F.when(broken, "malformed").when(bad_sales, "sales").when(~valid(keep_non_positive) | F.col("order_date").isNull(), "date"))


@dataclass
class SalesStore:
    """Tables under ``root``, a folder that all executors share."""

    spark: SparkSession
    root: str

    def load(self, raw: DataFrame, load_id: int, date_format: str = "dd/MM/yyyy", keep_non_positive: bool = True) -> dict:
        """Take rows in, one scan and one write, and bring the partials of their years up to date.

        The load replaces every year that it holds, so a load that is run again changes
        nothing. Returns the number of rows by outcome and the years.
        """
        marked = judged(raw, date_format, keep_non_positive)
        counts = Observation()
        is_reason = lambda r: F.count_if(F.col("reason") == r).alias(r)
        kept = F.col("reason").isNull()
        years = F.expr("bitmap_construct_agg(CASE WHEN reason IS NULL THEN bitmap_bit_position(year) END)")
        seen = marked.observe(counts, F.count(F.lit(1)).alias("rows"), *[is_reason(r) for r in ("malformed", "sales", "date")], F.count_if(kept).alias("kept"), years.alias("years"))
        line = F.col(MALFORMED) if MALFORMED in raw.columns else F.lit(None).cast("string")
        own = [c for c in GRAIN if c in marked.columns]
        out = seen.select(*own, line.alias("line"), "reason", F.when(kept, "grain").otherwise("rejects").alias("table"), F.when(kept, F.col("year")).otherwise(F.lit(load_id)).alias("part"))
        self._replace(out, "loads", ["table", "part"])
        found = counts.get
        mask = np.unpackbits(np.frombuffer(bytes(found.pop("years")), np.uint8), bitorder="little")
        found["years"] = [int(i) + 1 for i in np.flatnonzero(mask)]
        if found["years"]:
            self._partials(found["years"])
        return found

    def grain(self) -> DataFrame:
        """Kept rows with their ``year``; a filter on the year reads its partitions alone."""
        stored = self.spark.read.parquet(f"{self.root}/loads/table=grain").drop("line", "reason")
        return stored.withColumnRenamed("part", "year")

    def rejects(self) -> DataFrame:
        """``load_id, reason``, the malformed line, and what could be read of the others; no columns if nothing was ever rejected."""
        try:
            return self.spark.read.parquet(f"{self.root}/loads/table=rejects").withColumnRenamed("part", "load_id")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "load_id int, reason string, line string")

    def _replace(self, df: DataFrame, name: str, by: list[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{name}")

    def _partials(self, years: list[int]) -> None:
        grain = self.grain().filter(F.col("year").isin(years))
        for name, (dims, ids) in PARTIALS.items():
            sums = grain.groupBy("year", *dims).agg(F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("articles"))
            self._replace(sums, f"{name}-sums", ["year"])
            whole = {i: isinstance(grain.schema[i].dataType, T.IntegralType) for i in ids}
            entry = lambda k, i: F.struct(F.lit(k).alias("which"), (F.col(i).cast("long") if whole[i] else F.lit(None).cast("long")).alias("id"), (F.lit(None).cast("string") if whole[i] else F.col(i).cast("string")).alias("name"))
            every = grain.select("year", *dims, F.inline(F.array(*[entry(k, i) for k, i in enumerate(ids)]))).filter("id is not null or name is not null")
            # Whole numbers become bits of a bucket, other ids are kept as they are, once each.
            bits = every.groupBy("year", *dims, "which", F.expr("bitmap_bucket_number(id)").alias("bucket"), "name").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bits"))
            bits = bits.withColumn("bits", F.when(F.col("name").isNull(), F.col("bits")))
            self._replace(bits, f"{name}-ids", ["year"])

    def merged(self, name: str, by: list[str]) -> DataFrame:
        """Measures of a partial by some of its dimensions: exact sums and distinct numbers of ids."""
        ids = PARTIALS[name][1]
        total = F.sum("sales").cast("double")
        sums = self.spark.read.parquet(f"{self.root}/{name}-sums").groupBy(*by).agg(total.alias("full"), F.sum("articles").alias("articles"))
        union = self.spark.read.parquet(f"{self.root}/{name}-ids").groupBy(*by, "which", "bucket", "name").agg(F.expr("bitmap_count(bitmap_or_agg(bits))").alias("n"))
        union = union.withColumn("n", F.when(F.col("name").isNotNull(), 1).otherwise(F.col("n")))
        counted = lambda i: F.coalesce(F.sum(F.when(F.col("which") == i, F.col("n"))), F.lit(0)).alias(f"n_{ids[i]}")
        counts = union.groupBy(*by).agg(*[counted(i) for i in range(len(ids))])
        if not by:
            return sums.crossJoin(counts)  # one row each
        joined = sums.join(counts, reduce(Column.__and__, [sums[c].eqNullSafe(counts[c]) for c in by]), "left")
        return joined.select(*[sums[c] for c in by], "full", "articles", *[F.coalesce(f"n_{i}", F.lit(0)).alias(f"n_{i}") for i in ids])

    def annual(self) -> DataFrame:
        """As ``kpis.annual``, from partials."""
        y = self.merged("annual", ["year"])
        sales, orders = F.round("full", 2), F.col("n_order_id")
        y = y.select("year", sales.alias("sales"), orders.alias("orders"), "articles", F.round(F.col("full") / orders, 2).alias("basket"), F.col("n_customer_id").alias("clients"), F.col("n_product_id").alias("products"))
        y = y.withColumn("previous", F.lag("sales").over(Window.orderBy("year")))  # a row a year
        return y.withColumn("yoy_pct", change_pct(F.col("sales"), F.col("previous")))

    def region_quarter(self) -> DataFrame:
        """As ``kpis.region_quarter``, from partials."""
        r = self.merged("region_quarter", ["region", "year", "quarter"])
        return r.select("region", "year", "quarter", F.round("full", 2).alias("sales"), F.col("n_order_id").alias("orders"), "articles", F.round(F.col("full") / F.col("n_order_id"), 2).alias("basket"), F.col("n_customer_id").alias("clients"))

    def top_products(self, n: int = 10) -> DataFrame:
        """As ``kpis.top_products``, from partials of all years."""
        p = self.merged("products", ["sub_category"])
        p = p.select("sub_category", F.round("full", 2).alias("sales"), "articles", F.round(F.col("full") / F.col("articles"), 2).alias("avg_price"), F.col("n_customer_id").alias("clients"), F.col("n_order_id").alias("orders"))
        return top(p, n, "sales", "sub_category")

