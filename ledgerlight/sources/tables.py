"""Sinks, latest-row reads, schema evolution and table checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCOPE = ["year", "region", "category"]


def write_tables(tables: dict[str, DataFrame], root: str, partitions: dict[str, list[str]] | None = None, types: dict[str, T.StructType] | None = None, dynamic: bool = False) -> None:
    """Each table as Parquet under ``root``, replaced whole, or with ``dynamic`` only the partitions that it holds.

    ``partitions`` names partition columns; ``types`` gives a table's columns and types, to which it is brought first.
    """
    for name, df in tables.items():
        df = evolve(df, types[name]) if types and name in types else df
        mode = "dynamic" if dynamic else "static"
        df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*(partitions or {}).get(name, [])).parquet(f"{root}/{name}")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    A session in one process may leave it unset and then uses a local folder; a cluster has
    to name one that all executors share.
    """
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "ledgerlight-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read again: what is built on it runs no part of its plan twice."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").parquet(path)


def latest_per_scope(reports: DataFrame, scope: list[str] = SCOPE, at: str = "generated_at", tie: str = "report_id") -> DataFrame:
    """The newest row of each scope; nulls in a scope are equal."""
    w = Window.partitionBy(*scope).orderBy(F.desc(at), F.desc(tie))
    return reports.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def of_scope(df: DataFrame, **values) -> DataFrame:
    """Rows whose scope columns are exactly these values, null for none."""
    return df.filter(reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(values.get(c))) for c in SCOPE]))


def evolve(df: DataFrame, target: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """The table with the target's columns: renamed, missing ones as null, cast to its types."""
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows, status`` of each table."""
    each = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.when(F.col("n_rows") > 0, "ok").otherwise("empty").alias("status")) for n, df in sorted(tables.items())]
    return reduce(DataFrame.unionAll, each)


def stale_audit(texts: DataFrame, phrases: tuple[str, str], text_col: str = "text", year_col: str | None = None) -> DataFrame:
    """Counts of stale texts: a zero percentage, either phrase (any case), the larger of the two, the rows with any, which are those that ``purged`` takes, and reports of a single year."""
    low, c = F.lower(F.col(text_col)), F.col(text_col)
    zero = c.rlike(r"\+?0[.,]0\s?%")
    phrase = F.coalesce(low.contains(phrases[0].lower()) | low.contains(phrases[1].lower()), F.lit(False))
    counts = {"zero_growth": F.count_if(zero), "stale_phrase": F.count_if(phrase), "purge_rows": F.count_if(F.coalesce(zero, F.lit(False)) | phrase)}
    if year_col:
        counts["mono_year"] = F.count(year_col)
    return texts.agg(*[v.alias(k) for k, v in counts.items()]).withColumn("purge_candidates", F.greatest("zero_growth", "stale_phrase"))


def purged(texts: DataFrame, phrases: tuple[str, str], text_col: str = "text") -> DataFrame:
    """The rows that the audit does not name."""
    low, c = F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(text_col), F.lit(""))
    return texts.filter(~(c.rlike(r"\+?0[.,]0\s?%") | low.contains(phrases[0].lower()) | low.contains(phrases[1].lower())))
