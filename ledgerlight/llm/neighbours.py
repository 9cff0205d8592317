"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected onto several random sets of directions, shifted, and ordered along a
Hilbert curve for each set. Spark range-partitions the curve keys; a query is compared
with the block of the order that it falls into and the blocks beside it, the windows of
all orders merge, and original vectors give the final order. Equal vectors are one point
with the smallest ids it stands for, so a crowd of copies costs no recall and no time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (``bits`` bits each), by Gray-code rotation from the top bit down."""
    x = cells.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = q - one
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> np.uint64(b)) & one == 1, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key.astype(np.int64)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v``: one row for each id, without null, empty, zero or non-finite vectors; of several vectors of an id the smallest."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, orders: int = 16, directions: int = 8, bits: int = 7, least_block: int = 2048, block_growth: float = 9.0, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` found with the largest inner product for each id divisible by ``every``.

    Every other usable row is a candidate. A block holds ``max(least_block, block_growth *
    sqrt(n))`` points, so a task's data grows with the root of the input. Ties go to the
    smaller id; fewer than ``k`` candidates give them all. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do null ids or vectors of another
    length than the most frequent one; repeated ids count once; an empty table gives an
    empty one; other columns are not read.
    """
    if directions * bits > 62:
        raise ValueError("curve keys must fit into a long")
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vec_col), "ann-rows")
    kind = vectors.schema[id_col].dataType.simpleString()
    empty = f"query_id {kind}, rank int, vec_id {kind}, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim = sizes["d"]
    rows = rows.filter(F.size("v") == dim)

    # Points: distinct vectors, each with the k + 1 smallest ids that have it.
    some = rows.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("at") <= k + 1)
    points = written(some.groupBy("v").agg(F.min("vec_id").alias("point"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-points")
    asked = written(rows.filter(F.col("vec_id") % every == 0).join(points.select("v", "point"), "v").select("vec_id", "point"), "ann-queries")
    marked = points.join(asked.select("point").distinct().withColumn("asked", F.lit(True)), "point", "left").select("point", "v", F.coalesce("asked", F.lit(False)).alias("asked"))

    # Moments decide the cells; inner product becomes distance by one more coordinate.
    def moments(batches):
        for b in batches:
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, dim))
            yield pa.RecordBatch.from_pydict({"n": [len(x)], "most": [float((x * x).sum(1).max(initial=0))], "total": [x.sum(0).tolist()], "square": [float((x * x).sum())]})

    sums = points.select("v").mapInArrow(moments, "n long, most double, total array<double>, square double").toPandas()
    n, most = int(sums.n.sum()), float(sums.most.max())
    mean = np.append(np.sum(sums.total.tolist(), axis=0) / n, 0.0)
    spread = math.sqrt(max((float(sums.square.sum()) / n - float(mean @ mean)) / dim, 1e-300))
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, : min(directions, dim + 1)] for _ in range(orders)]
    shifts = [rng.random(b.shape[1]) for b in bases]
    block = max(least_block, math.ceil(block_growth * math.sqrt(n)))

    def keys(batches):
        for b in batches:
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
            wanted = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            square = (x * x).sum(1)
            here = np.column_stack([x, np.sqrt(np.maximum(most - square, 0))])
            there = np.column_stack([x * (math.sqrt(most) / np.sqrt(square))[:, None], np.zeros(len(x))])[wanted]
            for o, (basis, shift) in enumerate(zip(bases, shifts)):
                for role, y, ids in ((0, here, b.column(0)), (1, there, b.column(0).filter(b.column(2)))):
                    cells = np.clip((((y - mean) @ basis / spread + 3.5) / 8 + shift / 8) * (1 << bits), 0, (1 << bits) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), o, np.int32)), pa.array(hilbert_keys(cells.astype(np.int64), bits)), pa.array(np.full(len(y), role, np.int32)), ids], names=["o", "key", "role", "point"])

    curve = marked.mapInArrow(keys, f"o int, key long, role int, point {kind}")
    parts = max(orders, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = curve.repartitionByRange(parts, "o", "key", "point", "role").sortWithinPartitions("o", "key", "point", "role").withColumn("place", F.monotonically_increasing_id())
    ordered = written(ordered.select("o", "role", "point", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ann-ordered")
    runs = ordered.groupBy("o", "part").agg(F.count("*").alias("n"), F.min("at").alias("low")).orderBy("o", "part").toPandas()  # one row for each partition and order
    runs["before"] = runs.groupby("o").n.cumsum() - runs.n
    offsets = spark.createDataFrame(runs[["o", "part", "low", "before"]].astype(int), "o int, part long, low long, before long")
    placed = ordered.join(F.broadcast(offsets), ["o", "part"]).select("o", "role", "point", F.floor((F.col("at") - F.col("low") + F.col("before")) / block).alias("block"))
    beside = F.when(F.col("role") == 1, F.array(*[F.col("block") + i for i in (-1, 0, 1)])).otherwise(F.array("block"))
    work = placed.select("o", "role", "point", F.explode(beside).alias("block")).join(points.select("point", "v"), "point")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        here, there = pdf[pdf.role == 0], pdf[pdf.role == 1]
        if not len(here) or not len(there):
            return pd.DataFrame({"query": pdf.point[:0], "point": pdf.point[:0], "score": np.zeros(0)})
        scores = np.stack(there.v.to_numpy()) @ np.stack(here.v.to_numpy()).T
        ids, out = here.point.to_numpy(), []
        for q, s in zip(there.point.to_numpy(), scores):
            bar = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -np.inf
            near = np.flatnonzero(s >= bar)
            near = near[np.lexsort((ids[near], -s[near]))][: k + 1]
            out.append(pd.DataFrame({"query": q, "point": ids[near], "score": s[near]}))
        return pd.concat(out)

    found = work.groupBy("o", "block").applyInPandas(compare, f"query {kind}, point {kind}, score double")
    best = found.groupBy("query", "point").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "point"))).filter(F.col("r") <= k + 1)
    spelled = best.join(points.select("point", "ids"), "point").select("query", F.explode("ids").alias("vec_id"), "score")
    spelled = spelled.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query")).join(spelled.drop("r"), "query").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
