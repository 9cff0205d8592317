"""An inverted file of vectors: cells around centroids, stored by cell, searched cell by cell with exact scores.

Centroids are fitted on a bounded sample; every row is assigned and stored. A search looks
into the cells nearest to each query. Cells, and the queries of a cell, are dealt out in
slices of bounded size, so a crowded cell is many tasks and no task holds an unbounded group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import unit

SAMPLE, MOST_CELLS, LEAST_CELLS, SLICE = 20_000, 2048, 32, 20_000


def _centroids(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; starts are drawn rows."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


@dataclass
class InvertedFile:
    """``root/rows``: id, unit vector, metadata, partitioned by cell; ``root/cells``: cell, centroid and number of slices."""

    spark: SparkSession
    root: str

    def build(self, passages: DataFrame, id_col: str = "passage_id", metadata: list[str] = (), cells: int | None = None, sample: int = SAMPLE, slice_rows: int = SLICE) -> None:
        """Store every passage with a vector (column ``embedding``); zero and null vectors take no part.

        There are about as many cells as the root of the number of rows, ``MOST_CELLS`` at most.
        """
        rows = unit(passages.filter("embedding is not null").select(id_col, *metadata, "embedding"), "embedding")
        n = rows.count()
        chosen = rows.filter(F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30)))
        x = np.array([r[0] for r in chosen.select("embedding").limit(2 * sample).collect()], float)
        k = cells or max(1, min(MOST_CELLS, int(n**0.5)))
        c = self.spark.sparkContext.broadcast(_centroids(x, k) if len(x) else np.zeros((1, 1)))

        def assign(v: pd.Series) -> pd.Series:
            import numpy as np
            import pandas as pd

            return pd.Series((np.stack(v.to_numpy()) @ c.value.T).argmax(1).astype("int32") if len(v) else [], dtype="int32")

        cell = F.pandas_udf(assign, "int")(F.col("embedding"))
        by = ["cell"] if n else []  # an empty table without partitions keeps its columns
        rows.withColumn("cell", cell).write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/rows")
        found = {r["cell"]: r["n"] for r in self.rows().groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        listed = [(i, [float(v) for v in c.value[i]], -(-m // slice_rows)) for i, m in sorted(found.items())]
        self.spark.createDataFrame(listed, "cell int, centroid array<double>, slices int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cells")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def search(self, queries: DataFrame, k: int = 5, least: float = 0.3, probe: float = 0.6, query_id: str = "query_id", id_col: str = "passage_id", where: dict | None = None, slice_rows: int = SLICE) -> DataFrame:
        """``query_id, passage_id, similarity, rank``: the ``k`` most similar passages, above ``least``, in the nearest cells of each query.

        ``probe`` is the share of cells that a query looks into, at least ``LEAST_CELLS``. The
        default suits vectors without structure; clustered ones need far fewer. Similarities
        are exact, rounded to four digits; ties go to the smaller id. ``where`` restricts
        passages by equality on metadata (None asks for null) and reaches the scan. A query
        does not find itself.
        """
        table = self.spark.read.parquet(f"{self.root}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        mine = unit(queries.filter("embedding is not null").select(query_id, F.col("embedding").alias("_q")), "_q")
        stored = self.rows()
        for column, value in (where or {}).items():
            stored = stored.filter(F.col(column).eqNullSafe(F.lit(value)))
        look = min(len(table), max(LEAST_CELLS, int(probe * len(table))))
        cells, slices = [r["cell"] for r in table], {r["cell"]: r["slices"] for r in table}
        c = self.spark.sparkContext.broadcast((np.array([r["centroid"] for r in table], float), np.array(cells, np.int32)))

        def nearest(v: pd.Series) -> pd.Series:
            import numpy as np
            import pandas as pd

            centroids, names = c.value
            if not len(v) or not len(names):
                return pd.Series([[] for _ in range(len(v))], dtype=object)
            score = np.stack(v.to_numpy()) @ centroids.T
            best = np.argpartition(-score, look - 1, axis=1)[:, :look]
            return pd.Series([names[b].tolist() for b in best])

        asked = mine.withColumn("cell", F.explode(F.pandas_udf(nearest, "array<int>")(F.col("_q"))))
        load = {r["cell"]: -(-r["n"] // slice_rows) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        plan = self.spark.createDataFrame([(i, slices[i], load.get(i, 0)) for i in cells], "cell int, slices int, blocks int")
        plan = F.broadcast(plan)  # MOST_CELLS rows at most
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda key, n, seed: F.pmod(F.xxhash64(F.lit(seed), key), F.col(n)).cast("int")
        q = asked.join(plan, "cell").withColumn("block", deal(query_id, "blocks", 1)).select("cell", "block", every("slices").alias("slice"), F.col(query_id).alias("q"), "_q")
        p = stored.join(plan.filter("blocks > 0"), "cell").withColumn("slice", deal(id_col, "slices", 2)).select("cell", "slice", every("blocks").alias("block"), F.col(id_col).alias("p"), "embedding")
        kinds = f"q {mine.schema[query_id].dataType.simpleString()}, p {stored.schema[id_col].dataType.simpleString()}, similarity double"

        def scored(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            import numpy as np
            import pandas as pd

            out = []
            if len(a) and len(b):
                vectors, ids = np.stack(b["embedding"].to_numpy()), b["p"].to_numpy()
                for at in range(0, len(a), 256):
                    part = a.iloc[at : at + 256]
                    names = part["q"].to_numpy()
                    s = np.stack(part["_q"].to_numpy()) @ vectors.T
                    s[names[:, None] == ids[None, :]] = -2
                    s = np.round(s, 4)
                    cut = min(k, s.shape[1])
                    floor = np.maximum(np.partition(s, s.shape[1] - cut, axis=1)[:, s.shape[1] - cut], least + 1e-9)  # ties at the last place all stay
                    i, j = np.nonzero(s >= floor[:, None])
                    out.append(pd.DataFrame({"q": names[i], "p": ids[j], "similarity": s[i, j]}))
            return pd.concat(out) if out else pd.DataFrame({"q": [], "p": [], "similarity": []})

        keys = ["cell", "slice", "block"]
        hits = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(scored, kinds)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "p"))
        return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("p").alias(id_col), "similarity", "rank")
