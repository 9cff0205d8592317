"""The inverted file against brute force: recall, exact similarities, filters, crowded cells, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import inverted, retrieval



def brute(ids, x, asked, k=5, least=0.3):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = np.round(x @ x[i], 4)
        s[ids == ids[i]] = -2
        order = [j for j in np.lexsort((ids, -s))[:k] if s[j] > least]
        out[int(ids[i])] = [(int(ids[j]), round(float(s[j]), 4)) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.passage_id, round(r.similarity, 4)))
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, tmp_path, folder):
    v = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").select(F.col("vec_id").alias("passage_id"), "label", "embedding")
    rows = v.collect()
    ids, x = np.array([r.passage_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0))
    stored = inverted.InvertedFile(spark, str(tmp_path))
    stored.build(v, metadata=["label"])
    hits = stored.search(v.filter("passage_id % 20 = 0").withColumnRenamed("passage_id", "query_id"))
    got = found(hits)
    share = sum(len(set(want[q]) & set(got.get(q, []))) for q in want) / sum(map(len, want.values()))
    assert share >= 0.95
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert all(len(h) <= 5 and q not in {p for p, _ in h} for q, h in got.items())


def test_all_cells_are_exact_whatever_the_slices(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.r_[np.tile(rng.normal(size=8), (60, 1)), rng.normal(size=(140, 8))]  # a crowd of equal vectors
    rows = [(i, "a" if i % 3 else None, [float(c) for c in v]) for i, v in enumerate(x)]
    v = spark.createDataFrame([*rows, (900, "a", [0.0] * 8), (901, "a", None)], "passage_id long, kind string, embedding array<double>")
    queries = v.filter("passage_id % 7 = 0").withColumnRenamed("passage_id", "query_id")
    want = brute(np.arange(200), x, range(0, 200, 7), k=4)
    for rows_a_slice in (7, 10_000):
        stored = inverted.InvertedFile(spark, str(tmp_path / str(rows_a_slice)))
        stored.build(v, metadata=["kind"], cells=6, slice_rows=rows_a_slice)
        got = found(stored.search(queries, k=4, probe=1.0, slice_rows=rows_a_slice))
        assert got == {q: h for q, h in want.items() if h}
        mine = {i for i in range(200) if i % 3 == 0}
        only = found(stored.search(queries, k=200, probe=1.0, where={"kind": None}))
        assert all(p in mine for h in only.values() for p, _ in h) and only
    empty = inverted.InvertedFile(spark, str(tmp_path / "empty"))
    empty.build(v.filter("passage_id < 0"), metadata=["kind"])
    assert empty.search(queries).collect() == [] and stored.search(queries.filter("query_id < 0")).collect() == []


def test_pairs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "passage_id int, embedding array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 9), (2, 2)], "a int, b int")
    assert sorted(map(tuple, retrieval.pair_cosines(pairs, v).collect())) == [(1, 2, 1.0), (1, 3, 0.0), (2, 2, 1.0)]


def test_pairwise_has_every_vector_of_both_sides(spark, tmp_path):
    from ledgerlight.plans import registry

    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (7, [3.0, 0.0]), (20, [0.0, 1.0]), (40, [0.0, 0.0]), (60, None)], "vec_id long, embedding array<float>")
    v.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, registry.QUERIES["x12_pairwise"](spark, str(tmp_path)).select("query_id", "passage_id", "similarity").collect()))
    assert got == [(0, 1, 0.0), (0, 7, 1.0), (0, 20, 0.0), (20, 0, 0.0), (20, 1, 1.0), (20, 7, 0.0)]
    asked = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    passages = v.withColumnRenamed("vec_id", "passage_id")
    assert sorted(map(tuple, retrieval.scored_pairs(asked, passages, most_queries=1).collect())) == got
