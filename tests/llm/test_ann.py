import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import ann


def exact(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[ids == ids[i]] = -9
        out[int(ids[i])] = [int(j) for j in ids[np.lexsort((ids, -s))][:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("dim", [64, 128])
def test_recall(spark, dim):
    """Full blocks, of which the given share is ranked again."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(16_800, dim)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(len(x)) * 2, "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), dim).cast(pa.list_(pa.float32()))})
    got = found(ann.search(spark.createDataFrame(table), F.col("vec_id") % 100 == 0))
    x = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = []
    for i in range(0, len(x), 50):
        s = x @ x[i]
        s[i] = -9
        hits.append(len(set((2 * np.argsort(-s)[:5]).tolist()) & set(got[2 * i])))
    assert len(got) == len(hits) and np.mean(hits) / 5 >= 0.9


def test_nearest_pivots():
    likeness = np.array([[1.0, 3.0, 2.0, 0.0], [0.5, 0.1, 0.2, 0.4]])
    assert ann.nearest(likeness, 3).tolist() == [[1, 2, 0], [0, 3, 2]] and ann.nearest(likeness, 4).tolist() == [[1, 2, 0, 3], [0, 3, 2, 1]]


def test_scores_and_small_tables(spark):
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [4.0, 0.0]), (5, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["rank"], r.vec_id, r.score) for r in ann.search(frame, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (2, 3, 1.0), (3, 5, 0.0)]  # ties to the smaller id; fewer than five candidates


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [2.0, 4.0]), (50, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS vec", "2 AS perm", "3 AS score", "4 AS query")
    assert found(ann.search(frame, F.col("vec_id") % 50 == 0)) == {0: [8]}
    assert ann.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows * 3, "vec_id long, embedding array<float>")
    assert found(ann.search(frame, F.col("vec_id") % 50 == 0)) == exact(rows)
    crowd = [(1000, [1.0, 0.001 * i, 0.0]) for i in range(3000)]  # one vec_id with more rows than are ranked again
    few = [(0, [1.0, 0.0, 0.0]), *((i, [1.0, 0.0, float(i)]) for i in range(1, 7))]
    got = found(ann.search(spark.createDataFrame(few + crowd, "vec_id long, embedding array<float>"), F.col("vec_id") == 0))
    assert got == {0: [1000, 1, 2, 3, 4]}


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(3000)] + [(5000 + i, [float(i), 1.0, 2.0]) for i in range(300)]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 100))
    assert got == {100: [0, 1, 2, 3, 4]}
