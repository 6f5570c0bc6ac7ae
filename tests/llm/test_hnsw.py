import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgauge.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector int, shard int, ids string"


def frame(spark, vectors, ids=None):
    rows = [(i, [float(x) for x in v], 0, 9, 9, 9, "x") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def exact(vectors, query, k=20):
    scores = vectors.astype(np.float32).astype(float) @ vectors[query].astype(np.float32).astype(float)
    order = [j for j in np.lexsort((np.arange(len(vectors)), -scores)) if j != query]
    return order[:k]


@pytest.mark.parametrize("settings", [hnsw.Settings(), hnsw.Settings(shard=150, block=20)])
def test_recall_on_vectors_of_different_norms(spark, settings):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 24)) * rng.uniform(0.5, 2, (900, 1))
    rows = hnsw.search(frame(spark, vectors), F.col("vec_id") % 20 == 0, settings).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20)) and all(sorted(x[0] for x in v) == list(range(1, 21)) for v in found.values())
    recall = np.mean([len({v for _, v, _ in hits} & set(exact(vectors, q))) / 20 for q, hits in found.items()])
    assert recall >= 0.9
    for q, hits in found.items():
        assert [x[1:] for x in sorted(hits)] == sorted((x[1:] for x in hits), key=lambda x: (-x[1], x[0]))
        a = vectors[q].astype(np.float32).astype(float)
        assert all(abs(s - float(vectors[v].astype(np.float32).astype(float) @ a)) < 1e-9 for _, v, s in hits)


def test_copies_ties_and_unusable_vectors(spark):
    vectors = [[1.0, 0.0]] * 60 + [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.5, 0.5], [1.0, 2.0, 3.0]]
    df = frame(spark, vectors).unionAll(frame(spark, [[1.0, 0.0]], [5]))
    df = df.unionByName(spark.createDataFrame([(100, None, 0, 9, 9, 9, "x"), (101, [None, 1.0], 0, 9, 9, 9, "x"), (None, [1.0, 1.0], 0, 9, 9, 9, "x")], SCHEMA))
    asks = F.col("vec_id").isin(0, 30, 60, 61, 63, 64, 100)
    found = {}
    for r in hnsw.search(df, asks).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(found) == {0, 30, 63}
    assert [v for _, v in sorted(found[0])] == list(range(1, 21))
    assert [v for _, v in sorted(found[30])] == list(range(20))
    assert [v for _, v in sorted(found[63])] == list(range(20))
    assert hnsw.search(df.limit(0), asks).collect() == []


def test_fewer_candidates_than_asked(spark):
    rows = hnsw.search(frame(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 2, 1.0), (2, 1, 0.0)]
