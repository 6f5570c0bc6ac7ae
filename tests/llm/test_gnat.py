import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pressgauge.llm import gnat

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector int, node long, q long, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], k, 9, 9, 9, 9, "x") for i, v, k in rows], SCHEMA)


def mined(df, settings=gnat.Settings(), every=5):
    found = gnat.mine(df, F.col("vec_id") % every == 0, F.col("label"), settings)
    return sorted(tuple(r) for r in found.collect())


def brute(rows, every=5, positives=5, negatives=3):
    """Every anchor against every row, in Python integers."""
    rows = list({(i, tuple(np.float32(x).item() for x in v), k) for i, v, k in rows})
    whole = [(i, [int(np.floor(256 * x)) for x in v], k) for i, v, k in rows]
    out = []
    for a, v, label in whole:
        if a % every:
            continue
        scores = sorted(
            ((-sum(x * y for x, y in zip(v, w, strict=True)), b, k) for b, w, k in whole if b != a and len(w) == len(v)), key=lambda x: x[:2]
        )
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            fits = [x for x in scores if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, r, b, -s, -t) for r, (t, b, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def clusters(seed, n, dims=6, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, [float(x) for x in centres[rng.integers(5)] + spread * rng.normal(size=dims)], int(rng.integers(3))) for i in range(n)]


def test_equals_brute_force_through_several_levels(spark):
    rows = clusters(1, 300)
    found = mined(frame(spark, rows), gnat.Settings(leaf=60, block=16, degree=4, sample=30))
    assert found == brute(rows) and len(found) > 500


def test_hot_vector_ties_and_node_that_cannot_be_divided(spark):
    # a third of the rows share one vector, others one of few, and one vector has more labels than a leaf holds
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.5], i % 2) for i in range(60)] + [(200 + i, [1.0, 1.0], i) for i in range(30)]
    rows += [(60 + i, [float(rng.integers(-2, 3)) / 2, float(rng.integers(-2, 3)) / 2], int(rng.integers(3))) for i in range(90)]
    assert mined(frame(spark, rows), gnat.Settings(leaf=20, degree=4, sample=40, block=16)) == brute(rows)


def test_children_out_of_reach_are_left_out():
    # two far groups; a window that only the first can meet
    near, far = np.array([[10, 0], [9, 1]]), np.array([[-10, 0], [-9, 1]])
    children = []
    for k, group in enumerate((near, far)):
        away = gnat._distances(group, np.array([[10, 0], [-10, 0]]))
        norms = gnat._norms(group)
        children.append({"child": 1 + k, "shortest": norms.min(), "longest": norms.max(), "nearest": away.min(0), "farthest": away.max(0)})
    nodes = pd.DataFrame({"space": [2], "node": [0], "splits": [[[10, 0], [-10, 0]]], "children": [children]})
    asks = pd.DataFrame(
        {
            "q": [1, 2, 3],
            "space": 2,
            "node": 0,
            "label": 0,
            "vector": [[10, 0]] * 3,
            "windows": [[{"key": 0, "low": 50, "high": 200}], [{"key": 0, "low": -200, "high": -50}], [{"key": 0, "low": -200, "high": 200}]],
        }
    )
    seen = gnat._descend(asks, nodes, 2, greedy=False)
    assert sorted(zip(seen["q"], seen["node"], strict=True)) == [(1, 1), (2, 2), (3, 1), (3, 2)]
    assert list(gnat._descend(asks, nodes, 2, greedy=True)["node"]) == [1, 1, 1]


def test_unusable_rows_repeats_spaces_and_large_components(spark):
    rows = clusters(3, 40, dims=3)
    odd = frame(spark, rows + rows[:10])
    more = [
        (None, [1.0, 1.0, 1.0], 0),
        (100, None, 0),
        (105, [1.0, 1.0, 1.0], None),
        (110, [1.0, None, 1.0], 0),
        (115, [1.0, float("nan"), 1.0], 0),
        (120, [float("inf"), 1.0, 1.0], 0),
    ]
    extra = [(200 + i, [float(i)] * 2, i % 2) for i in range(10)] + [(300, [], 0), (301, [], 0), (302, [], 1)]
    found = mined(odd.unionByName(frame(spark, more + extra)))
    assert found == sorted(brute(rows) + brute(extra))
    assert (300, 301, 1, 302, 0, 0) in found
    # scores beyond 53 bits are exact, and end at 64 bits
    big = [(0, [2e6, 3.0, 0, 0], 0), (1, [2e6, 1.0, 0, 0], 0), (2, [1.5e6, 7.0, 0, 0], 1), (5, [1e30] * 5, 0), (6, [1e30] * 5, 0), (7, [9e29] * 5, 1)]
    found = mined(frame(spark, big))
    assert [r for r in found if r[0] == 0] == brute(big[:3]) != [] and {r[1] for r in found if r[0] == 5} <= {6}


def test_empty_and_alone(spark):
    df = frame(spark, clusters(4, 6))
    assert mined(df.limit(0)) == []
    assert mined(frame(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.7], 1)])) == []  # a negative score has no window
