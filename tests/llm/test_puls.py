import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgauge.llm import puls

BAD = ["awful", "rotten", "vile"]


@pytest.fixture(scope="module")
def case(spark, prose):
    """600 texts, a fifth toxic by their words; a third of all carry a label."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(i, 60).split()
        if toxic:
            for w in rng.choice(BAD, 3):
                words[rng.integers(len(words))] = str(w) + rng.choice(["", "ly", "ish"])
        docs.append((i, " ".join(words), "en", "a"))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(case):
    docs, labels = case
    rows = puls.score_held_out(docs, labels, puls.Settings(features=300)).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out]
    toxic = {r.doc_id for r in out if r.doc_id % 5 == 0}
    hits = {r.doc_id for r in out if r.predicted}
    assert len(out) > 80 and len(hits & toxic) >= 0.9 * len(toxic) and len(hits - toxic) <= 0.1 * len(hits)


def test_only_training_rows_and_text_count(case, spark):
    docs, labels = case
    few = puls.Settings(features=200, steps=60)
    first = {r.doc_id: r.score for r in puls.score_held_out(docs, labels, few).collect()}
    # labels of held-out rows, other columns and the order of rows change nothing
    turned = labels.withColumn("toxic", F.when(puls.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    changed = docs.withColumns({"lang": F.lit("zz"), "score": F.lit("x"), "unlabelled": F.lit(7), "toxic": F.lit(1)})
    again = puls.score_held_out(changed.repartition(7).orderBy(F.desc("doc_id")), turned, few)
    assert {r.doc_id: r.score for r in again.collect()} == first


def test_step_follows_the_corrected_risk():
    """Against differences of the risk written out; the direction turns once the clean part is negative."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(size=5), rng.normal(size=7)
    loss = lambda x: 1 / (1 + np.exp(x))

    def parts(p, u, prior):
        return loss(p).mean(), loss(-u).mean() - prior * loss(-p).mean()

    for prior in (0.2, 0.95):
        low = u - 3 if prior > 0.5 else u
        toxic, clean, on_p, on_u = puls.risk_step(p, low, prior)
        assert np.allclose((toxic, clean), parts(p, low, prior)) and (clean < 0) == (prior > 0.5)
        for k in range(5):
            step = np.eye(5)[k] * 1e-6
            a, b = parts(p + step, low, prior), parts(p - step, low, prior)
            slope = (prior * (a[0] - b[0]) + (a[1] - b[1])) / 2e-6 if clean >= 0 else -(a[1] - b[1]) / 2e-6
            assert abs(slope - on_p[k]) < 1e-6
        for k in range(7):
            step = np.eye(7)[k] * 1e-6
            slope = (parts(p, low + step, prior)[1] - parts(p, low - step, prior)[1]) / 2e-6
            assert abs((slope if clean >= 0 else -slope) - on_u[k]) < 1e-6


def test_features_equal_plain_sets():
    reader = puls.Reader((4, 5), {" vil": 0, "vile": 1, " vile ": 2, "zzzz": 3})
    assert reader.read("Vile, vile things") == {0, 1, 2} and reader.read("") == set() and reader.read("vilest") == {0, 1}
    assert puls.marked("ab", (4, 5)) == {" ab "} and puls.marked("abc", (4, 5)) == {" abc", "abc ", " abc "}


def test_odd_rows(case, odd_docs, no_docs, texts_of):
    docs, labels = case
    few = puls.Settings(features=50, steps=20)
    model = puls.train(docs, labels, few)
    rows = puls.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert puls.score(no_docs, model).collect() == []
    # nothing confirmed: labels empty, or of documents that are not there, or null
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("doc_id", F.col("doc_id") + 10_000), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert puls.train(docs, none, few) is None
    assert {(r.score, r.predicted) for r in puls.score_held_out(odd_docs, labels.limit(0)).collect()} == {(0.0, 0)}
    repeated = labels.unionByName(labels).withColumn("text", F.lit("x"))
    again = puls.train(docs, repeated, few)
    assert again.features == model.features and np.array_equal(again.weights, model.weights)
