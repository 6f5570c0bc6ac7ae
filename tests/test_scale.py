"""Paths that only larger tables take, at sizes made small."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressgauge.operators import linear, ordered, sampling
from pressgauge.sources import registry


@pytest.mark.parametrize("rows_per_slice", [1, 5, 40])
def test_totals_over_numbers_of_every_size(spark, rows_per_slice):
    rng = np.random.default_rng(4)
    values = {0.0, -1.0, 1.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, 1.0000000000000002, 0.9999999999999999}
    values |= {float(x) for x in rng.normal(size=60)} | {float(x) for x in 0.5 + rng.random(60) * 1e-9} | {float(10.0**k) for k in range(-300, 300, 50)}
    order = [None, *sorted(values), float("nan")]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(order)], "v double, n long").repartition(3)
    placed = {r.n: (r.at, r.upto) for r in ordered.running_totals(df, "v", {"at": F.lit(1).cast("long"), "upto": F.col("n")}, rows_per_slice).collect()}
    assert placed == {k: (k + 1, k * (k + 1) // 2) for k in range(len(order))}


@pytest.mark.parametrize("rows_per_slice", [1, 7])
def test_places_of_extreme_integers(spark, rows_per_slice):
    values = sorted({-(2**63), 2**63 - 1, 0, -1, 1, *range(1_000, 1_040), *(2**k for k in range(3, 62, 4))})
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    assert {r.v: r.at for r in ordered.number_rows(df, "v", "at", rows_per_slice).collect()} == {v: k for k, v in enumerate(values)}


def test_no_window_without_partition(spark, capsys):
    df = spark.range(2_000).select(F.col("id"), (F.col("id") * 7919 % 2_003).alias("v"))
    ordered.number_rows(df, "v", "at", 10).explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("ranked", [1, 4, 60])
def test_ticket_digits_find_the_same_rows(spark, monkeypatch, ranked):
    monkeypatch.setattr(sampling, "RANKED_ROWS", ranked)
    rows = [(i, None if i % 11 == 0 else "a" if i % 3 else "b") for i in range(400)] + [(1_000, "c")]
    df = spark.createDataFrame(rows, "id long, g string")
    for quota in (F.lit(17), F.floor(F.col("group_size") * 0.5), F.lit(0), F.lit(10_000)):
        flagged = sampling.first_per_group(df, "g", "id", quota, 42, "held").collect()
        assert len(flagged) == len(rows)
        for group in ("a", "b", "c"):
            ids = sorted((i for i, g in rows if g == group), key=lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest())
            n = {"17": 17, "0": 0, "10000": 10_000}.get(quota._jc.toString(), len(ids) // 2)
            assert {r.id for r in flagged if r.g == group and r.held} == set(ids[:n])
        assert not any(r.held for r in flagged if r.g is None)


def test_a_split_by_few_groups_leaves_rows_where_they_are(spark):
    df = spark.range(0, 4_000, 1, 8).select("id", (F.col("id") % 2).alias("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = sampling.stratified_split(df, "g", "id", 0.5).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in held.groupBy("task").count().collect()]
        assert sizes == [500] * 8 and held.filter("held").count() == 2_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


TEXTS = ["red fox runs", "red red hen", "blue fox sleeps", "old hen sleeps", "blue sky", "red sky runs", "no1 x yy", ""] * 3


@pytest.fixture
def articles(spark):
    rows = [(i, t, int("red" in t), i % 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, cleaned string, label_binary int, k int").repartition(3)


def plain_fit(rows, steps):
    """The same steps over dense rows: (words, y), copies written out."""
    terms = sorted({w for words, _ in rows for w in words})
    uses = np.array([[words.count(t) for t in terms] for words, _ in rows], np.int64)
    rarity = np.floor((np.log((1 + len(rows)) / (1 + (uses > 0).sum(0).astype(float))) + 1) * 4096 + 0.5).astype(np.int64)
    t = uses * rarity
    norms = np.sqrt((t.astype(float) ** 2).sum(1, keepdims=True))
    x = np.floor(t * 16384.0 / np.where(norms > 0, norms, 1) + 0.5).astype(np.int64)
    x = np.hstack([x, np.full((len(rows), 1), 16384)])
    y, penalty = np.array([y for _, y in rows]), np.append(np.ones(len(terms)), 0.0)
    d = 0.25 * (x * x.sum(1, keepdims=True)).sum(0) / 2.0**28 + penalty
    w = z = np.zeros(len(terms) + 1, np.int64)
    for step in range(1, steps + 1):
        r = np.floor((1 / (1 + np.exp(-(x @ z) / 2.0**34)) - y) * 2.0**20 + 0.5).astype(np.int64)
        new = np.floor(z - ((x * r[:, None]).sum(0) / 16384.0 + z * penalty) / d + 0.5).astype(np.int64)
        z = np.floor(new + (step - 1) / (step + 2) * (new - w) + 0.5).astype(np.int64)
        w = new
    return dict(zip(terms, w[:-1].tolist(), strict=True)), int(w[-1])


def test_piles_fit_side_by_side_as_alone(spark, articles, monkeypatch):
    piles = {"all": F.lit(1), "some": (F.col("k") < 2).cast("long"), "copies": F.when(F.col("k") == 0, 2).when(F.col("k") == 1, 1).otherwise(0)}
    monkeypatch.setattr(linear, "BLOCK", 5)
    models = linear.fit_piles(articles, "cleaned", piles, steps=15)
    words = [([w for w in t.split() if len(w) > 1], int("red" in t), i % 4) for i, t in enumerate(TEXTS)]
    written = {
        "all": [r[:2] for r in words],
        "some": [r[:2] for r in words if r[2] < 2],
        "copies": [r[:2] for r in words if r[2] < 2] + [r[:2] for r in words if r[2] == 0],
    }
    for name, rows in written.items():
        weights, bias = plain_fit(rows, 15)
        table = models[name].table()
        assert dict(zip(table["term"], table["weight"], strict=True)) == weights and models[name].bias == bias
    scored = linear.scorer(models["all"])(articles.withColumn("cleaned", F.when(F.col("id") != 1, F.col("cleaned"))), "cleaned").collect()
    assert [r.fake_score for r in scored if r.id == 1] == [None]
    assert all((r.fake_score > 0.5) == bool(r.label_binary) for r in scored if r.id != 1)


def test_words_of_texts_are_counted_without_a_shuffle_of_pairs(spark, articles, capsys):
    twice = articles.unionAll(articles.filter("id = 1"))
    counts = linear.term_counts(twice, "cleaned", {"all": F.lit(1), "copies": F.lit(2)})
    counts.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_COL" in plan and not any("Exchange" in line and "term" in line and "id#" in line for line in plan.splitlines())
    found = {r.term: tuple(r)[1:] for r in counts.collect()}
    # rows that share an id are one text
    assert found["red"] == (14, 9, 28, 18) and found["sleeps"] == (6, 6, 12, 12)


def test_scores_of_sliced_and_missing_words():
    model = linear.LinearModel(("a", "b"), np.array([4096, 8192]), np.array([1 << 20, -(1 << 20)]), 5)
    words = pa.array([["a"], None, ["b", "b", "zz", None], [], ["a", "b"]])
    told = model.scores_of(words.slice(1), pa.array(model.terms))
    assert told.tolist() == model.scores([[], ["b", "b"], [], ["a", "b"]]).tolist() and told[1] < 0.5


def test_converges_to_the_penalised_optimum(spark, articles):
    """At the optimum the gradient of summed loss and penalty is 0."""
    model = linear.fit_piles(articles, "cleaned", {"all": F.lit(1)}, steps=200)["all"]
    w = dict(zip(model.terms, model.weights / 2**20, strict=True))
    rarity = dict(zip(model.terms, model.rarity.astype(float), strict=True))
    slope = {t: w[t] for t in w}
    for text in TEXTS:
        words = [v for v in text.split() if v in w]
        norm = math.sqrt(sum((words.count(v) * rarity[v]) ** 2 for v in set(words))) or 1.0
        x = {v: words.count(v) * rarity[v] / norm for v in set(words)}
        p = 1 / (1 + math.exp(-sum(x[v] * w[v] for v in x) - model.bias / 2**20))
        for v in x:
            slope[v] += (p - ("red" in text)) * x[v]
    assert max(map(abs, slope.values())) < 5e-3


def test_registry_switches_whole_versions(spark, tmp_path):
    folder = str(tmp_path / "models")
    assert registry.read_version(spark, folder) is None
    rows = lambda n: spark.range(n).toDF("term")
    assert registry.publish(spark, folder, {"terms": rows(2)}, {"sorting": 70.0}) == 1

    class Broken(Exception):
        pass

    def fail(*_):
        raise Broken

    # a writer that breaks before its manifest has its name leaves the old version current
    rename = registry._rename
    registry._rename = fail
    try:
        with pytest.raises(Broken):
            registry.publish(spark, folder, {"terms": rows(5)}, {"sorting": 1.0})
    finally:
        registry._rename = rename
    tables, record = registry.read_version(spark, folder)
    assert tables["terms"].count() == 2 and record == {"sorting": 70.0}

    # another writer takes the number that this one was about to take
    def late(spark_, source, target):
        registry._rename = rename
        assert registry.publish(spark, folder, {"terms": rows(3)}, {"sorting": 80.0}) == 2
        return rename(spark_, source, target)

    registry._rename = late
    try:
        assert registry.publish(spark, folder, {"terms": rows(4)}, {"sorting": 80.5}) == 3
    finally:
        registry._rename = rename
    assert [registry.read_version(spark, folder, k)[0]["terms"].count() for k in (1, 2, 3)] == [2, 3, 4]
    assert registry.read_version(spark, folder)[1] == {"sorting": 80.5} and registry.read_version(spark, folder, 9) is None
    from pressgauge.operators.learning import retrain_decision

    told = registry.history(spark, folder, "sorting", retrain_decision).orderBy("version").collect()
    assert [(r.version, r.before, r.decision) for r in told] == [(1, None, None), (2, 70.0, "better"), (3, 80.0, "no real gain")]


def test_words_are_counted_once_for_the_fit_and_both_versions(spark, sf_dir, monkeypatch):
    from pressgauge.plans import catalog

    calls, count = [], linear.term_counts
    monkeypatch.setattr(linear, "term_counts", lambda *given: calls.append(given) or count(*given))
    published = []
    publish = registry.publish
    monkeypatch.setattr(registry, "publish", lambda spark, path, tables, record: published.append(tables["terms"]) or publish(spark, path, tables, record))
    catalog.model_registry(spark, sf_dir).collect()
    assert len(calls) == 1
    rows, pile = calls[0][0], calls[0][2]
    for name, terms in zip(("old", "new"), published, strict=True):
        alone = count(rows, "cleaned", {"pile": pile[name]}).filter("uses_pile > 0")
        assert terms.columns == alone.columns and terms.exceptAll(alone).count() == alone.exceptAll(terms).count() == 0
