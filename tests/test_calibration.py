import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgauge.operators import calibration as cal
from pressgauge.operators import metrics, ordered, sampling


def frame(spark, scores, truth):
    rows = [(i, float(s), int(t)) for i, (s, t) in enumerate(zip(scores, truth))]
    return spark.createDataFrame(rows, "id long, score double, truth int").repartition(4)


def exam(seed, n=800):
    rng = np.random.default_rng(seed)
    x = rng.beta(0.4, 0.4, n) if seed % 2 else np.round(rng.random(n), 2)
    truth = (x + rng.normal(0, [0.1, 0.3, 0.6][seed % 3], n) > 0.5).astype(int)
    x[: n // 3] = 0.75  # one score held by a third of all rows
    return x, truth


@pytest.mark.parametrize("rows_per_slice", [10**6, 37])
def test_running_totals_and_quantiles(spark, rows_per_slice):
    scores, truth = exam(1)
    df = frame(spark, scores, truth)
    fractions = cal.evenly_spaced(300)
    got = ordered.exact_quantiles(df, "score", fractions, rows_per_slice)
    assert fractions == list(np.linspace(0.001, 0.999, 300))
    assert np.allclose(got, np.quantile(scores, fractions), rtol=0, atol=1e-14)
    summed = ordered.running_totals(df, "id", {"sum_truth": F.col("truth")}, rows_per_slice).orderBy("id").collect()
    assert [r.sum_truth for r in summed] == list(np.cumsum(truth))
    placed = ordered.number_rows(df.filter("id % 3 = 0"), "id", "at", rows_per_slice).orderBy("id").collect()
    assert [r["at"] for r in placed] == list(range(len(placed)))


@pytest.mark.parametrize("rows_per_slice", [10**6, 29])
def test_sorting_score(spark, rows_per_slice):
    scores, truth = exam(2)
    fakes, reals = scores[truth == 1], scores[truth == 0]
    want = ((fakes[:, None] > reals[None, :]) + 0.5 * (fakes[:, None] == reals[None, :])).mean()
    got = metrics.sorting_score(frame(spark, scores, truth), rows_per_slice).first()[0]
    assert abs(got - want) < 1e-12


@pytest.mark.parametrize("seed", range(3))
def test_sweep_and_choice(spark, seed):
    scores, truth = exam(seed)
    df = frame(spark, scores, truth)
    cuts = cal.cutoff_candidates(df, 150)
    rows = cal.sweep(df, cuts).orderBy("position").collect()
    real, fake = truth == 0, truth == 1
    for r, c in zip(rows, cuts):
        said = scores >= c
        assert r.cutoff == c
        assert abs(r.accuracy - (said == fake).mean() * 100) < 1e-9
        assert abs(r.real_recall - (~said[real]).mean()) < 1e-12 and abs(r.fake_recall - said[fake].mean()) < 1e-12
    best = max(rows, key=lambda r: r.accuracy)
    fairest = min(rows, key=lambda r: abs(r.real_recall - r.fake_recall))
    chosen = cal.choose_cutoff(cal.sweep(df, cuts)).first()
    assert (chosen.best, chosen.fairest) == (best.cutoff, fairest.cutoff)
    shown = {r.position for r in cal.tradeoff_table(cal.sweep(df, cuts)).collect()}
    spots = set(np.linspace(0, len(cuts) - 1, 12).round().astype(int) + 1)
    assert shown == spots | {best.position, fairest.position}


@pytest.mark.parametrize("seed", range(9))
def test_flag_band_equals_walk(spark, seed):
    scores, truth = exam(seed, 400)
    df = frame(spark, scores, truth)
    cuts = cal.cutoff_candidates(df, 60)
    want = None
    for t in reversed(cuts):
        flagged = scores > t
        if flagged.sum() < cal.MIN_FLAGGED:
            continue
        if truth[flagged].mean() >= cal.FLAG_PRECISION_FLOOR:
            want = t
        elif want is not None:
            break
    assert cal.find_flag_band(df, cuts).first().score_above == want


@pytest.mark.parametrize("seed", range(3))
def test_unsure_band_equals_loop(spark, seed):
    scores, truth = exam(seed)
    scores = np.where(scores == 0.75, 0.97, scores)
    correct = (scores >= 0.5).astype(int) == truth
    best = None
    for low, high in cal.UNSURE_CANDIDATES:
        inside = (scores > low) & (scores < high)
        if inside.sum() < cal.MIN_FLAGGED or inside.mean() > cal.UNSURE_MAX_COVERAGE:
            continue
        within, outside = correct[inside].mean() * 100, correct[~inside].mean() * 100
        if within >= cal.UNSURE_ACCURACY_FLOOR or outside <= within:
            continue
        if best is None or inside.mean() > best[2]:
            best = (low, high, inside.mean())
    got = cal.find_unsure_band(frame(spark, scores, truth), 0.5).first()
    assert (got and (got.low, got.high)) == (best and best[:2])


def test_record_never_rounds_cutoffs(spark):
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 600)
    scores = 1 - 10.0 ** -(3 + 3 * truth + rng.random(600) * 3)
    halves = sampling.stratified_split(frame(spark, scores, truth), "truth", "id", 0.5, out="a")
    told = cal.calibrate(halves.filter("a"), halves.filter("not a"))
    assert 0.999 < told["cutoff"] < 1 and told["verdict"]["score_above"] == told["cutoff"]
    assert told["accuracy"] > 85 and told["cutoff_chosen_on"] + told["measured_on"] == 600


def test_report_and_samples(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(2), rng.randrange(2)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "truth int, prediction int")
    got = {r.name: r for r in metrics.classification_report(df).collect()}
    cell = Counter(pairs)
    assert abs(got["FAKE"].precision - cell[1, 1] / (cell[1, 1] + cell[0, 1])) < 1e-12
    assert abs(got["REAL"].recall - cell[0, 0] / (cell[0, 0] + cell[0, 1])) < 1e-12
    assert abs(got["accuracy"].f1 - (cell[0, 0] + cell[1, 1]) / 200) < 1e-12
    assert got["weighted avg"].support == 200

    rows = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(1000)], "id long, g string")
    split = sampling.stratified_split(rows, "g", "id", 0.3)
    assert {r.g: r.n for r in split.filter("held").groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 240, "b": 60}
    sample = sampling.balanced_sample(rows, "g", "id", 500)
    assert {r.g: r.n for r in sample.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 250, "b": 200}
    spread = sampling.spread_sample(rows, "id", 10, 3, rows_per_slice=90)
    assert sorted(r.id for r in spread.collect()) == [p * 100 + k for p in range(10) for k in range(3)]


@pytest.mark.parametrize("rows_per_slice", [10**6, 100, 7])
def test_missing_scores_give_one_answer(spark, rows_per_slice):
    rows = [(None if i % 10 == 0 else float("nan") if i % 10 == 1 else (i * 37 % 101) / 101, i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "score double, truth int")
    real = [(s, t) for s, t in rows if s is not None and s == s]
    pairs = [(a > b) + (a == b) / 2 for a, t in real if t for b, u in real if not u]
    assert abs(metrics.sorting_score(df, rows_per_slice).first()[0] - sum(pairs) / len(pairs)) < 1e-9
    values = sorted({s for s, _ in real})
    frame = spark.createDataFrame([(v,) for v in [None, float("nan"), *values]], "v double")
    placed = {repr(r.v): r.at for r in ordered.number_rows(frame, "v", "at", rows_per_slice).collect()}
    assert [placed[repr(v)] for v in [None, *values, float("nan")]] == list(range(len(values) + 2))
