import pytest
from pyspark.sql import functions as F

from pressgauge.operators import learning, metrics
from pressgauge.operators.verdict import performance_sentence


@pytest.fixture(scope="module")
def articles(spark):
    """Fakes and reals with telling words, in two collections."""
    words = {1: "shocking hoax exposed truth", 0: "minister said committee report"}
    rows = []
    for i in range(160):
        y = i % 2
        filler = " ".join(f"w{(i * k) % 17}" for k in range(3, 9))
        rows.append((i, "one" if i < 80 else "two", f"Title {i}", f"{words[y]} {filler}", "FAKE" if y else "REAL", f"s{i % 4}"))
    frame = spark.createDataFrame(rows, "id long, collection string, title string, text string, label string, source string")
    return learning.prepare(frame).cache()


def test_train_score_terms(spark, articles, tmp_path):
    model = learning.train(articles.filter("collection = 'one'"), "cleaned")
    scored = learning.model_scorer(model)(articles.filter("collection = 'two'"), "cleaned")
    truth = scored.select(F.col("label_binary").alias("truth"), F.col("fake_score").alias("score"))
    assert metrics.sorting_score(truth).first()[0] > 0.99
    terms = {r.term: r.leans for r in learning.top_terms(spark, model, 4).collect()}
    assert terms["hoax"] == "FAKE" and terms["minister"] == "REAL"
    # Kept with the model's own format, read back, same scores.
    model.write().overwrite().save(str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model"))
    null = articles.limit(1).withColumn("cleaned", F.lit(None).cast("string"))
    assert learning.model_scorer(again)(null, "cleaned").first().fake_score is None


def test_experiment_record_and_ablations(spark, articles):
    results = learning.run_experiment(articles, "one", "two")
    assert results.count() == 6
    changes = {r.split: r.change for r in learning.accuracy_changes(results).collect()}
    assert set(changes) == {"shuffled", "one -> two", "two -> one"}
    model, record = learning.fit_and_record(articles, results, "one", "two")
    assert record["training_samples"] == 80 and record["total_samples"] == 160
    assert "a separate collection" in performance_sentence(record)

    base = articles.filter("collection = 'one' and source in ('s0', 's1')")
    exam = articles.filter("collection = 'two'")
    more = articles.filter("collection = 'one' and source in ('s2', 's3')")
    runs = learning.ablate_fakes(base, more.filter("label_binary = 1"), exam)
    assert [r.n_train for r in runs.orderBy("run").collect()] == [40, 60, 60]
    assert learning.worth(runs).first().decision in ("nothing measurable", "small gain", "real gain")
    runs = learning.ablate_reals(base, more.filter("label_binary = 0"), exam, F.col("source") == "s0")
    assert [r.n_train for r in runs.orderBy("run").collect()] == [40, 60, 60, 21]
    assert learning.worth(runs).first().worth is not None


def test_retrain_decision(spark):
    rows = spark.createDataFrame([(74.0, 73.0), (74.0, 74.5), (74.0, 84.0)], "o double, n double")
    got = [r[0] for r in rows.select(learning.retrain_decision(F.col("o"), F.col("n"))).collect()]
    assert got == ["worse", "no real gain", "better"]


def test_exam_headlines_are_never_taught(spark):
    rows = [(i, "one" if i < 40 else "two", f"T {i % 50}", f"body text {i}", "FAKE" if i % 2 else "REAL") for i in range(80)]
    frame = learning.prepare(spark.createDataFrame(rows, "id long, collection string, title string, text string, label string"))
    for name, teach, exam in learning.experiment_splits(frame, "one", "two")[1:]:
        taught = {r.title.lower() for r in teach.collect()}
        assert taught and exam.count() and not taught & {r.title.lower() for r in exam.collect()}, name


def test_scores_agree_with_a_tighter_fit(spark, articles, monkeypatch):
    def scores():
        model = learning.train(articles.filter("collection = 'one'"), "cleaned")
        scored = learning.model_scorer(model)(articles.filter("collection = 'two'"), "cleaned")
        return {r.id: r.fake_score for r in scored.select("id", "fake_score").collect()}

    usual = scores()
    monkeypatch.setattr(learning, "TOLERANCE", 1e-9)
    assert all(abs(usual[k] - v) < 1e-3 for k, v in scores().items())
