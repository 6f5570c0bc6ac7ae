from pyspark.sql import functions as F

from pressgauge.operators import corpus, report, verdict, web
from pressgauge.operators.learning import batch_scorer
from pressgauge.streaming.intake import analyze_stream, read_requests

LONG = "The cat of the house was in the garden and it is on the wall with all of the birds of the old town. "


def make_corpus(spark):
    rows = [
        (1, "Same Headline", LONG, "REAL", "Pub", "source"),
        (2, "Same headline!", "", "FAKE", "Checker", "fact_check"),
        (3, "Other", "x " + LONG, "FAKE", "Blog", "source"),
        (4, "Tie", "", "REAL", "A", "source"),
        (5, "tie", "", "FAKE", "B", "source"),
        (6, "!!!", "", "FAKE", "B", "source"),
    ]
    frame = spark.createDataFrame(rows, "id long, headline string, body string, label string, source string, basis string")
    return corpus.corpus_rows(frame, "id")


def test_cascade(spark):
    requests = spark.createDataFrame(
        [
            (1, "same  HEADLINE", ""),
            (2, "tie.", "whatever"),
            (3, "Changed headline", "x " + LONG + " and more"),
            (4, "x The cat of the house was in", "the garden and it is on the wall with all of the birds of the old town."),
            (5, "???", ""),
            (6, "Unknown short", "text"),
            (7, "Nobody knows", "Reuters " * 30),
            (8, "Nobody knows this", "y " + LONG * 3),
        ],
        "id long, headline string, body string",
    )

    def scorer(df, text):
        return df.withColumn("fake_score", F.when(F.col(text).isNotNull(), F.when(F.length(text) < 60, 0.4).otherwise(0.405)))

    record = verdict.CutoffRecord(0.4, 86.9, 90.0, 3160)
    got = {r.id: r for r in verdict.analyze(requests, make_corpus(spark), scorer, record).collect()}
    assert [(got[i].score, got[i].label, got[i].method, got[i].matched_on) for i in range(1, 9)] == [
        (100, "Likely Fake", "database", "headline"),
        (0, "Likely Real", "database", "headline"),
        (100, "Likely Fake", "database", "body"),
        (100, "Likely Fake", "database", "body"),
        (50, "Not Sure", "too_short", None),
        (50, "Not Sure", "too_short", None),
        (40, "Likely Real", "reading_model", None),
        (40, "Likely Fake", "reading_model", None),
    ]
    assert got[1].explanation == (
        "Found in our dataset of 6 articles, fact-checked FAKE by Checker. The 100% is how certain the match is."
    )
    assert "the headline you pasted is not the one" in got[3].explanation
    assert got[6].confidence is None and got[7].confidence == 90.0 and got[8].confidence == 86.9
    assert "right 90.0% of the time, measured on 3,160 articles" in got[7].explanation

    own = {r.id: r for r in verdict.analyze(requests, make_corpus(spark), scorer).collect()}
    assert (own[8].score, own[8].confidence, own[8].method) == (40, 59.5, "ml_prediction")
    none = {r.id: r for r in verdict.analyze(requests, make_corpus(spark)).collect()}
    assert (none[8].score, none[8].label, none[8].confidence, none[8].method) == (0, "Unknown", 0.0, "unavailable")


def test_python_scorer_sees_only_what_is_left(spark):
    def load():
        def predict(texts):
            assert 0 < len(texts) <= 2 and all(t is not None for t in texts)
            return [len(t) / 1000 for t in texts]

        return predict

    df = spark.createDataFrame([(i, None if i % 2 else "x" * i) for i in range(10)], "id long, t string").coalesce(1)
    got = {r.id: r.fake_score for r in batch_scorer(load, batch=2)(df, "t").collect()}
    assert got == {i: None if i % 2 else i / 1000 for i in range(10)}


def test_reports(spark):
    rows = [(1, "Likely Fake", "database"), (2, "Likely Real", "reading_model"), (3, "Unknown", "unavailable")]
    history = spark.createDataFrame(rows, "id long, result_label string, method string").withColumn(
        "analyzed_at", F.timestamp_seconds("id")
    )
    told = report.dashboard(history).first()
    assert (told.total, told.real_count, told.fake_count, told.unsure_count, told.fake_pct) == (3, 1, 1, 0, 33.3)
    empty = report.dashboard(history.limit(0)).first()
    assert (empty.total, empty.real_pct) == (0, 0.0)
    assert [(r.label, r.articles) for r in report.chart_series(history).orderBy("chart", "position").collect()] == [
        ("Database Match", 1), ("Reading Model", 1), ("Word-Counter", 0), ("Likely Real", 1), ("Likely Fake", 1), ("Not Sure", 0),
    ]
    assert [(r.row_number, r.id) for r in report.recent(history, 2).orderBy("row_number").collect()] == [(2, 2), (3, 3)]
    assert report.delete_analyses(history, history.filter("id = 2")).count() == 2
    assert report.clear_history(history, "DELETE").count() == 0 and report.clear_history(history, "yes").count() == 3


def test_band_edges_and_queue(spark):
    scores = [0.02, 0.4, 0.97, 0.01, 0.99, 0.0, 1.0, None]
    rows = [(i, s, "reading_model", i == 4, 1_000_000 + i) for i, s in enumerate(scores)] + [(99, 0.5, "database", True, 5)]
    df = spark.createDataFrame(rows, "id long, fake_score double, method string, requested boolean, t long")
    df = df.withColumn("analyzed_at", F.timestamp_seconds("t"))
    queue = web.web_check_queue(df, 0.01, 0.99)
    assert {r.id: r.reason for r in queue.collect()} == {0: "unsure", 1: "unsure", 2: "unsure", 4: "requested"}
    assert {r.id for r in web.web_check_queue(df, None, None).collect()} == {4}
    queue = {r.id: (r.turn, r.within_allowance) for r in web.web_check_queue(df, 0.01, 0.99, per_day=2).collect()}
    assert {k for k, (_, within) in queue.items() if within} == {0, 1}
    assert sorted(t for t, _ in queue.values()) == list(range(1, len(queue) + 1))


def test_web_replies(spark):
    def wrap(text):
        import json

        return json.dumps(
            {"candidates": [{"content": {"parts": [{"text": text[:5]}, {"x": 1}, {"text": text[5:]}]},
                             "groundingMetadata": {"groundingChunks": [{"web": {"uri": "u1", "title": ""}}, {"web": {}}, {}],
                                                   "webSearchQueries": "one query"}}]}
        )

    replies = [
        wrap('{"verdict": "real", "confidence": "HIGH", "reporting": ["BBC", null, " N/A ", 7], "summary": null}'),
        wrap('```json\n{"verdict": "FAKE", "debunking": "Snopes", "factcheck_rating": "None"}\n```'),
        wrap('{"verdict": "UNCLEAR", "reporting": [], "debunking": [], "factcheck_rating": null}'),
        wrap("sorry, no idea"),
        wrap("[1, 2]"),
        '{"error": 1}',
        "not json",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = [r.web_check for r in web.normalize_web_replies(df).orderBy("i").collect()]
    assert [(w.status, w.verdict) for w in got] == [
        ("found", "REAL"), ("found", "FAKE"), ("nothing", "UNCLEAR"), ("found", "UNCLEAR"), ("found", "UNCLEAR"),
        ("unavailable", None), ("unavailable", None), ("unavailable", None),
    ]
    assert got[0].reporting == ["BBC", "7"] and got[0].confidence == "high" and got[0].summary == ""
    assert got[1].debunking == ["Snopes"] and got[1].factcheck_rating is None
    assert got[3].summary == "sorry, no idea" and got[3].error == web.NO_JSON
    assert [(s.title, s.url) for s in got[3].sources] == [("u1", "u1")] and got[3].queries == ["one query"]
    assert got[5].error == web.NO_CONTENT and got[5].sources == []


def test_stream_appends_verdicts(spark, tmp_path):
    make_corpus(spark).write.parquet(str(tmp_path / "corpus"))
    requests = tmp_path / "requests"
    requests.mkdir()
    (requests / "a.json").write_text(
        '{"id": 1, "text": "Same headline\\nbody", "submitted_at": "2024-01-01T00:00:00Z"}\n'
        '{"id": 2, "text": "El gato", "submitted_at": "2024-01-01T00:00:00Z"}\n'
        '{"id": 3, "text": "   ", "submitted_at": "2024-01-01T00:00:00Z"}\n'
    )
    stream = analyze_stream(
        read_requests(spark, str(requests)), str(tmp_path / "corpus"), str(tmp_path / "history"), str(tmp_path / "ckpt")
    )
    stream.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "history")).orderBy("id").collect()
    assert [(r.id, r.method) for r in got] == [(1, "database"), (2, "too_short")]
