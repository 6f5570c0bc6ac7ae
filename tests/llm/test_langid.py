import zlib

import pytest
from pyspark.sql import functions as F

from pressgauge.llm import langid

SAMPLES = {
    "en": "the house and the river were quiet while they walked through with their dog",
    "de": "der hund und die katze gehen nicht durch das haus weil sie schlafen wollen",
    "fr": "le chien et la maison sont dans les bois avec une grande rivière tranquille",
}


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(k, " ".join(text.split()[(k * 3 + j) % 13] for j in range(8)), lang) for k in range(60) for lang, text in SAMPLES.items()]
    return spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")


def test_accuracy_on_held_out_rows(taught):
    rows = langid.identify_held_out(taught).join(taught, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_unseen_words_back_off_to_their_pieces(taught):
    model = langid.train(taught)
    scorer = langid.Scorer(model)
    assert scorer.predict("rivièretranquillemaison")[0] == "fr"
    assert scorer.predict("schlafenhauskatze")[0] == "de"
    assert scorer.predict("12 !? \n") == ("und", 0.0)
    # an unseen word is cut greedily, the longest known piece first
    word = "rivers"
    at, pieces = 0, []
    marked = f" {word} "
    while at < len(marked):
        n = next((n for n in range(5, 0, -1) if at + n <= len(marked) and marked[at : at + n] in model.grams), 0)
        if n:
            pieces.append(model.grams[marked[at : at + n]] / n)
        at += max(n, 1)
    row = scorer._rows[scorer._learn(word)]
    assert abs(row - sum(pieces) / len(pieces)).max() < 1e-12


def test_answers_do_not_depend_on_what_came_before(taught, monkeypatch):
    model = langid.train(taught)
    monkeypatch.setattr(langid.Scorer, "MOST", 2)
    texts = [r.text + " neuesword" for r in taught.limit(40).collect()]
    scorer = langid.Scorer(model)
    assert [scorer.predict(t) for t in texts] == [langid.Scorer(model).predict(t) for t in texts]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = langid.identify_held_out(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    nothing = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify_held_out(nothing).collect()} == {("und", 0.0)}
    assert langid.identify_held_out(no_docs).collect() == []
