"""Language identification: words first, then shorter and shorter character n-grams.

Training counts words and character n-grams for each language in a bounded sample of the training
documents. A word that the model knows scores its log relative frequency in each language, smoothed.
An unseen word is cut into the longest n-grams first: from each place, the longest known n-gram
scores and is passed over; only a character no n-gram knows is skipped. A text's score for a
language is the mean over its words (each word's n-gram scores are averaged first), and the
language of the largest score wins; ties go to the language that sorts first.

Text that is null or has no letter is `und` with score 0. Rows of a null language are not learned
from, and null text holds no words to learn. With nothing to learn from, every text is `und`.
Repeated rows count as often as they occur in the sample and are answered alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import cut_lineage, doc_text, map_arrow, share_for, strings, unit_hash

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 400  # training documents of each language, those of the smallest hash
    languages: int = 200  # learned, the most frequent in the training rows
    vocabulary: int = 20_000  # words kept for each language, the most frequent; others take n-grams
    longest: int = 5  # character n-gram
    grams: int = 20_000  # n-grams kept for each language and length


@dataclass(frozen=True)
class Model:
    """Languages in order, and the log score of every word and n-gram in each of them."""

    languages: tuple[str, ...]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    longest: int


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(train: DataFrame, settings: Settings) -> DataFrame:
    """lang and text of the sampled rows. Ids are ranked, and at most sample_rows for each language broadcast."""
    known = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select("doc_id", "lang", "text")
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.languages)
    order = Window.partitionBy("lang").orderBy(unit_hash("doc_id"), "doc_id")
    # at most `languages` rows; little more than sample_rows of each language are then ranked
    ids = known.select("doc_id", "lang").join(F.broadcast(common), "lang")
    ids = ids.where(unit_hash("doc_id") < share_for(settings.sample_rows, F.col("count"))).select("doc_id", "lang").distinct()
    ids = ids.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= settings.sample_rows)
    return known.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi").select("lang", "text")


def _pieces(rows: DataFrame, longest: int) -> DataFrame:
    """lang, size (0: word) and what, with counts inside each slice of rows."""

    def work(batch: pa.RecordBatch) -> dict:
        counts: dict[tuple[str, int, str], int] = {}
        for lang, text in zip(batch["lang"].to_pylist(), strings(batch["text"]), strict=True):
            for word in words_of(text):
                key = (lang, 0, word)
                counts[key] = counts.get(key, 0) + 1
        for (lang, _, word), times in list(counts.items()):
            marked = f" {word} "
            for n in range(1, longest + 1):
                for i in range(len(marked) - n + 1):
                    key = (lang, n, marked[i : i + n])
                    counts[key] = counts.get(key, 0) + times
        langs, sizes, whats = zip(*counts, strict=True) if counts else ((), (), ())
        return {
            "lang": pa.array(langs, pa.string()),
            "size": pa.array(sizes, pa.int32()),
            "what": pa.array(whats, pa.string()),
            "times": pa.array(counts.values(), pa.int64()),
        }

    return map_arrow(rows, "lang string, size int, what string, times bigint", work)


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from a bounded sample; what reaches the driver is bounded by the settings."""
    counts = _pieces(_sample(docs, settings), settings.longest)
    counts = cut_lineage(counts.groupBy("lang", "size", "what").agg(F.sum("times").alias("times")))
    totals = {(r.lang, r.size): r.total for r in counts.groupBy("lang", "size").agg(F.sum("times").alias("total")).collect()}
    order = Window.partitionBy("lang", "size").orderBy(F.desc("times"), "what")
    kept = counts.withColumn("__n", F.row_number().over(order)).where(
        F.col("__n") <= F.when(F.col("size") == 0, settings.vocabulary).otherwise(settings.grams)
    )
    languages = tuple(sorted({lang for lang, _ in totals}))
    place = {lang: i for i, lang in enumerate(languages)}
    tables: tuple[dict[str, np.ndarray], dict[str, np.ndarray]] = ({}, {})
    for row in kept.select("lang", "size", "what", "times").collect():
        scores = tables[row["size"] > 0].setdefault(row.what, np.zeros(len(languages), np.float64))
        scores[place[row.lang]] = row.times
    for found, sizes in zip(tables, (lambda _: 0, len), strict=True):
        for what, times in found.items():
            total = np.array([totals.get((lang, sizes(what)), 0) for lang in languages], float)
            # half a count stands for what a language has not shown
            found[what] = np.log((times + 0.5) / (total + 1.0))
    return Model(languages, *tables, settings.longest)


class Scorer:
    """Answers for single texts; made once in a task."""

    MOST = 300_000  # words whose scores a task keeps; it starts anew beyond them

    def __init__(self, model: Model):
        self._model = model
        self._grams = {gram: k for k, gram in enumerate(model.grams)}
        rows = [scores / len(gram) for gram, scores in model.grams.items()]
        self._gram_rows = np.array(rows).reshape(len(rows), len(model.languages))
        self._forget()

    def _forget(self) -> None:
        """Row 0 stands for words without any score."""
        self._place: dict[str, int] = {word: k for k, word in enumerate(self._model.words, 1)}
        known = np.array(list(self._model.words.values())).reshape(len(self._model.words), len(self._model.languages))
        self._rows = np.zeros((len(known) + 1024, len(self._model.languages)))
        self._rows[1 : len(known) + 1] = known
        self._used = len(known) + 1

    def _learn(self, word: str) -> int:
        """The place of a word seen for the first time, by its longest known n-grams."""
        marked, at, found, grams = f" {word} ", 0, [], self._grams
        end, longest = len(marked), self._model.longest
        while at < end:
            for stop in range(min(at + longest, end), at, -1):
                k = grams.get(marked[at:stop])
                if k is not None:
                    found.append(k)
                    at = stop - 1
                    break
            at += 1
        if not found:
            self._place[word] = 0
            return 0
        if self._used == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        self._rows[self._used] = self._gram_rows[found].sum(axis=0) / len(found)
        self._place[word] = self._used
        self._used += 1
        return self._place[word]

    def predict(self, text: str) -> tuple[str, float]:
        """The language, and its share when the mean scores are taken as log odds."""
        words = words_of(text)
        if not words or not self._model.languages:
            return UNKNOWN, 0.0
        if len(self._place) > len(self._model.words) + self.MOST:
            self._forget()
        place, learn = self._place, self._learn
        at = [place[word] if word in place else learn(word) for word in words]
        mean = self._rows[at].sum(axis=0) / max(len(at) - at.count(0), 1)
        best = int(np.argmax(mean))
        return self._model.languages[best], float(1 / np.exp(mean - mean[best]).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row; nothing but the text is looked at. No shuffle.

    The model is broadcast; Settings bounds its size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, scorer: Scorer) -> dict:
        answers = [scorer.predict(t) for t in strings(batch["text"])]
        return {
            "doc_id": batch["doc_id"],
            "lang_pred": pa.array([a for a, _ in answers], pa.string()),
            "score": pa.array([s for _, s in answers], pa.float64()),
        }

    rows = doc_text(docs)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return map_arrow(rows, schema, work, setup=lambda: Scorer(shared.value))


def identify_held_out(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learns from the documents that are not held out and answers for all of them."""
    model = train(docs.where(~held_out(F.col("doc_id"))), settings)
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
