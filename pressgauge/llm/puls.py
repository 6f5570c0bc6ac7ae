"""Toxicity by non-negative positive-unlabelled learning.

Only texts confirmed as toxic are taken as labelled; other texts are unlabelled, toxic ones among them. With the share
`prior` of toxic texts, the risk of a classifier is prior * (loss of the confirmed ones as toxic) + (loss of the
unlabelled ones as clean) - prior * (loss of the confirmed ones as clean). The last two terms estimate the loss of the
clean texts, which cannot be negative: once their sum falls below 0, a step of the fit raises it again instead
of lowering the risk, which keeps the classifier from learning the confirmed texts by heart.

The classifier is linear over which words and marked character n-grams a text has, each worth its rarity, with sigmoid
loss (bounded, so no single text can drive the correction) and a quadratic penalty, fitted with numpy on a bounded
sample: the `positives` confirmed texts and `unlabelled` texts of smallest id hash. Features are the `features` ones
whose shares among both differ most beyond chance. The prior is the share of toxic rows among all labelled rows that may
be learned from, unless it is set; if labels are given to toxic texts more often than to others, set it.

A document is confirmed if any of its label rows says toxic = 1; null labels say nothing. Rows without an id or text are
not learned from. Null text is empty; a text without words has the score of no feature. Without a confirmed document all
scores are 0. Repeated rows are answered alike. Columns but doc_id and text (and toxic of labels) are never looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import doc_text, hash_sample, map_arrow, stored, strings

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    positives: int = 2_000  # confirmed documents to learn from, at most
    unlabelled: int = 8_000  # other documents to learn from, at most
    features: int = 4_096
    grams: tuple[int, ...] = (4, 5)
    prior: float | None = None
    steps: int = 300
    rate: float = 0.05
    penalty: float = 1e-4
    reach: float = 20.0  # what the features of an unlabelled text are worth together, on average at most


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: float
    grams: tuple[int, ...]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def marked(word: str, grams: tuple[int, ...]) -> set[str]:
    """A word's features: itself, and the n-grams of it between blanks. No n-gram has a blank on both sides."""
    edged = f" {word} "
    found = {edged[i : i + n] for n in grams for i in range(len(edged) - n + 1)}
    found.add(edged)
    return found


class Reader:
    """The features of single texts; made once in a task. `chosen` None keeps all features, as text."""

    MOST = 300_000  # words whose features a task remembers; it starts anew beyond them

    def __init__(self, grams: tuple[int, ...], chosen: dict[str, int] | None = None):
        self._grams, self._chosen, self._known = grams, chosen, {}

    def _of(self, word: str):
        found, chosen = marked(word, self._grams), self._chosen
        if chosen is not None:
            found = tuple(chosen[x] for x in found if x in chosen)
        if len(self._known) >= self.MOST:
            self._known.clear()
        self._known[word] = found
        return found

    def read(self, text: str) -> set:
        present: set = set()
        known, of = self._known, self._of
        for word in set(_LETTERS.findall(text.lower())):
            found = known.get(word)
            if found is None:
                found = of(word)
            if found:
                present.update(found)
        return present


def _counts(sample: DataFrame, settings: Settings) -> DataFrame:
    """Of each feature, the confirmed and the unlabelled texts that have it."""

    def work(batch: pa.RecordBatch, reader: Reader) -> dict:
        counts: dict[str, list[int]] = {}
        for kind, text in zip(batch["unlabelled"].to_pylist(), strings(batch["text"]), strict=True):
            for feature in reader.read(text):
                counts.setdefault(feature, [0, 0])[kind] += 1
        both = np.array(list(counts.values()), np.int64).reshape(-1, 2)
        return {"feature": pa.array(counts, pa.string()), "p": pa.array(both[:, 0]), "u": pa.array(both[:, 1])}

    found = map_arrow(sample, "feature string, p bigint, u bigint", work, setup=lambda: Reader(settings.grams))
    return found.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _chosen(sample: DataFrame, sizes: list[int], settings: Settings) -> list[str]:
    """The features whose shares differ most, in standard deviations."""
    p, u = (F.lit(float(max(n, 1))) for n in sizes)
    share = (F.col("p") + F.col("u") + 1) / (p + u + 2)
    apart = F.abs(F.col("p") / p - F.col("u") / u) / F.sqrt(share * (1 - share) * (1 / p + 1 / u))
    ranked = _counts(sample, settings).orderBy(F.desc(apart), "feature").limit(settings.features)
    return [row.feature for row in ranked.select("feature").collect()]


def _rows(sample: DataFrame, chosen: dict[str, int], settings: Settings) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(text, feature) places of the confirmed and the unlabelled texts; at most rows x features of the settings."""

    def work(batch: pa.RecordBatch, reader: Reader) -> dict:
        ids = [sorted(reader.read(text)) for text in strings(batch["text"])]
        return {"unlabelled": batch["unlabelled"], "ids": pa.array(ids, pa.list_(pa.int32()))}

    read = map_arrow(sample, "unlabelled int, ids array<int>", work, setup=lambda: Reader(settings.grams, chosen))
    # the order of tasks must not show in the sums of the fit
    lists = sorted((row.unlabelled, row.ids) for row in read.collect())
    out = []
    for kind in (0, 1):
        mine = [ids for k, ids in lists if k == kind]
        lengths = np.array([len(ids) for ids in mine], np.int64)
        flat = np.concatenate([np.array(ids, np.int64) for ids in mine]) if mine else np.zeros(0, np.int64)
        out.append((np.repeat(np.arange(len(mine)), lengths), flat, len(mine)))
    return out


def risk_step(
    on_confirmed: np.ndarray, on_unlabelled: np.ndarray, prior: float
) -> tuple[float, float, np.ndarray, np.ndarray]:
    """From raw scores: the loss on confirmed texts as toxic, the estimated loss on clean ones, and the direction in
    which the scores should fall, for confirmed and unlabelled texts."""
    p, u = _sigmoid(on_confirmed), _sigmoid(on_unlabelled)
    toxic, clean = float((1 - p).mean()), float(u.mean() - prior * p.mean())
    on_p, on_u = p * (1 - p) / len(p), u * (1 - u) / len(u)
    return (toxic, clean, -2 * prior * on_p, on_u) if clean >= 0 else (toxic, clean, prior * on_p, -on_u)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _worth(unlabelled: tuple, size: int, reach: float) -> np.ndarray:
    """How much each feature counts: 0 if every text has it, scaled so that steps suit texts of many features."""
    rows, at, n = unlabelled
    rarity = np.log((n + 1) / (np.bincount(at, minlength=size) + 1))
    together = rarity[at].sum() / max(n, 1) / max(rarity.max(initial=0), 1e-9)
    return rarity / max(rarity.max(initial=0), 1e-9) * min(1.0, reach / max(together, 1e-9))


def fit(confirmed: tuple, unlabelled: tuple, size: int, prior: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias, by shrinking steps with momentum scaled to each weight's gradients (Adam), in a fixed order."""
    worth = _worth(unlabelled, size, settings.reach)
    w, mean, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, settings.steps + 1):
        weights = w[:size] * worth
        scores = [w[size] + np.bincount(rows, weights[at], minlength=n) for rows, at, n in (confirmed, unlabelled)]
        _, _, *falls = risk_step(*scores, prior)
        gradient = np.zeros(size + 1)
        for fall, (rows, at, _) in zip(falls, (confirmed, unlabelled), strict=True):
            gradient[:size] += worth * np.bincount(at, fall[rows], minlength=size)
            gradient[size] += fall.sum()
        gradient[:size] += settings.penalty * w[:size]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        rate = settings.rate * (1 - 0.95 * step / settings.steps)
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:size] * worth, float(w[size])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """From the documents that are not held out, and their labels; None without a confirmed one."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    texts = texts.select("doc_id", "text")
    # confirmed documents that are there: their ids, at most `positives`
    there = texts.select("doc_id").distinct()
    confirmed = hash_sample(known.where("toxic = 1").select("doc_id").join(there, "doc_id", "left_semi"), "doc_id", settings.positives)
    others = hash_sample(there, "doc_id", settings.unlabelled)
    ids = stored(confirmed.withColumn("unlabelled", F.lit(0)).unionByName(others.withColumn("unlabelled", F.lit(1))))
    # a document may be in both samples: the unlabelled one is drawn from all
    sample = stored(texts.join(F.broadcast(ids), "doc_id").select("unlabelled", "text"))
    sizes = {row.unlabelled: row["count"] for row in sample.groupBy("unlabelled").count().collect()}
    if not sizes.get(0):
        return None
    prior = settings.prior if settings.prior is not None else min(share, 0.5)
    chosen = {feature: k for k, feature in enumerate(_chosen(sample, [sizes[0], sizes.get(1, 0)], settings))}
    weights, bias = fit(*_rows(sample, chosen, settings), len(chosen), prior, settings)
    return Model(chosen, weights, bias, settings.grams)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of each row. No shuffle; the model is broadcast, its size is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, reader: Reader | None) -> dict:
        model = shared.value
        if model is None:
            scores = np.zeros(batch.num_rows)
        else:
            raw = [model.bias + float(model.weights[sorted(reader.read(text))].sum()) for text in strings(batch["text"])]
            scores = _sigmoid(np.array(raw, np.float64))
        return {
            "doc_id": batch["doc_id"],
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array((scores >= 0.5).astype(np.int32)),
        }

    def setup() -> Reader | None:
        return Reader(shared.value.grams, shared.value.features) if shared.value else None

    rows = doc_text(docs)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int"
    return map_arrow(rows, schema, work, setup=setup)


def score_held_out(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learns from the documents that are not held out and scores all of them."""
    scored = score(docs, train(docs, labels, settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
