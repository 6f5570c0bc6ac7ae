"""Lookups in the corpus and the verdict cascade."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import wording
from pressgauge.functions.chars import let
from pressgauge.functions.fingerprints import clean_article_text
from pressgauge.functions.intake import MIN_WORDS, check_long_enough, word_count
from pressgauge.functions.matching import full_text, has_key, keep_keyed, normalize_headline, opening_of
from pressgauge.operators.corpus import basis_rank, corpus_label, describe_basis
from pressgauge.operators.web import attach_web_checks

EVIDENCE = ("id", "label", "source", "label_basis", "headline", "article_text")

# A scorer adds the double column `fake_score` given a text column; rows with null
# text need no score and get null.
Scorer = Callable[[DataFrame, str], DataFrame]


class CutoffRecord(NamedTuple):
    """What was measured for the reading model; all a verdict may quote."""

    score_above: float
    fake_precision: float
    real_precision: float
    measured_on: int


def pick_best(corpus: DataFrame, key: str) -> DataFrame:
    """(key, match): per key the row with the best evidence, then the oldest id.
    A partial aggregate, so a key with very many copies is reduced before moving."""
    best = F.min_by(F.struct(*EVIDENCE), F.struct(basis_rank(F.col("label_basis")), F.col("id")))
    return keep_keyed(corpus, key).groupBy(F.col(key).alias("key")).agg(best.alias("match"))


KINDS = ("headline_key", "body_key")


def match_rank(match: Column) -> Column:
    """What orders matches of one key: the better evidence, then the older id, comes first."""
    return F.struct(basis_rank(match["label_basis"]), match["id"])


def corpus_index(corpus: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, key, match) of every key of the corpus."""
    parts = [pick_best(corpus, kind).select(F.lit(kind).alias("kind"), "key", "match") for kind in kinds]
    return reduce(DataFrame.unionByName, parts)


def best_match(requests: DataFrame, corpus: DataFrame, headline: str = "headline") -> DataFrame:
    """Inner lookup by headline: the matched requests with their evidence."""
    keyed = keep_keyed(requests.withColumn("key", normalize_headline(F.col(headline))), "key")
    return keyed.join(pick_best(corpus, "headline_key"), "key").drop("key")


def keyed_requests(requests: DataFrame) -> DataFrame:
    """Add the three keys to try: headline, body opening, opening of the whole paste.

    The whole paste is the headline, a newline and the body; normalising it equals
    joining the normalised parts, so no text is normalised twice.
    """
    head, body = normalize_headline(F.col("headline")), normalize_headline(F.col("body"))
    return (
        requests.withColumns({"__head": head, "__body": body})
        .withColumns(
            {
                "headline_key": F.col("__head"),
                "body_key": opening_of(F.col("__body")),
                "paste_key": opening_of(F.trim(F.concat_ws(" ", "__head", "__body"))),
            }
        )
        .drop("__head", "__body")
    )


def _match_candidates(keyed: DataFrame, index: DataFrame, doors: list[tuple[str, str]]) -> DataFrame:
    """(id, match, door): first door whose key is in the index of the corpus.

    Only ids and non-blank keys travel to the corpus, never the text, and blank
    keys, which would all land in one task, are gone before the join.
    """
    tries = F.array(
        *[
            F.when(has_key(F.col(key)), F.struct(F.lit(n).alias("door"), F.lit(kind).alias("kind"), F.col(key).alias("key")))
            for n, (key, kind) in enumerate(doors)
        ]
    )
    tried = keyed.select("id", F.explode(F.array_compact(tries)).alias("try")).select("id", "try.*")
    found = tried.join(index, ["kind", "key"])
    return found.groupBy("id").agg(F.min_by(F.struct("match", "door"), "door").alias("found")).select("id", "found.*")


HEADLINE_DOOR = [("headline_key", "headline_key")]
BODY_DOORS = [("body_key", "body_key"), ("paste_key", "body_key")]


def best_match_by_body(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, match, door) by the opening of the body, then of the whole paste."""
    return _match_candidates(keyed_requests(requests), corpus_index(corpus, ("body_key",)), BODY_DOORS)


def lookup(requests: DataFrame, corpus: DataFrame | None, index: DataFrame | None = None) -> DataFrame:
    """Requests (id, headline, body, ...) with `match` and `matched_on`, null when
    unknown: headline first, then the two openings; every comparison is exact.
    `index` (kind, key, match) stands for the corpus if given."""
    doors = HEADLINE_DOOR + BODY_DOORS
    found = _match_candidates(keyed_requests(requests.select("id", "headline", "body")), corpus_index(corpus) if index is None else index, doors)
    matched_on = F.when(F.col("door") == 0, "headline").when(F.col("door") > 0, "body")
    return requests.join(found, "id", "left").withColumn("matched_on", matched_on).drop("door")


def says_fake(score: Column, cutoff: float, strict: bool = True) -> Column:
    """Verdicts use `>`; sweeps use `>=`."""
    return score > cutoff if strict else score >= cutoff


def _percent(value: float) -> Column:
    return F.lit(str(float(value)))


def analyze(
    requests: DataFrame,
    corpus: DataFrame | None,
    scorer: Scorer | None = None,
    record: CutoffRecord | None = None,
    model_record: dict | None = None,
    cleaned: bool = True,
    replies: DataFrame | None = None,
    band: tuple[float, float] | None = None,
    index: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """The cascade, one output row per request (id, headline, body, ...).

    Exact lookup; then too short; then the scorer: with a measured record the
    verdict quotes measured precision, without one the model's own probability;
    then nothing available. Adds score, label, confidence, method, explanation,
    matched_on, match and fake_score. With `replies` (id, web_check) a last step adds
    what the web says where the score is in `band` or `search_web` asks for it. An `index`
    (rows and the number of corpus rows behind them, see sources/index.py) stands for the corpus.
    """
    looked = lookup(requests, corpus, index[0] if index else None)
    text = full_text(F.col("headline"), F.col("body"))
    joined = F.concat_ws(" ", "headline", "body")
    known = F.col("match").isNotNull()
    short = word_count(joined) < MIN_WORDS
    looked = looked.withColumn("__step", F.when(known, 1).when(short, 2).otherwise(3))

    if scorer is None:
        scored = looked.withColumn("fake_score", F.lit(None).cast("double"))
    else:
        clean = clean_article_text(text)
        tidy = let(clean, lambda c: F.when(c != "", c).otherwise(text)) if cleaned else text
        # Null for every row an earlier step answered: the model never sees those.
        scored = scorer(looked.withColumn("__input", F.when(F.col("__step") == 3, tidy)), "__input").drop("__input")

    p = F.col("fake_score")
    if record is not None:
        fake = says_fake(p, record.score_above)
        reliability = F.when(fake, record.fake_precision).otherwise(record.real_precision)
        method, score, confidence = "reading_model", F.rint(p * 100).cast("int"), reliability
        quoted = F.when(fake, _percent(record.fake_precision)).otherwise(_percent(record.real_precision))
        told = F.format_string(wording.READING_MODEL, quoted, F.lit(record.measured_on).cast("long"))
    else:
        fake = p > 0.5
        confidence = F.round(F.greatest(p, 1 - p) * 100, 2)
        method = "ml_prediction"
        score = F.when(fake, confidence).otherwise(100 - confidence).cast("int")
        word = F.when(fake, "Fake").otherwise("Real")
        told = F.format_string(
            wording.WORD_COUNTER, confidence.cast("string"), word, F.lit(performance_sentence(model_record))
        )

    total = F.lit(index[1]).cast("long") if index else corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    match = F.col("match")
    note = F.when(F.col("matched_on") == "body", wording.DATABASE_BODY_NOTE).otherwise("")
    from_corpus = F.format_string(
        wording.DATABASE, total, describe_basis(match["label"], match["source"], match["label_basis"]), note
    )

    def by_step(hit: Column, brief: Column, judged: Column, nothing: Column) -> Column:
        step = F.when(F.col("__step") == 1, hit).when(F.col("__step") == 2, brief)
        return step.when(p.isNotNull(), judged).otherwise(nothing)

    answered = scored.withColumns(
        {
            "score": by_step(F.when(match["label"] == "FAKE", 100).otherwise(0), F.lit(50), score, F.lit(0)),
            "label": by_step(
                corpus_label(match["label"]),
                F.lit("Not Sure"),
                F.when(fake, "Likely Fake").otherwise("Likely Real"),
                F.lit("Unknown"),
            ),
            "confidence": by_step(F.lit(100.0), F.lit(None).cast("double"), confidence, F.lit(0.0)),
            "method": by_step(F.lit("database"), F.lit("too_short"), F.lit(method), F.lit("unavailable")),
            "explanation": by_step(
                from_corpus, check_long_enough(joined)["message"], told, F.lit(wording.UNAVAILABLE)
            ),
        }
    ).drop("__step")
    if replies is None:
        return answered
    return attach_web_checks(answered, replies, *(band or (None, None)))


def performance_sentence(model_record: dict | None) -> str:
    """What the word counter's record says about it; '' when nothing was measured."""
    if not model_record:
        return ""
    shared = model_record.get("evaluation") == "cross_source"
    return (wording.CROSS_SOURCE_RECORD if shared else wording.SHUFFLED_RECORD).format(**model_record)
