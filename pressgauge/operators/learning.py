"""TF-IDF text models, the cross-source experiment and the ablations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions.chars import WORD
from pressgauge.functions.fingerprints import clean_article_text
from pressgauge.functions.matching import full_text, normalize_headline
from pressgauge.operators.calibration import (
    FINE_LADDER,
    SWEEP_CANDIDATES,
    choose_cutoff,
    evenly_spaced,
    measure,
    sweep,
)
from pressgauge.operators.corpus import label_binary
from pressgauge.operators.metrics import sorting_score
from pressgauge.operators.ordered import exact_quantiles
from pressgauge.operators.sampling import SPLIT_SEED, first_per_group, stratified_split
from pressgauge.operators.selection import drop_leaks
from pressgauge.operators.verdict import Scorer
from pressgauge.session import cut_lineage

MAX_FEATURES, MAX_ITERATIONS = 50_000, 1000  # fixed values
TOLERANCE = 1e-6  # relative change of the loss at which a fit stops
PARALLEL_RUNS = 4
ROWS_PER_TASK = 2_000  # of a pass over the features, at least
MODEL_TEXT = "model_text"
NOTHING_BELOW, SMALL_BELOW = 0.5, 2.0  # fixed values, points of sorting score


def prepare(df: DataFrame, title: str = "title", text: str = "text", label: str = "label") -> DataFrame:
    """Add raw, cleaned, key and label_binary; rows without any text are dropped."""
    usable = df.filter(F.col(text).isNotNull()).withColumn("raw", full_text(F.col(title), F.col(text)))
    return usable.filter(F.col("raw") != "").withColumns(
        {
            "cleaned": clean_article_text(F.col("raw")),
            "key": normalize_headline(F.col(title)),
            "label_binary": label_binary(F.col(label)),
        }
    )


def drop_emptied(df: DataFrame, cleaned: str = "cleaned") -> DataFrame:
    return df.filter(F.length(cleaned) > 0)


def train(df: DataFrame, text: str, label: str = "label_binary", features: int = MAX_FEATURES) -> PipelineModel:
    """Word counts weighted by rarity, then a logistic model with unit penalty.

    Weights are idf + 1 and rows are unit length; the penalty 1/n on the mean loss
    equals a unit penalty on the summed loss.
    """
    words = RegexTokenizer(inputCol=MODEL_TEXT, outputCol="words", gaps=False, pattern=WORD + "{2,}")
    stop = StopWordsRemover(inputCol="words", outputCol="kept_words")
    read = df.select(F.col(text).alias(MODEL_TEXT), label)
    tokens = stop.transform(words.transform(read)).select("kept_words", label)
    tokens = tokens.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = tokens.count()
        counter = CountVectorizer(inputCol="kept_words", outputCol="counts", vocabSize=features).fit(tokens)
        counts = counter.transform(tokens)
        rarity = IDF(inputCol="counts", outputCol="unused").fit(counts).idf.toArray() + 1.0
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(rarity), inputCol="counts", outputCol="weighted")
        unit = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
        learner = LogisticRegression(
            featuresCol="features", labelCol=label, regParam=1.0 / rows, elasticNetParam=0.0, standardization=False,
            maxIter=MAX_ITERATIONS, tol=TOLERANCE,
        )
        # Every iteration is a pass over the features. They are written out once, so that
        # no pass carries the vocabulary and the text along or starts over when an
        # executor is lost.
        # Each pass starts one task for a partition: few rows need few.
        tasks = max(1, rows // ROWS_PER_TASK)
        features = cut_lineage(unit.transform(weigh.transform(counts)).select("features", label).coalesce(tasks))
    finally:
        tokens.unpersist()
    fitted = learner.fit(features)
    return PipelineModel([words, stop, counter, weigh, unit, fitted])


def model_scorer(model: PipelineModel) -> Scorer:
    """The model as a cascade step, entirely inside the JVM; null text is not scored."""

    def scorer(df: DataFrame, text: str) -> DataFrame:
        scored = model.transform(df.withColumn(MODEL_TEXT, F.coalesce(F.col(text), F.lit(""))))
        fake = F.when(F.col(text).isNotNull(), vector_to_array("probability")[1])
        return scored.withColumn("fake_score", fake).select(*df.columns, "fake_score")

    return scorer


def batch_scorer(load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 16) -> Scorer:
    """Any other model: `load` runs once per Python worker and returns a function from
    a batch of texts to scores. Only rows that need a score are passed to it."""

    @F.pandas_udf("double")
    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in columns:
            wanted = texts.dropna()
            scores = []
            for start in range(0, len(wanted), batch):
                scores.extend(model(wanted.iloc[start : start + batch].tolist()))
            yield pd.Series(scores, index=wanted.index, dtype="float64").reindex(texts.index)

    return lambda df, text: df.withColumn("fake_score", predict(F.col(text)))


def top_terms(spark: SparkSession, model: PipelineModel, k: int = 20) -> DataFrame:
    """The k most REAL-leaning and k most FAKE-leaning words."""
    # The vocabulary is capped at `features` words, whatever the corpus size.
    weights = model.stages[-1].coefficients.toArray()
    terms = spark.createDataFrame(
        pd.DataFrame({"term": model.stages[2].vocabulary, "weight": weights}), "term string, weight double"
    )
    real = terms.orderBy("weight", "term").limit(k).withColumn("leans", F.lit("REAL"))
    fake = terms.orderBy(F.desc("weight"), "term").limit(k).withColumn("leans", F.lit("FAKE"))
    return real.unionByName(fake)


def _accuracy() -> Column:
    return F.avg(F.when((F.col("fake_score") > 0.5) == (F.col("label_binary") == 1), 1.0).otherwise(0.0)) * 100


def _side_by_side(spark: SparkSession, run: Callable, calls: list[tuple]) -> list:
    """Independent runs submitted together: while one waits for its last tasks, the
    others keep the executors busy."""
    with ThreadPool(min(PARALLEL_RUNS, len(calls))) as pool:
        # a target for each call: threads that shared one would share its job properties
        return pool.map(lambda target: target(), [inheritable_thread_target(spark)(partial(run, *call)) for call in calls])


def run_experiment(df: DataFrame, first: str, second: str) -> DataFrame:
    """Three ways to split, each with raw and cleaned text: accuracy and sizes.

    `df` has id, collection, title, raw, cleaned, label_binary. The shuffled split is
    the flattering one; the arrow rows teach one collection and examine the other,
    without headlines that were taught. Rows that cleaning empties take no part.
    """
    splits = experiment_splits(df, first, second)

    def run(name, teach, test, version, text):
        model = train(teach, text)
        accuracy, n_test = model_scorer(model)(test, text).agg(_accuracy(), F.count(F.lit(1))).first()
        return name, version, accuracy, teach.count(), n_test

    versions = (("raw", "raw"), ("clean", "cleaned"))
    rows = _side_by_side(df.sparkSession, run, [(*split, *version) for split in splits for version in versions])
    schema = "split string, version string, accuracy double, n_train long, n_test long"
    return df.sparkSession.createDataFrame(rows, schema)


def experiment_splits(df: DataFrame, first: str, second: str) -> list[tuple[str, DataFrame, DataFrame]]:
    """(name, teach, exam) of the three ways to split."""
    # The texts are cleaned once; every split and fit reads them from the shared folder.
    df = cut_lineage(drop_emptied(df.select("id", "collection", "title", "raw", "cleaned", "label_binary")))
    shuffled = stratified_split(df, "label_binary", "id", 0.2, out="__test")
    piles = {name: df.filter(F.col("collection") == name) for name in (first, second)}
    splits = [("shuffled", shuffled.filter(~F.col("__test")), shuffled.filter("__test"))]
    for teach, exam in ((first, second), (second, first)):
        splits.append((f"{teach} -> {exam}", piles[teach], cut_lineage(drop_leaks(piles[exam], piles[teach]))))
    return splits


def experiment_sizes(df: DataFrame, first: str, second: str) -> DataFrame:
    """How many rows each split teaches and examines, by label: what an accuracy rests on."""
    parts = []
    for name, teach, exam in experiment_splits(df, first, second):
        for part, rows in (("teach", teach), ("exam", exam)):
            sizes = rows.groupBy("label_binary").agg(F.count(F.lit(1)).alias("articles"))
            parts.append(sizes.select(F.lit(name).alias("split"), F.lit(part).alias("part"), "label_binary", "articles"))
    return reduce(DataFrame.unionAll, parts)


def vocabulary(
    df: DataFrame, text: str = "cleaned", features: int = MAX_FEATURES, stop_words: list[str] | None = None
) -> DataFrame:
    """term, articles (that hold it) and idf: the words a model of `df` would know, the most used first."""
    words = RegexTokenizer(inputCol=MODEL_TEXT, outputCol="words", gaps=False, pattern=WORD + "{2,}")
    stop = StopWordsRemover(inputCol="words", outputCol="kept_words")
    if stop_words is not None:
        stop.setStopWords(stop_words)
    tokens = stop.transform(words.transform(df.select(F.col(text).alias(MODEL_TEXT)))).select("kept_words")
    n = tokens.count()
    # the words of a row are together, so their uses are added up before anything is shuffled
    numbered = tokens.withColumn("row", F.monotonically_increasing_id())
    held = numbered.select("row", F.explode("kept_words").alias("term"))
    held = held.groupBy("row", "term").agg(F.count(F.lit(1)).alias("uses"))
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("articles"), F.sum("uses").alias("uses"))
    idf = F.log((F.lit(n) + 1.0) / (F.col("articles") + 1.0))
    return terms.orderBy(F.desc("uses"), "term").limit(features).select("term", "articles", "uses", idf.alias("idf"))


def accuracy_changes(results: DataFrame) -> DataFrame:
    """Per split: accuracy on raw and cleaned text and the difference."""
    wide = results.groupBy("split").pivot("version", ["raw", "clean"]).agg(F.first("accuracy"))
    return wide.withColumn("change", F.col("clean") - F.col("raw"))


def fit_and_record(df: DataFrame, results: DataFrame, first: str, second: str) -> tuple[PipelineModel, dict]:
    """Model for use, taught on everything cleaned, with the honest measurement and,
    under their own names, the flattering ones."""
    model = train(df, "cleaned")
    got = {(r["split"], r["version"]): r for r in results.collect()}  # six rows
    honest = got[(f"{first} -> {second}", "clean")]
    return model, {
        "test_accuracy": round(honest["accuracy"], 2),
        "training_samples": honest["n_train"],
        "test_samples": honest["n_test"],
        "total_samples": df.count(),
        "vocabulary_size": len(model.stages[2].vocabulary),
        "trained_at": str(pd.Timestamp.now().date()),
        "evaluation": "cross_source",
        "trained_on": first,
        "tested_on": second,
        "text_cleaned": True,
        "inflated_shuffled_accuracy": round(got[("shuffled", "clean")]["accuracy"], 2),
        "uncleaned_cross_source_accuracy": round(got[(f"{first} -> {second}", "raw")]["accuracy"], 2),
        "reverse_cross_source_accuracy": round(got[(f"{second} -> {first}", "clean")]["accuracy"], 2),
    }


def examine(name: str, teach: DataFrame, exam: DataFrame, from_scores: bool) -> tuple:
    """One run: sorting score without any cutoff, then accuracy on half of the exam at
    the line that works best on the other half."""
    model = train(teach, "cleaned")
    scored = model_scorer(model)(exam.select("id", "cleaned", "label_binary"), "cleaned").select(
        "id", F.col("label_binary").alias("truth"), F.col("fake_score").alias("score")
    )
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        halves = stratified_split(scored, "truth", "id", 0.5, out="chooses")
        half_a, half_b = halves.filter("chooses"), halves.filter(~F.col("chooses"))
        lines = exact_quantiles(half_a, "score", evenly_spaced(SWEEP_CANDIDATES)) if from_scores else FINE_LADDER
        line = choose_cutoff(sweep(half_a, lines)).first()["best"]
        at = measure(half_b, line).first()
        sorting = sorting_score(scored).first()[0] * 100
    finally:
        scored.unpersist()
    return name, teach.count(), sorting, line, at["accuracy"], at["fake_recall"] * 100, at["real_recall"] * 100


RUNS = (
    "run string, n_train long, sorting double, best_line double, accuracy double, fake_recall double, "
    "real_recall double"
)


def _copies(pile: DataFrame, rows: int, seed: int) -> DataFrame:
    """`rows` rows of a one-label pile, without replacement."""
    return first_per_group(pile, "label_binary", "id", F.lit(rows), seed, "__in").filter("__in").drop("__in")


def ablate_fakes(base: DataFrame, extra: DataFrame, exam: DataFrame) -> DataFrame:
    """Before, with new fakes, and with as many copied ones (same tilt, nothing new)."""
    fakes = base.filter("label_binary = 1")
    copies = _copies(fakes, min(extra.count(), fakes.count()), SPLIT_SEED)
    piles = [("A before", base), ("B new", base.unionByName(extra)), ("C tilt only", base.unionByName(copies))]
    return base.sparkSession.createDataFrame(
        _side_by_side(base.sparkSession, examine, [(n, p, exam, False) for n, p in piles]), RUNS
    )


def ablate_reals(base: DataFrame, extra: DataFrame, exam: DataFrame, dominant: Column) -> DataFrame:
    """As above for reals, plus a run that trims the `dominant` real source instead."""
    pool = base.filter("label_binary = 0").filter(dominant)
    n_new, n_pool = extra.count(), pool.count()
    copies = _copies(pool, min(n_new, n_pool), SPLIT_SEED)
    dropped = _copies(pool, min(n_new, n_pool - 1), SPLIT_SEED + 1).select("id")
    piles = [
        ("A before", base),
        ("B new", base.unionByName(extra)),
        ("C balance only", base.unionByName(copies)),
        ("D trimmed", base.join(dropped, "id", "left_anti")),
    ]
    return base.sparkSession.createDataFrame(
        _side_by_side(base.sparkSession, examine, [(n, p, exam, True) for n, p in piles]), RUNS
    )


def worth(runs: DataFrame) -> DataFrame:
    """What the new articles are worth over every control, and what to make of it."""
    by_run = {"A before": "a", "B new": "b", "C tilt only": "c", "C balance only": "c", "D trimmed": "d"}
    short = F.element_at(F.create_map(*[F.lit(x) for pair in by_run.items() for x in pair]), F.col("run"))

    def of(run):
        return F.max(F.when(short == run, F.col("sorting")))

    gains = runs.agg(of("a").alias("a"), of("b").alias("b"), of("c").alias("c"), of("d").alias("d"))
    value = F.least(F.col("b") - F.col("c"), F.col("b") - F.col("d"))
    decision = F.when(value < NOTHING_BELOW, "nothing measurable").when(value < SMALL_BELOW, "small gain")
    return gains.select(
        (F.col("b") - F.col("a")).alias("gain_new"),
        (F.col("c") - F.col("a")).alias("gain_copied"),
        (F.col("d") - F.col("a")).alias("gain_trimmed"),
        value.alias("worth"),
        decision.otherwise("real gain").alias("decision"),
    )


def retrain_decision(old: Column, new: Column) -> Column:
    """Compare sorting scores in points."""
    gain = new - old
    return F.when(gain < 0, "worse").when(gain < 1, "no real gain").otherwise("better")
