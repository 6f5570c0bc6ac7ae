"""Cutoffs and bands: chosen on one half of the scored exam, reported on the other.

A scored frame has `score` (double) and `truth` (1 = fake). Candidate cutoffs
number about two thousand whatever the data size, so a sweep buckets each score
among the candidates and adds up the buckets; no score meets every candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.operators.ordered import bucket_of, exact_quantiles

# What was decided rather than measured.
SWEEP_CANDIDATES, FLAG_CANDIDATES = 2000, 400
FLAG_PRECISION_FLOOR, MIN_FLAGGED = 0.75, 50
UNSURE_MAX_COVERAGE, UNSURE_ACCURACY_FLOOR = 0.20, 75.0
UNSURE_CANDIDATES = [(0.01, 0.99), (0.05, 0.99), (0.05, 0.95), (0.10, 0.90), (0.20, 0.80), (0.30, 0.70)]
SEARCHES_PER_DAY = 500
TABLE_ROWS = 12


def ladder(start: float, stop: float, step: float) -> list[float]:
    return [start + i * step for i in range(round((stop - start) / step) + 1)]


COARSE_LADDER = ladder(0.05, 0.95, 0.05)
FINE_LADDER = ladder(0.05, 0.95, 0.01)


def evenly_spaced(count: int, low: float = 0.001, high: float = 0.999) -> list[float]:
    step = (high - low) / (count - 1)
    return [low + i * step for i in range(count - 1)] + [high]


def cutoff_candidates(scored: DataFrame, count: int = SWEEP_CANDIDATES) -> list[float]:
    """Quantiles of the scores themselves plus the coarse ladder, ascending."""
    return sorted(set(exact_quantiles(scored, "score", evenly_spaced(count))) | set(COARSE_LADDER))


def _share(condition: Column, among: Column | None = None) -> Column:
    hit = F.when(condition, 1.0).otherwise(0.0)
    return F.avg(hit if among is None else F.when(among, hit))


def _percent(condition: Column, among: Column | None = None) -> Column:
    return F.round(_share(condition, among) * 100, 1)


def _truth() -> Column:
    return F.col("truth") == 1


def measure(scored: DataFrame, cutoff: float) -> DataFrame:
    """Accuracy (percent) and recall per class at one cutoff; `>=` counts as fake."""
    said = F.col("score") >= cutoff
    return scored.agg(
        F.lit(float(cutoff)).alias("cutoff"),
        (_share(said == _truth()) * 100).alias("accuracy"),
        _share(~said, ~_truth()).alias("real_recall"),
        _share(said, _truth()).alias("fake_recall"),
    )


def sweep(scored: DataFrame, candidates: list[float]) -> DataFrame:
    """measure() at every candidate, in one pass over the scores."""
    cuts = sorted(set(candidates))
    spark = scored.sparkSession
    # Bucket b holds the scores with exactly b candidates at or below them, so a
    # score says fake at candidate i (0-based) when its bucket is above i.
    counted = bucket_of(scored, "score", cuts, "b").groupBy(F.col("b").cast("int").alias("b")).agg(
        F.count(F.when(_truth(), 1)).alias("fakes"), F.count(F.when(~_truth(), 1)).alias("reals")
    )
    grid = spark.createDataFrame(list(enumerate(cuts, start=1)) + [(0, None)], "b int, cutoff double")
    # From here on there is one row per candidate.
    upward = Window.orderBy(F.desc("b"))
    everything = Window.partitionBy(F.lit(0))
    table = (
        grid.join(counted, "b", "left")
        .na.fill(0, ["fakes", "reals"])
        .withColumns(
            {
                "caught": F.sum("fakes").over(upward),
                "blamed": F.sum("reals").over(upward),
                "all_fakes": F.sum("fakes").over(everything),
                "all_reals": F.sum("reals").over(everything),
            }
        )
    )
    spared = F.col("all_reals") - F.col("blamed")
    return table.filter(F.col("cutoff").isNotNull()).select(
        F.col("b").alias("position"),
        "cutoff",
        ((F.col("caught") + spared) * 100 / (F.col("all_fakes") + F.col("all_reals"))).alias("accuracy"),
        F.try_divide(spared, F.col("all_reals")).alias("real_recall"),
        F.try_divide(F.col("caught"), F.col("all_fakes")).alias("fake_recall"),
    )


def choose_cutoff(swept: DataFrame) -> DataFrame:
    """One row: the most accurate cutoff and the most even one; ties take the lowest."""
    gap = F.abs(F.col("real_recall") - F.col("fake_recall"))
    return swept.agg(
        F.max_by("cutoff", F.struct(F.col("accuracy"), -F.col("position"))).alias("best"),
        F.min_by("cutoff", F.struct(gap, F.col("position"))).alias("fairest"),
    )


def tradeoff_table(swept: DataFrame) -> DataFrame:
    """A dozen candidates evenly spaced by position, plus the best and the fairest."""
    chosen = swept.agg(
        F.max("position").alias("n"),
        F.max_by("position", F.struct(F.col("accuracy"), -F.col("position"))).alias("best"),
        F.min_by(
            "position", F.struct(F.abs(F.col("real_recall") - F.col("fake_recall")), F.col("position"))
        ).alias("fairest"),
    )
    spots = [F.rint((F.col("n") - 1) * i / (TABLE_ROWS - 1)).cast("int") + 1 for i in range(TABLE_ROWS)]
    shown = chosen.select(
        F.explode(F.array_distinct(F.array(*spots, "best", "fairest"))).alias("position"), "best", "fairest"
    )
    mark = F.when(F.col("position") == F.col("best"), "best accuracy").when(
        F.col("position") == F.col("fairest"), "most even"
    )
    return swept.join(shown, "position").select(
        "position", "cutoff", "accuracy", "real_recall", "fake_recall", F.coalesce(mark, F.lit("")).alias("mark")
    )


def describe_verdict(scored: DataFrame, cutoff: float) -> DataFrame:
    """What readers are told: how often each kind of verdict is right (`>`)."""
    said = F.col("score") > cutoff
    return scored.agg(
        F.lit(float(cutoff)).alias("score_above"),
        _percent(said == _truth()).alias("accuracy"),
        _percent(_truth(), said).alias("fake_precision"),
        _percent(said).alias("fake_coverage"),
        _percent(~_truth(), ~said).alias("real_precision"),
        _percent(~said).alias("real_coverage"),
        F.count(F.lit(1)).alias("measured_on"),
    )


def flag_table(scored: DataFrame, candidates: list[float]) -> DataFrame:
    """(step, cutoff, flagged, right) from the highest candidate down, `>` flags."""
    falling = sorted(set(candidates), reverse=True)
    # Negating turns "score > t" into "-t is above -score": count thresholds
    # strictly below a score by looking the negated score up among negated cuts.
    negated = scored.select((-F.col("score")).alias("minus"), "truth")
    cuts = [-t for t in falling]
    counted = bucket_of(negated, "minus", cuts, "b").groupBy(F.col("b").cast("int").alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(_truth(), 1)).alias("fakes")
    )
    grid = scored.sparkSession.createDataFrame(list(enumerate(falling)), "step int, cutoff double")
    down = Window.orderBy("step")  # one row per candidate
    return (
        grid.join(counted, "step", "left")
        .na.fill(0, ["n", "fakes"])
        .select("step", "cutoff", F.sum("n").over(down).alias("flagged"), F.sum("fakes").over(down).alias("right"))
    )


def find_flag_band(scored: DataFrame, candidates: list[float] | None = None) -> DataFrame:
    """One row, `score_above`: the lowest cutoff of the first run, walking down, whose
    flags are right often enough; null when there is none."""
    table = flag_table(scored, cutoff_candidates(scored, FLAG_CANDIDATES) if candidates is None else candidates)
    counted = table.filter(F.col("flagged") >= MIN_FLAGGED).withColumn(
        "good", F.col("right") / F.col("flagged") >= FLAG_PRECISION_FLOOR
    )
    down = Window.orderBy("step")
    # A run ends at the first failure after a success.
    ran = counted.withColumn("ok_before", F.max(F.col("good").cast("int")).over(down))
    ended = ran.withColumn(
        "over", F.max(((F.col("ok_before") == 1) & ~F.col("good")).cast("int")).over(down)
    )
    return ended.agg(F.min(F.when(F.col("good") & (F.col("over") == 0), F.col("cutoff"))).alias("score_above"))


def describe_band(scored: DataFrame, threshold: float) -> DataFrame:
    flagged = F.col("score") > threshold
    return scored.agg(
        F.lit(float(threshold)).alias("score_above"),
        _percent(_truth(), flagged).alias("precision"),
        _percent(flagged).alias("coverage"),
        _percent(~_truth(), ~flagged).alias("below_band_real"),
        _percent(~flagged).alias("below_band_coverage"),
        F.count(F.lit(1)).alias("measured_on"),
    )


def in_band(score: Column, low, high) -> Column:
    """Strictly inside; no score or no band means no."""
    low, high = (F.lit(v) if not isinstance(v, Column) else v for v in (low, high))
    return F.coalesce((score > low) & (score < high), F.lit(False))


def unsure_table(scored: DataFrame, cutoff: float) -> DataFrame:
    """Each candidate band with its coverage and accuracy, from a single pass."""
    correct = (F.col("score") >= cutoff) == _truth()
    sums = [F.count(F.lit(1)).alias("n"), F.count(F.when(correct, 1)).alias("right")]
    for i, (low, high) in enumerate(UNSURE_CANDIDATES):
        inside = in_band(F.col("score"), low, high)
        sums += [F.count(F.when(inside, 1)).alias(f"n{i}"), F.count(F.when(inside & correct, 1)).alias(f"right{i}")]
    bands = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(low).alias("low"),
                F.lit(high).alias("high"),
                F.col(f"n{i}").alias("inside"),
                F.try_divide(F.col(f"n{i}"), F.col("n")).alias("coverage"),
                F.try_divide(F.col(f"right{i}") * 100, F.col(f"n{i}")).alias("accuracy_inside"),
                F.try_divide((F.col("right") - F.col(f"right{i}")) * 100, F.col("n") - F.col(f"n{i}")).alias(
                    "accuracy_outside"
                ),
            )
            for i, (low, high) in enumerate(UNSURE_CANDIDATES)
        ]
    )
    return scored.agg(*sums).select(F.inline(bands))


def find_unsure_band(scored: DataFrame, cutoff: float) -> DataFrame:
    """The widest band worth a second opinion; no row when none qualifies."""
    fit = (
        (F.col("inside") >= MIN_FLAGGED)
        & (F.col("coverage") <= UNSURE_MAX_COVERAGE)
        & (F.col("accuracy_inside") < UNSURE_ACCURACY_FLOOR)
        & (F.col("accuracy_outside") > F.col("accuracy_inside"))
    )
    return unsure_table(scored, cutoff).filter(fit).orderBy(F.desc("coverage"), "position").limit(1)


def describe_unsure_band(scored: DataFrame, cutoff: float, low: float, high: float) -> DataFrame:
    inside = in_band(F.col("score"), low, high)
    correct = (F.col("score") >= cutoff) == _truth()
    told = scored.agg(
        F.lit(float(low)).alias("low"),
        F.lit(float(high)).alias("high"),
        _percent(inside).alias("coverage"),
        _percent(correct, inside).alias("accuracy_inside"),
        _percent(correct, ~inside).alias("accuracy_outside"),
        F.rint(_share(inside) * 1000).cast("int").alias("searches_per_1000_articles"),
        F.count(F.lit(1)).alias("measured_on"),
    )
    daily = F.lit(SEARCHES_PER_DAY) / F.greatest("coverage", F.lit(0.1)) * 100
    return told.withColumn("articles_per_day", daily.cast("int"))


def compare_cutoffs(scored: DataFrame, tuned: float, fairest: float, default: float = 0.5) -> DataFrame:
    """Default, most accurate and most even cutoff side by side, one pass."""
    runs = [("default", default), ("best accuracy", tuned), ("most even", fairest)]
    sums = []
    for i, (_, cutoff) in enumerate(runs):
        said = F.col("score") >= cutoff
        sums += [
            (_share(said == _truth()) * 100).alias(f"a{i}"),
            _share(~said, ~_truth()).alias(f"r{i}"),
            _share(said, _truth()).alias(f"f{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(float(cutoff)).alias("cutoff"),
                F.col(f"a{i}").alias("accuracy"),
                F.col(f"r{i}").alias("real_recall"),
                F.col(f"f{i}").alias("fake_recall"),
                (F.col(f"a{i}") - F.col("a0")).alias("accuracy_change"),
            )
            for i, (name, cutoff) in enumerate(runs)
        ]
    )
    return scored.agg(*sums).select(F.inline(rows))


def calibrate(half_a: DataFrame, half_b: DataFrame, chosen_for: str = "best accuracy on a held-out half of the exam") -> dict:
    """The whole record: chosen on `half_a`, reported on `half_b`. Cutoffs stay
    unrounded; only figures for display are rounded."""
    choice = choose_cutoff(sweep(half_a, cutoff_candidates(half_a))).first()
    best, fairest = choice["best"], choice["fairest"]
    tuned = measure(half_b, best).first()
    flag = find_flag_band(half_a).first()["score_above"]
    unsure = find_unsure_band(half_a, best).first()
    return {
        "cutoff": best,
        "chosen_for": chosen_for,
        "accuracy": round(tuned["accuracy"], 2),
        "real_recall": round(tuned["real_recall"], 3),
        "fake_recall": round(tuned["fake_recall"], 3),
        "cutoff_chosen_on": half_a.count(),
        "measured_on": half_b.count(),
        "evaluation": "cross_source",
        "alternative_even_cutoff": fairest,
        "verdict": describe_verdict(half_b, best).first().asDict(),
        "flag": None if flag is None else describe_band(half_b, flag).first().asDict(),
        "flag_precision_floor": FLAG_PRECISION_FLOOR,
        "unsure_band": None
        if unsure is None
        else describe_unsure_band(half_b, best, unsure["low"], unsure["high"]).first().asDict(),
        "unsure_max_coverage": UNSURE_MAX_COVERAGE,
        "unsure_accuracy_floor": UNSURE_ACCURACY_FLOOR,
    }
