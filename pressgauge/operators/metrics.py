"""How well a scored or predicted frame does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.operators.ordered import ROWS_PER_SLICE, running_totals

CLASS_NAMES = {0: "REAL", 1: "FAKE"}


def sorting_score(scored: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row, `sorting_score`: chance that a fake outscores a real, ties half.

    Equal scores are counted together first, so a score shared by very many rows
    is a single row in the ranking. A row without a score (null, NaN) cannot be
    sorted and does not count.
    """
    has_score = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double"))
    counted = scored.filter(has_score).groupBy("score").agg(
        F.count(F.when(F.col("truth") == 1, 1)).alias("fakes"), F.count(F.when(F.col("truth") == 0, 1)).alias("reals")
    )
    ranked = running_totals(counted, "score", {"reals_upto": F.col("reals")}, rows_per_slice)
    reals = F.col("reals").cast("double")
    wins = F.sum(F.col("fakes") * (F.col("reals_upto") - reals / 2))
    return ranked.agg((wins / F.sum(F.col("fakes").cast("double")) / F.sum(reals)).alias("sorting_score"))


def classification_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, their plain and weighted
    averages, and the accuracy, from `truth` and `prediction` (0/1)."""
    cells = predicted.groupBy(F.col("truth").cast("int").alias("y"), F.col("prediction").cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_class = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.coalesce(F.try_divide(F.col(f"hit{y}"), F.col(f"said{y}")), F.lit(0.0)).alias("precision"),
                F.coalesce(F.try_divide(F.col(f"hit{y}"), F.col(f"is{y}")), F.lit(0.0)).alias("recall"),
                F.coalesce(F.try_divide(2 * F.col(f"hit{y}"), F.col(f"said{y}") + F.col(f"is{y}")), F.lit(0.0)).alias(
                    "f1"
                ),
                F.col(f"is{y}").alias("support"),
            )
            for y, name in CLASS_NAMES.items()
        ]
    )

    def cell(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    sums = [cell(F.col("y") == F.col("p")).alias("right"), cell(F.lit(True)).alias("all")]
    for y in CLASS_NAMES:
        sums += [
            cell((F.col("y") == y) & (F.col("p") == y)).alias(f"hit{y}"),
            cell(F.col("p") == y).alias(f"said{y}"),
            cell(F.col("y") == y).alias(f"is{y}"),
        ]
    base = cells.agg(*sums).withColumn("c", per_class)

    def average(name, weights):
        def mean(measure):
            parts = [F.col("c")[i][measure] * w for i, w in enumerate(weights)]
            return sum(parts[1:], parts[0]).alias(measure)

        return F.struct(
            F.lit(name).alias("name"), mean("precision"), mean("recall"), mean("f1"), F.col("all").alias("support")
        )

    accuracy = F.try_divide(F.col("right"), F.col("all"))
    overall = F.struct(
        F.lit("accuracy").alias("name"),
        accuracy.alias("precision"),
        accuracy.alias("recall"),
        accuracy.alias("f1"),
        F.col("all").alias("support"),
    )
    shares = [F.try_divide(F.col(f"is{y}"), F.col("all")) for y in CLASS_NAMES]
    rows = F.concat(
        F.col("c"),
        F.array(overall, average("macro avg", [F.lit(0.5), F.lit(0.5)]), average("weighted avg", shares)),
    )
    return base.select(F.inline(rows))


def composition(df: DataFrame, group: str = "collection", label: str = "label_binary") -> DataFrame:
    """Rows, fakes and reals per collection."""
    fake = F.count(F.when(F.col(label) == 1, 1))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("articles"), fake.alias("fake"), (F.count(F.lit(1)) - fake).alias("real")
    )
