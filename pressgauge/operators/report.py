"""Reports on the analysis history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions.matching import display_headline
from pressgauge.operators.web import WEB_CHECK

# Chart series, in display order.
VERDICT_SERIES = ["Likely Real", "Likely Fake", "Not Sure"]
METHOD_SERIES = {"Database Match": "database", "Reading Model": "reading_model", "Word-Counter": "ml_prediction"}

HISTORY_COLUMNS = [
    "id", "headline", "article_text", "score", "result_label", "explanation", "analyzed_at", "confidence", "method",
    "matched_headline", "matched_extract", "web_check",
]


def history_rows(analyzed: DataFrame, analyzed_at: Column | None = None) -> DataFrame:
    """One history row per analysed request: shortened headline, verdict, and a copy
    of the evidence; confidence stays null when the verdict was refused, and web_check
    when no search ran."""
    web_check = F.col("web_check") if "web_check" in analyzed.columns else F.lit(None)
    shown = display_headline(F.col("headline"), F.col("body"))
    return analyzed.withColumn("__shown", shown).select(
        "id",
        F.col("__shown.headline").alias("headline"),
        F.col("__shown.body").alias("article_text"),
        "score",
        F.col("label").alias("result_label"),
        "explanation",
        (F.current_timestamp() if analyzed_at is None else analyzed_at).alias("analyzed_at"),
        "confidence",
        "method",
        F.coalesce("match.headline", F.lit("")).alias("matched_headline"),
        F.coalesce("match.article_text", F.lit("")).alias("matched_extract"),
        web_check.cast(WEB_CHECK).alias("web_check"),
    )


def history_total(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("total"))


def dashboard(history: DataFrame) -> DataFrame:
    """Totals and percentages; 'Unknown' counts in the total only."""

    def verdicts(label):
        return F.count(F.when(F.col("result_label") == label, 1))

    counts = history.agg(
        F.count(F.lit(1)).alias("total"),
        verdicts("Likely Real").alias("real_count"),
        verdicts("Likely Fake").alias("fake_count"),
        verdicts("Not Sure").alias("unsure_count"),
    )

    def percent(name):
        return F.coalesce(F.round(F.try_divide(F.col(name) * 100, F.col("total")), 1), F.lit(0.0))

    return counts.withColumns({f"{n}_pct": percent(f"{n}_count") for n in ("real", "fake", "unsure")})


def chart_series(history: DataFrame) -> DataFrame:
    """(chart, position, label, articles) with zeros for what never happened."""
    series = [("verdict", i, name, F.col("result_label") == name) for i, name in enumerate(VERDICT_SERIES)]
    series += [
        ("method", i, name, F.col("method") == method) for i, (name, method) in enumerate(METHOD_SERIES.items())
    ]
    sums = [F.count(F.when(test, 1)).alias(f"n{i}") for i, (_, _, _, test) in enumerate(series)]
    rows = F.array(
        *[
            F.struct(
                F.lit(chart).alias("chart"),
                F.lit(position).alias("position"),
                F.lit(name).alias("label"),
                F.col(f"n{i}").alias("articles"),
            )
            for i, (chart, position, name, _) in enumerate(series)
        ]
    )
    return history.agg(*sums).select(F.inline(rows))


def recent(history: DataFrame, rows: int = 20) -> DataFrame:
    """The newest analyses, numbered so that the newest has the highest number."""
    newest = history.orderBy(F.desc("analyzed_at"), F.desc("id")).limit(rows)
    total = history.agg(F.count(F.lit(1)).alias("n")).scalar()
    # `rows` rows at most reach this window.
    offset = F.row_number().over(Window.orderBy(F.desc("analyzed_at"), F.desc("id"))) - 1
    return newest.withColumn("row_number", total - offset).withColumn(
        "shown_date", F.date_format("analyzed_at", "MMM d, yyyy")
    )


def delete_analyses(history: DataFrame, ids: DataFrame) -> DataFrame:
    """History without the given ids."""
    return history.join(ids.select("id"), "id", "left_anti")


def clear_history(history: DataFrame, confirm: str) -> DataFrame:
    """An empty history, only when asked for with the typed word."""
    return history.limit(0) if confirm == "DELETE" else history
