"""Stored tables and records."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions.chars import strip
from pressgauge.operators.corpus import CORPUS_SCHEMA, merge_new
from pressgauge.operators.ordered import number_rows

DIVERSE_FAKES = ["title", "text", "label", "domain", "type", "url"]
DIVERSE_REALS = ["title", "text", "label", "outlet", "url", "date"]

VERDICT = (
    "score_above:double,accuracy:double,fake_precision:double,fake_coverage:double,real_precision:double,"
    "real_coverage:double,measured_on:long"
)
FLAG = (
    "score_above:double,precision:double,coverage:double,below_band_real:double,below_band_coverage:double,"
    "measured_on:long"
)
UNSURE = (
    "low:double,high:double,coverage:double,accuracy_inside:double,accuracy_outside:double,"
    "searches_per_1000_articles:int,measured_on:long"
)
CUTOFF_SCHEMA = (
    "cutoff double, chosen_for string, accuracy double, real_recall double, fake_recall double, cutoff_chosen_on long, "
    "measured_on long, evaluation string, alternative_even_cutoff double, "
    f"verdict struct<{VERDICT}>, flag struct<{FLAG}>, flag_precision_floor double, unsure_band struct<{UNSURE}>, "
    "unsure_max_coverage double, unsure_accuracy_floor double"
)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus, empty when nothing was loaded yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CORPUS_SCHEMA)
    return spark.read.schema(CORPUS_SCHEMA).parquet(path)


def append_corpus(new_rows: DataFrame, path: str, reset: bool = False) -> None:
    """Add top-up rows; ids go on from the largest held, in load order. With `reset`
    they take the place of everything held, and should come from a top-up of nothing."""
    spark = new_rows.sparkSession
    held = None if reset else read_corpus(spark, path).agg(F.max("id")).first()[0]
    order = F.shiftleft(F.col("file_no").cast("long"), 56) + F.col("pos")
    numbered = number_rows(new_rows.withColumn("__order", order), "__order", "__n")
    rows = numbered.withColumn("id", F.col("__n") + F.lit((held or 0) + 1)).drop("__order", "__n", "file_no", "pos")
    rows = rows.select(*[c.split()[0] for c in CORPUS_SCHEMA.split(", ")])
    if reset:
        replace_table(rows, path)
    else:
        rows.write.mode("append").parquet(path)


def append_history(history: DataFrame, path: str, batch: str | None = None) -> None:
    """One folder per day of analysis, so that reports on a period read only it, and in it
    one per batch. A batch written again under its name replaces its rows of those days."""
    rows = history.withColumns({"day": F.to_date("analyzed_at"), "batch": F.lit(batch or f"run-{uuid.uuid4().hex}")})
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day", "batch").parquet(path)


def replace_table(df: DataFrame, path: str, *partition: str) -> None:
    """Rewrite a table from a frame that may read it: the new rows are safe in a
    sibling folder before the old ones go."""
    staged = path.rstrip("/") + ".staged"
    df.write.mode("overwrite").parquet(staged)
    spark = df.sparkSession
    spark.read.parquet(staged).write.mode("overwrite").partitionBy(*partition).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_scores(scored: DataFrame, path: str) -> None:
    scored.select("title", "label_binary", "score").write.mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores saved earlier; an error when there are none to reuse."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no saved scores at {path}: score the exam first")
    return spark.read.schema("title string, label_binary int, score double").parquet(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON object; numbers are written in full, thresholds are never rounded."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_cutoff(spark: SparkSession, path: str) -> dict | None:
    """The cutoff record, or None when it is missing or holds no verdict figures: a
    model without a measurement must not answer."""
    if not _exists(spark, path):
        return None
    try:
        row = spark.read.schema(CUTOFF_SCHEMA).json(path).first()
    except AnalysisException:
        return None
    return None if row is None or row["verdict"] is None else row.asDict(recursive=True)


def diverse_rows(decided: DataFrame, label: str, columns: list[str], title: str, body: str, site: str) -> DataFrame:
    """Kept rows of a selection in the fixed column order of a diverse set."""
    kept = decided.filter("kept").withColumns({"__title": strip(F.col(title)), "__text": strip(F.col(body))})
    named = {"title": F.col("__title"), "text": F.col("__text"), "label": F.lit(label), site: F.col("counted_site")}
    return kept.select(*[(named[c] if c in named else F.coalesce(c, F.lit(""))).alias(c) for c in columns])


def write_diverse(df: DataFrame, path: str, existing: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Header CSV of a diverse set, merged into `existing` if given. A dry run only
    returns what would be written."""
    merged = df if existing is None else merge_new(existing, df)
    if not dry_run:
        merged.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return merged
