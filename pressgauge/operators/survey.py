"""How much publisher fingerprint a collection carries, and what cleaning costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions.fingerprints import clean_article_text, fingerprint_hits, rule_names


def survey_fingerprints(df: DataFrame, text: str = "raw", *by: str) -> DataFrame:
    """Articles containing each rule's marker per group, and the whole percent they
    are of the group. One pass; only one row per group is shuffled and unpivoted."""
    by = by or ("collection", "label_binary")
    hits = df.select(*by, *fingerprint_hits(F.col(text)))
    sums = hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("articles"),
        *[F.count(F.when(F.col(f"`{name}`") > 0, 1)).alias(name) for name in rule_names()],
    )
    long = sums.unpivot([*by, "articles"], [f"`{n}`" for n in rule_names()], "rule", "hits")
    return long.withColumn("percent", F.floor(F.col("hits") * 100 / F.col("articles")))


def cleaning_loss(df: DataFrame, text: str = "raw") -> DataFrame:
    """One row: articles, how many cleaning empties, and the percent of text removed."""
    sizes = df.select(
        F.length(text).alias("before"), F.length(clean_article_text(F.col(text))).alias("after")
    )
    raw, cleaned = F.coalesce(F.sum("before"), F.lit(0)), F.coalesce(F.sum("after"), F.lit(0))
    kept: Column = F.floor(cleaned * 100 / F.greatest(raw, F.lit(1)))
    return sizes.agg(
        F.count(F.lit(1)).alias("articles"),
        F.count(F.when(F.col("after") == 0, 1)).alias("emptied"),
        raw.alias("raw_chars"),
        cleaned.alias("cleaned_chars"),
        (F.lit(100) - kept).alias("removed_percent"),
    )
