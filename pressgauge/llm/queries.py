"""The training-data queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm import bagminhash, bpe, gnat, hnsw, html, langid, lm, mixing, pii, puls, quality, runs, substrings
from pressgauge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(table(spark, folder, "documents"))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.sha2("kept", 256).alias("kept_sha256")
    return substrings.cut(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", kept)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify_held_out(table(spark, folder, "documents"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.words_taken(table(spark, folder, "documents")).select(
        "doc_id", "size", "source", "source_size", "target", "taken"
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return gnat.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where the words of a text of n words come from: one in ten texts goes on periodically from some word."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.scan(table(spark, folder, "documents"), periodic_tail, digest=True)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.col("collapsed").alias("collapsed_sha256")
    )


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return puls.score_held_out(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_lm_scoring,
        op3_pii,
        op4_substring_dedup,
        op5_quality_rules,
        op6_nearest_neighbours,
        op7_language_id,
        op8_bpe,
        op9_minhash,
        op10_mixing,
        op11_hard_negatives,
        op12_periodic_runs,
        op13_toxicity,
    )
}

SQL: dict[str, str] = {"op2_lm_scoring": lm.oracle()}
