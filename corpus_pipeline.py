"""A training corpus from raw documents: judge, deduplicate, redact, mix, tokenize.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a
DataFrame; run() writes it as Parquet in the cluster's shared folder and reads it back for the next one.
All stages but the last return the columns of documents: doc_id, text, lang, source, n_chars.

A null text is an empty text; the quality rules reject it. Rows that are repeated in documents are copies,
of which near-duplicate removal keeps one. Extra columns are dropped at the first stage. Empty documents
give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm import bagminhash, bpe, mixing, pii, quality
from pressgauge.llm.common import table
from pressgauge.session import checkpoint_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every learned rule, unchanged.

    The rules are learned from the labels, and judged from the text alone.
    """
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), quality.Settings(), *COLUMNS[1:])
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near-copies: the class's smallest doc_id, one row of it.

    Where a class has no doc_id at all, and where rows share id and text, the row that stays is that of the
    smallest remaining columns. Ids and digests are ranked, never texts; a class is reduced inside the tasks
    before it meets in one.
    """
    classes = bagminhash.near_duplicates(docs.select("doc_id", "text"))
    first = Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "content")
    kept = classes.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    key = lambda content: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), content)
    kept = kept.select(key(F.col("content")).alias("__key"))
    keyed = docs.select(*COLUMNS).withColumn("__key", key(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    # one shuffle of the texts serves the join and the choice among rows of the same id and text
    order = Window.partitionBy("__key").orderBy("lang", "source", "n_chars", F.col("text").isNull())
    rows = keyed.join(kept, "__key").withColumn("__n", F.row_number().over(order))
    return rows.where("__n = 1").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with marks in place of personal data; n_chars is the new length."""
    found = pii.scan(docs, pii.Settings(), "lang", "source")
    return found.select(
        "doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("bigint").alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, no, one or two times each, so that the words of each source add up to its target and a
    document's copies follow the share of it that the mix takes.
    """
    plan = mixing.plan_mix(docs, mixing.Settings(), "n_chars").where("size > 0")
    parts = ("doc_id", "source", "n_chars", "size")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("doc_id", "n_chars", "size")])
    key = F.concat(key, F.coalesce(F.concat(F.lit("|"), F.col("source").cast("string")), F.lit("")))
    # rows that the plan cannot tell apart (same id, source and length) get its rows in turn
    drawn = plan.select(*parts, "first_taken").groupBy(key.alias("__key")).agg(
        F.sort_array(F.collect_list("first_taken"), asc=False).alias("__times")
    )
    drawn = drawn.where(F.element_at("__times", 1) > 0)
    keyed = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text"))).withColumn("__key", key)
    order = Window.partitionBy("__key").orderBy("lang", F.xxhash64("text"), "text")
    rows = keyed.join(drawn, "__key").withColumn("__n", F.row_number().over(order))
    rows = rows.withColumn("__times", F.element_at("__times", F.col("__n"))).where("__times > 0")
    return rows.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each document, which decode to its text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, True, "lang", "source", "n_chars")
    ids, decoded = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", ids, decoded)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

# The learned stages have no SQL; tests hold every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
