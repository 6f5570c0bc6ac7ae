"""The driver's tables in the roles of news data.

documents are pastes (first line the headline); documents with labels are the
corpus; sources are sites; events are a scored exam and a log of scored requests;
conversation turns carry web replies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions.matching import normalize_headline, split_paste
from pressgauge.operators.corpus import corpus_rows
from pressgauge.operators.sampling import stratified_split
from pressgauge.operators.verdict import CutoffRecord
from pressgauge.session import read_table

RECORD = CutoffRecord(score_above=0.4, fake_precision=86.9, real_precision=90.1, measured_on=3160)
BAND = (0.3, 0.7)

# Publisher markers put in front of a document, by doc_id; the tables have none.
MARKERS = [
    "",
    "WASHINGTON (Reuters) - ",
    "NEW YORK/LONDON (AP) : ",
    "Reporting by Jeff Mason; Editing by Peter Cooney. ",
    "Featured image via Getty Images. ",
    "Photo by AP Photo. See https://news.example.com/a?b=1 now. ",
    "pic.twitter.com/abc and t.co/xyz said Associated Press. ",
    "Follow us on Facebook for more. ",
    "[VIDEO] watch: (Photos) ",
    "Screengrab courtesy of istock. Sign up for our letter. ",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def documents(spark, folder):
    return table(spark, folder, "documents")


def pastes(spark, folder) -> DataFrame:
    """id, headline, body, source, lang of every document."""
    pasted = documents(spark, folder).withColumn("p", split_paste(F.col("text")))
    return pasted.select(F.col("doc_id").alias("id"), "p.headline", "p.body", "source", "lang")


def labelled(spark, folder) -> DataFrame:
    """Pastes with label and basis."""
    return (
        pastes(spark, folder)
        .join(table(spark, folder, "labels").withColumnRenamed("doc_id", "id"), "id")
        .withColumns(
            {
                "label": F.when(F.col("quality") == 0, "FAKE").otherwise("REAL"),
                "basis": F.when(F.col("toxic") == 1, "fact_check").otherwise("source"),
            }
        )
    )


def corpus(spark, folder) -> DataFrame:
    return corpus_rows(labelled(spark, folder), "id")


def incoming(spark, folder) -> DataFrame:
    """Every paste as a row to load, one file per language, with evidence by source."""
    grade = F.element_at(
        F.create_map(F.lit("src3"), F.lit("fact_check"), F.lit("src5"), F.lit("hearsay")), F.col("source")
    )
    return pastes(spark, folder).select(
        F.when(F.col("lang") == "en", 1).otherwise(2).alias("file_no"),
        F.col("id").alias("pos"),
        F.when(F.col("lang") == "en", "english.csv").otherwise("other.csv").alias("file"),
        "headline",
        "body",
        F.when(F.col("id") % 2 == 0, "FAKE").otherwise("REAL").alias("label"),
        "source",
        F.coalesce(grade, F.lit("source")).alias("basis"),
        normalize_headline(F.col("headline")).alias("key"),
    )


def piles(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(training pile, exam): sources src0-src9 and src10-src19."""
    rows = pastes(spark, folder).withColumnRenamed("headline", "title").withColumnRenamed("body", "text")
    teach = F.length("source") == 4
    return rows.filter(teach), rows.filter(~teach)


def marked(spark, folder) -> DataFrame:
    """doc_id, lang, source, raw: whole documents behind a publisher marker."""
    marker = F.element_at(F.array(*map(F.lit, MARKERS)), (F.col("doc_id") % len(MARKERS)).cast("int") + 1)
    return documents(spark, folder).select("doc_id", "lang", "source", F.concat(marker, "text").alias("raw"))


def scored_exam(spark, folder, with_event: bool = False) -> DataFrame:
    """event_id, score, truth: scores pushed to both ends, truth a noisy version."""

    def spread(x):
        return F.when(x < 0.5, 2 * x * x).otherwise(1 - 2 * (1 - x) * (1 - x))

    x = F.col("value") / (F.col("value") + 35)
    noise = ((F.col("event_id") * 7919 % 1000) / 1000 - 0.5) * 0.35
    rows = table(spark, folder, "events").select("event_id", "ts", "event_type", x.alias("x"), noise.alias("noise"))
    once = rows.withColumn("once", spread(F.col("x")))
    return once.select(
        *(("event_id", "ts", "event_type") if with_event else ("event_id",)),
        spread(F.col("once")).alias("score"),
        F.when(F.col("x") + F.col("noise") > 0.5, 1).otherwise(0).alias("truth"),
    )


def halves(spark, folder) -> tuple[DataFrame, DataFrame]:
    split = stratified_split(scored_exam(spark, folder), "truth", "event_id", 0.5, out="chooses")
    return split.filter("chooses"), split.filter(~F.col("chooses"))


def digest_scorer(df: DataFrame, text: str) -> DataFrame:
    """A deterministic score for checks of the cascade, from the text's digest."""
    return df.withColumn("fake_score", F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") / 16777215.0)


def request_log(spark, folder) -> DataFrame:
    """Scored requests over time: id, analyzed_at, method, fake_score, requested."""
    return scored_exam(spark, folder, with_event=True).select(
        F.col("event_id").alias("id"),
        F.col("score").alias("fake_score"),
        F.col("ts").alias("analyzed_at"),
        F.when(F.col("event_type") == "error", "database").otherwise("reading_model").alias("method"),
        (F.col("event_type") == "signup").alias("requested"),
    )


def web_replies(spark, folder) -> DataFrame:
    """conv_id, turn, reply: raw search replies of every shape around each turn's text."""
    t, kind = F.col("text"), (F.col("conv_id") + F.col("turn")) % 8
    first_line = F.substring_index(t, "\n", 1)

    def answer(verdict, confidence, reporting, debunking, rating):
        return F.to_json(
            F.struct(
                F.lit(verdict).alias("verdict"),
                F.lit(confidence).alias("confidence"),
                reporting.alias("reporting"),
                debunking.alias("debunking"),
                t.alias("summary"),
                F.lit(rating).alias("factcheck_rating"),
            )
        )

    none = F.array().cast("array<string>")
    names = F.array(first_line, F.lit("None"), F.lit("  BBC  "), F.lit("n/a"), F.col("role"))
    many = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("Outlet "), i.cast("string")))
    real = answer("REAL", "High", names, none, None)
    fake = answer(" fake ", "sure", many, names, "Pants on fire")
    blank = answer("UNCLEAR", "low", F.array(F.lit("null")), none, "None")
    lone = answer("maybe", "medium", first_line, none, "")
    body = (
        F.when(kind == 0, real)
        .when(kind == 1, F.concat(F.lit("```json\n"), fake, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here you go: "), real, F.lit(" Hope it helps.")))
        .when(kind.isin(3, 4), F.concat(F.lit("I could not say. "), t))
        .when(kind == 6, blank)
        .otherwise(lone)
    )
    page = F.concat(F.lit("https://news.example.com/"), F.col("conv_id").cast("string"))
    title = F.when(F.col("turn") % 2 == 0, first_line)
    chunk = F.struct(F.struct(page.alias("uri"), title.alias("title")).alias("web"))
    grounding = F.struct(
        F.when(kind != 4, F.array(chunk, chunk)).alias("groundingChunks"),
        F.array(F.lit("query one"), first_line).alias("webSearchQueries"),
    )
    parts = F.array(F.struct(body.alias("text")), F.struct(F.lit(" ").alias("text")))
    candidate = F.struct(F.struct(parts.alias("parts")).alias("content"), grounding.alias("groundingMetadata"))
    answered = F.to_json(F.struct(F.array(candidate).alias("candidates")))
    reply = F.when(kind == 5, '{"error": {"code": 500}}').otherwise(answered)
    return table(spark, folder, "conversations").select("conv_id", "turn", reply.alias("reply"))
