"""Article files.

`pos` orders rows by file name, then by place in the file. A file whose quoted fields hold newlines is still read by as
many tasks as it has byte ranges (`records`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions.chars import strip
from pressgauge.functions.matching import full_text, normalize_headline
from pressgauge.operators.corpus import SOURCE, label_binary
from pressgauge.sources import records

# Texts a data frame reader takes for a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The known collections.
DATASETS = {
    "fake": {"path": "Fake.csv", "source": "Kaggle ISOT", "label": "FAKE", "basis": SOURCE},
    "true": {"path": "True.csv", "source": "Kaggle ISOT", "label": "REAL", "basis": SOURCE},
    "mixed": {"path": "fake_or_real_news.csv", "source": "McIntire", "label": None, "basis": SOURCE},
}

RAW_CRAWL = "id string, type string, domain string, scraped_at string, url string, authors string, title string, content string"


def read_article_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with quoted newlines, every column a string, missing values null."""
    return _read_article_csv(spark, path).drop("pos")


def _read_article_csv(spark: SparkSession, path: str, one_table: bool = False) -> DataFrame:
    # for the names only: this reads no more than the first record
    names = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False).columns
    read = records.read_records(spark, path, one_table).filter("number > 0")
    read = read.select(records.position().alias("pos"), records.fields(F.col("text"), names).alias("f"))
    return read.select(*[_or_null(F.col(f"f.`{c}`")).alias(c) for c in names], "pos")


def _or_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING), text)


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    source: str,
    label: str | None = None,
    basis: str = SOURCE,
    title_col: str = "title",
    text_col: str = "text",
    label_col: str = "label",
    file_no: int = 0,
    one_table: bool = False,
) -> DataFrame:
    """One labelled file as top-up input: file_no, pos, file, headline, body, label,
    source, basis, key. Rows without a headline (or without a needed label) go.
    one_table: a folder's files are parts of one file, and pos counts through them."""
    df = _read_article_csv(spark, path, one_table)
    for column, hint in ((title_col, "title"), (None if label else label_col, "label")):
        if column and column not in df.columns:
            raise ValueError(f"{path} has no {hint} column {column!r}; found {df.columns}")
    df = df.filter(F.col(title_col).isNotNull())
    if label is None:
        df = df.filter(F.col(label_col).isNotNull())
    body = F.coalesce(F.col(text_col), F.lit("")) if text_col in df.columns else F.lit("")
    return df.select(
        F.lit(file_no).alias("file_no"),
        "pos",
        F.lit(path.rsplit("/", 1)[-1]).alias("file"),
        F.col(title_col).alias("headline"),
        body.alias("body"),
        (F.lit(label.upper()) if label else F.upper(strip(F.col(label_col)))).alias("label"),
        F.lit(source).alias("source"),
        F.lit(basis).alias("basis"),
        normalize_headline(F.col(title_col)).alias("key"),
    )


def load_datasets(spark: SparkSession, folder: str, only: list[str] | None = None, **columns) -> DataFrame:
    """The known collections (or some of them) in their fixed order."""
    names = list(DATASETS) if only is None else only
    unknown = [n for n in names if n not in DATASETS]
    if unknown:
        raise ValueError(f"unknown datasets {unknown}; known are {list(DATASETS)}")
    parts = [
        read_labelled_csv(
            spark, f"{folder}/{d['path']}", d["source"], d["label"], d["basis"], file_no=n, **columns
        )
        for n, d in enumerate(DATASETS[name] for name in names)
    ]
    return reduce(DataFrame.unionByName, parts)


def load_collections(piles: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Stack (title, text, label, ...) piles with their name as `collection`; rows need
    text, and headline and text are joined as `raw`."""
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [pile.withColumn("collection", F.lit(name)) for name, pile in piles.items()],
    )
    stacked = stacked.filter(F.col("text").isNotNull()).withColumns(
        {
            "title": F.coalesce("title", F.lit("")),
            label: F.upper(strip(F.col(label))),
            "raw": full_text(F.col("title"), F.col("text")),
        }
    )
    return stacked.filter(F.col("raw") != "").withColumn("label_binary", label_binary(F.col(label)))


def read_raw_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Eight-column crawl dump without a header; only rows with exactly eight fields
    and an all-digit id are whole articles."""
    names = [part.split()[0] for part in RAW_CRAWL.split(", ")]
    read = records.read_records(spark, path).select(
        records.position().alias("pos"), records.fields(F.col("text"), names, "_broken").alias("f")
    )
    whole = F.col("f._broken").isNull() & F.col("f.id").rlike("^[0-9]+$")
    filled = [F.coalesce(f"f.{c}", F.lit("")).alias(c) for c in names if c != "id"]
    return read.filter(whole).select("pos", "f.id", *filled)


def read_real_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Newsroom crawl: publication, title, article, url, date; the rest is ignored."""
    df = _read_article_csv(spark, path)
    return df.select("pos", "publication", "title", "article", "url", "date")
