"""The labelled corpus: evidence ranking, top-up, status, key upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions.chars import strip
from pressgauge.functions.matching import body_key, build_extract, has_key, keep_keyed, normalize_headline

# How far each kind of evidence is trusted; smaller is better.
FACT_CHECK, SOURCE = "fact_check", "source"
BASIS_RANKS = {FACT_CHECK: 0, SOURCE: 1}
UNKNOWN_RANK = 99
ALL_RANKS = (0, 1, UNKNOWN_RANK)

# Column widths of the stored corpus.
HEADLINE_CHARS, HEADLINE_KEY_CHARS, BODY_KEY_CHARS = 1000, 1000, 400

CORPUS_SCHEMA = (
    "id long, headline string, headline_key string, article_text string, body_key string, "
    "label string, source string, label_basis string"
)
OUTCOMES = ("added", "better_evidence", "already_had", "unusable")


def basis_rank(basis: Column) -> Column:
    ranked = F.when(basis == FACT_CHECK, BASIS_RANKS[FACT_CHECK]).when(basis == SOURCE, BASIS_RANKS[SOURCE])
    return ranked.otherwise(UNKNOWN_RANK)


def label_binary(label: Column) -> Column:
    """1 = FAKE, anything else 0."""
    return F.when(F.upper(label) == "FAKE", 1).otherwise(0)


def corpus_label(label: Column) -> Column:
    """Anything but FAKE counts as real in a match."""
    return F.when(label == "FAKE", "Likely Fake").otherwise("Likely Real")


def is_fact_checked(basis: Column) -> Column:
    return F.coalesce(basis == FACT_CHECK, F.lit(False))


def describe_basis(label: Column, source: Column, basis: Column) -> Column:
    verb = F.when(is_fact_checked(basis), "fact-checked").otherwise("labelled")
    return F.concat(verb, F.lit(" "), label, F.lit(" by "), source)


def corpus_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Shape (headline, body, label, source, basis) as stored corpus columns, after
    the `keep` columns. The opening key is taken from the stored extract, so that
    both always agree."""
    extract = build_extract(F.col("body"))
    return df.select(
        *keep,
        F.substring(strip(F.col("headline")), 1, HEADLINE_CHARS).alias("headline"),
        F.substring(normalize_headline(F.col("headline")), 1, HEADLINE_KEY_CHARS).alias("headline_key"),
        extract.alias("article_text"),
        F.substring(body_key(extract), 1, BODY_KEY_CHARS).alias("body_key"),
        "label",
        "source",
        F.col("basis").alias("label_basis"),
    )


def held_ranks(corpus: DataFrame) -> DataFrame:
    """Best (smallest) evidence rank held per headline key."""
    return corpus.groupBy(F.col("headline_key").alias("key")).agg(
        F.min(basis_rank(F.col("label_basis"))).alias("held_rank")
    )


def _insertions(corpus: DataFrame, incoming: DataFrame) -> DataFrame:
    """(file_no, pos, outcome) of the rows a one-by-one load would insert.

    A row goes in when its rank beats everything held and everything earlier with
    its key. Ranks take three values only, so per key it is enough to know where
    each rank first appears: at most three rows per key can go in. That is a
    partial aggregate, with no per-key window over the copies of a popular headline.
    """
    place = F.struct("file_no", "pos")
    rank = basis_rank(F.col("basis"))
    first = (
        keep_keyed(incoming, "key")
        .groupBy("key")
        .agg(*[F.min(F.when(rank == r, place)).alias(f"first_{r}") for r in ALL_RANKS])
        .join(held_ranks(corpus), "key", "left")
    )
    candidates = []
    for i, r in enumerate(ALL_RANKS):
        here = F.col(f"first_{r}")
        beats_held = F.col("held_rank").isNull() | (F.lit(r) < F.col("held_rank"))
        beats_earlier = F.lit(True)
        for better in ALL_RANKS[:i]:
            other = F.col(f"first_{better}")
            beats_earlier = beats_earlier & (other.isNull() | (here < other))
        earliest = F.least(*[F.col(f"first_{q}") for q in ALL_RANKS])
        outcome = F.when(F.col("held_rank").isNull() & (here == earliest), "added").otherwise("better_evidence")
        candidates.append(
            F.when(
                here.isNotNull() & beats_held & beats_earlier,
                F.struct(here["file_no"].alias("file_no"), here["pos"].alias("pos"), outcome.alias("outcome")),
            )
        )
    return first.select(F.explode(F.array_compact(F.array(*candidates))).alias("row")).select("row.*")


def top_up(corpus: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, outcome of every incoming row) of loading `incoming` in order.

    `incoming` has file_no, pos, file, headline, body, label, source, basis, key.
    New rows keep file_no and pos, which give them their ids on append.
    """
    inserted = _insertions(corpus, incoming)
    wanted = incoming.join(inserted.select("file_no", "pos"), ["file_no", "pos"], "left_semi")
    decided = incoming.select("file_no", "pos", "file", "key").join(inserted, ["file_no", "pos"], "left")
    decided = decided.withColumn(
        "outcome",
        F.when(~has_key(F.col("key")), "unusable").otherwise(F.coalesce("outcome", F.lit("already_had"))),
    )
    return corpus_rows(wanted, "file_no", "pos"), decided


def load_report(corpus: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome counts per file (by number: names may repeat) and in total (file null), one
    aggregate over the rows plus the few that went in; no row-level join is needed to count."""
    seen = incoming.select("file_no", "file", F.when(has_key(F.col("key")), "seen").otherwise("unusable").alias("what"))
    files = incoming.groupBy("file_no").agg(F.min("file").alias("file"))
    gone_in = _insertions(corpus, incoming).join(files, "file_no").select("file_no", "file", F.col("outcome").alias("what"))

    def tally(*whats: str) -> Column:
        return F.count(F.when(F.col("what").isin(*whats), 1))

    inserted = tally("added", "better_evidence")
    return (
        seen.unionByName(gone_in)
        .rollup("file_no")
        .agg(
            F.when(F.grouping_id() == 0, F.min("file")).alias("file"),
            tally("seen", "unusable").alias("rows_read"),
            inserted.alias("inserted"),
            tally("added").alias("added"),
            tally("better_evidence").alias("better_evidence"),
            (tally("seen") - inserted).alias("already_had"),
            tally("unusable").alias("unusable"),
        )
        .drop("file_no")
    )


def corpus_status(corpus: DataFrame) -> DataFrame:
    """Row counts: in total, per basis and per source, in one pass."""
    columns = [F.col("label_basis"), F.col("source")]
    sets = corpus.groupingSets([[], [columns[0]], [columns[1]]], *columns).agg(
        F.count(F.lit(1)).alias("articles"), F.grouping_id().alias("set")
    )
    # Bits of the grouping id: 2 = basis left out, 1 = source left out.
    return sets.select(
        F.when(F.col("set") == 3, "total").when(F.col("set") == 1, "basis").otherwise("source").alias("scope"),
        F.when(F.col("set") == 3, "all").when(F.col("set") == 1, F.col("label_basis")).otherwise(F.col("source")).alias("name"),
        "articles",
    )


def merge_new(existing: DataFrame, incoming: DataFrame, title: str = "title") -> DataFrame:
    """All of `existing` plus the incoming rows whose normalised title is not in it."""
    key = normalize_headline(F.col(title)).alias("__key")
    have = existing.select(key).distinct()
    fresh = incoming.withColumn("__key", key).join(have, "__key", "left_anti").drop("__key")
    return existing.unionByName(fresh, allowMissingColumns=True)


def backfill_body_keys(corpus: DataFrame) -> DataFrame:
    """Fill the opening key of every row that has text enough for one."""
    fresh = body_key(F.col("article_text"))
    return corpus.withColumn("body_key", F.when(has_key(fresh), fresh).otherwise(F.col("body_key")))


def clear_body_keys(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("body_key", F.lit(""))
