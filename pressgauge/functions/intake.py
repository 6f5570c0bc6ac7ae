"""Language and length measurements, and the gates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import wording
from pressgauge.functions.chars import count_chars, strip

# Limits and floors.
MIN_WORDS = 25
MAX_WORDS = 400
LATIN_FLOOR = 0.85
ENGLISH_FLOOR = 0.10

# English function words.
ENGLISH_MARKERS = (
    "the of and to in a is that for it on was with as at by from be this "
    "have or an not are but had has were they which you we their all been more will "
    "would there can who said one about when what so its if out up says"
).split()

PROBLEM = "struct<code:string,message:string,detail:map<string,double>>"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(r"[\p{L}\p{N}_'-]+"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def latin_share(text: Column) -> Column:
    """ASCII letters among all letters; 0.0 without letters."""
    text = _text(text)
    return _share(count_chars(text, "A-Za-z"), count_chars(text, r"\p{L}"))


def english_share(text: Column) -> Column:
    """Function words among all words; a token must equal one ("it's" is not "it")."""
    words = F.regexp_extract_all(F.lower(_text(text)), F.lit("[a-z']+"), F.lit(0))
    return _share(F.size(F.filter(words, lambda w: w.isin(ENGLISH_MARKERS))), F.size(words))


def _problem(code: str, message: Column, **detail: Column) -> Column:
    pairs = [item for name, value in detail.items() for item in (F.lit(name), value.cast("double"))]
    found = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")
    return F.struct(F.lit(code).alias("code"), message.alias("message"), found.alias("detail")).cast(PROBLEM)


def problem_from(blank: Column, words: Column, latin: Column, english: Column) -> Column:
    """The first failing check, given the measurements; null when all pass."""
    return (
        F.when(blank, _problem("empty", F.lit(wording.EMPTY)))
        .when(
            words > MAX_WORDS,
            _problem(
                "too_long", F.format_string(wording.TOO_LONG, words.cast("long"), F.lit(MAX_WORDS)), words=words
            ),
        )
        .when(
            latin < LATIN_FLOOR,
            _problem("not_english", F.lit(wording.NOT_ENGLISH), latin_share=F.round(latin, 3)),
        )
        .when(
            (words >= MIN_WORDS) & (english < ENGLISH_FLOOR),
            _problem("not_english_prose", F.lit(wording.NOT_ENGLISH_PROSE), english_share=F.round(english, 3)),
        )
    )


def check_input(text: Column) -> Column:
    """Problem struct saying why `text` is refused, or null. There is no minimum
    length: a short headline can still be looked up."""
    text = strip(_text(text))
    return problem_from(text == "", word_count(text), latin_share(text), english_share(text))


def check_long_enough(text: Column) -> Column:
    """Problem struct when a text is too short for a model, else null."""
    words = word_count(text)
    message = F.format_string(
        wording.TOO_SHORT, words, F.when(words == 1, "").otherwise("s"), F.lit(MIN_WORDS)
    )
    return F.when(words < MIN_WORDS, _problem("too_short_for_model", message, words=words))


def measure_input(df: DataFrame, text: str) -> DataFrame:
    """Add words, latin_share and english_share (unrounded) of the stripped text."""
    stripped = strip(_text(F.col(text)))
    return df.withColumns(
        {
            "words": word_count(stripped),
            "latin_share": latin_share(stripped),
            "english_share": english_share(stripped),
        }
    )


def describe_input(df: DataFrame, text: str) -> DataFrame:
    """Add words, both shares to three decimals, and the problem code."""
    measured = measure_input(df, text)
    problem = problem_from(
        strip(_text(F.col(text))) == "", F.col("words"), F.col("latin_share"), F.col("english_share")
    )
    return measured.withColumn("problem", problem["code"]).withColumns(
        {name: F.round(name, 3) for name in ("latin_share", "english_share")}
    )


def gate(requests: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): refused rows carry code and message and go no further.

    The verdict leaves a generator rather than a filter, which the optimizer would
    push below the measurements and work out twice.
    """
    measured = measure_input(requests, text)
    blank = strip(_text(F.col(text))) == ""
    problem = problem_from(blank, F.col("words"), F.col("latin_share"), F.col("english_share"))
    own = [F.col(c) for c in requests.columns]
    passed = F.when(problem.isNull(), F.array(F.lit(True)))
    accepted = measured.select(*own, F.explode(passed).alias("__passed")).drop("__passed")
    refused = measured.select(*own, F.explode(F.array_compact(F.array(problem))).alias("__problem"))
    return accepted, refused.select(*own, "__problem.code", "__problem.message", "__problem.detail")
