"""Second opinions from the web: whom to ask about, and what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions.chars import strip
from pressgauge.operators.calibration import SEARCHES_PER_DAY, in_band

# Accepted answers, list and text limits.
VERDICTS, CONFIDENCES = ["REAL", "FAKE", "UNCLEAR"], ["high", "medium", "low"]
NOT_A_NAME = ["none", "null", "n/a"]
LIST_ITEMS, QUERY_ITEMS, SOURCE_ITEMS = 8, 5, 8
NAME_CHARS, TITLE_CHARS, SUMMARY_CHARS, RAW_SUMMARY_CHARS, RATING_CHARS = 80, 100, 400, 300, 60
NO_CONTENT, NO_JSON = "reply had no usable content", "could not read the reply as JSON"


def web_check_queue(
    analyzed: DataFrame, low: float | None, high: float | None, per_day: int = SEARCHES_PER_DAY, requested: str = "requested"
) -> DataFrame:
    """Model verdicts worth a search, with the reason, their turn on the day and whether
    that is within the day's allowance (first come, first served); none is left out.
    Without a measured band only requests qualify.

    A day's rows are numbered minute by minute, so that a busy day is many tasks' work.
    """
    band = F.lit(False) if low is None or high is None else in_band(F.col("fake_score"), low, high)
    asked = F.coalesce(F.col(requested), F.lit(False))
    wanted = analyzed.filter((F.col("method") == "reading_model") & (band | asked)).withColumn(
        "reason", F.when(band, "unsure").otherwise("requested")
    )
    timed = wanted.withColumns({"__day": F.to_date("analyzed_at"), "__minute": F.date_trunc("minute", "analyzed_at")})
    earlier = Window.partitionBy("__d").orderBy(F.col("__m").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    minutes = timed.groupBy(F.col("__day").alias("__d"), F.col("__minute").alias("__m")).agg(F.count(F.lit(1)).alias("__n"))
    minutes = minutes.select("__m", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__minute").orderBy("analyzed_at", "id"))
    turn = (F.col("__before") + F.col("__turn")).cast("int")
    numbered = timed.withColumn("__turn", inside).join(minutes, F.col("__minute").eqNullSafe(F.col("__m")))
    queue = numbered.withColumn("turn", turn).withColumn("within_allowance", F.col("turn") <= per_day)
    return queue.drop("__day", "__minute", "__turn", "__m", "__before")


def clean_list(items: Column, limit: int = LIST_ITEMS) -> Column:
    """Array of names: trimmed, non-names dropped, cut to size; null becomes empty."""
    trimmed = F.transform(items, lambda x: strip(F.coalesce(x, F.lit("none"))))
    named = F.filter(trimmed, lambda x: (x != "") & ~F.lower(x).isin(NOT_A_NAME))
    cut = F.transform(named, lambda x: F.substring(x, 1, NAME_CHARS))
    return F.coalesce(F.slice(cut, 1, limit), F.array().cast("array<string>"))


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _names(value: Column, path: str, limit: int) -> Column:
    """A list, or one bare string, under `path`."""
    one = _get(value, path, "string")
    many = _get(value, path, "array<string>")
    bare = F.when(F.schema_of_variant(F.coalesce(_get(value, path, "variant"), F.parse_json(F.lit("null")))) == "STRING", one)
    return clean_list(F.coalesce(many, F.when(bare.isNotNull(), F.array(bare))), limit)


def _object(text: Column) -> Column:
    """The JSON object in a reply that may carry a code fence or a sentence around it."""
    bare = F.regexp_replace(strip(text), r"(?m)^\s*```(?:json)?|```\s*$", "")
    start = F.instr(bare, "{")
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    whole = F.try_parse_json(bare)
    return F.coalesce(whole, F.when((start > 0) & (braces != ""), F.try_parse_json(braces)))


def normalize_web_replies(replies: DataFrame, reply: str = "reply", elapsed: str | None = None) -> DataFrame:
    """Add `web_check`, the flat record of one stored reply (JSON text).

    A search that ran and found nothing ('nothing') stays apart from one that did
    not complete ('unavailable').
    """
    envelope = F.try_parse_json(F.col(reply))
    parts = F.transform(
        _get(F.col("__env"), "$.candidates[0].content.parts", "array<variant>"),
        lambda p: F.coalesce(_get(p, "$.text", "string"), F.lit("")),
    )
    chunks = F.slice(
        F.coalesce(
            _get(F.col("__env"), "$.candidates[0].groundingMetadata.groundingChunks", "array<variant>"),
            F.array().cast("array<variant>"),
        ),
        1,
        SOURCE_ITEMS,
    )

    def source(chunk: Column) -> Column:
        url = _get(chunk, "$.web.uri", "string")
        title = F.nullif(_get(chunk, "$.web.title", "string"), F.lit(""))
        return F.struct(F.substring(F.coalesce(title, url), 1, TITLE_CHARS).alias("title"), url.alias("url"))

    sources = F.filter(F.transform(chunks, source), lambda s: s["url"].isNotNull() & (s["url"] != ""))
    parsed = F.when(F.schema_of_variant(F.col("__obj")).startswith("OBJECT"), F.col("__obj"))

    verdict = F.upper(strip(_get(F.col("__obj"), "$.verdict", "string")))
    confidence = F.lower(strip(_get(F.col("__obj"), "$.confidence", "string")))
    rating = strip(_get(F.col("__obj"), "$.factcheck_rating", "string"))
    read = replies.withColumn("__env", envelope).withColumns(
        {
            "__text": F.array_join(parts, ""),
            "__sources": sources,
            "__queries": _names(F.col("__env"), "$.candidates[0].groundingMetadata.webSearchQueries", QUERY_ITEMS),
        }
    )
    read = read.withColumn("__obj", _object(F.col("__text"))).withColumn("__obj", parsed)
    read = read.withColumns(
        {
            "__verdict": F.when(verdict.isin(VERDICTS), verdict).otherwise("UNCLEAR"),
            "__confidence": F.when(confidence.isin(CONFIDENCES), confidence),
            "__reporting": _names(F.col("__obj"), "$.reporting", LIST_ITEMS),
            "__debunking": _names(F.col("__obj"), "$.debunking", LIST_ITEMS),
            "__rating": F.when(~F.lower(rating).isin(NOT_A_NAME + [""]), F.substring(rating, 1, RATING_CHARS)),
            "__summary": F.substring(
                strip(F.coalesce(_get(F.col("__obj"), "$.summary", "string"), F.lit(""))), 1, SUMMARY_CHARS
            ),
        }
    )
    usable, as_json = F.col("__text").isNotNull(), F.col("__obj").isNotNull()
    empty = (
        (F.size("__reporting") == 0)
        & (F.size("__debunking") == 0)
        & F.col("__rating").isNull()
        & (F.col("__verdict") == "UNCLEAR")
    )
    status = (
        F.when(~usable, "unavailable")
        .when(~as_json, F.when(F.size("__sources") > 0, "found").otherwise("unavailable"))
        .when(empty, "nothing")
        .otherwise("found")
    )
    none = F.array().cast("array<string>")
    no_sources = F.array().cast("array<struct<title:string,url:string>>")
    record = F.struct(
        status.alias("status"),
        F.when(usable, F.col("__verdict")).alias("verdict"),
        F.col("__confidence").alias("confidence"),
        F.when(~usable, "")
        .when(~as_json, F.substring(strip(F.col("__text")), 1, RAW_SUMMARY_CHARS))
        .otherwise(F.col("__summary"))
        .alias("summary"),
        F.when(as_json, F.col("__reporting")).otherwise(none).alias("reporting"),
        F.when(as_json, F.col("__debunking")).otherwise(none).alias("debunking"),
        F.col("__rating").alias("factcheck_rating"),
        F.when(usable, F.col("__sources")).otherwise(no_sources).alias("sources"),
        F.when(usable, F.col("__queries")).otherwise(none).alias("queries"),
        F.when(~usable, NO_CONTENT).when(~as_json, NO_JSON).alias("error"),
        F.round(F.col(elapsed) if elapsed else F.lit(0.0), 2).alias("elapsed"),
    )
    return read.withColumn("web_check", record).select(*replies.columns, "web_check")


WEB_CHECK = (
    "struct<status:string,verdict:string,confidence:string,summary:string,reporting:array<string>,debunking:array<string>,"
    "factcheck_rating:string,sources:array<struct<title:string,url:string>>,queries:array<string>,error:string,"
    "elapsed:double,reason:string>"
)


def attach_web_checks(
    analyzed: DataFrame, read: DataFrame, low: float | None, high: float | None, requested: str = "search_web"
) -> DataFrame:
    """Add `web_check` to answered requests: what a search said where the model is unsure or
    one was asked for, with that reason; null where none ran. Verdicts stay as they are.

    `read` has id and the record of `normalize_web_replies`. A search that brought no
    record is 'unavailable', which is neither 'nothing' nor null.
    """
    band = F.lit(False) if low is None or high is None else in_band(F.col("fake_score"), low, high)
    asked = F.coalesce(F.col(requested), F.lit(False)) if requested in analyzed.columns else F.lit(False)
    wanted = (F.col("method") == "reading_model") & (band | asked)
    reason = F.when(band, "unsure").otherwise("requested")
    blank = F.from_json(F.lit('{"status": "unavailable", "error": "no reply"}'), WEB_CHECK)
    found = read.select(F.col("id").alias("__id"), F.col("web_check").alias("__reply"))
    joined = analyzed.withColumn("__ask", F.when(wanted, F.col("id"))).join(found, F.col("__ask") == F.col("__id"), "left")
    record = F.coalesce(F.col("__reply").withField("reason", reason).cast(WEB_CHECK), blank.withField("reason", reason))
    return joined.withColumn("web_check", F.when(F.col("__ask").isNotNull(), record)).drop("__ask", "__id", "__reply")


def flag_disagreement(df: DataFrame, label: str = "result_label") -> DataFrame:
    """Add `disagrees`: the web found the opposite of the model's verdict."""
    web = F.col("web_check")
    against = ((web["verdict"] == "REAL") & (F.col(label) == "Likely Fake")) | (
        (web["verdict"] == "FAKE") & (F.col(label) == "Likely Real")
    )
    return df.withColumn("disagrees", F.coalesce((web["status"] == "found") & against, F.lit(False)))
