"""Every query by name: (spark, folder) -> DataFrame over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pressgauge.functions import fingerprints, intake, matching
from pressgauge.operators import calibration, corpus, learning, linear, metrics, report, sampling, selection, survey, verdict, web
from pressgauge.plans import standins as data
from pressgauge.session import checkpoint_folder, cut_lineage
from pressgauge.sources import articles, index, loads, registry, store
from pressgauge.streaming import allowance

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _scratch(spark, name: str) -> str:
    """A fresh folder where every executor can write: the cluster's shared one."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- text functions -------------------------------------------------------------


@query
def normalize_headlines(spark, folder):
    docs = data.documents(spark, folder)
    pasted = matching.split_paste(F.col("text"))
    return docs.select(
        "doc_id",
        matching.normalize_headline(pasted["headline"]).alias("headline_key"),
        F.md5(matching.normalize_headline(F.col("text"))).alias("text_digest"),
    )


@query
def body_keys(spark, folder):
    keyed = verdict.keyed_requests(data.pastes(spark, folder))
    return keyed.select("id", "body_key", "paste_key")


@query
def simple_keys(spark, folder):
    return data.documents(spark, folder).select(
        "doc_id", F.md5(matching.simple_key(F.col("text"))).alias("simple_digest"),
        matching.simple_key(matching.split_paste(F.col("text"))["headline"]).alias("simple_key"),
    )


@query
def build_extracts(spark, folder):
    return data.pastes(spark, folder).select("id", matching.build_extract(F.col("body")).alias("extract"))


@query
def display_headlines(spark, folder):
    shown = matching.display_headline(F.col("headline"), F.col("body"))
    return data.pastes(spark, folder).select(
        "id", shown["headline"].alias("headline"), F.md5(shown["body"]).alias("body_digest")
    )


@query
def full_texts(spark, folder):
    text = matching.full_text(F.col("headline"), F.col("body"))
    return data.pastes(spark, folder).select("id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


@query
def clean_text(spark, folder):
    cleaned = data.marked(spark, folder).withColumn("cleaned", fingerprints.clean_article_text(F.col("raw")))
    return cleaned.select("doc_id", F.length("cleaned").alias("chars"), F.md5("cleaned").alias("digest"))


@query
def fingerprint_counts(spark, folder):
    hits = [c.alias(n.replace(" ", "_").replace("-", "_")) for n, c in zip(fingerprints.rule_names(), fingerprints.fingerprint_hits(F.col("raw")))]
    return data.marked(spark, folder).select("doc_id", *hits)


@query
def fingerprint_map(spark, folder):
    counted = fingerprints.count_fingerprints(F.col("raw"))
    return data.marked(spark, folder).select("doc_id", F.explode(counted).alias("rule", "hits"))


@query
def fingerprint_survey(spark, folder):
    return survey.survey_fingerprints(data.marked(spark, folder), "raw", "lang", "source")


@query
def cleaning_loss(spark, folder):
    return survey.cleaning_loss(data.marked(spark, folder), "raw")


@query
def input_profile(spark, folder):
    described = intake.describe_input(data.documents(spark, folder), "text")
    return described.select("doc_id", "words", "latin_share", "english_share", "problem")


@query
def input_gate(spark, folder):
    _, refused = intake.gate(data.documents(spark, folder).select("doc_id", "text"), "text")
    return refused.select("doc_id", "code", "message")


@query
def gate_summary(spark, folder):
    checked = intake.describe_input(data.documents(spark, folder), "text")
    return checked.groupBy(F.coalesce("problem", F.lit("accepted")).alias("code")).agg(F.count(F.lit(1)).alias("articles"))


@query
def too_short_for_model(spark, folder):
    problem = intake.check_long_enough(F.concat_ws(" ", "headline", "body"))
    found = data.pastes(spark, folder).select("id", F.explode(F.array_compact(F.array(problem))).alias("p"))
    return found.select("id", "p.code", "p.message")


# --- corpus ----------------------------------------------------------------------


@query
def corpus_table(spark, folder):
    return data.corpus(spark, folder)


@query
def basis_descriptions(spark, folder):
    return data.corpus(spark, folder).select(
        "id",
        corpus.basis_rank(F.col("label_basis")).alias("basis_rank"),
        corpus.is_fact_checked(F.col("label_basis")).alias("fact_checked"),
        corpus.describe_basis(F.col("label"), F.col("source"), F.col("label_basis")).alias("described"),
    )


@query
def held_ranks(spark, folder):
    return corpus.held_ranks(data.corpus(spark, folder))


@query
def corpus_status(spark, folder):
    return corpus.corpus_status(data.corpus(spark, folder))


@query
def corpus_top_up(spark, folder):
    new_rows, _ = corpus.top_up(data.corpus(spark, folder), data.incoming(spark, folder))
    return new_rows


@query
def top_up_outcomes(spark, folder):
    _, decided = corpus.top_up(data.corpus(spark, folder), data.incoming(spark, folder))
    return decided.select("pos", "file", "outcome")


@query
def top_up_report(spark, folder):
    told = corpus.load_report(data.corpus(spark, folder), data.incoming(spark, folder))
    return told.withColumn("file", F.coalesce("file", F.lit("all files")))


@query
def backfill_keys(spark, folder):
    blanked = corpus.clear_body_keys(data.corpus(spark, folder))
    return corpus.backfill_body_keys(blanked).select("id", "body_key")


@query
def corpus_append(spark, folder):
    """Top up, store, read back: ids follow on from the largest held."""
    held = data.corpus(spark, folder)
    path = _scratch(spark, "corpus")
    held.write.parquet(path)
    stored = store.read_corpus(spark, path)
    new_rows, _ = corpus.top_up(stored, data.incoming(spark, folder))
    store.append_corpus(new_rows, path)
    return store.read_corpus(spark, path).select("id", "headline_key", "label_basis")


@query
def corpus_two_writers(spark, folder):
    """Two loads that share a third of their rows; the second is done while the first is at work, then tried again."""
    path = _scratch(spark, "loads")
    held, incoming = data.corpus(spark, folder), data.incoming(spark, folder)
    loads.load(spark, path, "held", lambda _: held.withColumns({"file_no": F.lit(0), "pos": F.col("id")}).drop("id"))
    parts = {"first": incoming.where("pos % 3 < 2"), "second": incoming.where("pos % 3 > 0")}

    def second():
        loads.load(spark, path, "second", lambda corpus_then: corpus.top_up(corpus_then, parts["second"])[0])

    def first(corpus_then):
        second()
        return corpus.top_up(corpus_then, parts["first"])[0]

    loads.load(spark, path, "first", first)
    second()
    return loads.read_loaded(spark, path).select("id", "headline_key", "label_basis")


@query
def merge_new(spark, folder):
    teach, exam = data.piles(spark, folder)
    return corpus.merge_new(teach, exam).select("id", "title", "source")


@query
def labelled_csv_scan(spark, folder):
    """Documents written as a labelled CSV and scanned back, newlines and all."""
    path = _scratch(spark, "csv")
    data.pastes(spark, folder).select(
        F.nullif("headline", F.lit("")).alias("title"), "body", F.concat(F.lit(" "), "lang", F.lit(" ")).alias("kind")
    ).write.option("header", True).option("escape", '"').csv(path)
    scanned = articles.read_labelled_csv(spark, path, "documents", text_col="body", label_col="kind")
    return scanned.select("key", "label", "source", "basis", F.md5("body").alias("body_digest"))


# --- lookup and verdicts ---------------------------------------------------------


@query
def headline_lookup(spark, folder):
    found = verdict.best_match(data.pastes(spark, folder), data.corpus(spark, folder))
    return found.select("id", F.col("match.id").alias("match_id"), "match.label", "match.label_basis")


@query
def body_lookup(spark, folder):
    found = verdict.best_match_by_body(data.pastes(spark, folder), data.corpus(spark, folder))
    return found.select("id", F.col("match.id").alias("match_id"), "door")


def _cascade(spark, folder):
    return verdict.analyze(
        data.pastes(spark, folder), data.corpus(spark, folder), data.digest_scorer, data.RECORD
    )


@query
def cascade(spark, folder):
    return _cascade(spark, folder).select(
        "id", "score", "label", "confidence", "method", "explanation", "matched_on", F.col("match.id").alias("match_id")
    )


@query
def cascade_indexed(spark, folder):
    """The cascade against a stored index that three top-ups built."""
    place, held = _scratch(spark, "index"), data.corpus(spark, folder)
    for n in (2, 0, 1):
        stored = index.add_to_index(held.where(F.col("id") % 3 == n), place, f"load-{n}", buckets=16)
    told = verdict.analyze(data.pastes(spark, folder), None, data.digest_scorer, data.RECORD, index=stored[:2])
    return told.select("id", "score", "label", "confidence", "method", "explanation", "matched_on", F.col("match.id").alias("match_id"))


@query
def cascade_by_method(spark, folder):
    """Flagship: how the cascade answers every document."""
    return _cascade(spark, folder).groupBy("method", "label").agg(F.count(F.lit(1)).alias("articles"))


@query
def cascade_without_record(spark, folder):
    """Own probability instead of measured precision when nothing was measured."""
    told = verdict.analyze(data.pastes(spark, folder), data.corpus(spark, folder), data.digest_scorer)
    return told.select("id", "score", "label", "confidence", "method", "explanation")


@query
def cascade_unavailable(spark, folder):
    told = verdict.analyze(data.pastes(spark, folder), data.corpus(spark, folder))
    return told.groupBy("method", "label", "score").agg(F.count(F.lit(1)).alias("articles"))


# --- training sets ---------------------------------------------------------------


@query
def leak_drop(spark, folder):
    teach, exam = data.piles(spark, folder)
    return selection.drop_leaks(exam, teach).select("id", "title")


@query
def blocklist(spark, folder):
    teach, exam = data.piles(spark, folder)
    return selection.taught_keys(teach, exam)


def _selected(spark, folder):
    spec = selection.fakes_spec(
        20, site="source", title="headline", body="body", position="id", kind="lang", kinds=["en", "fr", "de"]
    )
    known = data.labelled(spark, folder).filter("toxic = 1").withColumnRenamed("headline", "title")
    return selection.select_diverse(data.pastes(spark, folder), spec, selection.taught_keys(known))


@query
def diverse_select(spark, folder):
    return _selected(spark, folder).select("id", "source", "kept", "reason")


@query
def diverse_select_reals(spark, folder):
    names = [f"src{i}" for i in range(2, 18)]
    spec = selection.reals_spec(
        15, site="source", title="headline", body="body", position="id", deny=["src3", "src4"], allow=names
    )
    return selection.select_diverse(data.pastes(spark, folder), spec).select("id", "kept", "reason")


@query
def rejection_tally(spark, folder):
    return selection.rejection_tally(_selected(spark, folder))


@query
def selection_profile(spark, folder):
    return selection.selection_profile(_selected(spark, folder))


@query
def kept_per_site(spark, folder):
    return selection.kept_per(_selected(spark, folder))


@query
def target_trim(spark, folder):
    return selection.trim_to_target(_selected(spark, folder), "id", 100).select("id", "source")


@query
def diverse_set_rows(spark, folder):
    decided = _selected(spark, folder).withColumnRenamed("lang", "type")
    rows = store.diverse_rows(decided, "FAKE", ["title", "text", "label", "domain", "type"], "headline", "body", "domain")
    return rows.select("title", F.md5("text").alias("digest"), "label", "domain", "type")


@query
def spread_sample(spark, folder):
    docs = data.documents(spark, folder)
    return sampling.spread_sample(docs, "doc_id", 30, 4).select("doc_id", "source")


@query
def stratified_split(spark, folder):
    return sampling.stratified_split(data.documents(spark, folder), "lang", "doc_id", 0.2).select("doc_id", "held")


@query
def balanced_sample(spark, folder):
    rows = data.labelled(spark, folder).select("id", "label")
    return sampling.balanced_sample(rows, "label", "id", 100)


@query
def composition(spark, folder):
    teach, exam = data.piles(spark, folder)
    known = data.labelled(spark, folder).select("id", "label")
    stacked = articles.load_collections({"teach": teach.join(known, "id"), "exam": exam.join(known, "id")})
    return metrics.composition(stacked)


# --- calibration -----------------------------------------------------------------


@query
def cutoff_candidates(spark, folder):
    half_a, _ = data.halves(spark, folder)
    found = calibration.cutoff_candidates(half_a)
    return spark.createDataFrame(list(enumerate(found, start=1)), "position int, cutoff double")


def _sweep(spark, folder):
    half_a, _ = data.halves(spark, folder)
    return calibration.sweep(half_a, calibration.cutoff_candidates(half_a))


@query
def cutoff_sweep(spark, folder):
    return _sweep(spark, folder)


@query
def fixed_ladder_sweep(spark, folder):
    half_a, _ = data.halves(spark, folder)
    return calibration.sweep(half_a, calibration.FINE_LADDER)


@query
def choose_cutoff(spark, folder):
    return calibration.choose_cutoff(_sweep(spark, folder))


@query
def tradeoff_table(spark, folder):
    return calibration.tradeoff_table(_sweep(spark, folder))


@query
def verdict_stats(spark, folder):
    return calibration.describe_verdict(data.halves(spark, folder)[1], 0.4)


@query
def cutoff_metrics(spark, folder):
    return calibration.measure(data.halves(spark, folder)[1], 0.4)


@query
def flag_band(spark, folder):
    return calibration.find_flag_band(data.halves(spark, folder)[0])


@query
def band_stats(spark, folder):
    return calibration.describe_band(data.halves(spark, folder)[1], 0.4)


@query
def unsure_bands(spark, folder):
    return calibration.unsure_table(data.halves(spark, folder)[0], 0.5)


@query
def unsure_band(spark, folder):
    return calibration.find_unsure_band(data.halves(spark, folder)[0], 0.5)


@query
def unsure_stats(spark, folder):
    return calibration.describe_unsure_band(data.halves(spark, folder)[1], 0.5, *data.BAND)


@query
def compare_cutoffs(spark, folder):
    return calibration.compare_cutoffs(data.halves(spark, folder)[1], 0.4, 0.45)


@query
def sorting_score(spark, folder):
    return metrics.sorting_score(data.scored_exam(spark, folder))


@query
def classification_report(spark, folder):
    exam = data.scored_exam(spark, folder)
    return metrics.classification_report(exam.withColumn("prediction", (F.col("score") >= 0.4).cast("int")))


# --- history and web -------------------------------------------------------------


def _history(spark, folder):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))
    return report.history_rows(_cascade(spark, folder), at)


@query
def history(spark, folder):
    rows = _history(spark, folder).withColumn("article_digest", F.md5("article_text"))
    return rows.select("id", "headline", "article_digest", "score", "result_label", "confidence", "method", "matched_headline")


@query
def history_web(spark, folder):
    """History with the web step: the band asks, every eleventh request asks for itself, replies by conversation."""
    asked = data.pastes(spark, folder).withColumn("search_web", F.col("id") % 11 == 0)
    read = web.normalize_web_replies(data.web_replies(spark, folder).filter("turn = 0"))
    replies = read.select(F.col("conv_id").alias("id"), "web_check")
    told = verdict.analyze(asked, data.corpus(spark, folder), data.digest_scorer, data.RECORD, replies=replies, band=data.BAND)
    rows = report.history_rows(told, F.timestamp_seconds(F.col("id")))
    return rows.select("id", "method", *[F.col(f"web_check.{c}").alias(f"web_{c}") for c in ("reason", "status", "verdict")])


@query
def history_total(spark, folder):
    return report.history_total(_history(spark, folder))


@query
def dashboard(spark, folder):
    return report.dashboard(_history(spark, folder))


@query
def chart_series(spark, folder):
    return report.chart_series(_history(spark, folder))


@query
def recent_20(spark, folder):
    return report.recent(_history(spark, folder)).select("row_number", "id", "headline", "result_label", "shown_date")


@query
def delete_analyses(spark, folder):
    gone = data.table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return report.delete_analyses(_history(spark, folder), gone).select("id", "method")


@query
def web_queue(spark, folder):
    queue = web.web_check_queue(data.request_log(spark, folder), *data.BAND, per_day=50)
    return queue.select("id", "reason", "turn", "within_allowance")


@query
def web_queue_stream(spark, folder):
    """The queue of the same log fed in three parts, each by a stream that starts anew."""
    path = _scratch(spark, "queue")
    log = cut_lineage(data.request_log(spark, folder))
    seconds = F.col("analyzed_at").cast("timestamp").cast("double")
    first, last = log.agg(F.min(seconds), F.max(seconds)).first()
    part = F.floor((seconds - F.lit(first)) * 3 / F.greatest(F.lit(last) - F.lit(first), F.lit(1.0)))
    part = F.coalesce(F.least(part, F.lit(2)), F.lit(0))
    for n in range(3):
        log.where(part == n).write.mode("append").parquet(f"{path}/log")
        arriving = spark.readStream.schema(log.schema).parquet(f"{path}/log")
        stream = allowance.queue_stream(
            arriving, f"{path}/queue", f"{path}/counters", f"{path}/progress", *data.BAND, per_day=50, keep_days=10_000
        )
        stream.awaitTermination()
    return spark.read.parquet(f"{path}/queue").select("id", "reason", "turn", "within_allowance")


@query
def web_replies(spark, folder):
    read = web.normalize_web_replies(data.web_replies(spark, folder)).select("conv_id", "turn", "web_check.*")
    source = F.transform("sources", lambda s: F.concat(s["title"], F.lit(" | "), s["url"]))
    return read.select(
        "conv_id", "turn", "status", "verdict", "confidence", "summary", "factcheck_rating", "error",
        F.array_join("reporting", ";").alias("reporting"), F.array_join("debunking", ";").alias("debunking"),
        F.array_join(source, ";").alias("sources"), F.array_join("queries", ";").alias("queries"),
    )


@query
def disagreement(spark, folder):
    read = web.normalize_web_replies(data.web_replies(spark, folder))
    label = F.when(F.col("conv_id") % 2 == 0, "Likely Fake").otherwise("Likely Real")
    return web.flag_disagreement(read.withColumn("result_label", label)).select("conv_id", "turn", "disagrees")


# --- learning (no SQL equivalent) ------------------------------------------------


def _taught(spark, folder):
    known = data.labelled(spark, folder).withColumnRenamed("headline", "title").withColumnRenamed("body", "text")
    pile = F.when(F.length("source") == 4, "first").otherwise("second")
    prepared = learning.drop_emptied(learning.prepare(known)).withColumn("collection", pile)
    # cleaned once; training and scoring both read it
    return cut_lineage(prepared.select("id", "collection", "title", "source", "raw", "cleaned", "key", "label", "label_binary"))


@query
def tfidf_scores(spark, folder):
    """Model taught on the first pile, every labelled document scored."""
    rows = _taught(spark, folder)
    model = learning.train(rows.filter("collection = 'first'"), "cleaned")
    return learning.model_scorer(model)(rows.select("id", "collection", "label_binary", "cleaned"), "cleaned").drop("cleaned")


@query
def tfidf_train_eval(spark, folder):
    rows = _taught(spark, folder)
    model = learning.train(rows.filter("collection = 'first'"), "cleaned")
    exam = selection.drop_leaks(rows.filter("collection = 'second'"), rows.filter("collection = 'first'"))
    scored = learning.model_scorer(model)(exam, "cleaned")
    return metrics.classification_report(
        scored.select(F.col("label_binary").alias("truth"), (F.col("fake_score") > 0.5).cast("int").alias("prediction"))
    )


@query
def top_terms(spark, folder):
    return learning.top_terms(spark, learning.train(_taught(spark, folder), "cleaned"))


@query
def cross_source_experiment(spark, folder):
    return learning.accuracy_changes(learning.run_experiment(_taught(spark, folder), "first", "second"))


@query
def experiment_sizes(spark, folder):
    """What each split of the experiment teaches and examines."""
    return learning.experiment_sizes(_taught(spark, folder), "first", "second").where("split <> 'shuffled'")


@query
def tfidf_vocabulary(spark, folder):
    """Words of the taught articles with their uses, articles and rarity, stop words kept."""
    return learning.vocabulary(_taught(spark, folder), stop_words=[])


@query
def emptied_rows(spark, folder):
    """Articles of which cleaning leaves nothing, and the rest, by label."""
    marked = data.marked(spark, folder).select(F.col("doc_id").alias("id"), F.col("raw").alias("body"))
    known = data.labelled(spark, folder).drop("body").join(marked, "id").withColumnRenamed("headline", "title")
    rows = learning.prepare(known.withColumn("text", F.when(F.col("id") % 7 == 0, "www.example.com/a").otherwise(F.col("body"))).withColumn("title", F.lit("")))
    kept = learning.drop_emptied(rows).groupBy("label_binary").agg(F.count(F.lit(1)).alias("kept"))
    return rows.groupBy("label_binary").agg(F.count(F.lit(1)).alias("articles")).join(kept, "label_binary")


@query
def ablation_piles(spark, folder):
    """How many articles of each label the ablation's piles hold, taught headlines dropped from the exam."""
    base, extra, exam = _three_piles(_taught(spark, folder), "label_binary = 1")
    parts = [p.select(F.lit(n).alias("pile"), "label_binary") for n, p in (("base", base), ("extra", extra), ("exam", exam))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("pile", "label_binary").agg(F.count(F.lit(1)).alias("articles"))


@query
def corpus_reset(spark, folder):
    """A corpus loaded anew in place of one that is held: ids start at 1 again."""
    path = _scratch(spark, "reset")
    data.corpus(spark, folder).write.parquet(path)
    none = data.corpus(spark, folder).limit(0)
    new_rows, _ = corpus.top_up(none, data.incoming(spark, folder))
    store.append_corpus(new_rows, path, reset=True)
    return store.read_corpus(spark, path).select("id", "headline_key", "label_basis")


@query
def score_store(spark, folder):
    """Scores of an exam, stored and read back."""
    path = _scratch(spark, "scores")
    exam = data.scored_exam(spark, folder).select(F.col("event_id").cast("string").alias("title"), F.col("truth").alias("label_binary"), "score")
    store.write_scores(exam, path)
    return store.read_scores(spark, path)


@query
def raw_crawl(spark, folder):
    """Documents as an eight-column crawl dump, some rows broken, and what is read of it."""
    path = _scratch(spark, "crawl")
    shown = F.when(F.col("id") % 10 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id").cast("string"))
    blank = F.lit("")
    rows = data.pastes(spark, folder).select(
        shown.alias("id"), F.col("lang").alias("type"), F.col("source").alias("domain"), blank.alias("at"), blank.alias("url"),
        blank.alias("authors"), F.col("headline").alias("title"), F.col("body").alias("content"),
    )
    rows.write.option("escape", '"').option("emptyValue", "").csv(path)
    read = articles.read_raw_crawl(spark, path)
    return read.select("id", "type", "domain", "title", F.md5("content").alias("content_digest"))


@query
def ablation_fakes(spark, folder):
    rows = _taught(spark, folder)
    base, extra, exam = _three_piles(rows, "label_binary = 1")
    return learning.ablate_fakes(base, extra, exam)


@query
def ablation_reals(spark, folder):
    rows = _taught(spark, folder)
    base, extra, exam = _three_piles(rows, "label_binary = 0")
    return learning.ablate_reals(base, extra, exam, F.col("source").isin("src0", "src1"))


def _three_piles(rows, wanted):
    """src0-src4 teach, src5-src9 bring new articles of one label, the rest examine."""
    teach = rows.filter("collection = 'first'")
    base = teach.filter(F.col("source") < "src5")
    extra = teach.filter(F.col("source") >= "src5").filter(wanted)
    return base, extra, selection.drop_leaks(rows.filter("collection = 'second'"), base, extra)


@query
def cascade_with_model(spark, folder):
    """The cascade with a fitted model behind it."""
    model = learning.train(_taught(spark, folder), "cleaned")
    told = verdict.analyze(data.pastes(spark, folder), data.corpus(spark, folder), learning.model_scorer(model), data.RECORD)
    return told.groupBy("method", "label").agg(F.count(F.lit(1)).alias("articles"))


# --- learning by whole-number sums ------------------------------------------------


def _first(column=None):
    return (F.col("collection") == "first").cast("long")


def _linear_exam(rows):
    return selection.drop_leaks(rows.filter("collection = 'second'"), rows.filter("collection = 'first'"))


@query
def linear_scores(spark, folder):
    """Model taught on the first pile, every labelled document scored."""
    rows = _taught(spark, folder)
    model = linear.fit_piles(rows, "cleaned", {"first": _first()})["first"]
    scored = linear.scorer(model)(rows.select("id", "collection", "label_binary", "cleaned"), "cleaned")
    return scored.select("id", "collection", "label_binary", F.round("fake_score", 6).alias("fake_score"))


@query
def linear_train_eval(spark, folder):
    """Taught on the first pile, examined on what is new in the second."""
    rows = _taught(spark, folder)
    scored = linear.scorer(linear.fit_piles(rows, "cleaned", {"first": _first()})["first"])(_linear_exam(rows), "cleaned")
    return metrics.classification_report(
        scored.select(F.col("label_binary").alias("truth"), (F.col("fake_score") > 0.5).cast("int").alias("prediction"))
    )


@query
def linear_top_terms(spark, folder):
    """The words that lean most to either side, weights in units of 2^-20."""
    model = linear.fit_piles(_taught(spark, folder), "cleaned", {"all": F.lit(1)})["all"]
    terms = spark.createDataFrame(model.table()).select("term", F.col("weight").cast("long").alias("weight"))
    real = terms.orderBy("weight", "term").limit(20).withColumn("leans", F.lit("REAL"))
    return real.unionByName(terms.orderBy(F.desc("weight"), "term").limit(20).withColumn("leans", F.lit("FAKE")))


@query
def linear_experiment(spark, folder):
    """Three ways to split, raw and cleaned text: accuracy in percent."""
    rows = sampling.stratified_split(_taught(spark, folder), "label_binary", "id", 0.2, out="test")
    second = (F.col("collection") == "second").cast("long")
    piles = {"shuffled": (~F.col("test")).cast("long"), "first -> second": _first(), "second -> first": second}
    exams = {
        "shuffled": rows.filter("test"),
        "first -> second": _linear_exam(rows),
        "second -> first": selection.drop_leaks(rows.filter("collection = 'first'"), rows.filter("collection = 'second'")),
    }
    told = []
    for version, text in (("raw", "raw"), ("clean", "cleaned")):
        models = linear.fit_piles(rows, text, piles)
        for name, exam in exams.items():
            right = F.sum(((F.col("fake_score") > 0.5).cast("int") == F.col("label_binary")).cast("long")).alias("hits")
            scored = linear.scorer(models[name])(exam.select("label_binary", text), text)
            told.append(scored.agg(right, F.count(F.lit(1)).alias("articles")).select(F.lit(name).alias("split"), F.lit(version).alias("version"), "hits", "articles"))
    out = told[0]
    for more in told[1:]:
        out = out.unionAll(more)
    return out.select("split", "version", "hits", "articles", (F.col("hits") * 100.0 / F.col("articles")).alias("accuracy"))


def _ablation(spark, folder, wanted, with_trimmed):
    """src0-src4 teach, src5-src9 bring new articles of one label; copies and trims are the first by ticket."""
    rows = _taught(spark, folder)
    old = (F.col("collection") == "first") & (F.col("source") < "src5")
    new = (F.col("collection") == "first") & (F.col("source") >= "src5") & (F.col("label_binary") == wanted)
    pool = old & (F.col("label_binary") == wanted)
    if with_trimmed:
        pool = pool & F.col("source").isin("src0", "src1")
    n_new, n_pool = rows.agg(F.count(F.when(new, 1)), F.count(F.when(pool, 1))).first()
    drawn = rows.withColumn("pooled", pool.cast("int"))
    drawn = sampling.first_per_group(drawn, "pooled", "id", F.lit(min(n_new, n_pool)), sampling.SPLIT_SEED, "copied")
    drawn = sampling.first_per_group(drawn, "pooled", "id", F.lit(max(min(n_new, n_pool - 1), 0)), sampling.SPLIT_SEED + 1, "dropped")
    drawn = cut_lineage(drawn)
    piles = linear.ablation_piles(old, new, pool, F.col("copied"), F.col("dropped") if with_trimmed else None)
    exam = selection.drop_leaks(rows.filter("collection = 'second'"), rows.filter(old), rows.filter(new))
    return drawn, piles, exam


@query
def linear_ablation_fakes(spark, folder):
    """Before, with new fakes, with as many copied: one table, one fit."""
    return linear.compare_piles(*_ablation(spark, folder, 1, False)).select("run", "n_train", F.round("sorting", 6).alias("sorting"), "accuracy")


@query
def linear_ablation_reals(spark, folder):
    """As for fakes, and with rows of the dominant sources dropped."""
    return linear.compare_piles(*_ablation(spark, folder, 0, True)).select("run", "n_train", F.round("sorting", 6).alias("sorting"), "accuracy")


@query
def ablation_trimmed_rows(spark, folder):
    """The rows of the run that drops articles of the dominant sources."""
    drawn, piles, _ = _ablation(spark, folder, 0, True)
    return drawn.filter(piles["D"] > 0).select("id", "source", "label_binary")


@query
def model_registry(spark, folder):
    """Two models deployed with their records, read back, and what the second is worth over the first."""
    path, rows = _scratch(spark, "models"), _taught(spark, folder)
    old = ((F.col("collection") == "first") & (F.col("source") < "src5")).cast("long")
    piles = {"old": old, "new": _first()}
    # words are counted once, for the fit and for both versions
    counts = cut_lineage(linear.term_counts(rows, "cleaned", piles))
    figures = {r.run: r for r in linear.compare_piles(rows, piles, _linear_exam(rows), counts=counts).collect()}
    for name in piles:
        own = counts.select("term", F.col(f"uses_{name}").alias("uses_pile"), F.col(f"articles_{name}").alias("articles_pile")).filter("uses_pile > 0")
        registry.publish(spark, path, {"terms": own}, {"sorting": round(figures[name].sorting, 6), "training_samples": figures[name].n_train})
    told = registry.history(spark, path, "sorting", learning.retrain_decision)
    tables, record = registry.read_version(spark, path)
    return told.crossJoin(tables["terms"].agg(F.count(F.lit(1)).alias("terms"))).withColumn("training_samples", F.lit(record["training_samples"]).cast("long"))


@query
def cutoff_record(spark, folder):
    """The record of a calibration, written and read back."""
    path = _scratch(spark, "cutoff")
    half_a, half_b = data.halves(spark, folder)
    store.write_record(spark, calibration.calibrate(half_a, half_b), path)
    read = spark.read.schema(store.CUTOFF_SCHEMA).json(path)
    return read.select(
        "cutoff", "chosen_for", "accuracy", "real_recall", "fake_recall", "cutoff_chosen_on", "measured_on", "evaluation", "alternative_even_cutoff"
    )


@query
def dataset_registry(spark, folder):
    """Documents written as the known collections and loaded as such, two of the three."""
    path = _scratch(spark, "sets")
    rows = data.pastes(spark, folder).filter("headline <> ''")
    files = {"Fake.csv": 0, "True.csv": 1, "fake_or_real_news.csv": 2}
    for name, part in files.items():
        kind = F.when(F.col("id") % 2 == 0, " fake").otherwise("real ").alias("label")
        columns = [F.col("headline").alias("title"), F.col("body").alias("text"), *([kind] if part == 2 else [])]
        rows.filter(F.col("id") % 3 == part).select(*columns).write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    loaded = articles.load_datasets(spark, path, ["true", "mixed"])
    return loaded.select("file_no", "file", "key", "label", "source", "basis", F.md5("body").alias("body_digest"))


@query
def csv_positions(spark, folder):
    """Documents as one CSV table in parts, and the place in it at which each is read."""
    path = _scratch(spark, "place")
    rows = data.pastes(spark, folder).select(F.col("id").cast("string").alias("title"), "body")
    order = F.col("title").cast("long")
    rows.repartitionByRange(order).sortWithinPartitions(order).write.option("header", True).option("escape", '"').csv(path)
    read = articles.read_labelled_csv(spark, path, "documents", label="real", text_col="body", one_table=True)
    return read.select("pos", F.col("headline").cast("long").alias("id"), F.md5("body").alias("body_digest"))
