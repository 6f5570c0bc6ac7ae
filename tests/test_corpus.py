import random

import pytest
from pyspark.sql import functions as F

from pressgauge.operators import corpus
from pressgauge.sources import articles, store

INCOMING = (
    "file_no int, pos long, file string, headline string, body string, label string, source string, basis string, key string"
)


def load_one_by_one(held, rows):
    best, out = dict(held), {}
    for file_no, pos, _, _, _, _, _, basis, key in sorted(rows, key=lambda r: (r[0], r[1])):
        rank = corpus.BASIS_RANKS.get(basis, 99)
        if not key:
            out[file_no, pos] = "unusable"
        elif key in best and rank >= best[key]:
            out[file_no, pos] = "already_had"
        else:
            out[file_no, pos] = "better_evidence" if key in best else "added"
            best[key] = rank
    return out


def corpus_frame(spark, rows):
    full = [(i, k, k, "", "", "REAL", "s", b) for i, (k, b) in enumerate(rows, start=1)]
    return spark.createDataFrame(full, corpus.CORPUS_SCHEMA)


@pytest.mark.parametrize("seed", range(6))
def test_top_up_equals_one_by_one_load(spark, seed):
    rng = random.Random(seed)
    bases = ["source"] * 4 + ["fact_check", "hearsay", None]
    held_rows = [(f"k{rng.randrange(12)}", rng.choice(bases)) for _ in range(rng.choice([0, 6]))]
    held = {}
    for key, basis in held_rows:
        held[key] = min(held.get(key, 99), corpus.BASIS_RANKS.get(basis, 99))
    rows = []
    for file_no in (1, 2):
        for pos in range(60):
            key = "k0" if rng.random() < 0.3 else rng.choice(["", f"k{rng.randrange(30)}"])
            rows.append((file_no, pos, f"f{file_no}", key, "body", "FAKE", "s", rng.choice(bases), key))
    incoming = spark.createDataFrame(rows, INCOMING).repartition(4)
    stored = corpus_frame(spark, held_rows)
    new_rows, decided = corpus.top_up(stored, incoming)
    want = load_one_by_one(held, rows)
    assert {(r.file_no, r.pos): r.outcome for r in decided.collect()} == want
    inserted = {k for k, v in want.items() if v in ("added", "better_evidence")}
    assert {(r.file_no, r.pos) for r in new_rows.collect()} == inserted
    for r in corpus.load_report(stored, incoming).collect():
        mine = [v for k, v in want.items() if r.file is None or f"f{k[0]}" == r.file]
        assert [r.added, r.better_evidence, r.already_had, r.unusable] == [mine.count(o) for o in corpus.OUTCOMES]
        assert r.rows_read == len(mine)


def test_csv_to_store_and_back(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_text(
        'title,text,label\n"Big ""news""\nhere","line one\nline two", fake \n,"no title",REAL\nnan,x,REAL\n'
        "Other,,real\n!!! ---,body,REAL\nBig news here,again,REAL\nNo label,x,\n"
    )
    rows = articles.read_labelled_csv(spark, str(path), "Test")
    got = rows.orderBy("pos").collect()
    assert [(r.headline, r.body, r.label) for r in got] == [
        ('Big "news"\nhere', "line one\nline two", "FAKE"),
        ("Other", "", "REAL"),
        ("!!! ---", "body", "REAL"),
        ("Big news here", "again", "REAL"),
    ]
    whole = articles.read_labelled_csv(spark, str(path), "Test", label="fake")
    assert {r.label for r in whole.collect()} == {"FAKE"} and whole.count() == 5
    with pytest.raises(ValueError, match="no title column"):
        articles.read_labelled_csv(spark, str(path), "Test", title_col="headline")
    with pytest.raises(ValueError, match="no label column"):
        articles.read_labelled_csv(spark, str(path), "Test", label_col="verdict")

    stored = str(tmp_path / "corpus")
    for turn in range(2):  # loading twice changes nothing
        new_rows, decided = corpus.top_up(store.read_corpus(spark, stored), rows)
        report = corpus.load_report(store.read_corpus(spark, stored), rows).filter("file is null").first()
        assert (report.added, report.already_had, report.unusable) == ((2, 1, 1) if turn == 0 else (0, 3, 1))
        store.append_corpus(new_rows, stored)
    kept = store.read_corpus(spark, stored).orderBy("id").collect()
    assert [(r.id, r.headline_key) for r in kept] == [(1, "big news here"), (2, "other")]
    store.append_corpus(new_rows, stored, reset=True)
    assert store.read_corpus(spark, stored).count() == 0


def test_raw_crawl_keeps_whole_rows_only(spark, tmp_path):
    path = tmp_path / "crawl.csv"
    path.write_bytes(
        b'1,fake,a.com,d,u,au,Title one,"body\nmore"\n2,fake,a.com,d,u,au,short row\nx3,fake,a.com,d,u,au,T,c\n'
        b"4,rumor,b.com,d,u,au,T4,c4,extra\n5,rumor,,d,u,au,T5,\xff\xfe bad bytes\n"
    )
    got = articles.read_raw_crawl(spark, str(path)).select("id", "domain", "title").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("1", "a.com", "Title one"), ("5", "", "T5")]
    assert articles.read_raw_crawl(spark, str(path)).count() == 2


def test_merge_backfill_and_sets(spark, tmp_path):
    old = spark.createDataFrame([("A one", "t"), ("B", "t")], "title string, text string")
    new = spark.createDataFrame([("a ONE!", "t"), ("C", "t")], "title string, text string")
    assert {r.title for r in corpus.merge_new(old, new).collect()} == {"A one", "B", "C"}
    out = str(tmp_path / "set")
    store.write_diverse(new, out, old, dry_run=True)
    assert not (tmp_path / "set").exists()
    store.write_diverse(new, out, old)
    assert articles.read_article_csv(spark, out).count() == 3
    words = " ".join(f"w{i}" for i in range(25))
    rows = spark.createDataFrame([(1, words, ""), (2, "few", ""), (3, "", "kept")], "id int, article_text string, body_key string")
    filled = corpus.backfill_body_keys(rows)
    assert [r.body_key for r in filled.orderBy("id").collect()] == [" ".join(words.split()[:20]), "", "kept"]
    assert {r.body_key for r in corpus.clear_body_keys(filled).collect()} == {""}


def test_records(spark, tmp_path):
    path = str(tmp_path / "cutoff")
    assert store.read_cutoff(spark, path) is None
    store.write_record(spark, {"cutoff": 0.99993797, "verdict": None}, path)
    assert store.read_cutoff(spark, path) is None
    verdict = {"score_above": 0.99993797, "fake_precision": 86.9, "real_precision": 90.1, "measured_on": 10}
    store.write_record(spark, {"cutoff": 0.99993797, "verdict": verdict}, path)
    assert store.read_cutoff(spark, path)["verdict"]["score_above"] == 0.99993797
    scores = spark.createDataFrame([("t", 1, 0.99993797)], "title string, label_binary int, score double")
    with pytest.raises(FileNotFoundError):
        store.read_scores(spark, str(tmp_path / "none"))
    store.write_scores(scores, str(tmp_path / "scores"))
    assert store.read_scores(spark, str(tmp_path / "scores")).first().score == 0.99993797


def test_history_table_rewrite(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.range(5).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("analyzed_at"))
    store.append_history(rows, path)
    held = spark.read.parquet(path)
    store.replace_table(held.filter("id <> 3"), path, "day")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 4]


def test_report_tells_files_of_one_name_apart(spark):
    schema = "file_no int, pos long, file string, headline string, body string, label string, source string, basis string, key string"
    rows = [(k, i, "news.csv", f"H {k} {i}", "", "REAL", "s", "source", f"h {k} {i}") for k in range(2) for i in range(k + 1)]
    none = corpus.corpus_rows(spark.createDataFrame(rows, schema).withColumn("id", F.col("pos")), "id").limit(0)
    told = [(r.file, r.rows_read, r.added) for r in corpus.load_report(none, spark.createDataFrame(rows, schema)).collect()]
    assert sorted(told, key=repr) == sorted([("news.csv", 1, 1), ("news.csv", 2, 2), (None, 3, 3)], key=repr)


def test_rows_follow_file_names_not_sizes(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, n in (("c.csv", 400), ("a.csv", 2), ("b.csv", 50)):
        lines = "".join(f'"{name} {i}","{"long text " * 20}"\n' for i in range(n))
        (folder / name).write_text("title,text\n" + lines)
    read = articles.read_labelled_csv(spark, str(folder), "s", label="real").orderBy("pos").collect()
    assert [r.headline for r in read] == [f"{name} {i}" for name, n in (("a.csv", 2), ("b.csv", 50), ("c.csv", 400)) for i in range(n)]


def test_batch_and_stream_share_a_history(spark, tmp_path):
    path = str(tmp_path / "shared")
    rows = spark.range(4).withColumn("analyzed_at", F.timestamp_seconds(F.col("id") * 86_400))
    store.append_history(rows, path)
    store.append_history(rows, path, "stream-0")
    store.append_history(rows, path, "stream-0")  # a replay takes the place of the first attempt
    history = spark.read.parquet(path)
    assert history.count() == 8 and history.select("batch").distinct().count() == 2
