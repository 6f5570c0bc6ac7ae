import pytest
from pyspark.sql import functions as F

from pressgauge.operators import verdict
from pressgauge.operators.corpus import CORPUS_SCHEMA
from pressgauge.sources import index, registry
from pressgauge.streaming.intake import analyze_stream, read_requests


@pytest.fixture(scope="module")
def corpus(spark):
    """Equal keys with evidence of all ranks, blank and null keys, over 60 rows."""
    bases = ["fact_checked", "source", None, "other"]
    columns = [c.split()[0] for c in CORPUS_SCHEMA.split(", ")]

    def row(k):
        keys = {"headline_key": ["", None, f"head {k % 7}"][min(k % 9, 2)], "body_key": None if k % 5 == 0 else f"body {k % 11}"}
        known = {"id": k, "label": ["FAKE", "REAL"][k % 2], "label_basis": bases[k * 7 % 4], "source": f"s{k % 3}", **keys}
        return tuple(known.get(c) for c in columns)

    return spark.createDataFrame([row(k) for k in range(60)], CORPUS_SCHEMA)


def rows_of(df):
    return sorted((r.kind, r.key, r.match.id) for r in df.collect())


def test_top_ups_equal_one_search(spark, corpus, tmp_path):
    folder = str(tmp_path)
    assert index.read_index(spark, folder) is None
    for n in (3, 0, 2, 1):
        stored = index.add_to_index(corpus.where(F.col("id") % 4 == n), folder, f"b{n}", buckets=3)
    assert rows_of(stored.rows) == rows_of(verdict.corpus_index(corpus)) and (stored.held, stored.number) == (60, 4)
    # a batch that is in is not added again, one without rows is
    assert index.add_to_index(corpus, folder, "b0")[1:] == (60, 4)
    assert index.add_to_index(corpus.limit(0), folder, "none")[1:] == (60, 5)
    assert rows_of(index.read_index(spark, folder).rows) == rows_of(stored.rows)
    assert index.read_index(spark, folder, 1).held == 15 and index.read_index(spark, folder, 9) is None


def test_first_load_may_be_empty(spark, corpus, tmp_path):
    stored = index.add_to_index(corpus.limit(0), str(tmp_path), "none", buckets=2)
    assert (stored.rows.count(), stored.held) == (0, 0)
    assert rows_of(index.add_to_index(corpus, str(tmp_path), "all").rows) == rows_of(verdict.corpus_index(corpus))


def test_another_session_finds_it(spark, corpus, tmp_path):
    folder = str(tmp_path / "it's")
    stored = index.add_to_index(corpus, folder, "all", buckets=3)
    want = rows_of(stored.rows)
    for table in spark.catalog.listTables():
        if table.name.startswith("corpus_index_"):
            spark.sql(f"DROP TABLE {table.name}")
    assert rows_of(index.read_index(spark, folder).rows) == want


def test_interleaved_top_ups(spark, corpus, tmp_path, monkeypatch):
    folder, claim, raced = str(tmp_path), registry.claim, []

    def slow(*args):
        if not raced:
            raced.append(1)
            index.add_to_index(corpus.where("id < 30"), folder, "fast", buckets=3)
        return claim(*args)

    monkeypatch.setattr(registry, "claim", slow)
    stored = index.add_to_index(corpus.where("id >= 30"), folder, "slow", buckets=3)
    assert stored[1:] == (60, 2) and rows_of(stored.rows) == rows_of(verdict.corpus_index(corpus))


def bucketed_side(df):
    """What stands between the join and the scan of the index."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("corpus_index_")
    assert "Bucketed: true" in plan[scan:]
    return plan[: plan.index("\n", scan)].split("SortMergeJoin [kind")[-1], plan


def test_neither_lookup_nor_top_up_shuffles_the_index(spark, corpus, tmp_path):
    requests = spark.createDataFrame(
        [(1, "head 3", "x"), (2, "none", "a body of some length " * 40), (3, None, None)], "id long, headline string, body string"
    )
    key = verdict.keyed_requests(requests).where("id = 2").first()["body_key"]
    corpus = corpus.withColumn("body_key", F.when(F.col("id") == 4, key).otherwise(F.col("body_key")))
    stored = index.add_to_index(corpus.where("id < 30"), str(tmp_path), "a", buckets=3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, plan = bucketed_side(index.merged(stored.rows, verdict.corpus_index(corpus)))
        # only the new rows are dealt by kind and key
        assert plan.count("hashpartitioning(kind") == 1
        stored = index.add_to_index(corpus.where("id >= 30"), str(tmp_path), "b")
        found = verdict.lookup(requests, None, stored.rows)
        above, plan = bucketed_side(found)
        assert plan.count("hashpartitioning(kind") == 1
        assert above.rindex("Exchange") < above.rindex("Scan ExistingRDD")
        got = {r.id: (r.matched_on, r.match and r.match.id) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {r.id: (r.matched_on, r.match and r.match.id) for r in verdict.lookup(requests, corpus).collect()}
    assert got == want and got[1][0] == "headline" and got[2] == ("body", 4) and got[3] == (None, None)
    files = stored.rows.inputFiles()
    assert 0 < len(files) <= 3


def test_stream_answers_from_the_current_version(spark, corpus, tmp_path):
    folder, requests = str(tmp_path / "index"), tmp_path / "requests"
    requests.mkdir()

    def run(n):
        (requests / f"{n}.json").write_text('{"id": %d, "text": "Head 3\\nbody", "submitted_at": "2024-01-01T00:00:00Z"}\n' % n)
        read = read_requests(spark, str(requests))
        # no corpus lies at that path: only the index can answer
        places = [str(tmp_path / x) for x in ("corpus", "history", "ckpt")]
        analyze_stream(read, *places, index_folder=folder).awaitTermination(120)
        return {r.id: r.method for r in spark.read.parquet(str(tmp_path / "history")).collect()}

    assert run(1) == {1: "too_short"}
    index.add_to_index(corpus, folder, "all", buckets=3)
    assert run(2) == {1: "too_short", 2: "database"}
