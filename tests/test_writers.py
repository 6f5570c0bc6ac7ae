from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressgauge.operators.web import web_check_queue
from pressgauge.sources import loads, registry
from pressgauge.streaming import allowance

ROW = "headline string, headline_key string, article_text string, body_key string, label string, source string, label_basis string, file_no int, pos long"


def new(spark, *keys):
    rows = [(k, k, "", "", "FAKE", "s", "source", 1, n) for n, k in enumerate(keys)]
    return spark.createDataFrame(rows, ROW)


def fresh(held, rows):
    return rows.join(held.select("headline_key"), "headline_key", "left_anti")


def keys_of(df):
    return {r.id: r.headline_key for r in df.collect()}


def test_interleaved_loads(spark, tmp_path):
    folder, tries = str(tmp_path / "corpus"), []
    assert keys_of(loads.read_loaded(spark, folder)) == {}
    other = lambda: loads.load(spark, folder, "b", lambda held: fresh(held, new(spark, "k2", "k3")))

    def slow(held):
        tries.append(held.count())
        other()
        return fresh(held, new(spark, "k1", "k2"))

    mine = loads.load(spark, folder, "a", slow)
    # the other load came first, so this one was worked out again and left its k2 out
    assert tries == [0, 2] and (mine["number"], mine["first_id"], mine["rows"]) == (2, 3, 1)
    assert keys_of(loads.read_loaded(spark, folder)) == {1: "k2", 2: "k3", 3: "k1"}
    assert keys_of(loads.read_loaded(spark, folder, 1)) == {1: "k2", 2: "k3"}
    # a batch that was loaded is not loaded again, one without rows is
    assert loads.load(spark, folder, "a", lambda held: new(spark, "k9")) == mine
    assert loads.load(spark, folder, "none", lambda held: new(spark).where("false"))["rows"] == 0
    assert loads.load(spark, folder, "c", lambda held: new(spark, "k4"))["first_id"] == 4


def test_broken_load_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    loads.load(spark, folder, "a", lambda held: new(spark, "k1"))
    rename = registry._rename

    def fail(*_):
        raise OSError("gone")

    registry._rename = fail
    try:
        with pytest.raises(OSError):
            loads.load(spark, folder, "b", lambda held: new(spark, "k2"))
    finally:
        registry._rename = rename
    assert keys_of(loads.read_loaded(spark, folder)) == {1: "k1"}
    assert loads.load(spark, folder, "b", lambda held: new(spark, "k2"))["first_id"] == 2
    assert keys_of(loads.read_loaded(spark, folder)) == {1: "k1", 2: "k2"}


LOG = "id long, fake_score double, analyzed_at timestamp, method string, requested boolean"


def log(spark, times):
    return spark.createDataFrame([(n, 0.5, t, "reading_model", False) for n, t in times], LOG)


def turns(df):
    return {r.id: (r.turn, r.within_allowance) for r in df.collect()}


def test_turns_go_on_over_batches(spark, tmp_path):
    start = datetime(2024, 5, 1, 20)
    times = [(n, start + timedelta(minutes=17 * n)) for n in range(40)] + [(90, None), (91, None)]
    whole = turns(web_check_queue(log(spark, times), 0.4, 0.6, 9))
    parts = [times[:15] + times[40:41], times[15:16], times[16:40] + times[41:]]
    got = {}
    for n, part in enumerate(parts):
        first = turns(allowance.next_turns(log(spark, part), 0.4, 0.6, str(tmp_path), n, 9))
        # a batch that is run again hands out the same turns
        assert turns(allowance.next_turns(log(spark, part), 0.4, 0.6, str(tmp_path), n, 9)) == first
        got.update(first)
    assert got == whole
    assert registry.numbers(spark, str(tmp_path), "") == [1, 2]
    # a batch without rows keeps the counters
    assert turns(allowance.next_turns(log(spark, times).where("false"), 0.4, 0.6, str(tmp_path), 3, 9)) == {}
    late = [(100, start), (101, start + timedelta(days=30)), (102, start + timedelta(days=1))]
    assert turns(allowance.next_turns(log(spark, late[:2]), 0.4, 0.6, str(tmp_path), 4, 9))[100][0] > 9
    # its day's counter is gone: no turn, but not left out
    assert turns(allowance.next_turns(log(spark, late[2:]), 0.4, 0.6, str(tmp_path), 5, 9)) == {102: (None, False)}
