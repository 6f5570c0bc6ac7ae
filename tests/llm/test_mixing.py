import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressgauge.llm import mixing


def targets(sizes, settings):
    """Shares by weight, the excess over a source's limit shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: settings.weights[k % len(settings.weights)] for k, s in enumerate(names)}
    held, total = {}, settings.share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(held.values())) / sum(weight[s] for s in free) if free else 0
        over = {s: settings.most * sizes[s] for s in free if level * weight[s] > settings.most * sizes[s]}
        if not over:
            return {s: held.get(s, level * weight[s]) for s in names}
        held |= over


@pytest.fixture(scope="module")
def docs(spark, prose):
    rows = [(k, prose(k, 20 + k % 150), ["hot", "hot", "b", "c", None, "d", "hot"][k % 7]) for k in range(1_500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_targets_limits_and_reruns(docs):
    settings = mixing.Settings(lane_rows=100, block=16, shard_blocks=200)
    rows = mixing.plan_mix(docs, settings).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes, settings)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 64) for s in sizes)
    again = mixing.plan_mix(docs.repartition(2), settings).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_whole_documents_meet_targets(spark, prose):
    """Even where one document is a fifth of its source; rows without an id of their own are drawn like others."""
    import corpus_pipeline

    names, rows = ["a", "b", None], []
    for k in range(1_800):
        text = prose(k, 20 + k % 100)
        rows.append((None if k % 9 == 0 else k // 2, text, "en", names[k % 3], len(text)))
    for name in names:
        words = sum(len(r[1].split()) for r in rows if r[3] == name)
        rows.append((-1, prose(7, words // 4), "en", name, 1))
    same = prose(8, 50)
    rows += [(-2, same, "en", "b", 300)] * 75
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sizes, longest = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
        longest[r[3]] = max(longest[r[3]], len(r[1].split()))
    assert all(0.17 * sizes[s] < longest[s] for s in sizes)
    want, given, times, words = targets(sizes, mixing.Settings()), Counter(rows), Counter(), Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        times[tuple(r)] += 1
        words[r.source] += len(r.text.split())
    assert all(n <= 2 * given[r] for r, n in times.items())
    assert all(abs(words[s] - want[s]) <= 64 + 0.005 * sizes[s] for s in sizes), (words, want)
    plan = mixing.plan_mix(docs, mixing.Settings(), "n_chars").collect()
    assert len(plan) == len(rows) and all(0 <= r.first_taken <= 2 for r in plan)
    # copies follow what the mix takes: rows of which nothing is taken are seldom used, those taken twice mostly twice
    short = [r for r in plan if r.size < 200]
    mean = lambda part: sum(r.first_taken for r in part) / len(part)
    assert mean([r for r in short if r.taken == 2 * r.size]) > mean([r for r in short if r.taken == 0]) + 1


def test_shard_draws_are_spread(docs):
    settings = mixing.Settings(block=16, shard_blocks=500)
    draws = mixing.shard_draws(docs, settings).collect()
    shards = Counter()
    for r in draws:
        shards[r.shard] += r.blocks
    assert len(shards) > 10 and max(shards.values()) < 1.5 * min(shards.values())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1_000])
def test_shuffle_is_a_permutation(spark, n):
    settings = mixing.Settings()
    key = F.lit(5).cast("long")
    rows = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), key, settings).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    if n == 1_000:
        moved = [r.p for r in rows]
        assert sum(abs(a - b) == 1 for a, b in zip(moved, moved[1:], strict=False)) < 20


def test_word_counts(odd_docs, texts_of):
    got = Counter((r.doc_id, r.n) for r in odd_docs.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect())
    assert got == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in texts_of(odd_docs))


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.plan_mix(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert all(r.taken <= 2 * r.size for r in rows) and sum(r.taken for r in rows) > 0
    assert mixing.plan_mix(no_docs).collect() == []
    empty = odd_docs.withColumn("text", F.lit(""))
    assert {(r.size, r.taken, r.target) for r in mixing.plan_mix(empty).collect()} == {(0, 0, 0.0)}
