import random
import re
from collections import Counter

import numpy as np
import pytest

from pressgauge.llm import bagminhash as B


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def classes_of(rows, least=0.8):
    """Components by comparing all pairs; equal texts are one class."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or similarity(sets[i], sets[j]) >= least:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def edited(text, share, rng):
    return " ".join(w if rng.random() > share else w + "x" for w in text.split())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    for a, b in [(rng.integers(1, 9, 300), rng.integers(1, 9, 300)), (np.ones(300, int), rng.integers(0, 2, 300)), (np.full(300, 5), np.full(300, 4))]:
        text = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        found = B.signatures(text, np.concatenate([ids[a > 0], ids[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 2_000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((found[0] == found[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 2_000) + 1e-9
    assert (B.signatures(np.zeros(0, int), ids[:0], np.zeros(0, int), 1, 8) == 0).all()


def test_verified_similarity_is_exact():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    got = B.overlap(pa.array(texts[:-1]), pa.array(texts[1:]), 5)
    assert np.allclose(got, [similarity(shingles(a), shingles(b)) for a, b in zip(texts, texts[1:], strict=False)])


@pytest.mark.parametrize("seed", [3, 4])
def test_classes_equal_comparing_all_pairs(spark, prose, seed):
    rng = random.Random(seed)
    texts = [prose(seed * 100 + k, 120) for k in range(12)]
    # groups whose members are near the original, not all near each other; and texts that share half
    texts += [edited(texts[k % 3], rng.choice([0.01, 0.02, 0.05]), rng) for k in range(45)]
    texts += [" ".join(texts[4].split()[:70]) + " " + prose(seed * 1000 + k, 30) for k in range(25)]
    texts += [texts[5], "one two", "one two", "one  two", "", " "]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in B.near_duplicates(df).collect()}
    assert same_partition([got[k] for k, _ in rows], classes_of(rows))
    assert all(c <= k for k, c in got.items())


def test_pairs_within_a_common_passage(spark, prose):
    """Planted pairs are little more than a passage that hundreds share, so that they meet in its buckets alone."""
    words = lambda seed, n: [f"w{seed}x{k}" for k in range(n)]
    passage = words("p", 60)
    texts = [" ".join(passage + words(f"f{k}", 30 + k % 60)) for k in range(240)]
    for k in range(60):
        ends = words(f"s{k}", 2)
        texts += [" ".join(ends + passage + words(f"{side}{k}", 6)) for side in "ab"]
    # shingles that repeat
    texts += [" ".join(passage + ["again"] * n) for n in (12, 15, 30)]
    rows = list(enumerate(texts))
    want = classes_of(rows)
    assert len(set(want)) == 240 + 60 + 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in B.near_duplicates(df).collect()}
    assert same_partition([got[k] for k, _ in rows], want)


def test_candidates_hold_every_pair(spark, prose):
    """Copies of one original, each its own component: no pair at the similarity is excluded, and of the others few stay;
    each copy's hub is a text that it may equal in kind."""
    rng, settings = random.Random(9), B.Settings()
    texts = [prose(900, 150)] + [edited(prose(900, 150), rng.choice([0.01, 0.02, 0.04]), rng) for _ in range(60)]
    texts += [" ".join(["again"] * n) for n in (12, 15, 17)] + ["", "one two"]
    rows = [(f"{k:03d}", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "content string, text string")
    prefixed = B.prefixes(df.select(B.F.col("content").alias("member")), df, settings)
    tokens = prefixed.select("member", "common", B.F.col("short").alias("s"), B.F.posexplode("tokens").alias("place", "token"))
    labeled = tokens.withColumn("short", B.F.col("place") < B.F.col("s")).withColumn("c", B.F.col("member"))
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for j in range(len(rows)) for i in range(j)]
    near = {(rows[i][0], rows[j][0]) for i, j in pairs if similarity(sets[i], sets[j]) >= 0.8}
    got = {(r.a, r.b) for r in B.candidates(labeled, prefixed, settings).collect()}
    assert near <= got and len(got) < 1.2 * len(near)
    hubs = [(r.a, r.b) for r in B.hub_pairs(labeled, prefixed, settings).collect()]
    assert 0 < len(hubs) <= len(rows)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("x", "y")], "a string, b string")
    found = {r.node: r.component for r in B.components(links).collect()}
    assert {found[f"{k:03d}"] for k in range(41)} == {"000"} and found["y"] == found["x"] == "x"


def test_odd_rows(odd_docs, no_docs, texts_of):
    rows = B.near_duplicates(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts_of(odd_docs))
    twins = {r.class_id for r in rows if r.class_size == 3 and r.doc_id in (1, 2)}
    assert twins == {1}
    # null and empty texts are exact copies of each other; blank ones are not
    assert {(r.doc_id, r.class_id) for r in rows if r.doc_id in (3, 4, 5)} == {(3, 3), (4, 3), (5, 5)}
    assert B.near_duplicates(no_docs).collect() == []


def test_few_links_take_few_tasks(spark):
    """Each task of a shuffle writes files of its own, so the steps of a short list of links must not have hundreds."""
    links = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(40) if k % 10 < 9], "a string, b string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = B.components(links)
        assert found.rdd.getNumPartitions() <= 2
        assert {(r.node, r.component) for r in found.collect()} == {(f"{k:03d}", f"{k // 10 * 10:03d}") for k in range(40)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
