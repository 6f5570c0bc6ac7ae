import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressgauge.llm import queries, runs


def brute(words, repeats=4, least=6):
    """Runs by their definition, period by period."""
    out = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                part = words[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts, rules=runs.Settings()):
    return runs.find(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64), rules)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4), st.sampled_from([(4, 6), (2, 2), (3, 5), (2, 9)]))
def test_equals_brute_force_on_small_alphabets(texts, rules):
    assert found(texts, runs.Settings(*rules)) == [brute(t, *rules) for t in texts]


def test_equals_brute_force_on_planted_periods():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.randrange(8) for _ in range(rng.randint(30, 150))]
        for _ in range(2):
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            stop = min(len(words), a + p * rng.randint(3, 7) + rng.randrange(p))
            for i in range(a, stop):
                words[i] = words[a + (i - a) % p] if a + (i - a) % p < i else words[i]
        assert found([words, words[::-1]]) == [brute(words), brute(words[::-1])]


def test_long_texts():
    one, three = [0] * 30_000, [0, 1, 2] * 9_000 + [0]
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert found([one, three, b]) == [[(0, 30_000, 1)], [(0, 27_001, 3)], []]
    assert found([b + b[:9_000] * 4])[0]


def test_no_run_crosses_texts():
    assert found([[1, 1, 1], [1, 1, 1, 1], [2, 2, 2, 2, 2, 2]]) == [[], [], [(0, 6, 1)]]


def expected(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    all_runs = brute(words)
    best = max(all_runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, m, q in all_runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in all_runs)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(all_runs), *numbers, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("plant", [False, True])
def test_whole_rows(spark, odd_docs, prose, texts_of, plant):
    some = [(k, prose(k, 60 + k % 50), "en", "a") for k in range(10, 130)]
    some += [(500, "x " * 50 + "y y y y y y", "en", "a"), (501, "na " * 5 + "no na " * 6, "en", "a")]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string")
    docs = odd_docs.unionByName(df, allowMissingColumns=True).where("doc_id is null or doc_id <> 6")
    got = runs.scan(docs, queries.periodic_tail if plant else None, digest=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed"
    )
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: key(tuple(map(str, r)))) == sorted(
        (expected(i, t, plant) for i, t in texts_of(docs)), key=lambda r: key(tuple(map(str, r)))
    )
    planted = [i for i, _ in texts_of(docs) if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
    assert planted


def test_runs_and_text_as_columns(spark, no_docs):
    df = spark.createDataFrame([(1, "a b a b a b a b c c c c c c end", 5)], "doc_id long, text string, runs int")
    row = runs.scan(df).first()
    assert [tuple(r) for r in row.runs] == [(0, 8, 2), (8, 6, 1)] and row.n_words == 15
    assert row.collapsed == "a b c end" and (row.start, row.length, row.period, row.exponent_milli) == (8, 6, 1, 6000)
    assert runs.scan(no_docs).collect() == []
    # ties: 8/2 and 4/1 are both four periods, but six words are the least
    assert runs.strongest([(3, 8, 2), (0, 12, 3), (20, 8, 2)]) == (3, 8, 2) or runs.strongest([(0, 12, 3), (3, 8, 2)]) == (0, 12, 3)
