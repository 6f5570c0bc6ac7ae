import random
from collections import Counter

import numpy as np
import pytest

from pressgauge.llm import substrings as S


def plain(texts, length):
    """(bytes, removed, spans, kept) of each text, by counting every string."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def test_interval_search_equals_counting():
    rng = random.Random(5)
    for _ in range(150):
        length = rng.choice([1, 2, 3, 5, 8, 12])
        alphabet = [97, 98, 0, 255][: rng.randint(1, 4)]
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(length, 40))) for _ in range(rng.randint(1, 11))]
        strings = list(dict.fromkeys(strings))
        times = np.array([rng.choice([1, 1, 1, 2]) for _ in strings], float)
        counts = Counter()
        for s, n in zip(strings, times, strict=True):
            counts.update({k: v * n for k, v in Counter(s[i : i + length] for i in range(len(s) - length + 1)).items()})
        want = [[i for i in range(len(s) - length + 1) if counts[s[i : i + length]] > 1] for s in strings]
        assert [x.tolist() for x in S.repeated_starts(strings, times, length)] == want


def test_runs_cover_every_start_and_parts_share_their_core():
    rng = random.Random(6)
    settings = S.Settings(length=12, gram=4)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab ") for _ in range(rng.randrange(60))) for _ in range(rng.randint(1, 5))]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        first, last, value, _, grams = S.runs(data, offsets, 12, 4)
        want = [i for a, b in zip(offsets[:-1], offsets[1:], strict=True) for i in range(a, b - 11)]
        assert [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)] == want
        for a, b, v in zip(first.tolist(), last.tolist(), value.tolist(), strict=True):
            assert all(grams[i : i + 9].min() == v for i in range(a, b + 1))
            for depth in (1, 2, 3):
                parts = S.split(a, b, v, grams, depth, settings)
                assert [i for p in parts for i in range(p[0], p[1] + 1)] == list(range(a, b + 1))
                assert all(i <= p[3] < p[4] <= i + 12 for p in parts for i in range(p[0], p[1] + 1))


@pytest.mark.parametrize("frequent", [1_000, 2])
def test_documents_equal_counting(spark, prose, frequent):
    """frequent=2 splits every anchor."""
    passage = prose(9, 30)
    texts = [prose(k, 60) for k in range(12)] + [prose(0, 60), prose(1, 40) + passage, passage + prose(2, 60), "ab" * 150, passage]
    texts += ["x" * 39, "y" * 40, "y" * 40, "", None, prose(3, 30) + prose(3, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    settings = S.Settings(length=40, gram=12, frequent=frequent, screen_bits=1 << 16, shard_bytes=2_000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.cut(df, settings).collect()}
    assert got == dict(enumerate(plain([(t or "").encode() for t in texts], 40)))


def test_odd_rows(odd_docs, no_docs, texts_of):
    rows = texts_of(odd_docs)
    want = Counter((i, *p) for (i, _), p in zip(rows, plain([t.encode() for _, t in rows], 200), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.cut(odd_docs).collect())
    assert got == want
    assert S.cut(no_docs).collect() == []


def test_only_texts_that_lose_bytes_are_shuffled(spark, prose):
    """Texts are wide: those that keep every byte must not travel."""
    texts = [prose(k, 60) for k in range(6)] + [prose(0, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = S.cut(df, S.Settings(length=40, gram=12))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()}
    assert got == dict(enumerate(plain([t.encode() for t in texts], 40)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join") == 1


def test_strings_whose_surroundings_differ_are_not_searched(spark, prose):
    """An anchor found twice is no repeated string: only what it stands in tells."""
    phrase = prose(50, 12)[:24]
    texts = [prose(k, 8) + phrase + prose(k + 100, 8) for k in range(20)]
    texts += [prose(200, 8) + prose(7, 12), prose(201, 8) + prose(7, 12) + prose(202, 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    settings = S.Settings(length=40, gram=12, screen_bits=1 << 20, shard_bytes=2_000)
    seen = []
    likely = S.likely
    try:
        S.likely = lambda strings, settings: seen.append((strings.where("bytes is not null").count(), likely(strings, settings))) or seen[-1][1]
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.cut(df, settings).collect()}
    finally:
        S.likely = likely
    assert got == dict(enumerate(plain([t.encode() for t in texts], 40)))
    had, left = seen[0]
    assert 0 < left.count() <= had / 2


def test_equal_strings_share_a_core():
    rng = random.Random(7)
    settings = S.Settings(length=12, gram=4)
    for _ in range(200):
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(40))) for _ in range(4)]
        texts.append(texts[0] + texts[1][:3])
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        first, last, value, _, grams = S.runs(data, offsets, 12, 4)
        once = np.array([(grams[a : b + 9] == v).sum() == 1 for a, b, v in zip(first, last, value, strict=True)], bool)
        first, last, value = first[once], last[once], value[once]
        before, has_before, behind, has_behind = S.cores(first, last, value, grams, settings)
        assert (has_before | has_behind).all()
        named: dict[bytes, set] = {}
        for k in range(len(first)):
            place = first[k] + int(np.flatnonzero(grams[first[k] : last[k] + 9] == value[k])[0])
            for i in range(first[k], last[k] + 1):
                early = place - i >= 5
                assert (has_before if early else has_behind)[k]
                named.setdefault(bytes(data[i : i + 12]), set()).add((early, int((before if early else behind)[k])))
        assert all(len(x) == 1 for x in named.values())
