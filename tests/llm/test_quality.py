import re
from collections import Counter

import numpy as np
import pytest

from pressgauge.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    words = re.findall(WORD, text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubled, len(repeated)


CASES = ["", "a", "a b c a b c", "a a a a", "x\ny\nx\n \n \n x", "no break \x1f unit", "a|b <c> # $ % & *\v\f", "é\ré\ré\ré", "q w e r t y", "a b c d a b c"]


def test_counts_equal_the_rules(spark, odd_docs, texts_of):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for frame in (df, odd_docs):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measure(frame).collect())
        assert got == Counter((i, *plain(t)) for i, t in texts_of(frame))


def test_learned_list_is_precise_and_ordered(spark):
    rng = np.random.default_rng(2)
    values = rng.uniform(size=(3_000, len(quality.FEATURES)))
    bad = (values[:, 1] > 0.8) | ((values[:, 3] > 0.7) & (values[:, 4] < 0.2))
    prune = rng.uniform(size=3_000) < 1 / 3
    rules = quality.learn(values, bad, prune)
    hit = np.logical_or.reduce([quality._covered(r, values) for r in rules])
    assert rules and bad[hit].mean() > 0.97 and hit[bad].mean() > 0.9
    # the Spark expression numbers the first rule that holds
    cuts = [quality.Condition("symbol_share", True, 0.5)], [quality.Condition("word_length", False, 3.0)]
    df = spark.createDataFrame([(4, 8, 2), (4, 20, 3), (4, 8, 0), (4, 20, 0)], "n_words long, word_chars long, n_symbols long")
    assert [r[0] for r in df.select(quality.rule_number([tuple(c) for c in cuts])).collect()] == [1, 1, 2, None]


@pytest.mark.parametrize("labelled", [True, False])
def test_judging_rows(spark, prose, labelled):
    good = [prose(k, 80) for k in range(120)]
    bad = [" ".join(w + "***" for w in prose(k, 80).split()) for k in range(60)]
    rows = list(enumerate([*good, *bad, prose(1, 20), "again and " * 60, None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(k, 1 if k < 120 else 0) for k in range(180)] + [(5, None), (None, 0), (9_999, 0), (0, 1)]
    labels = spark.createDataFrame(known if labelled else [], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(got[k].kept for k in range(120))
    assert all(got[k].kept != labelled for k in range(120, 180))
    assert all(got[k].base_failed and not got[k].kept for k in (180, 181, 182))


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert quality.judge(odd_docs, labels).count() == odd_docs.count()
    assert quality.judge(no_docs, labels).collect() == []
