import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from pressgauge.llm import lm


def plain(rows, settings):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in rows]
    c1 = Counter(w for t in texts for w in t)
    c1["begin"] = sum(map(bool, texts))
    c2 = Counter(p for t in texts for p in zip(["begin", *t], t, strict=False))
    n, out = sum(map(len, texts)), []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        total, backed = 0.0, 0
        for v, w in zip(["begin", *t], t, strict=False):
            if c2[v, w] > 1:
                total += math.log((c2[v, w] - 1) / max(c1[v] - 1, 1))
            else:
                backed += 1
                total += math.log(settings.backoff * max(c1[w] - 1, 1) / max(n - 1, 1))
        out.append((doc_id, len(t), backed, round(total, 6), round(total / len(t), 6) if t else None))
    return out


def key(row):
    return [(x is None, x or 0) for x in row]


@pytest.mark.parametrize(
    "settings",
    [
        lm.Settings(),
        lm.Settings(vocabulary=25, shard_words=300, share_entries=100),
        lm.Settings(vocabulary=3, rare_shards=1, shard_words=300, share_entries=100),
        lm.Settings(vocabulary=0, shard_words=3_000),
    ],
)
def test_equals_counting(odd_docs, texts_of, settings):
    """How many words are common changes no answer; with few there are several shards of each kind, cut again."""
    got = sorted((tuple(r) for r in lm.scores(odd_docs, settings).collect()), key=key)
    want = sorted(plain(texts_of(odd_docs), settings), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs((a or 0) - (b or 0)) < 2e-6 for g, w in zip(got, want, strict=True) for a, b in zip(g[3:], w[3:], strict=True))


def test_equals_sql(spark, prose):
    settings = lm.Settings(vocabulary=12)
    frame = pd.DataFrame({"doc_id": range(30), "text": [prose(k, 5 * k) if k % 7 else None for k in range(30)]})
    con = duckdb.connect()
    con.register("documents", frame)
    want = sorted(con.execute(lm.oracle(settings)).fetchall())
    df = spark.createDataFrame([tuple(r) for r in frame.itertuples(index=False)], "doc_id long, text string")
    assert sorted(tuple(r) for r in lm.scores(df, settings).collect()) == want


def test_no_rows(no_docs):
    assert lm.scores(no_docs).collect() == []
