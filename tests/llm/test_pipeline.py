import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from pressgauge.llm import bagminhash, bpe, mixing, pii, quality, queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What goes into each stage and comes out of it."""
    folder, docs, seen = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        out = spark.read.parquet(f"{folder}/{n}")
        seen.append((docs, out))
        docs = out
    return seen


def rows(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_columns(stages):
    assert all(tuple(out.columns) == corpus_pipeline.COLUMNS for _, out in stages[:-1])


def test_quality_stage(spark, sf_dir, stages):
    before, after = stages[0]
    judged = quality.judge(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert rows(after) == Counter(r for r in rows(before).elements() if r[0] in kept)


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    classes = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(before).collect()}
    assert rows(after) == Counter(r for r in rows(before).elements() if classes[r[0]] == r[0])


def test_redaction_stage(stages):
    before, after = stages[2]
    model = pii.train(before)
    want = Counter()
    for doc_id, text, lang, source, _ in rows(before).elements():
        new = pii.redact(text, pii.find_spans([text], model)[0][1])
        want[(doc_id, new, lang, source, len(new))] += 1
    assert rows(after) == want
    assert not any(pii.base_spans(t) for _, t, *_ in rows(after))


def test_mixing_stage(stages):
    before, after = stages[3]
    times = {r.doc_id: r.first_taken for r in mixing.plan_mix(before).collect()}
    assert rows(after) == Counter({r: times[r[0]] for r in rows(before) if times[r[0]]})
    assert set(times.values()) <= {0, 1, 2}


def test_encoding_stage(stages):
    before, after = stages[4]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text, *_ in rows(before).elements():
        ids = own.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want[(doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect())


def test_odd_and_empty_documents(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()
    # each stage alone takes what the pipeline itself would have dropped before it
    for _, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, odd_docs, str(tmp_path)).count()


def test_every_operator_has_its_query():
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.SQL) <= set(queries.QUERIES)
