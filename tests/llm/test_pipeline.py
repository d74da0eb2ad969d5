"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from railbird.llm import packing, pii, quality
from railbird.llm.queries import tokenizer
from railbird.llm.stage import materialize
from tests.llm.test_operators import NASTY, PRIVATE, brute_contamination, brute_groups, brute_spans, docs_of, near_copies


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay_until_the_last_stage(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])
    assert 0 < steps[5].count()


def test_classifier_rejects_what_it_scores_low(spark, sf, steps):
    scored = {r.doc_id for r in quality.score(steps[0], spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
    assert set(texts(steps[1])) == scored
    assert texts(steps[1]).items() <= texts(steps[0]).items()


def test_one_of_each_group_stays(steps):
    """Links are four bits or fewer, or a similarity of 0.8 or more of five-word shingles."""
    before, after = sorted(texts(steps[1]).items()), texts(steps[2])
    groups = brute_groups(before, 0.8)
    assert set(after) == {before[g][0] for g in groups}


def test_benchmark_passages_go(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute_contamination(list(texts(steps[2]).items()), items) if r[5]}
    assert set(texts(steps[3])) == set(texts(steps[2])) - hit


def test_personal_data_is_replaced(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert before.keys() == after.keys()
    spans = {r.doc_id: r.spans for r in pii.find_spans(steps[3]).collect()}
    for i, t in before.items():
        assert spans[i].startswith(brute_spans(t))
        assert after[i] == (pii.redact(t, spans[i]) if spans[i] else t)
        assert not brute_spans(after[i]) or brute_spans(t)


def test_every_token_is_packed(steps):
    encode = packing.Encoder(tokenizer("byte_bpe_50k.json"))
    want = sum(len(encode(t)) // 4 + 1 for t in texts(steps[4]).values())
    assert sum(r.length for r in steps[5].collect()) == want


def test_bare_rows_go_through_all_stages(spark, sf):
    """Nulls, repeated ids with different texts, clashing names, near copies; then nothing at all."""
    docs = docs_of(spark, NASTY + PRIVATE + near_copies()).withColumn("text", F.col("text").cast("string"))
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = materialize(stage(spark, now, sf), name)
            assert kept.columns == docs.columns
            n = kept.count()
            assert n <= now.count() and (name != "pii_sanitisation" or n == now.count())
            now = kept
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert packed.select("doc_id").count() >= now.count()


def test_run_leaves_only_its_own_tables(spark, sf):
    from railbird.llm import stage

    before = stage.tables_written()
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert stage.tables_written() == before + len(corpus_pipeline.STAGES)


def test_two_calls_at_once_keep_their_own_tables(spark):
    from threading import Barrier, Thread

    from railbird.llm import stage

    meet, left, counts = Barrier(2), {}, {}

    def call(k):
        with stage.only_last_stays(spark):
            one = stage.materialize(spark.range(10 + k), f"one{k}")
            meet.wait(120)
            left[k] = stage.materialize(one.where("id > 3"), f"two{k}")
            meet.wait(120)
        counts[k] = stage.tables_written()

    threads = [Thread(target=call, args=(k,)) for k in (0, 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {k: df.count() for k, df in left.items()} == {0: 6, 1: 7} and counts == {0: 1, 1: 1}


def test_training_takes_one_text_for_each_label(spark):
    from railbird.llm import quality

    texts = [(1, "good words of prose"), (2, "bad junk here")] * 30 + [(1, f"good words of prose {k}") for k in range(200)] + [(3, None), (3, "")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    weights, rates = quality.train(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    assert abs(rates[0] - 1 / 3) < 1e-9 and abs(rates[1] - 1 / 3) < 1e-9
