"""The pipeline stage by stage: what each keeps, drops and changes."""

import pytest

import corpus_pipeline
from basin.llm import pii, queries
from tests.llm.helpers import empty, odd_documents, rows
from tests.llm.test_duplicates import plain_fingerprint, union


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents after each stage, written and read back as the driver does."""
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, sf_dir, stages):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert all(s.columns == documents.columns for s in stages[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in [documents, *stages]]
    scores = {r.doc_id: r.score for r in queries.QUERIES["op7_toxicity"](spark, sf_dir).collect()}
    assert ids[1] == {i for i in ids[0] if scores[i] < 0.5}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in stages[0].collect()}
    order = sorted(prints)
    near = [(a, b) for i, a in enumerate(order) for b in order[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = union(near, order)
    assert ids[2] == {i for i in order if root[i] == i}
    assert ids[3] == ids[2]
    assert stages[2].filter(pii.has_entity("text")).count() == stages[1].filter(pii.has_entity("text")).count() > 0
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[1:3])
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {r.doc_id for r in stages[1].filter(pii.has_entity("text")).collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = {i for i in ids[3] if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
    low = {i for i in ids[3] if i in labels and labels[i].quality == 0}
    assert ids[4] <= ids[3] and len(clean & ids[4]) > 0.9 * len(clean) and len(low & ids[4]) < 0.9 * len(low)
    assert ids[5] == ids[4] and set(stages[4].columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run_gives_the_same_rows(spark, sf_dir, stages):
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(stages[-1])


def test_stages_take_odd_and_empty_documents(spark, sf_dir):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, empty(docs), sf_dir)) == [], name
        assert stage(spark, docs, sf_dir).count() > 0, name


def test_token_shares_after_the_mixing_stage(spark, sf_dir, stages):
    from basin.llm import mixing
    labelled = queries.labelled_quality(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rates = mixing.document_rates(stages[2], labelled, queries.PIPELINE_TARGETS)
    kept = stages[3].select("doc_id").join(rates, "doc_id").selectExpr("sum(n_tokens * p_low) / sum(n_tokens * (p_low + p_clean))")
    assert kept.first()[0] == pytest.approx(queries.PIPELINE_TARGETS["low"], abs=0.015)
