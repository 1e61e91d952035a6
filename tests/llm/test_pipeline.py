import re
from collections import Counter

import pytest
from test_packing import best_fit_one_by_one

import corpus_pipeline
from tracelake.llm import ngram_join, quality_classifier, secret_scan
from tracelake.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, medium, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's."""
    docs, out = spark.read.parquet(f"{medium}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, medium).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_all_but_the_last_have_the_columns_of_documents(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns


def test_classifier_rejects_what_it_scores_low(spark, medium, stages):
    before, after = stages[0]
    scores = quality_classifier.scored(spark, before, spark.read.parquet(f"{medium}/labels.parquet")).collect()
    assert ids(after) == Counter(r["doc_id"] for r in scores if r["predicted"])
    assert 0 < after.count() < before.count()


def test_one_document_of_each_group_stays(spark, stages):
    before, after = stages[1]
    groups = {r["component_id"] for r in ngram_join.join(spark, before).collect()}
    assert set(ids(after)) == groups and after.count() == len(groups)


def test_secrets_are_masked_and_documents_stay(stages):
    before, after = stages[2]
    assert ids(before) == ids(after)
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["text"] == secret_scan.masked_text(old[r["doc_id"]]) and r["n_chars"] == len(r["text"])


def test_sources_come_near_their_targets(stages):
    from test_source_mix import wanted_targets

    before, after = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in before.collect():
        sizes[r["source"]] += size(r["text"])
    for r in after.collect():
        taken[r["source"]] += size(r["text"])
    for source, target in wanted_targets(sizes).items():
        assert abs(taken[source] - target) <= 20
    assert max(ids(after).values()) <= 3


def test_everything_is_packed(stages):
    before, after = stages[4]
    got = after.toPandas()
    assert Counter(got[got["piece"] == 0]["doc_id"]) == ids(before)
    assert got["sequence_id"].nunique() == best_fit_one_by_one(got["length"].tolist(), 4096)


def test_stage_on_an_empty_table(spark, medium, stages):
    docs = stages[0][0].limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, medium)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, medium).count() == 0


def test_texts_go_to_workers_in_small_batches(spark, medium):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.read.parquet(f"{medium}/documents.parquet")
    try:
        for rows, want in (("10000", 1000), ("0", 1000), ("300", 300)):
            spark.conf.set(name, rows)
            corpus_pipeline.mask_secrets(spark, docs, medium)
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    from oracle import compare, connect

    compare(QUERIES[name](spark, small), connect(small), ORACLES[name])


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 11)] == [1] * 10
