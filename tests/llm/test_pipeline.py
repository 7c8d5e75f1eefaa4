"""The corpus pipeline stage by stage on the small tables and on awkward rows."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from graphmill.llm import toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def test_stages_in_order(spark, tmp_path):
    docs = given = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == given.dtypes
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    sizes = [len(kept[name]) for name, _ in corpus_pipeline.STAGES]
    assert sizes[0] < given.count() and sizes == sorted(sizes, reverse=True)
    assert kept["suffix_array"] == kept["near_duplicates"] and kept["bpe"] == kept["decontamination"]
    run = corpus_pipeline.run(spark, DATA)
    assert Counter(map(repr, run.collect())) == Counter(map(repr, docs.collect()))


def test_toxic_rows_go_and_clean_ones_stay(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, DATA).select("doc_id")
    clean = labels.where("toxic = 0").join(docs, "doc_id")
    assert clean.join(left, "doc_id").count() >= 0.97 * clean.count()
    assert toxicity.REJECT < 0.5


def test_one_document_of_each_group_stays(spark, docs):
    left = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    ids = [r.doc_id for r in left.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and None in ids
    assert corpus_pipeline.drop_near_duplicates(spark, left, DATA).count() == left.count()


def test_unlike_texts_of_an_id_and_rows_without_an_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a), (2, d), (3, b), (None, c), (None, c), (None, a + " end"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "s", "en", 0) for i, t in rows], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    left = [r.text for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()]
    assert len(left) == 6 and {"", None} < set(left)
    assert sorted((t or "")[:1] for t in left) == ["", "", "a", "b", "c", "d"]


def test_cut_texts_and_counts_agree(spark, docs):
    out = {(r.doc_id, r.source): r for r in corpus_pipeline.cut_repeats(spark, docs, DATA).collect()}
    assert out[(0, "s")].text is None and out[(3, "s")].text == "short"
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text is not None and r.n_chars is not None)
    assert sum(len(r.text or "") for r in out.values()) < sum(len(r.text or "") for r in docs.collect())


def test_stages_take_empty_tables(spark, empty_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, DATA).count() == 0
