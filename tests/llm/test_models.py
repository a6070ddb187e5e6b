"""Classifiers on rows that the fit did not see, and the pipeline stage by stage."""

import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import grams, quality, queries, simhash, toxicity
from tests.llm.helpers import odd_docs

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def middle():
    import os

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    return path


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.96)])
def test_held_out_rows(spark, middle, name, label, least):
    out = queries.queries()[name](spark, middle)
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    assert out.count() == docs.count()
    met = out.join(spark.read.parquet(f"{middle}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in met)
    unseen = [r for r in met if r.held_out]
    assert sum(r.predicted == r[label] for r in unseen) / len(unseen) >= least


def test_samples_are_bounded_and_leave_out(spark, middle):
    docs, labels = spark.read.parquet(f"{middle}/documents.parquet"), spark.read.parquet(f"{middle}/labels.parquet")
    assert grams.labelled_sample(docs, labels, "toxic", 50).count() == 50
    every = grams.labelled_sample(docs, labels.unionByName(labels), "toxic", 10_000).cache()
    assert every.count() == labels.where(~grams.held_out(F.col("doc_id"))).count()
    half = every.agg(F.sum(F.char_length("text"))).first()[0] // 2
    assert half * 0.9 < grams.labelled_sample(docs, labels, "toxic", 10_000, half).agg(F.sum(F.char_length("text"))).first()[0] <= half
    every.unpersist()


def test_fits_are_the_same_wherever_they_run(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = sorted(grams.labelled_sample(docs, labels, "toxic", 80).collect())
    there, here = toxicity.train(docs, labels, 80), toxicity.fit([(r.text, r.y) for r in rows])
    assert there.bias == here.bias and (there.weights == here.weights).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_tables(spark, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)] + [(None, 1, 1), (6, None, 0)], LABELS)
    df = odd_docs(spark, True)
    out = module.judged(df, labels)
    assert out.count() == df.count() and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert {r.score for r in module.judged(df, labels.limit(0)).collect()} == {0.5}
    assert module.judged(df.limit(0), labels).isEmpty()
    one = module.fit([("a b c", 1)])
    assert one.scores(["", "x"])[0] > 0.5


def test_ngrams_do_not_cross_texts():
    a, b = toxicity.features(["abcdef", "ghijkl"]), [toxicity.features([t]) for t in ("abcdef", "ghijkl")]
    assert sorted(a[1].tolist()) == sorted([*b[0][1].tolist(), *b[1][1].tolist()])
    whole = quality.SubwordModel(__import__("numpy").random.default_rng(0).normal(size=1 << quality.BITS), 0.1)
    texts = ["one two two", "three", "", "four five six " * 50]
    assert whole.scores(texts) == pytest.approx([whole.scores([t])[0] for t in texts])


def test_pipeline_by_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash near-dedup", "secret scans", "mixing sources", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(pipeline.STAGES)
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    scores = dict(zip(rows, model.scores([r.text or "" for r in rows.values()])))
    one = stage["toxicity"](spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {d for d, s in scores.items() if s < 0.5}
    two = stage["simhash near-dedup"](spark, one, sf)
    least = {r.component_id for r in simhash.classes(one).collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == least
    three = stage["secret scans"](spark, two, sf)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == least
    four = stage["mixing sources"](spark, three, sf)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= least
    per = four.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= per <= 2
    five = stage["bpe"](spark, four, sf)
    assert five.count() == four.count() == pipeline.run(spark, sf).count()


def test_pipeline_keeps_extra_columns(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as size", "2 as score", "3 as fp", "4 as target")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns[-4:] == ["size", "score", "fp", "target"] and docs.where("size <> 1 or score <> 2 or fp <> 3 or target <> 4").isEmpty()
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).isEmpty()
