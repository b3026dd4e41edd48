import numpy as np
from pyspark.sql import functions as F

from terrasol.llm.quality import fit, op7_quality, score, train
from tests.conftest import DATA


def test_interaction_is_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells anything
    model = fit(x[:3000], y[:3000])
    assert {0, 1} in [set(p) for p in model.pairs]
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9


def test_constant_labels_and_no_labels():
    for y in (np.ones(10), np.empty(0)):
        p = fit(np.zeros((len(y), 3)), y).score(np.zeros((2, 3)))
        assert np.isfinite(p).all() and (p > 0).all() and (p < 1).all()


def test_held_out_accuracy(spark):
    out = op7_quality(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.min(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept")).first()
    assert r.a >= 0.9 and r.kept == 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "A fine text.", "x"), (4, "word " * 100_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, None), (None, 1), (9, 7)], "doc_id long, quality int")
    got = score(docs, train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), train(docs, labels.limit(0))).count() == 0
