"""Embeddings of attribute values: errors, gradients and reruns."""

import numpy as np
import pytest
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import functions as F

from weekloom.operators import categorical, embedding
from weekloom.plans import catalogue


@pytest.fixture(scope="module")
def context(spark, sf_dir):
    return catalogue.settle(categorical.category_context(catalogue.weekly(spark, sf_dir, "categoria"), "categoria", wide=True))


def numeric_gradient(slope, weights, x):
    out = []
    for i, w in enumerate(weights):
        g = np.zeros_like(w)
        for at in np.ndindex(w.shape):
            ends = []
            for side in (1e-6, -1e-6):
                moved = [v.copy() for v in weights]
                moved[i][at] += side
                ends.append(slope(moved, x)[0])
            g[at] = (ends[0] - ends[1]) / 2e-6
        out.append(g)
    return out


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    shapes = [(4, 9), (9,), (9, 2), (2,), (2, 9), (9,), (9, 4), (4,)]
    weights, x = [rng.normal(0, 0.7, s) for s in shapes], rng.normal(0, 1, (7, 4))
    for mine, want in zip(embedding._autoencoder_slope(weights, x)[1], numeric_gradient(embedding._autoencoder_slope, weights, x)):
        assert np.allclose(mine, want, atol=1e-5)
    slope, rows = embedding._supervised_slope(2), np.hstack([rng.integers(1, 9, (6, 1)), rng.normal(3, 1, (6, 1)), rng.uniform(-1, 1, (6, 2))])
    weights = [rng.normal(1, 0.3, 2), np.array([2.0])]
    for mine, want in zip(slope(weights, rows)[1], numeric_gradient(slope, weights, rows)):
        assert np.allclose(mine, want, atol=1e-4)


def test_it_begins_at_the_components_and_errs_less(spark, context):
    """At equal size the error is under that of category_embedding, whose components are linear."""
    scaled = categorical.scaled_context(context)
    names = [c for c in scaled.columns if c != "value"]
    x = scaled.select(*names).toPandas().to_numpy()
    fitted = PCA(k=2, inputCol="x", outputCol="e").fit(VectorAssembler(inputCols=names, outputCol="x").transform(scaled))
    axes = fitted.pc.toArray()
    of_components = ((x - x @ axes @ axes.T) ** 2).mean()
    first = embedding.autoencoder(context, size=2, steps=0).agg(F.avg("error")).first()[0]
    assert first == pytest.approx(of_components, rel=1e-6)
    after = embedding.autoencoder(context, size=2, steps=40)
    assert after.agg(F.avg("error")).first()[0] < 0.98 * of_components
    assert [len(r.embedding) for r in after.take(3)] == [2, 2, 2] and after.count() == context.count()


def test_reruns_agree_and_parts_add_up(spark, context, monkeypatch):
    one = sorted(map(tuple, embedding.autoencoder(context.coalesce(1), size=2, steps=5).collect()), key=str)
    assert one == sorted(map(tuple, embedding.autoencoder(context.coalesce(1), size=2, steps=5).collect()), key=str)
    monkeypatch.setattr(embedding, "FAN", 2)
    many = {r.value: r.embedding for r in embedding.autoencoder(context.repartition(5), size=2, steps=5).collect()}
    assert all(np.allclose(many[value], code, atol=1e-7) for value, code, _ in one)


def test_minibatches_and_empty_tables(spark, context):
    assert embedding.autoencoder(context.repartition(6), size=2, steps=6, turns=2).count() == context.count()
    assert embedding.autoencoder(context.limit(0)).count() == 0
    assert embedding.supervised(spark.createDataFrame([], "c string, qty double"), "c").count() == 0
    odd = embedding.autoencoder(spark.createDataFrame([(None, 1.0, None), ("a", 1.0, 2.0), ("b", 1.0, 2.0)], "value string, n double, m double"), size=5, steps=2)
    assert {r.value: len(r.embedding) for r in odd.collect()} == {None: 2, "a": 2, "b": 2}


def test_supervised_vectors_tell_the_mean(spark):
    rows = [("a", 1.0)] * 50 + [("b", 5.0)] * 40 + [("c", 9.0)] * 60 + [(None, 3.0)] * 10 + [("a", None)]
    found = {r.value: r for r in embedding.supervised(spark.createDataFrame(rows, "c string, qty double"), "c", size=2).collect()}
    assert {k: round(r.predicted) for k, r in found.items()} == {"a": 1, "b": 5, "c": 9, None: 3}
    assert all(len(r.embedding) == 2 for r in found.values())
