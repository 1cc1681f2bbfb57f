"""Registered queries that SQL can't say: their whole results against what defines them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import boosting, categorical, embedding, explore, forecast, panel
from weekloom.plans import catalogue


@pytest.fixture(scope="module")
def frame(spark, sf_dir):
    df, names = catalogue._model_frame(spark, sf_dir)
    return df, names, *explore.split(df, 300, 301, 357)


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    return catalogue._fitted(spark, sf_dir)[-1]


def test_gbt_train_score(fitted, frame, spark, sf_dir, monkeypatch):
    """The error over validation rows, worked out from the predictions themselves."""
    monkeypatch.setattr(catalogue, "_fitted", lambda *a: (*frame, fitted))
    *_, valid = frame
    p = fitted.transform(valid).select("qty", "prediction").toPandas()
    error = (p.qty - p.prediction.clip(lower=0)).abs()
    (got,) = catalogue.gbt_train_score(spark, sf_dir).collect()
    assert got.wmape == pytest.approx(error.sum() / p.qty.abs().sum()) and got.mae == pytest.approx(error.mean())


def test_feature_importance(fitted, frame, spark, sf_dir, monkeypatch):
    """All features, most important first; one that no tree splits on has none, and all shares add up to one."""
    monkeypatch.setattr(catalogue, "_fitted", lambda *a: (*frame, fitted))
    rows = catalogue.feature_importance(spark, sf_dir).collect()
    names, trees = frame[1], fitted.stages[-1].toDebugString
    assert sorted(r.feature for r in rows) == sorted(names) and [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    assert sum(r.importance for r in rows) == pytest.approx(1)
    assert {r.feature for r in rows if r.importance > 0} == {n for i, n in enumerate(names) if f"feature {i} " in trees}


def test_recursive_forecast(fitted, frame, spark, sf_dir, monkeypatch):
    """Five weeks of each key of twelve weeks or more; the first one's are the model's own for the row after the last."""
    monkeypatch.setattr(catalogue, "_fitted", lambda *a: (*frame, fitted))
    got = catalogue.settle(catalogue.recursive_forecast(spark, sf_dir))
    keys = explore.long_histories(frame[0]).count()
    assert [(r.semana, r["count"]) for r in got.groupBy("semana").count().orderBy("semana").collect()] == [(w, keys) for w in range(1, 6)]
    state = forecast.histories(frame[0], 24, 12)
    first = fitted.transform(forecast.history_features(state, F.lit(1).cast("bigint"), F.lit(357), catalogue._MODEL, advanced=False))
    want = {(r.pdv, r.internal_product_id): max(r.prediction, 0.0) for r in first.collect()}
    assert {(r.pdv, r.produto): r.predicted for r in got.filter("semana = 1").collect()} == pytest.approx(want)
    assert got.filter("quantidade < 0 or abs(quantidade - predicted) > 0.5").count() == 0


def test_iterative_forecast(spark, sf_dir):
    got = catalogue.settle(catalogue.iterative_forecast(spark, sf_dir))
    top = {(r.pdv, r.internal_product_id) for r in catalogue._direct_frame(spark, sf_dir).select(*panel.KEYS).distinct().collect()}
    assert got.count() == 5 * len(top) and {(r.pdv, r.produto) for r in got.collect()} == top
    by_week = {r.semana: r.total for r in got.groupBy("semana").agg(F.sum("quantidade").alias("total")).collect()}
    assert by_week[5] == pytest.approx(by_week[4] * 3 / 7, rel=0.15) and got.filter("quantidade < 0").count() == 0


def test_loss_tournament(fitted, frame, spark, sf_dir):
    """The best is first, and trees of absolute loss have the score of their own query."""
    rows = catalogue.loss_tournament(spark, sf_dir).collect()
    assert [r.wmape for r in rows] == sorted(r.wmape for r in rows) and {r.model for r in rows} == {"squared", "absolute", "huber"}
    assert {r.model: r.wmape for r in rows}["absolute"] == pytest.approx(forecast.validate(fitted, frame[-1]).first().wmape)


def test_leafwise_tournament(frame, spark, sf_dir):
    """Each score is that of a fit of its own, worked out apart, and the best is first."""
    rows = catalogue.leafwise_tournament(spark, sf_dir).collect()
    assert [r.wmape for r in rows] == sorted(r.wmape for r in rows) and {r.model for r in rows} == {"squared", "absolute", "huber"}
    _, names, train, valid = frame
    x, y = valid.select(*names).toPandas().to_numpy(float), valid.select("qty").toPandas().qty.to_numpy()
    for r in rows[:2]:
        model = boosting.fit(train, names, "qty", valid, boosting.OBJECTIVES[r.model]())
        assert r.wmape == pytest.approx(np.abs(np.maximum(model.values(x), 0) - y).sum() / y.sum())


def test_leafwise_train_score(frame, spark, sf_dir):
    _, names, train, valid = frame
    (got,) = catalogue.leafwise_train_score(spark, sf_dir).collect()
    model = boosting.fit(train, names, valid=valid)
    assert got.wmape == pytest.approx(min(model.wmape)) and got.wmape <= model.wmape[0]


def test_random_search(spark, sf_dir):
    """Halves are given up at rungs, and what went furthest is in order of its error."""
    rows = sorted(catalogue.random_search(spark, sf_dir).collect())
    assert sorted(r.draw for r in rows) == list(range(25)) and [r.place for r in rows] == list(range(1, 26))
    assert [sum(r.rounds == n for r in rows) for n in (1, 3, 6)] == [12, 6, 3] and all(r.rounds == r.most_rounds for r in rows[:4])
    assert [r.mae for r in rows[:4]] == sorted(r.mae for r in rows[:4])
    assert [(r.leaves, r.ridge) for r in sorted(rows, key=lambda r: r.draw)] == [(g.leaves, round(g.ridge, 6)) for g in boosting.random_growths(25, 42)]


def test_category_embedding(spark, sf_dir):
    """Components of the standardised statistics, but for their signs."""
    context = categorical.category_context(catalogue.weekly(spark, sf_dir, "categoria"), "categoria", wide=True).toPandas().set_index("value").astype(float)
    z = (context - context.mean()) / context.std()
    values, vectors = np.linalg.eigh(np.cov(z.to_numpy().T))
    want = z.to_numpy() @ vectors[:, np.argsort(-values)[:3]]
    got = catalogue.category_embedding(spark, sf_dir).toPandas().set_index("value").loc[z.index]
    mine = np.array(got.embedding.tolist())
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-6)


@pytest.mark.parametrize("values", [[], ["a"], [None], ["a", "b"]])
def test_category_embedding_of_few_values(spark, values):
    """A table in which all rows have one value, or none, has no components; of two values there is one."""
    rows = [(v, q + 10.0 * i) for i, v in enumerate(values) for q in (1.0, 2.0, 4.0)]
    df = categorical.category_embedding(spark.createDataFrame(rows, "categoria string, qty double"), "categoria")
    found = {r.value: r.embedding.toArray() for r in df.collect()}
    assert set(found) == set(values) and all(len(v) == 3 for v in found.values())
    if len(values) < 2:
        assert not any(v.any() for v in found.values())
    else:
        assert np.allclose(found["a"], -found["b"]) and found["a"][0] and np.allclose(found["a"][1:], 0)


def test_category_embedding_of_equal_values(spark):
    rows = [(v, q) for v in "ab" for q in (1.0, 2.0, 4.0)]
    df = categorical.category_embedding(spark.createDataFrame(rows, "categoria string, qty double"), "categoria")
    assert [r.embedding.toArray().tolist() for r in df.collect()] == [[0.0] * 3] * 2


def test_embeddings_of_the_panel(spark, sf_dir):
    df = catalogue.settle(catalogue.weekly(spark, sf_dir, "categoria"))
    means = {r.categoria: r.y for r in df.groupBy("categoria").agg(F.avg("qty").alias("y")).collect()}
    found = catalogue.supervised_embedding(spark, sf_dir).collect()
    assert {r.value for r in found} == set(means)
    assert np.mean([abs(r.predicted - means[r.value]) for r in found]) < 0.5 * np.std(list(means.values()))
    coded = catalogue.autoencoder_embedding(spark, sf_dir).collect()
    assert {r.value for r in coded} == set(means) and {len(r.embedding) for r in coded} == {3}
    linear = embedding.autoencoder(categorical.category_context(df, "categoria", wide=True), steps=0)
    assert np.mean([r.error for r in coded]) < linear.agg(F.avg("error")).first()[0]


def test_comprehensive_features(spark, sf_dir):
    """Every row of the panel, no nulls, and the basic columns those of their own query."""
    got = catalogue.settle(catalogue.comprehensive_features(spark, sf_dir))
    assert got.count() == catalogue.weekly(spark, sf_dir).count() and len(got.columns) > 70
    nulls = explore.null_counts(got).first().asDict()
    assert not any(nulls.values())
    both = got.select("week_of_year", *panel.KEYS, F.col("lag_1").alias("a"), F.col("rmean_4").alias("b")).join(catalogue.rolling_basic(spark, sf_dir), ["week_of_year", *panel.KEYS])
    assert both.filter("abs(a - lag_1) > 1e-6 or abs(b - rmean_4) > 1e-6").count() == 0 and both.count() == got.count()
