"""Leaf-wise trees against a plain program, and what they are for."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekloom.operators import boosting, explore, forecast, panel
from weekloom.plans import catalogue, pipeline
from weekloom.sources import sinks

NAMES = ["a", "b"]


def plain_tree(x, y, score, objective, growth, weight):
    """One best-first tree over the values themselves; gives splits and each row's leaf value."""
    g, h = objective.slopes(y, score)
    g, h = g * weight, h * weight

    def best(rows):
        found = (0.0, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + growth.ridge)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= v]
                right = rows[x[rows, f] > v]
                if min(len(left), len(right)) < growth.least_rows:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + growth.ridge) for s in (left, right)) - whole
                if gain > found[0] + 1e-9:
                    found = (gain, f, v)
        return found

    leaves, splits = [np.arange(len(y))], []
    while len(leaves) < growth.leaves:
        found = [best(rows) for rows in leaves]
        k = max(range(len(leaves)), key=lambda i: found[i][0])
        gain, f, v = found[k]
        if f is None:
            break
        rows = leaves[k]
        leaves[k] = rows[x[rows, f] <= v]
        leaves.append(rows[x[rows, f] > v])
        splits.append((f, v, gain))
    values = np.zeros(len(y))
    for rows in leaves:
        if objective.quantile is not None:
            values[rows] = growth.step * np.median(y[rows] - score[rows])
        else:
            step = -g[rows].sum() / (h[rows].sum() + growth.ridge)
            values[rows] = growth.step * max(-growth.most_step, min(growth.most_step, step))
    return splits, values


@pytest.mark.parametrize("name", sorted(boosting.OBJECTIVES))
def test_trees_equal_a_plain_program(spark, name):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 9, 500), rng.integers(0, 30, 500)], axis=1).astype(float)
    y = np.maximum(0, np.round(x[:, 0] * 1.7 - (x[:, 1] > 20) * 6 + rng.normal(0, 2, 500), 3))
    weight = np.ones(500) if boosting.OBJECTIVES[name]().quantile is not None else rng.integers(1, 4, 500).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "qty": y, "w": weight})).repartition(3)
    objective, growth = boosting.OBJECTIVES[name](), boosting.Growth(rounds=12, step=0.4, leaves=6, least_rows=10, ridge=0.5, most_step=3.0)
    model = boosting.fit(df, NAMES, objective=objective, growth=growth, weight="w")
    score = np.full(500, np.average(y, weights=weight) if objective.start == "mean" else model.start)
    if objective.start == "median" and (weight == 1).all():
        assert model.start == pytest.approx(np.median(y))
    assert len(model.trees) == 12
    for tree in model.trees:
        splits, values = plain_tree(x, y, score, objective, growth, weight)
        mine = sorted((f, e, round(g, 6)) for f, e, g in zip(tree.feature, tree.edge, tree.gain) if f >= 0)
        assert mine == sorted((f, v, round(g, 6)) for f, v, g in splits)
        score = score + values
    got = model.transform(df).select(*NAMES, "prediction").toPandas()
    want = {tuple(k): s for k, s in zip(x, score)}
    assert all(want[r.a, r.b] == pytest.approx(r.prediction) for r in got.itertuples())
    assert sum(model.importances().values()) == pytest.approx(1)
    gains = sum(g for t in model.trees for f, g in zip(t.feature, t.gain) if f == 0)
    assert model.importances()["a"] == pytest.approx(gains / sum(g for t in model.trees for g in t.gain))


def test_leaf_values_are_medians_of_any_numbers(spark):
    """Also where a bucket holds many values, and for numbers of very different sizes."""
    rng = np.random.default_rng(8)
    for values in (rng.normal(0, 1, 301), 10.0 ** rng.uniform(-9, 9, 200), np.repeat([1.0, 2.0], 50), np.array([5.0]), np.array([-1e300, 1e300, 3.0, 4.0])):
        df = spark.createDataFrame(pd.DataFrame({"a": np.zeros(len(values)), "b": np.zeros(len(values)), "qty": values}))
        assert boosting.fit(df, NAMES, growth=boosting.Growth(rounds=0)).start == pytest.approx(np.median(values))


def test_missing_values_go_left_and_rows_without_target_do_not_count(spark):
    rows = [(None, 1.0, 0.0)] * 30 + [(1.0, 1.0, 0.0)] * 30 + [(5.0, 1.0, 9.0)] * 60 + [(5.0, 1.0, None), (float("nan"), 1.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, qty double")
    model = boosting.fit(df, NAMES, objective=boosting.squared(), growth=boosting.Growth(rounds=1, step=1.0))
    got = {(r.a if r.a == r.a else "nan"): round(r.prediction, 6) for r in model.transform(df).collect()}
    assert got == {None: 0.0, "nan": 0.0, 1.0: 0.0, 5.0: 9.0}


def test_of_no_rows_there_are_no_trees(spark):
    df = spark.createDataFrame([], "a double, b double, qty double")
    model = boosting.fit(df, NAMES, valid=df)
    assert model.trees == [] and model.start == 0.0
    assert model.transform(df).count() == 0
    constant = spark.createDataFrame([(1.0, 2.0, 3.0)] * 50, df.schema)
    assert boosting.fit(constant, NAMES).trees == [] and boosting.fit(constant, NAMES).start == 3.0


def test_fitting_stops_and_reruns_agree(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(0, 1, 800), "b": rng.normal(0, 1, 800), "qty": 5 + rng.normal(0, 1, 800)})
    frame.loc[frame.a > 0, "qty"] += 4
    df = spark.createDataFrame(frame).repartition(4)
    train, valid = df.filter("b < 0.5"), df.filter("b >= 0.5")
    growth = boosting.Growth(rounds=40, step=0.5, leaves=4, patience=3)
    model = boosting.fit(train, NAMES, valid=valid, growth=growth)
    assert 0 < len(model.trees) < 40 and model.wmape[len(model.trees)] == min(model.wmape)
    assert len(model.wmape) == len(model.trees) + 1 + 3
    assert boosting.fit(train, NAMES, valid=valid, growth=growth).as_dict() == model.as_dict()
    assert model.wmape[len(model.trees)] == pytest.approx(forecast.validate(model, valid).first().wmape)


def test_added_up_in_steps_it_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.integers(0, 9, 300), "b": rng.integers(0, 9, 300), "qty": rng.integers(0, 50, 300)}).astype(float)
    one = boosting.fit(spark.createDataFrame(frame).coalesce(1), NAMES, growth=boosting.Growth(rounds=3, leaves=5))
    monkeypatch.setattr(boosting, "FAN", 2)
    many = boosting.fit(spark.createDataFrame(frame).repartition(7), NAMES, growth=boosting.Growth(rounds=3, leaves=5))
    assert one.as_dict() == many.as_dict()


def test_zero_demand_costs_less_than_with_the_weight_column(spark, sf_dir):
    """Where a third of the rows sell nothing, the objective errs less on them than weighted trees of absolute loss."""
    df, names = catalogue._model_frame(spark, sf_dir)
    df = catalogue.settle(df.withColumn("qty", F.greatest(F.col("qty") - 20, F.lit(0.0))))
    asymmetric = boosting.fit(df, names, objective=boosting.asymmetric_log_cosh(1.5), growth=boosting.Growth(rounds=10, most_step=10.0))
    weighted = forecast.train_trees(forecast.zero_weight(df), names, params=catalogue.replace(catalogue.PARAMS, rounds=10), weight="weight")
    error = lambda m: m.transform(df).filter("qty = 0").agg(F.avg(F.abs(F.greatest("prediction", F.lit(0.0))))).first()[0]
    assert df.filter("qty = 0").count() > 1000
    assert error(asymmetric) < error(weighted)


def test_leaf_wise_trees_score_no_worse(spark, sf_dir):
    df, names = catalogue._model_frame(spark, sf_dir)
    train, valid = explore.split(df, 300, 301, 357)
    leaf_wise = forecast.validate(boosting.fit(train, names, valid=valid), valid).first().wmape
    assert leaf_wise <= catalogue.gbt_train_score(spark, sf_dir).first().wmape


def test_the_pipeline_with_leaf_wise_trees(spark, sf_dir, tmp_path):
    tables = catalogue.transactions(spark, sf_dir)
    tables.write.parquet(f"{tmp_path}/tx")
    params = catalogue.replace(catalogue._MODEL, rounds=3)
    scores = pipeline.run(spark, f"{tmp_path}/tx", f"{tmp_path}/out", "huber", advanced=False, params=params, leaf_wise=True)
    assert math.isfinite(scores["wmape"])
    model = sinks.read_model(spark, f"{tmp_path}/out/model.json")
    assert model.features and sinks.read_model(spark, f"{tmp_path}/none.json") is None
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/importance").count() == len(model.features)
    assert spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/out/submission").count() > 0
    with pytest.raises(ValueError):
        pipeline.run(spark, f"{tmp_path}/tx", f"{tmp_path}/out2", "huber")


def test_a_search_equals_plain_folds(spark):
    """Each draw that goes all the way has the errors of fits on two folds, scored on the third; the others those of theirs
    up to the rung at which they were given up."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"a": rng.integers(0, 9, 600), "b": rng.integers(0, 12, 600)}).astype(float)
    frame["qty"] = frame.a * 2 + (frame.b > 6) * 5 + rng.normal(0, 2, 600)
    frame["fold"] = np.arange(600) % 3
    df = spark.createDataFrame(frame).repartition(4)
    growths = boosting.random_growths(7, 1, (3, 5))
    found = boosting.search(df, NAMES, growths=growths, rungs=(1, 2), fold=F.col("fold"))
    assert sorted(d.number for d in found) == list(range(7))
    assert [d.rounds for d in found[2:]] == [2, 2, 1, 1, 1] and all(d.rounds == d.growth.rounds for d in found[:2])
    assert found[0].error <= found[1].error
    for d in (found[0], found[1], found[-1]):
        growth = catalogue.replace(growths[d.number], rounds=d.rounds)
        for fold in range(3):
            model = boosting.fit(df.filter(F.col("fold") != fold), NAMES, objective=boosting.squared(), growth=growth)
            held = df.filter(F.col("fold") == fold)
            assert forecast.validate(model, held).first().mae == pytest.approx(d.errors[fold]), (d, fold)


def test_draws_and_reruns_of_a_search_agree(spark):
    assert boosting.random_growths(25, 42) == boosting.random_growths(25, 42) and len(set(boosting.random_growths(25, 42))) == 25
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(90.0) % 7, "b": np.arange(90.0) % 5, "qty": np.arange(90.0) % 11})).repartition(3)
    one, two = (boosting.search(df, NAMES, growths=boosting.random_growths(4, 2, (2, 3)), rungs=(1,)) for _ in range(2))
    assert one == two and len(one) == 4
