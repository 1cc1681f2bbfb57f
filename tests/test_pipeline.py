"""The whole run, sources and sinks, cache, command line, and the streaming form."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.__main__ import main
from weekloom.operators import explore, forecast
from weekloom.params import Params
from weekloom.plans import pipeline
from weekloom.sources import sinks, tables
from weekloom.streaming import weekly

QUICK = replace(Params(), rounds=2, depth=2, train_until=60, valid_from=61, valid_until=90, least_history=12)


@pytest.fixture(scope="module")
def transactions(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tx") / "transactions")
    tables.demand_transactions(spark, sf_dir).filter("transaction_date < '1997-01-01'").write.parquet(path)
    return path


def test_run_writes_everything(spark, transactions, tmp_path):
    scores = pipeline.run(spark, transactions, str(tmp_path), params=QUICK)
    assert 0 < scores["wmape"] < 10
    submission = tables.read_submission(spark, f"{tmp_path}/submission")
    assert submission.columns == ["semana", "pdv", "produto", "quantidade"]
    assert {r.semana for r in submission.select("semana").distinct().collect()} == {1, 2, 3, 4, 5}
    assert explore.submission_check(submission).first().total >= 0
    for part in ("train", "validation", "features", "feature_statistics", "importance"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/{part}").count() > 0
    report, rows = json.load(open(f"{tmp_path}/outlier_report.json")), submission.count()
    assert report["total_groups"] > 0
    again = pipeline.run(spark, transactions, str(tmp_path), params=QUICK)  # from the cached stages
    assert again["wmape"] == pytest.approx(scores["wmape"])
    assert json.load(open(f"{tmp_path}/outlier_report.json")) == report
    log = sinks.read_experiments(spark, [f"{tmp_path}/experiment.json"])[0]
    assert log["total_predictions"] == rows == json.load(open(f"{tmp_path}/summary.json"))["total_predictions"]
    assert set(log["seconds"]) == {"features", "export", "training", "forecast"}


def test_squared_loss_has_its_own_history_and_names(spark, transactions, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(forecast, "histories", lambda panel, keep, least, statics: seen.append((least, statics)) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        pipeline.run(spark, transactions, str(tmp_path), model="squared", interactions=False, use_cache=False, params=replace(QUICK, rounds=1))
    assert seen[0][0] == 3 and all(c.replace("_", "").isalnum() for c in seen[0][1])


def test_asymmetric_runs_weigh_zero_demand(spark, transactions, tmp_path, monkeypatch):
    seen = []

    def caught(train, features, valid, loss, params, weight):
        seen.extend([*(df.select("qty", weight).distinct().collect() for df in (train, valid)), weight in features])
        raise InterruptedError

    monkeypatch.setattr(forecast, "train_trees", caught)
    monkeypatch.setattr(pipeline, "export", lambda *_: None)
    with pytest.raises(InterruptedError):
        pipeline.run(spark, transactions, str(tmp_path), interactions=False, use_cache=False, params=replace(QUICK, zero_weight=1.5))
    assert seen[0] and not seen[2]
    assert all(r.weight == (1.5 if r.qty == 0 else 1.0) for some in seen[:2] for r in some)


def test_a_replaced_input_is_another_one(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    before = sinks.state_of(spark, f"{tmp_path}/a")
    assert sinks.state_of(spark, f"{tmp_path}/a") == before
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert sinks.state_of(spark, f"{tmp_path}/a") != before


def test_cache_keys_and_retention(spark, tmp_path):
    cache = sinks.StageCache(spark, str(tmp_path), keep=2)
    df = spark.range(3)
    for z in (1.0, 2.0, 3.0):
        cache.save(df, replace(Params(), z_threshold=z), "x")
    assert cache.load(replace(Params(), z_threshold=3.0), "x").count() == 3
    assert cache.load(replace(Params(), z_threshold=1.0), "x") is None
    assert cache.load(replace(Params(), z_threshold=3.0), "y") is None
    assert cache.clear() == 2


def test_command_line_clears_the_cache(spark, tmp_path):
    sinks.StageCache(spark, f"{tmp_path}/cache").save(spark.range(1), Params())
    assert main(["unused", str(tmp_path), "--clear-cache"]) == 1


def test_raw_folder_by_columns(spark, tmp_path):
    frames = {"t": "select 1 internal_product_id, 2.0d quantity", "s": "select 1 pdv, 'z' zipcode", "p": "select 1 produto, 'c' categoria"}
    for name, sql in frames.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    got = tables.read_raw_folder(spark, f"{tmp_path}/*.parquet")
    assert sorted(got) == ["products", "stores", "transactions"] and "zipcode" in got["stores"].columns
    with pytest.raises(FileNotFoundError):
        tables.read_raw_folder(spark, f"{tmp_path}/t.parquet")


def test_submission_formats_and_summary(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 7, 3), (2, 5, 8, 0), (1, 6, 7, 4)], "semana int, pdv bigint, produto bigint, quantidade int")
    sinks.write_submission(df, f"{tmp_path}/csv")
    sinks.write_submission(df, f"{tmp_path}/parquet", "parquet")
    assert sorted(tables.read_submission(spark, f"{tmp_path}/csv").collect()) == sorted(spark.read.parquet(f"{tmp_path}/parquet").collect())
    row = sinks.write_summary(explore.submission_summary(df), f"{tmp_path}/s.json")
    assert row["by_semana"] == {"1": 7, "2": 0} and row["by_pdv"] == {"5": 3, "6": 4}
    assert json.load(open(f"{tmp_path}/s.json")) == row
    for name, wmape in (("a", 0.5), ("b", 0.25)):
        sinks.write_experiment(spark, f"{tmp_path}/{name}.json", Params(), wmape, 10)
    assert [x["wmape"] for x in sinks.read_experiments(spark, [f"{tmp_path}/{n}.json" for n in ("a", "none", "b")])] == [0.25, 0.5]


def test_random_search_and_model_round_trip(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 2).cast("double").alias("qty"))
    best = forecast.random_search(df, ["x"], draws=2, folds=2)
    assert min(best.avgMetrics) < 10
    model = forecast.train_trees(forecast.zero_weight(df), ["x"], params=QUICK, weight="weight")
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(str(tmp_path / "m")).transform(df).count() == 60


def test_streaming_weeks(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = weekly.weekly_totals(stream).writeStream.outputMode("complete").format("memory").queryName("weeks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("weeks").collect()) == sorted(weekly.weekly_totals(events).collect())


def test_trees_are_kept_up_to_the_best_round_on_valid_rows(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x), float(x > 0.5) + float(e)) for x, e in zip(rng.random(120), rng.normal(size=120))], "x double, qty double").coalesce(1)
    train, valid = df.limit(60).cache(), df.offset(60).cache()
    params = replace(QUICK, rounds=12, depth=4, step=0.5)
    whole, kept = (forecast.train_trees(train, ["x"], valid=v, loss="squared", params=params) for v in (None, valid))
    errors = whole.stages[-1].evaluateEachIteration(whole.stages[0].transform(valid), "squared")
    best = errors.index(min(errors)) + 1
    assert kept.stages[-1].getNumTrees == best < whole.stages[-1].getNumTrees == 12
    assert abs(forecast.validate(kept, valid).first().rmse ** 2 - forecast.validate(whole, valid).first().rmse ** 2) > 0
    assert [r["feature"] for r in forecast.importances(spark, kept, ["x"]).collect()] == ["x"]


def test_model_queries_train_in_full(spark, sf_dir, monkeypatch):
    from weekloom.plans import catalogue

    seen = []

    def stop(train, features, target="qty", valid=None, loss="absolute", params=None, weight=None):
        seen.append((params.rounds, params.depth, valid is not None))
        raise InterruptedError

    monkeypatch.setattr(forecast, "train_trees", stop)
    for name in ("gbt_train_score", "feature_importance", "recursive_forecast", "loss_tournament", "iterative_forecast"):
        with pytest.raises(InterruptedError):
            catalogue.QUERIES[name](spark, sf_dir)
    assert seen == [(Params().rounds, Params().depth, name < 4) for name in range(5)]
