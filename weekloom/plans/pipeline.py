"""The whole demand pipeline: load, panel, outliers, features, split, train, forecast, exports."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions.scalar import safe_names
from weekloom.operators import boosting, categorical, explore, features, forecast, outliers, panel
from weekloom.params import Params
from weekloom.sources import sinks
from weekloom.sources.stages import settle


@dataclass
class Prepared:
    panel: DataFrame
    featured: DataFrame
    feature_columns: list[str]
    train: DataFrame
    valid: DataFrame
    outlier_stats: DataFrame | None


def build_panel(transactions: DataFrame, params: Params = Params(), order: str | None = None) -> DataFrame:
    weekly = panel.weekly_panel(panel.clean(transactions, params), order)
    if params.anomalous_week is not None:
        weekly = panel.repair_week(weekly, params.anomalous_week)
    if params.extra_week is not None:
        weekly = weekly.filter(F.col("week_of_year") != params.extra_week)
    return weekly


def comprehensive_features(weekly: DataFrame, params: Params = Params(), advanced: bool = True, interactions: bool = True) -> tuple[DataFrame, list[str]]:
    df = features.basic_features(weekly, params)
    if advanced:
        df = features.advanced_features(df, params)
    numeric = features.feature_names(df)
    df, dummies = categorical.one_hot(df, params)
    df, frequent = categorical.frequencies(df, params)
    crossed: list[str] = []
    if interactions and dummies:
        df, crossed = categorical.interactions(df, dummies, params.most_interactions)
    return df, [*numeric, *crossed, *dummies, *frequent]


def process(transactions: DataFrame, params: Params = Params(), treat_outliers: bool = True, advanced: bool = True, interactions: bool = True, cache: sinks.StageCache | None = None, inputs: tuple[str, ...] = ()) -> Prepared:
    """Everything up to the training matrices. With a cache, the treated panel and the outliers' statistics are stage
    tables by all parameters. What is read more than once, panel and features, is settled."""
    switches = (*inputs, str(treat_outliers))
    weekly = cache.load(params, *switches) if cache else None
    stats = cache.load(params, *switches, "statistics") if cache else None
    if weekly is None:
        weekly = build_panel(transactions, params)
        if treat_outliers:
            weekly = settle(weekly)
            if params.outlier_method == "z_score":
                flagged = outliers.z_score_flags(weekly, params)
                stats = outliers.group_stats(flagged)
                weekly = outliers.treat_z_score(flagged, params).select(*weekly.columns)
            else:
                weekly = outliers.treat(weekly, params)
        weekly = cache.save(weekly, params, *switches) if cache else settle(weekly)
        if stats is not None:
            stats = cache.save(stats, params, *switches, "statistics") if cache else settle(stats)
    featured, names = comprehensive_features(weekly, params, advanced, interactions)
    featured = settle(featured)
    train, valid = explore.split(featured, params.train_until, params.valid_from, params.valid_until)
    return Prepared(weekly, featured, names, train, valid, stats)


def export(spark: SparkSession, made: Prepared, folder: str) -> None:
    sinks.write_matrix(made.train, made.feature_columns, f"{folder}/train")
    sinks.write_matrix(made.valid, made.feature_columns, f"{folder}/validation")
    sinks.write_csv(sinks.feature_kinds(spark, made.feature_columns), f"{folder}/features", one_file=True)
    sinks.write_csv(explore.describe(made.train, made.feature_columns), f"{folder}/feature_statistics", one_file=True)


def forecast_all(made: Prepared, model, params: Params = Params(), advanced: bool = True) -> DataFrame:
    """The recursive forecast of all active keys of enough history. Interactions are computed anew at each step."""
    static = [c for c in made.feature_columns if c.startswith(tuple(f"{d}_" for d in params.dummy_columns)) and "_x_" not in c or c.endswith(("_log_freq", "_freq_rank"))]
    crossed = [c for c in made.feature_columns if "_x_" in c]
    state = forecast.histories(explore.only_active(made.featured), params.history_kept, params.least_history, static)
    last_week = made.panel.agg(F.max("week_of_year")).first()[0] or 0

    def score(df: DataFrame) -> DataFrame:
        parts = [(c, *c.rsplit("_x_", 1)) for c in crossed]
        return model.transform(df.select("*", *((F.col(d) * F.col(n)).alias(c) for c, d, n in parts)))

    return forecast.recursive_forecast(state, score, params.forecast_weeks, last_week, params, advanced)


def renamed(made: Prepared, names: list[str]) -> Prepared:
    """made with its feature columns under other names."""
    new = dict(zip(made.feature_columns, names))
    other = lambda df: df.withColumnsRenamed(new)
    return replace(made, featured=other(made.featured), train=other(made.train), valid=other(made.valid), feature_columns=names)


def run(spark: SparkSession, path: str, output: str, model: str = "absolute", advanced: bool = True, interactions: bool = True, use_cache: bool = True, params: Params = Params(), leaf_wise: bool = False) -> dict:
    """Train and forecast from a table of transactions; everything is written under output.

    The validation weeks choose how many trees are kept. The model of squared loss is deeper, and it forecasts keys of
    three weeks or more; feature names are made safe for both where they aren't. Rows of zero demand count zero_weight times.
    leaf_wise trees take any objective of operators.boosting as model, and one of their own for zero demand.
    """
    if not leaf_wise and model not in ("absolute", "squared"):
        raise ValueError(f"{model} needs leaf-wise trees")
    seconds, began = {}, time.time()

    def done(stage: str) -> None:
        nonlocal began
        seconds[stage], began = round(time.time() - began, 3), time.time()

    if model == "squared":
        params = replace(params, depth=params.depth + 1, least_history=min(params.least_history, 3))
    cache = sinks.StageCache(spark, f"{output}/cache", keep=10) if use_cache else None
    made = process(spark.read.parquet(path), params, advanced=advanced, interactions=interactions, cache=cache, inputs=(path, sinks.state_of(spark, path)))
    made = made if model != "squared" else renamed(made, safe_names(made.feature_columns))
    if made.outlier_stats is not None:
        sinks.write_summary(outliers.report(made.outlier_stats), f"{output}/outlier_report.json")
    done("features")
    export(spark, made, output)
    done("export")
    train, valid, weight = made.train, made.valid, None
    if params.zero_weight != 1:
        train, valid = (forecast.zero_weight(df, heavy=params.zero_weight) for df in (train, valid))
        weight = "weight"
    if leaf_wise:
        growth = boosting.Growth(params.rounds, params.step, most_step=params.most_step)
        fitted = boosting.fit(train, made.feature_columns, "qty", valid, boosting.OBJECTIVES[model](), growth, weight)
        sinks.write_model(spark, fitted, f"{output}/model.json")
    else:
        fitted = forecast.train_trees(train, made.feature_columns, valid=valid, loss=model, params=params, weight=weight)
        fitted.write().overwrite().save(f"{output}/model")
    sinks.write_csv(forecast.importances(spark, fitted, made.feature_columns), f"{output}/importance", one_file=True)
    scores = forecast.validate(fitted, made.valid).first().asDict()
    done("training")
    predictions = settle(forecast_all(made, fitted, params, advanced))
    sinks.write_submission(predictions, f"{output}/submission")
    sinks.write_summary(explore.submission_summary(predictions), f"{output}/summary.json")
    done("forecast")
    sinks.write_experiment(spark, f"{output}/experiment.json", params, scores["wmape"], predictions.count(), seconds)
    return scores
