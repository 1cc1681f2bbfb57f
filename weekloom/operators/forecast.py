"""Forecasts: features from a history array, recursive, direct and frozen-mean strategies, and boosted-tree models.

State is one row for each key with its last values in a bounded array; a step computes the same features as training
does, with array functions, scores all keys at once, and appends the result: no shuffle, no collect. Each step's scores
are written to the checkpoint folder, so that later steps and the union of all weeks don't compute them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions.scalar import calendar_flags, half_even, seasonality
from weekloom.operators import boosting
from weekloom.operators.explore import metrics
from weekloom.operators.features import percent_changes, ratios_and_changes
from weekloom.operators.ordered import first_rows
from weekloom.operators.panel import KEYS
from weekloom.params import Params
from weekloom.sources.stages import settle


def histories(panel: DataFrame, keep: int = 24, least: int = 12, statics: list[str] | None = None) -> DataFrame:
    """(key, hist, n_weeks, statics): the last keep quantities of each key of least weeks or more, oldest first, and its last static values.

    A key has at most one row a week, so the array that is cut to keep is bounded by the number of weeks.
    """
    rows = F.sort_array(F.collect_list(F.struct("week_of_year", "qty")))
    keys = panel.groupBy(*KEYS).agg(rows.alias("rows"), F.count("*").alias("n_weeks"), *(F.max_by(c, "week_of_year").alias(c) for c in statics or []))
    values = F.transform("rows", lambda r: r["qty"])
    last = F.when(F.size(values) > keep, F.slice(values, -keep, keep)).otherwise(values)
    return keys.filter(F.col("n_weeks") >= least).select(*KEYS, last.alias("hist"), "n_weeks", *(statics or []))


def last_values(hist: Column, n: int) -> Column:
    return F.when(F.size(hist) > n, F.slice(hist, -n, n)).otherwise(hist)


def _fold(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), f)


def array_mean(a: Column) -> Column:
    return F.try_divide(_fold(a, lambda s, x: s + x), F.size(a))


def array_moment(a: Column, k: int) -> Column:
    m = array_mean(a)
    return F.try_divide(_fold(a, lambda s, x: s + F.pow(x - m, F.lit(float(k)))), F.size(a))


def array_std(a: Column, ddof: int = 1) -> Column:
    n = F.size(a)
    return F.when(n > ddof, F.sqrt(array_moment(a, 2) * n / (n - ddof)))


def array_skew(a: Column) -> Column:
    n = F.size(a)
    g = F.try_divide(array_moment(a, 3), F.pow(array_moment(a, 2), F.lit(1.5)))
    return F.when(F.array_max(a) == F.array_min(a), 0.0).otherwise(g * F.sqrt(n * (n - 1)) / (n - 2))


def array_slope(a: Column) -> Column:
    """Slope over positions, times n/(n-1), as the trend feature has it."""
    n = F.size(a)
    middle = (n - 1) / F.lit(2.0)
    pairs = F.transform(a, lambda x, i: (i - middle) * x)
    squares = F.transform(a, lambda x, i: (i - middle) * (i - middle))
    return F.try_divide(_fold(pairs, lambda s, x: s + x), _fold(squares, lambda s, x: s + x)) * n / (n - 1)


def history_features(state: DataFrame, week: Column, last_week: Column, params: Params = Params(), advanced: bool = True) -> DataFrame:
    """state with the features that training has for the row after hist."""
    h = F.col("hist")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    need = lambda a, n, c: F.when(F.size(a) >= n, c)
    all_lags = sorted(params.basic_lags + (params.extra_lags if advanced else ()))
    new = {f"lag_{k}": zero(F.try_element_at(h, F.lit(-k))) for k in all_lags}
    four, eight = last_values(h, 4), last_values(h, 8)
    new |= {"rmean_4": zero(need(four, 4, array_mean(four))), "rstd_4": zero(need(four, 4, array_std(four)))}
    new["nonzero_frac_8"] = zero(need(eight, 8, F.size(F.filter(eight, lambda x: x > 0)) / F.lit(8.0)))
    raw: dict[str, Column] = {}
    if advanced:
        for w in params.rolling_windows:
            a, n = last_values(h, w), params.least_periods
            raw |= {f"rmean_{w}": need(a, n, array_mean(a)), f"rstd_{w}": need(a, n, array_std(a)), f"rmax_{w}": need(a, n, F.array_max(a)), f"rmin_{w}": need(a, n, F.array_min(a)), f"rrange_{w}": need(a, n, F.array_max(a) - F.array_min(a))}
        for w in (4, 8, 12):
            a = last_values(h, w)
            raw |= {f"rskew_{w}": need(a, 4, array_skew(a)), f"trend_{w}": need(a, 3, array_slope(a))}
    df = state.withColumn("week_of_year", week).select("*", *(c.alias(k) for k, c in (new | raw).items()))
    if not advanced:
        return df
    more = percent_changes() | ratios_and_changes() | seasonality(F.col("week_of_year")) | calendar_flags(F.col("week_of_year"), last_week)
    keep = [c for c in df.columns if c not in raw]
    return df.select(*keep, *(zero(F.col(k)).alias(k) for k in raw), *(c.alias(k) for k, c in more.items()))


def thresholded(x: Column) -> Column:
    """Whole units, half to even; under half is none, and so is just a half."""
    return half_even(F.when(x >= 0.5, x).otherwise(0.0)).cast("int")


def recursive_forecast(state: DataFrame, score, weeks: tuple[int, ...], last_week: int, params: Params = Params(), advanced: bool = True) -> DataFrame:
    """(semana, pdv, produto, quantidade, predicted) for the weeks, each step seeing the steps before.

    score(df) adds a column prediction to rows of features. An empty state gives an empty table of the same columns.
    """
    keep, base, out = params.history_kept, list(state.columns), None
    for w in weeks:
        scored = score(history_features(state, F.lit(w).cast("bigint"), F.lit(last_week), params, advanced))
        scored = settle(scored.select(*base, F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted")))
        rows = scored.select(F.lit(w).alias("semana"), "pdv", F.col("internal_product_id").alias("produto"), thresholded(F.col("predicted")).alias("quantidade"), "predicted")
        out = rows if out is None else out.unionByName(rows)
        longer = last_values(F.concat("hist", F.array("predicted")), keep)
        state = scored.select(*(longer.alias(c) if c == "hist" else F.col(c) for c in base))
    return out


def direct_frame(panel: DataFrame, weeks: DataFrame, k: int, last_week: int) -> DataFrame:
    """The k keys of most volume for each forecast week, with the state of the last week, 0 where there is none."""
    totals = panel.groupBy(*KEYS).agg(F.sum("qty").alias("total"))
    top = first_rows(totals, [F.desc("total"), *KEYS], k).select(*KEYS)
    last = panel.filter(F.col("week_of_year") == last_week).select(*KEYS, F.col("qty").alias("lag_1_semana"), F.col("media_movel_4").alias("media_movel_4_semanas"))
    spread = weeks.agg(F.sort_array(F.collect_list("semana_do_ano")).alias("w"))  # one row of a few weeks
    return top.crossJoin(F.broadcast(spread)).select(*KEYS, F.explode("w").alias("semana_do_ano")).join(last, KEYS, "left").fillna(0.0, ["lag_1_semana", "media_movel_4_semanas"])


def frozen_mean_forecast(frame: DataFrame, score, weeks: tuple[int, ...], partial: dict[int, float] | None = None) -> DataFrame:
    """A step for each week over (pdv, internal_product_id, lag_1_semana, media_movel_4_semanas): only the lag moves on.

    partial: factors of weeks that are not whole, such as {5: 3 / 7}.
    """
    base, out = frame.columns, None
    for w in weeks:
        scored = score(frame.withColumn("semana_do_ano", F.lit(w))).select(*base, F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted"))
        scored = settle(scored)
        factor = F.lit(float((partial or {}).get(w, 1.0)))
        rows = scored.select(F.lit(w).alias("semana"), "pdv", F.col("internal_product_id").alias("produto"), half_even(F.col("predicted") * factor).cast("int").alias("quantidade"))
        out = rows if out is None else out.unionByName(rows)
        frame = scored.select(*(F.col("predicted").alias(c) if c == "lag_1_semana" else F.col(c) for c in base))
    return out


def first_trees(model, n: int):
    """The boosted model cut to its first n trees."""
    from pyspark.ml.regression import GBTRegressionModel

    java, context = model._java_obj, SparkSession.active().sparkContext
    kinds = context._jvm.org.apache.spark.ml.regression
    trees, weights = context._gateway.new_array(kinds.DecisionTreeRegressionModel, n), context._gateway.new_array(context._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:n], list(java.treeWeights())[:n])):
        trees[i], weights[i] = tree, weight
    return model._copyValues(GBTRegressionModel(kinds.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())))


def train_trees(train: DataFrame, features: list[str], target: str = "qty", valid: DataFrame | None = None, loss: str = "absolute", params: Params = Params(), weight: str | None = None):
    """A fitted pipeline of boosted trees; with valid rows, all rounds are made and those up to the best on valid kept.

    That is early stopping whose patience is the number of rounds: Spark's own stops at the first round without a gain.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    trees = GBTRegressor(featuresCol="features", labelCol=target, lossType=loss, maxIter=params.rounds, maxDepth=params.depth, stepSize=params.step, seed=params.seed, subsamplingRate=0.8 if loss == "squared" else 1.0, maxBins=64)
    if weight:
        trees = trees.setWeightCol(weight)
    columns = [*dict.fromkeys([*features, target, *([weight] if weight else [])])]
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    model = trees.fit(assembler.transform(train.select(*columns)))
    if valid is not None:
        errors = model.evaluateEachIteration(assembler.transform(valid.select(*columns)), loss)
        best = min(range(len(errors)), key=lambda i: (errors[i] != errors[i], errors[i])) + 1  # of no rows, all are NaN
        if best < len(errors) and errors[0] == errors[0]:
            model = first_trees(model, best)
    return PipelineModel([assembler, model])


def importances(spark: SparkSession, model, features: list[str]) -> DataFrame:
    """(feature, importance), most important first, of a pipeline of trees or a leaf-wise model."""
    shares = model.importances() if isinstance(model, boosting.Model) else dict(zip(features, map(float, model.stages[-1].featureImportances)))
    return spark.createDataFrame(sorted(shares.items(), key=lambda x: -x[1]), "feature string, importance double")


def validate(model, valid: DataFrame, target: str = "qty") -> DataFrame:
    scored = model.transform(valid).select(F.col(target).alias("y"), F.greatest(F.col("prediction"), F.lit(0.0)).alias("p"))
    return metrics(scored)


def tournament(train: DataFrame, valid: DataFrame, features: list[str], target: str = "qty", params: Params = Params()) -> DataFrame:
    """(model, wmape) for trees with squared and absolute loss and a linear model with Huber loss, best first."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    huber = LinearRegression(labelCol=target, loss="huber", maxIter=50)
    models = {loss: train_trees(train, features, target, valid, loss, params) for loss in ("squared", "absolute")}
    models |= {"huber": Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), huber]).fit(train)}
    rows = [(name, float(validate(m, valid, target).first().wmape)) for name, m in models.items()]
    return train.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[1]), "model string, wmape double")


def leafwise_tournament(train: DataFrame, valid: DataFrame, features: list[str], target: str = "qty", growth: boosting.Growth = boosting.Growth()) -> DataFrame:
    """(model, wmape) of leaf-wise trees by squared, absolute and Huber loss, best first."""
    models = {name: boosting.fit(train, features, target, valid, boosting.OBJECTIVES[name](), growth) for name in ("squared", "absolute", "huber")}
    rows = [(name, float(validate(m, valid, target).first().wmape)) for name, m in models.items()]
    return train.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[1]), "model string, wmape double")


def random_search(train: DataFrame, features: list[str], target: str = "qty", draws: int = 25, folds: int = 3, seed: int = 42):
    """The best of some random parameter draws by mean absolute error over folds."""
    import random

    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator

    rng, trees = random.Random(seed), GBTRegressor(labelCol=target, lossType="absolute", seed=seed)
    grid = [{trees.maxDepth: rng.choice([3, 4, 5, 6]), trees.stepSize: rng.choice([0.02, 0.05, 0.1]), trees.maxIter: rng.choice([10, 20, 40]), trees.minInstancesPerNode: rng.choice([1, 20, 50])} for _ in range(draws)]
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), trees])
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=target, metricName="mae"), numFolds=folds, seed=seed).fit(train)


def zero_weight(df: DataFrame, target: str = "qty", heavy: float = 1.5) -> DataFrame:
    """A weight column that counts errors at zero demand more."""
    return df.withColumn("weight", F.when(F.col(target) == 0, heavy).otherwise(1.0))
