"""Small hand-made frames: borders of keys, ties, nulls, short histories, inverted bounds, rounding."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekloom.functions import scalar
from weekloom.operators import categorical, explore, features, forecast, outliers, panel, prices
from weekloom.params import Params

PANEL = "week_of_year bigint, pdv bigint, internal_product_id bigint, qty double"


def series(spark, *keys):
    return spark.createDataFrame([(w, k, 1, float(q)) for k, values in enumerate(keys, 1) for w, q in enumerate(values, 1)], PANEL)


def column(df, name, key=1):
    return [r[name] for r in df.filter(F.col("pdv") == key).orderBy("week_of_year").collect()]


def test_rolling_windows_stop_at_the_border_of_keys(spark):
    df = series(spark, range(1, 7), range(100, 700, 100))
    got = df.select("*", features.rolling(8, 4)["rmean_8"].alias("m"))
    assert column(got, "m", 2) == [None, None, None, None, 250.0, 300.0]


def test_basic_features_of_one_key_do_not_depend_on_others_or_on_later_rows(spark):
    one = series(spark, [5, 0, 2, 8, 1, 1, 9, 4, 3, 7, 2, 6, 5])
    two = one.unionByName(series(spark, [0], [9] * 13).filter("pdv = 2"))
    alone, among = (features.advanced_features(features.basic_features(x)).filter("pdv = 1").orderBy("week_of_year").collect() for x in (one, two))
    assert alone == among
    cut = features.basic_features(one.filter("week_of_year <= 9"))
    whole = features.basic_features(one).filter("week_of_year <= 9")
    assert sorted(cut.collect()) == sorted(whole.collect())


def test_moments_against_pandas(spark):
    values = [3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]
    df = features.with_row_index(series(spark, values))
    got = df.select("*", features.skewness(8).alias("skew"), features.rolling(8, 4)["rstd_8"].alias("std"), features.trend(8).alias("trend"))
    s = pd.Series(values).shift(1)
    assert column(got, "skew")[5:] == pytest.approx(s.rolling(8, min_periods=4).skew().tolist()[5:])
    assert column(got, "std")[5:] == pytest.approx(s.rolling(8, min_periods=4).std().tolist()[5:])
    slope = lambda x: np.cov(np.arange(len(x)), x)[0, 1] / np.var(np.arange(len(x)))
    assert column(got, "trend")[8:] == pytest.approx(s.rolling(8).apply(slope, raw=True).tolist()[8:])
    assert column(got, "trend")[5] == pytest.approx(slope(np.array(values[:5])))  # a short window counts its own rows


def test_skewness_of_a_constant_window_is_zero(spark):
    assert column(series(spark, [2] * 6).select("*", features.skewness(4).alias("s")), "s")[5] == 0.0


def test_week_37_between_36_and_38(spark):
    rows = [(36, 1, 1, 10.0, 1.0, "a"), (38, 1, 1, 20.0, 3.0, "b"), (36, 2, 1, 8.0, 4.0, "c"), (38, 3, 1, 6.0, 2.0, "d")]
    df = spark.createDataFrame(rows, "week_of_year bigint, pdv bigint, internal_product_id bigint, qty double, gross double, categoria string")
    got = {r.pdv: (r.qty, r.gross, r.categoria) for r in panel.repair_week(df, 37).filter("week_of_year = 37").collect()}
    assert got == {1: (15.0, 2.0, "a"), 2: (4.0, 2.0, "c"), 3: (3.0, 1.0, "d")}
    compat = {r.pdv: r.categoria for r in panel.interpolated_week(df, 37, compat_fill=True).collect()}
    assert compat == {1: "a", 2: "c", 3: "c"}
    assert panel.repair_week(df.filter("week_of_year = 36"), 37).count() == 2


def test_bad_stores(spark):
    rows = [(None,), ("",), ("desconhecido",), ("x",), ("12",), ("-",)]
    df = spark.createDataFrame(rows, "pdv string")
    assert [r.pdv for r in panel.valid_stores(df).collect()] == [12]
    assert {r.reason: r["count"] for r in panel.rejected_stores(df).collect()} == {"null": 1, "unknown": 2, "junk": 2}
    assert [r.pdv for r in panel.digit_stores(df).collect()] == [12]


def test_panel_null_rules(spark):
    rows = [("2022-01-01 10:00:00", 1, 1, None, None, None, 1), ("2022-01-02 00:00:00", 1, 1, -3.0, None, "b", 2), ("2022-01-08 11:00:00", 1, None, 1.0, 1.0, "c", 3), ("2022-01-08 09:00:00", 1, 1, 2.0, 5.0, "a", 4)]
    df = spark.createDataFrame(rows, "t string, pdv bigint, internal_product_id bigint, quantity double, gross_value double, categoria string, row int").withColumn("transaction_date", F.to_timestamp("t"))
    got = panel.weekly_panel(panel.clean(df), "row").collect()
    assert [(r.week_of_year, r.qty, r.gross, r.categoria) for r in got] == [(1, 0.0, 5.0, "b")]  # the 8th at 9:00 is not yet a week later


def test_outliers_of_tiny_and_constant_keys(spark):
    got = outliers.z_score_flags(series(spark, [1], [1, 900], [5, 5, 5, 5, 5, 5, 5, 5, 5, 5]))
    assert got.filter("is_outlier").count() == 0
    stats = {r.pdv: r for r in outliers.group_stats(got).collect()}
    assert stats[1].mean_qty == 0.0 and stats[2].mean_qty == 0.0 and stats[3].std_qty == 1.0


def test_outlier_treatment_with_inverted_bounds(spark):
    values = [0] * 60 + [1000.0]  # the upper bound, three times the mean, is under the lower of the treatment
    flagged = outliers.z_score_flags(series(spark, values))
    mean = 1000 / 61
    treated = column(outliers.treat_z_score(flagged), "qty")
    assert treated[:-1] == [0.0] * 60 and treated[-1] <= 3 * mean + 1e-9
    assert outliers.treat_z_score(flagged, treatment="remove").count() == 60
    with pytest.raises(ValueError):
        outliers.treat_z_score(flagged, treatment="other")


def test_outlier_methods_dispatch(spark):
    df = series(spark, [10, 12, 11, 10, 500, 12, 11])
    capped = column(outliers.treat(df, Params(outlier_method="percentile_cap", absolute_cap=220.0)), "qty")
    median = column(outliers.treat(df, Params(outlier_method="median_imputation", absolute_cap=220.0)), "qty")
    assert max(capped) <= 220 and median[4] == 10.5


def test_frequency_ranks_break_ties_by_first_appearance(spark):
    rows = [(1, 1, 1, 1.0, "z"), (2, 1, 1, 1.0, "a"), (3, 1, 1, 1.0, "a"), (4, 1, 1, 1.0, "z"), (5, 1, 1, 1.0, None)]
    df = spark.createDataFrame(rows, PANEL + ", subcategoria string")
    ranks = {r.value: r.freq_rank for r in categorical.value_counts(df, "subcategoria").collect()}
    assert ranks == {"z": 1, "a": 2}
    got, names = categorical.frequencies(df)
    null = got.filter("subcategoria is null").first()
    assert names == ["subcategoria_log_freq", "subcategoria_freq_rank"] and null.subcategoria_log_freq == 0.0 and null.subcategoria_freq_rank == 3


def test_interactions_are_capped(spark):
    df = spark.createDataFrame([(w, 1, 1, 1.0, f"v {w % 7}") for w in range(1, 40)], PANEL + ", categoria string")
    full, dummies = categorical.one_hot(features.basic_features(df))
    _, crossed = categorical.interactions(full, dummies, 11)
    assert len(dummies) == 7 and "categoria_v_1" in dummies and len(crossed) == 11


def test_price_change_from_zero_is_infinite(spark):
    df = series(spark, [0, 2, 4]).withColumn("gross", F.lit(10.0))
    got = prices.price_features(prices.unit_price(df))
    assert column(got, "unit_price") == [0.0, 5.0, 2.5]
    assert column(got, "unit_price_change_pct") == [0.0, math.inf, -0.5]
    assert column(prices.with_price_forecast(prices.unit_price(df)), "unit_price_predicted") == [2.0, 2.0, 2.0]


def test_half_even_and_threshold(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(forecast.thresholded(F.col("x"))).collect()] == [0, 0, 2, 2]


def test_safe_names():
    assert scalar.safe_names(["a b", "a-b", "<x>", "__", "a_b"]) == ["a_b", "a_b_1", "x", "feature_3", "a_b_2"]


def test_distinct_dims_fan_out(spark):
    facts = spark.createDataFrame([(1, 7, 1.0)], "internal_product_id int, internal_store_id int, quantity double")
    dims = spark.createDataFrame([(1, "a"), (1, "b")], "produto int, marca string")
    stores = spark.createDataFrame([(7, "s")], "pdv int, premise string")
    assert explore.with_dims(facts, dims, stores).count() == 2
    assert explore.with_dims(facts, explore.first_per_key(dims, ["produto"], ["marca"]), stores).count() == 1


def test_scaled_context_and_lookup(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 7.0), (None, 9.0), (None, 11.0)], "kind string, qty double")
    context = categorical.category_context(df, "kind")
    scaled = {r.value: r for r in categorical.scaled_context(context).collect()}
    assert scaled["b"]["mean"] == scaled["b"]["std"] == scaled["a"]["count"] == 0
    assert scaled["a"]["mean"] == pytest.approx(-(1.5**0.5)) and scaled[None]["mean"] == pytest.approx(1.5**0.5)
    asked = spark.createDataFrame([(1, "a"), (2, "new"), (3, None), (1, "a")], "mean int, kind string")
    got = sorted((r["mean"], r.kind_mean, r.kind_count) for r in categorical.with_context(asked, context, "kind").collect())
    assert got == [(1, 2.0, 2), (1, 2.0, 2), (2, 0.0, 0), (3, 10.0, 2)]
    assert categorical.scaled_context(context.limit(0)).count() == 0 and categorical.with_context(asked, context.limit(0), "kind").count() == 4


def test_serving_features_equal_training_features(spark):
    """What a history array gives for the next week is what the window features give once that week is there."""
    values = [3.0, 0, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3, 2, 3, 8, 4, 6, 2, 6, 4, 3, 3]
    df = series(spark, [*values, 0])
    train = features.advanced_features(features.basic_features(df)).filter(f"week_of_year = {len(values) + 1}").first()
    state = forecast.histories(df.filter(f"week_of_year <= {len(values)}"), 24, 12)
    serve = forecast.history_features(state, F.lit(len(values) + 1).cast("bigint"), F.lit(len(values) + 1)).first()
    for name in features.feature_names(features.advanced_features(features.basic_features(df))):
        assert serve[name] == pytest.approx(train[name], abs=1e-9), name


def test_recursive_forecast_step_by_step(spark):
    df = series(spark, [float(x) for x in range(1, 16)])
    score = lambda x: x.withColumn("prediction", F.col("lag_1") + F.col("rmean_4") - 13)
    got = [r.predicted for r in forecast.recursive_forecast(forecast.histories(df), score, (1, 2, 3), 15, advanced=False).orderBy("semana").collect()]
    hist = [float(x) for x in range(1, 16)]
    for expected in got:
        p = max(0.0, hist[-1] + sum(hist[-4:]) / 4 - 13)
        assert expected == pytest.approx(p)
        hist.append(p)
    empty = forecast.recursive_forecast(forecast.histories(df.limit(3)), score, (1, 2), 15, advanced=False)
    assert empty.count() == 0 and empty.columns[:4] == ["semana", "pdv", "produto", "quantidade"]


def test_shuffled_input_gives_the_same_features(spark):
    df = series(spark, [5, 1, 4, 2, 8, 6, 7, 1, 3], [2, 2, 9, 1, 4, 4, 4, 0, 6])
    a, b = (sorted(features.advanced_features(features.basic_features(x)).collect()) for x in (df, df.orderBy(F.desc("week_of_year"), "pdv")))
    assert a == b
