"""One order over a whole table, percentiles by narrowing, and lookups, with ranges and buckets of every size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekloom.operators import categorical, explore, features, lookup, ordered, outliers, panel
from weekloom.plans import catalogue


def frame(spark, values, keys=7):
    return spark.createDataFrame([(i % keys, 0, i // keys, v) for i, v in enumerate(values)], "pdv bigint, internal_product_id bigint, week_of_year bigint, qty double").repartition(3)


@pytest.mark.parametrize("parts", [1, 3, 17, 60])
def test_windows_run_on_from_range_to_range(spark, parts):
    """Also where ranges hold fewer rows than the window, and some hold none."""
    rng = np.random.default_rng(parts)
    df = frame(spark, rng.integers(0, 30, 70).astype(float).tolist())
    got = features.compat_rolling(df, (4, 12), (8,), parts=parts).toPandas().sort_values(["pdv", "internal_product_id", "week_of_year"]).reset_index(drop=True)
    flat = got.groupby(["pdv", "internal_product_id"])["qty"].shift(1)
    for w in (4, 12):
        r = flat.rolling(w, min_periods=4)
        for name, want in ((f"rmean_{w}", r.mean()), (f"rstd_{w}", r.std()), (f"rmax_{w}", r.max()), (f"rmin_{w}", r.min()), (f"rrange_{w}", r.max() - r.min())):
            assert np.allclose(got[name].astype(float), want, equal_nan=True), name
    assert np.allclose(got["rskew_8"].astype(float), flat.rolling(8, min_periods=4).skew(), equal_nan=True)
    treated = outliers.past_percentiles(df, 80.0, 25.0, 6, compat=True, parts=parts).toPandas().sort_values(["pdv", "week_of_year"]).reset_index(drop=True)
    r = flat.rolling(6, min_periods=3)
    assert np.allclose(treated["limit"], np.minimum(r.quantile(0.8).fillna(25.0), 25.0)) and np.allclose(treated["past_median"].astype(float), r.median(), equal_nan=True)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_values_are_carried_on(spark, parts):
    rng = np.random.default_rng(parts)
    values = [None if rng.random() < 0.7 else float(i) for i in range(50)]
    for some in (values, [None] * 50, [None] * 49 + [3.0]):
        df = frame(spark, [1.0] * 50, 1).drop("qty").join(spark.createDataFrame(list(enumerate(some)), "week_of_year bigint, v double"), "week_of_year")
        got = ordered.carried(df, ["pdv", "week_of_year"], ["v"], parts=parts).orderBy("week_of_year").toPandas()["v"].astype(float)
        assert np.allclose(got, pd.Series(some, dtype=float).ffill().bfill(), equal_nan=True)


@pytest.mark.parametrize("k", [0, 1, 30, 69, 70, 500])
def test_first_rows(spark, k):
    df = frame(spark, [float(i * 37 % 11) for i in range(70)])
    want = sorted((-r.qty, r.pdv, r.week_of_year) for r in df.collect())[:k]
    got = ordered.first_rows(df, [F.desc("qty"), "pdv", "week_of_year"], k, parts=5)
    assert sorted((-r.qty, r.pdv, r.week_of_year) for r in got.collect()) == want
    assert got.columns == df.columns and ordered.first_rows(df.limit(0), ["qty"], 3).count() == 0


def test_no_window_has_the_whole_table(spark, sf_dir):
    """Every window of the compat columns is by range or by key; the one without a key sees a row a range."""
    o = ordered.ordered(catalogue.weekly(spark, sf_dir), *panel.KEYS, "week_of_year", parts=8)
    assert o.ranges.count() > 1 and o.ranges.agg(F.max("_rows")).first()[0] < 0.5 * o.rows.count()
    plan = features.compat_rolling(catalogue.weekly(spark, sf_dir), parts=8)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("buckets", [2, 5, 4096])
def test_percentiles_narrow_to_the_value(spark, monkeypatch, buckets):
    monkeypatch.setattr(explore, "BUCKETS", buckets)
    rng = np.random.default_rng(3)
    df = pd.DataFrame({"a": rng.normal(0, 1, 500), "b": rng.integers(0, 3, 500).astype(float), "c": 10.0 ** rng.uniform(-6, 6, 500), "d": np.full(500, 7.0), "e": np.repeat([-1.7e308, 1.7e308], 250)})
    df.loc[::3, "a"] = np.nan
    rows = spark.createDataFrame(df.astype(object).where(df.notna(), None), "a double, b double, c double, d double, e double").withColumn("none", F.lit(None).cast("double"))
    got = {r.feature_name: r for r in explore.describe(rows, [*df.columns, "none"]).collect()}
    for c in "abcd":
        want = df[c].quantile([0.25, 0.5, 0.75]).tolist()
        assert [got[c].p25, got[c].p50, got[c].p75] == pytest.approx(want) and got[c]["count"] == df[c].count()
    assert (got["e"].p25, got["e"].p75) == (-1.7e308, 1.7e308)
    assert got["none"].p50 is None and got["none"]["count"] == 0


def test_describing_shuffles_no_cells(spark, sf_dir):
    """What a pass sends to the next stage does not depend on the rows: buckets that are met, a task."""
    df = catalogue.settle(catalogue.weekly(spark, sf_dir).select("qty", "gross"))
    counted = explore.column_percentiles(df, {"qty": (df.count(), 0.0, 300.0)}, {"m": 0.5})
    assert counted.count() == 1


def test_frequencies_leave_the_panel_where_it_is(spark, sf_dir, monkeypatch):
    df = catalogue.settle(catalogue.weekly(spark, sf_dir, "subcategoria", "fabricante"))
    df = catalogue.settle(df.withColumn("subcategoria", F.when(F.col("week_of_year") % 5 != 0, F.col("subcategoria"))))
    few, names = categorical.frequencies(df, catalogue.PARAMS)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    want = sorted(map(tuple, few.select(*panel.KEYS, "week_of_year", *names).collect()))
    monkeypatch.setattr(lookup, "MOST_BROADCAST", 0)
    monkeypatch.setattr(lookup, "HOT_ROWS", 50)
    many, _ = categorical.frequencies(df, catalogue.PARAMS)
    assert sorted(map(tuple, many.select(*panel.KEYS, "week_of_year", *names).collect())) == want
