"""Outlier detection and treatment by key, in window expressions: statistics, flags, treatment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.features import before, with_previous
from weekloom.operators.ordered import last_rows, rolled
from weekloom.operators.panel import KEYS
from weekloom.params import Params


def _key():
    return Window.partitionBy(*KEYS)


def adaptive_threshold(p: Params) -> Column:
    base, n, cv, zero, mean = F.lit(p.z_threshold), F.col("n_obs"), F.col("cv"), F.col("zero_pct"), F.col("mean_qty")
    if not p.adaptive_threshold:
        return base
    small = F.when(cv > 2.0, 1.3).when(zero > 0.7, 1.2).otherwise(1.0)
    large = F.when(cv > 2.0, 1.5).when(cv > 1.0, 1.2).otherwise(0.8) * F.when(zero > 0.7, 1.3).otherwise(1.0) * F.when(mean > 100, 0.9).otherwise(1.0)
    return F.when(n < 3, base).when(n < p.least_observations, base * small).otherwise(base * large)


def z_score_flags(panel: DataFrame, params: Params = Params()) -> DataFrame:
    """panel with the statistics of each key, z_limit's parts and is_outlier; keys of under 3 rows have no outliers.

    Statistics cover the whole key, later weeks too; the rolling mean and deviation look at earlier weeks only.
    """
    q = F.col("qty")
    std = F.stddev_pop(q).over(_key())
    df = panel.select("*", F.count("*").over(_key()).alias("n_obs"), F.avg(q).over(_key()).alias("mean_qty"), F.when(std == 0, 1.0).otherwise(std).alias("std_qty"), F.avg((q == 0).cast("double")).over(_key()).alias("zero_pct"))
    df = df.withColumn("cv", F.col("std_qty") / (F.col("mean_qty") + 1e-8))
    df = df.withColumn("threshold_used", adaptive_threshold(params))
    win = before(params.outlier_window)
    seen = F.count(q).over(win) >= 3
    mean = F.coalesce(F.when(seen, F.avg(q).over(win)), F.col("mean_qty"))
    dev = F.coalesce(F.nullif(F.when(seen, F.stddev_samp(q).over(win)), F.lit(0.0)), F.col("std_qty"))
    few = F.abs(q - F.col("mean_qty")) > F.col("threshold_used") * F.col("std_qty")
    many = F.abs((q - mean) / dev) > F.col("threshold_used")
    flag = F.when(F.col("n_obs") < 3, False).when(F.col("n_obs") < params.least_observations, few).otherwise(many)
    return df.withColumn("is_outlier", flag)


def treat_z_score(flagged: DataFrame, params: Params = Params(), treatment: str | None = None) -> DataFrame:
    """Treat the keys that have an outlier: values over a multiple of the mean are cut to it, then outliers are
    winsorized, capped or removed, with bounds from the values before that."""
    treatment = treatment or params.treatment
    q, mean, n = F.col("qty"), F.col("mean_qty"), F.col("n_obs")
    percentile = lambda p: F.percentile(q, F.lit(p)).over(_key())
    bounds = {"winsorize": (0.02, 0.98), "cap": (0.10, 0.90)}.get(treatment, ())
    df = flagged.select("*", F.max("is_outlier").over(_key()).alias("_any"), *(percentile(p).alias(f"_p{i}") for i, p in enumerate(bounds)))
    top = mean * params.cap_multiplier
    cut = F.when(q > top, top).otherwise(q)
    if treatment == "winsorize":
        new = F.least(F.greatest(cut, F.greatest(F.lit(0.0), F.col("_p0"))), F.least(F.col("_p1"), mean * 3))
    elif treatment == "cap":
        reach = F.lit(1.5) * F.col("std_qty")
        enough = n >= params.least_observations
        high = F.when(enough, F.least(F.col("_p1"), mean + reach)).otherwise(mean + reach)
        low = F.greatest(F.lit(0.0), F.when(enough, F.col("_p0")).otherwise(mean - reach))
        new = F.when(cut > high, high).when(cut < low, low).otherwise(cut)
    elif treatment == "remove":
        new = cut
        df = df.filter(~F.col("is_outlier"))
    else:
        raise ValueError(f"no treatment named {treatment}")
    treated = F.when(F.col("_any"), F.when(F.col("is_outlier"), new).otherwise(cut)).otherwise(q)
    return df.select(*(treated.alias(c) if c == "qty" else F.col(c) for c in flagged.columns))


def group_stats(flagged: DataFrame) -> DataFrame:
    """One row for each key; keys of under 3 rows have zeros for statistics."""
    enough = lambda c: F.when(F.max("n_obs") < 3, 0.0).otherwise(F.max(c)).alias(c)
    n_out = F.sum(F.col("is_outlier").cast("bigint"))
    return flagged.groupBy(*KEYS).agg(F.max("n_obs").alias("n_obs"), *map(enough, ("mean_qty", "std_qty", "cv", "zero_pct")), F.max("threshold_used").alias("threshold_used"), n_out.alias("n_outliers"), (n_out / F.count("*") * 100).alias("outlier_pct"))


def past_percentiles(panel: DataFrame, percentile: float, cap: float, window: int = 12, compat: bool = False, parts: int | None = None) -> DataFrame:
    """panel with limit (percentile of earlier rows, from three on, at most cap), median of them, and is_outlier.

    compat: windows run on from one key into the next, in the order of keys and weeks.
    """
    q, win = (F.col("_previous"), last_rows(window)) if compat else (F.col("qty"), before(window))
    at = lambda p: F.when(F.count(q).over(win) >= 3, F.percentile(q, F.lit(p)).over(win))
    new = {"limit": F.least(F.coalesce(at(percentile / 100), F.lit(cap)), F.lit(cap)), "past_median": at(0.5)}
    if compat:
        df = rolled(with_previous(panel, "qty"), [*KEYS, "week_of_year"], window, new, parts).drop("_previous")
    else:
        df = panel.select("*", *(c.alias(k) for k, c in new.items()))
    return df.withColumn("is_outlier", F.col("qty") > F.col("limit"))


def treat_percentile_cap(panel: DataFrame, percentile: float = 99.5, cap: float = 220.0, window: int = 12, compat: bool = False) -> DataFrame:
    df = past_percentiles(panel, percentile, cap, window, compat)
    return df.withColumn("qty", F.when(F.col("is_outlier"), F.col("limit")).otherwise(F.col("qty")))


def treat_median(panel: DataFrame, percentile: float = 99.5, cap: float = 220.0, window: int = 12, compat: bool = False) -> DataFrame:
    """Outliers become the median of earlier rows, 1 where there is none."""
    df = past_percentiles(panel, percentile, cap, window, compat)
    return df.withColumn("qty", F.when(F.col("is_outlier"), F.coalesce("past_median", F.lit(1.0))).otherwise(F.col("qty")))


def volume_change(before_df: DataFrame, after_df: DataFrame) -> DataFrame:
    """One row: outliers, volume before and after, and percent lost."""
    a = before_df.agg(F.sum("qty").alias("volume_before"))
    b = after_df.agg(F.sum("qty").alias("volume_after"), F.count_if(F.col("is_outlier")).alias("total_outliers"), F.max("qty").alias("final_max"), F.avg("qty").alias("final_mean"))
    return a.crossJoin(F.broadcast(b)).withColumn("volume_reduction_pct", F.try_divide((F.col("volume_before") - F.col("volume_after")) * 100, F.col("volume_before")))  # one row each


def treat(panel: DataFrame, params: Params = Params()) -> DataFrame:
    """panel with qty treated by the method of params."""
    if params.outlier_method == "median_imputation":
        out = treat_median(panel, params.percentile_cap, params.absolute_cap, params.outlier_window)
    elif params.outlier_method == "percentile_cap":
        out = treat_percentile_cap(panel, params.percentile_cap, params.absolute_cap, params.outlier_window)
    else:
        out = treat_z_score(z_score_flags(panel, params), params)
    return out.select(*panel.columns)


def report(stats: DataFrame) -> DataFrame:
    """One row of counts over the keys' statistics."""
    count = lambda cond, name: F.count_if(cond).alias(name)
    cv, zero, mean, t = F.col("cv"), F.col("zero_pct"), F.col("mean_qty"), F.col("threshold_used")
    return stats.agg(
        F.count("*").alias("total_groups"), count(F.col("n_outliers") > 0, "groups_with_outliers"), F.sum("n_outliers").alias("total_outliers"),
        count(cv < 1, "cv_low"), count((cv >= 1) & (cv < 2), "cv_mid"), count(cv >= 2, "cv_high"),
        count(zero <= 0.3, "zeros_low"), count((zero > 0.3) & (zero <= 0.7), "zeros_mid"), count(zero > 0.7, "zeros_high"),
        count(mean < 10, "volume_low"), count((mean >= 10) & (mean < 100), "volume_mid"), count(mean >= 100, "volume_high"),
        F.min(t).alias("threshold_min"), F.avg(t).alias("threshold_mean"), F.max(t).alias("threshold_max"), F.stddev_samp(t).alias("threshold_std"),
    )


def top_by_outliers(stats: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k stores or products with most outliers, with their number of keys; ties by key."""
    return stats.groupBy(key).agg(F.sum("n_outliers").alias("n_outliers"), F.count("*").alias("n_groups")).orderBy(F.desc("n_outliers"), key).limit(k)
