"""Unit prices of the panel: lags, changes, and a forecast from the recent trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.scalar import clip, half_even
from weekloom.operators.features import before, by_key, with_previous
from weekloom.operators.ordered import last_rows, rolled
from weekloom.operators.panel import KEYS


def unit_price(panel: DataFrame) -> DataFrame:
    price = half_even(F.col("gross") / F.nullif("qty", F.lit(0.0)), 2)
    return panel.withColumn("unit_price", F.when((F.col("qty") > 0) & (F.col("gross") > 0), price).otherwise(0.0))


def price_features(priced: DataFrame) -> DataFrame:
    """Lags 1, 2, 4, change on the row before (infinite from 0 up), and mean of the previous 4 rows, from one row on."""
    p = F.col("unit_price")
    last = F.lag(p).over(by_key())
    change = F.when(last.isNull() | (p == last), 0.0).when(last == 0, F.lit(float("inf"))).otherwise(half_even(p / F.nullif(last, F.lit(0.0)) - 1, 4))
    new = {f"unit_price_lag_{k}": F.coalesce(F.lag(p, k).over(by_key()), F.lit(0.0)) for k in (1, 2, 4)}
    new |= {"unit_price_change_pct": change, "unit_price_rolling_mean_4": F.coalesce(half_even(F.avg(p).over(before(4)), 2), F.lit(0.0))}
    return priced.select("*", *(c.alias(k) for k, c in new.items()))


def compat_price_mean(priced: DataFrame, parts: int | None = None) -> DataFrame:
    """priced with unit_price_rolling_mean_4 as it comes out when windows run on from one key into the next."""
    mean = F.coalesce(half_even(F.avg("_previous").over(last_rows(4)), 2), F.lit(0.0))
    return rolled(with_previous(priced, "unit_price"), [*KEYS, "week_of_year"], 4, {"unit_price_rolling_mean_4": mean}, parts).drop("_previous")


def price_forecast(priced: DataFrame, recent: int = 6) -> DataFrame:
    """(key, predicted): the last price moved on by the slope of the last recent ones, within 0.8 and 1.3 times itself."""
    at = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("week_of_year")))
    rows = priced.filter(F.col("unit_price") > 0).withColumn("back", at).filter(F.col("back") <= recent)
    last = F.max_by("unit_price", "week_of_year")
    slope = F.when(F.count("*") > 1, F.regr_slope(F.col("unit_price"), -F.col("back").cast("double"))).otherwise(0.0)
    return rows.groupBy(*KEYS).agg(half_even(clip(last + slope, last * 0.8, last * 1.3), 2).alias("predicted"))


def with_price_forecast(priced: DataFrame) -> DataFrame:
    joined = priced.join(price_forecast(priced), KEYS, "left")
    return joined.withColumn("unit_price_predicted", F.coalesce("predicted", "unit_price")).drop("predicted")
