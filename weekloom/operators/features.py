"""Lag, rolling, trend and calendar features of the weekly panel.

Every feature of a row looks at earlier rows of its own key only. All windows share one partitioning and order, so one
exchange and one sort serve them all. Windows never cross the border between keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.scalar import calendar_flags, seasonality
from weekloom.operators.ordered import last_rows, rolled
from weekloom.operators.panel import KEYS
from weekloom.params import Params

INDEX = "week_of_year_row"


def by_key():
    return Window.partitionBy(*KEYS).orderBy("week_of_year")


def before(n: int):
    return by_key().rowsBetween(-n, -1)


def needing(n: int, window, value: Column, of: Column) -> Column:
    """value if the window has at least n values, else null."""
    return F.when(F.count(of).over(window) >= n, value)


def lags(lags_: tuple[int, ...], column: str = "qty") -> dict[str, Column]:
    return {f"lag_{k}": F.coalesce(F.lag(column, k).over(by_key()), F.lit(0.0)) for k in lags_}


def rolling(w: int, need: int, column: str = "qty", window=before) -> dict[str, Column]:
    """Mean, sample deviation, extremes and range of the previous w rows; null with fewer than need of them."""
    c, win = F.col(column), window(w)
    at = lambda f: needing(need, win, f(c).over(win), c)
    return {f"rmean_{w}": at(F.avg), f"rstd_{w}": at(F.stddev_samp), f"rmax_{w}": at(F.max), f"rmin_{w}": at(F.min), f"rrange_{w}": at(F.max) - at(F.min)}


def nonzero_share(w: int = 8, column: str = "qty") -> Column:
    c, win = F.col(column), before(w)
    return needing(w, win, F.avg((c > 0).cast("double")).over(win), c)


def skewness(w: int, need: int = 4, column: str = "qty", window=before) -> Column:
    """Bias-corrected skewness of the previous w rows, 0 where they are all the same."""
    c, win = F.col(column), window(w)
    n = F.count(c).over(win)
    corrected = F.skewness(c).over(win) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= need, F.when(F.max(c).over(win) == F.min(c).over(win), 0.0).otherwise(corrected))


def trend(w: int, need: int = 3, column: str = "qty", index: str = INDEX) -> Column:
    """Slope over the positions of the previous w rows, with sample covariance over population variance: n/(n-1) times
    the least-squares slope."""
    win = before(w)
    n = F.count(column).over(win)
    return F.when(n >= need, F.regr_slope(F.col(column), F.col(index)).over(win) * n / (n - 1))


def with_row_index(panel: DataFrame) -> DataFrame:
    return panel.withColumn(INDEX, F.row_number().over(by_key()).cast("double"))


def basic_features(panel: DataFrame, params: Params = Params()) -> DataFrame:
    short = rolling(4, 4)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    new = lags(params.basic_lags) | {"rmean_4": zero(short["rmean_4"]), "rstd_4": zero(short["rstd_4"]), "nonzero_frac_8": zero(nonzero_share(8))}
    return panel.select("*", *(c.alias(k) for k, c in new.items()))


def percent_changes(ks: tuple[int, ...] = (1, 2, 4, 8)) -> dict[str, Column]:
    """From lag columns."""
    return {f"pct_change_{k}": (F.col("lag_1") - F.col(f"lag_{k}")) / F.greatest(F.abs(f"lag_{k}"), F.lit(0.01)) for k in ks}


def ratios_and_changes() -> dict[str, Column]:
    """Variation, momentum and acceleration from rolling and trend columns; 1 where a part is null."""
    one = lambda c: F.coalesce(c, F.lit(1.0))
    out = {f"rcv_{w}": one(F.col(f"rstd_{w}") / (F.col(f"rmean_{w}") + 0.01)) for w in (4, 8, 12)}
    out |= {f"momentum_{s}_{n}": one(F.col(f"rmean_{s}") / (F.col(f"rmean_{n}") + 0.01)) for s, n in ((4, 8), (8, 12), (4, 12))}
    return out | {f"accel_{s}_{n}": one(F.col(f"trend_{s}") - F.col(f"trend_{n}")) for s, n in ((4, 8), (8, 12))}


def advanced_features(featured: DataFrame, params: Params = Params()) -> DataFrame:
    """All further features of a panel that has the basic ones; nulls are 0, ratios' nulls 1."""
    rolled: dict[str, Column] = {}
    for w in params.rolling_windows:
        rolled |= rolling(w, params.least_periods)
    rolled |= {f"rskew_{w}": skewness(w) for w in (4, 8, 12)} | {f"trend_{w}": trend(w) for w in (4, 8, 12)}
    df = with_row_index(featured)
    df = df.select("*", *(c.alias(k) for k, c in (lags(params.extra_lags) | rolled).items()))
    last = df.agg(F.max("week_of_year").alias("_last"))  # one row
    df = df.crossJoin(F.broadcast(last))
    more = percent_changes() | ratios_and_changes() | seasonality(F.col("week_of_year")) | calendar_flags(F.col("week_of_year"), F.col("_last"))
    filled = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in rolled}
    keep = [c for c in df.columns if c not in filled and c not in ("_last", INDEX)]
    return df.select(*keep, *(c.alias(k) for k, c in (filled | more).items()))


def with_previous(panel: DataFrame, column: str, name: str = "_previous") -> DataFrame:
    """panel with the row before's value of a column; null in a key's first row."""
    return panel.withColumn(name, F.lag(column).over(by_key()))


def compat_rolling(panel: DataFrame, windows: tuple[int, ...] = (8, 12, 16, 20), skewed: tuple[int, ...] = (8, 12), need: int = 4, parts: int | None = None) -> DataFrame:
    """panel with the rolling columns as they come out when windows run on from one key into the next, in the order of keys
    and weeks: a row's window is the previous quantities of it and the rows before, whosever they are."""
    new: dict[str, Column] = {}
    for w in windows:
        new |= rolling(w, need, "_previous", last_rows)
    new |= {f"rskew_{w}": skewness(w, need, "_previous", last_rows) for w in skewed}
    return rolled(with_previous(panel, "qty"), [*KEYS, "week_of_year"], max((*windows, *skewed)), new, parts).drop("_previous")


def feature_names(df: DataFrame) -> list[str]:
    """The numerical features among df's columns."""
    kinds = ("lag_", "rmean_", "rstd_", "rmax_", "rmin_", "rrange_", "rskew_", "rcv_", "pct_change_", "trend_", "accel_", "momentum_", "is_")
    named = ("week_of_year", "nonzero_frac_8", "month", "quarter", "week_of_month", "month_sin", "month_cos", "quarter_sin", "quarter_cos")
    return [c for c in df.columns if c in named or c.startswith(kinds)]


def notebook_features(totals: DataFrame) -> DataFrame:
    """Lags 1-4, means of the previous 4 and 2 and deviation of the previous 4 rows of quantity_total, from one row on."""
    win = Window.partitionBy("pdv", "produto").orderBy("semana_do_ano")
    q = F.col("quantity_total")
    back = lambda n: win.rowsBetween(-n, -1)
    new = {f"lag_{k}": F.lag(q, k).over(win) for k in (1, 2, 3, 4)} | {"media_movel_4": F.avg(q).over(back(4)), "media_movel_2": F.avg(q).over(back(2)), "std_movel_4": F.stddev_samp(q).over(back(4))}
    return totals.select("*", *(c.alias(k) for k, c in new.items()))
