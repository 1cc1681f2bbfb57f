"""All registered queries of the demand engine with the SQL that says the same.

Queries run over the demand view of the star-schema tables (sources.tables.demand_transactions). Numbers are rounded to
six places on both sides, since the order of summation differs between engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions import scalar
from weekloom.operators import boosting, categorical, embedding, explore, features, forecast, ordered, outliers, panel, prices
from weekloom.params import Params
from weekloom.plans import pipeline
from weekloom.sources import sinks, tables
from weekloom.sources.stages import checkpoint_dir, settle
from weekloom.streaming import histories as stream_histories
from weekloom.streaming import weekly as stream_weekly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PARAMS = Params()
_KEYS = ["week_of_year", *panel.KEYS]
PLACES = 6

# ---- SQL parts -------------------------------------------------------------------------------------------------

_TX = """tx AS (
  SELECT l_shipdate AS ts, CAST(s_nationkey AS BIGINT) AS pdv, l_suppkey AS supp, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS prod,
    l_quantity AS q, l_extendedprice AS g, p_type AS categoria, n_name AS premise, p_brand AS subcategoria, CAST(p_size AS VARCHAR) AS fabricante
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
cl AS (SELECT *, CAST(floor(date_sub('day', (SELECT min(ts) FROM tx), ts) / 7) AS BIGINT) + 1 AS wk FROM tx)"""
_PANEL = (
    _TX
    + """,
pn AS (SELECT wk AS week_of_year, pdv, prod AS internal_product_id, greatest(coalesce(sum(q), 0), 0) AS qty, coalesce(sum(g), 0) AS gross,
    min(categoria) AS categoria, min(premise) AS premise, min(subcategoria) AS subcategoria, min(fabricante) AS fabricante
  FROM cl WHERE wk <> 37 GROUP BY ALL)"""
)
_W = "PARTITION BY pdv, internal_product_id ORDER BY week_of_year"
_K = "week_of_year, pdv, internal_product_id"


def _prev(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {PLACES}) + CAST(0 AS DOUBLE) AS {name}"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _lag(k: int) -> str:
    return f"coalesce(lag(qty, {k}) OVER ({_W}), 0)"


def _need(n: int, w: int, expr: str) -> str:
    return f"CASE WHEN count(qty) OVER {_prev(w)} >= {n} THEN {expr} END"


def _agg(f: str, w: int, n: int) -> str:
    return _need(n, w, f"{f}(qty) OVER {_prev(w)}")


# ---- helpers of the queries --------------------------------------------------------------------------------------


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.demand_transactions(spark, sf_dir)


def weekly(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    return panel.weekly_panel(panel.clean(transactions(spark, sf_dir), PARAMS), attributes=attributes)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(df.dtypes)
    # + 0.0 makes a zero of either sign the same
    return df.select(*((F.round(c, PLACES) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns or df.columns))


# ---- cleaning and panel ------------------------------------------------------------------------------------------


@query("clean_transactions", _with(_TX) + f" SELECT wk AS week_of_year, count(*) AS n, {_r('sum(q)', 'quantity')} FROM cl WHERE wk <> 37 GROUP BY wk")
def clean_transactions(spark, sf_dir):
    df = panel.clean(transactions(spark, sf_dir), PARAMS)
    return rounded(df.groupBy("week_of_year").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity")))


@query("weekly_panel", _with(_PANEL) + f" SELECT {_K}, {_r('qty', 'qty')}, {_r('gross', 'gross')}, categoria, premise, subcategoria, fabricante FROM pn")
def weekly_panel(spark, sf_dir):
    return rounded(weekly(spark, sf_dir, *panel.ATTRIBUTES))


@query("weekly_panel_iso", _with(_TX) + f" SELECT CAST(week(ts) AS INTEGER) AS semana_do_ano, pdv, prod AS produto, {_r('sum(q)', 'quantity_total')} FROM cl GROUP BY ALL")
def weekly_panel_iso(spark, sf_dir):
    return rounded(panel.iso_panel(transactions(spark, sf_dir)))


@query(
    "interpolate_week",
    _with(_PANEL)
    + f""", a AS (SELECT * FROM pn WHERE week_of_year = 36), b AS (SELECT * FROM pn WHERE week_of_year = 38)
SELECT CAST(37 AS BIGINT) AS week_of_year, coalesce(a.pdv, b.pdv) AS pdv, coalesce(a.internal_product_id, b.internal_product_id) AS internal_product_id,
  {_r('(coalesce(a.qty, 0) + coalesce(b.qty, 0)) / 2', 'qty')}, {_r('(coalesce(a.gross, 0) + coalesce(b.gross, 0)) / 2', 'gross')},
  coalesce(a.categoria, b.categoria) AS categoria, coalesce(a.premise, b.premise) AS premise, coalesce(a.subcategoria, b.subcategoria) AS subcategoria, coalesce(a.fabricante, b.fabricante) AS fabricante
FROM a FULL JOIN b ON a.pdv = b.pdv AND a.internal_product_id = b.internal_product_id""",
)
def interpolate_week(spark, sf_dir):
    return rounded(panel.interpolated_week(weekly(spark, sf_dir, *panel.ATTRIBUTES), 37))


@query(
    "densify_panel",
    _with(_PANEL)
    + f""", sp AS (SELECT pdv, internal_product_id, min(week_of_year) AS a, max(week_of_year) AS b FROM pn GROUP BY ALL),
s AS (SELECT pdv, internal_product_id, unnest(generate_series(a, b)) AS week_of_year FROM sp)
SELECT pdv, internal_product_id, week_of_year, {_r('coalesce(qty, 0)', 'qty')} FROM s LEFT JOIN pn USING (pdv, internal_product_id, week_of_year)""",
)
def densify_panel(spark, sf_dir):
    return rounded(panel.densify(weekly(spark, sf_dir)), *panel.KEYS, "week_of_year", "qty")


# ---- features ----------------------------------------------------------------------------------------------------


def _lag_query(ks):
    return _with(_PANEL) + f" SELECT {_K}, " + ", ".join(_r(_lag(k), f"lag_{k}") for k in ks) + " FROM pn"


@query("lags_basic", _lag_query(PARAMS.basic_lags))
def lags_basic(spark, sf_dir):
    return rounded(weekly(spark, sf_dir).select(*_KEYS, *(c.alias(k) for k, c in features.lags(PARAMS.basic_lags).items())))


@query("lags_extended", _lag_query(PARAMS.extra_lags))
def lags_extended(spark, sf_dir):
    return rounded(weekly(spark, sf_dir).select(*_KEYS, *(c.alias(k) for k, c in features.lags(PARAMS.extra_lags).items())))


_BASIC_COLUMNS = [*(f"lag_{k}" for k in PARAMS.basic_lags), "rmean_4", "rstd_4", "nonzero_frac_8"]
_BASIC = ", ".join(_r(_lag(k), f"lag_{k}") for k in PARAMS.basic_lags) + ", " + ", ".join([_r(f"coalesce({_agg('avg', 4, 4)}, 0)", "rmean_4"), _r(f"coalesce({_agg('stddev_samp', 4, 4)}, 0)", "rstd_4"), _r(f"coalesce({_need(8, 8, f'avg(CASE WHEN qty > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER {_prev(8)}')}, 0)", "nonzero_frac_8")])


@query("rolling_basic", _with(_PANEL) + f" SELECT {_K}, {_BASIC} FROM pn")
def rolling_basic(spark, sf_dir):
    return rounded(features.basic_features(weekly(spark, sf_dir), PARAMS), *_KEYS, *_BASIC_COLUMNS)


_MOMENTS = [(f"{n}_{w}", f, w) for w in PARAMS.rolling_windows for n, f in (("rmean", "avg"), ("rstd", "stddev_samp"), ("rmax", "max"), ("rmin", "min"))]


@query("rolling_moments", _with(_PANEL) + f" SELECT {_K}, " + ", ".join(_r(_agg(f, w, 4), n) for n, f, w in _MOMENTS) + ", " + ", ".join(_r(f"{_agg('max', w, 4)} - {_agg('min', w, 4)}", f"rrange_{w}") for w in PARAMS.rolling_windows) + " FROM pn")
def rolling_moments(spark, sf_dir):
    new: dict = {}
    for w in PARAMS.rolling_windows:
        new |= features.rolling(w, 4)
    return rounded(weekly(spark, sf_dir).select(*_KEYS, *(c.alias(k) for k, c in new.items())))


def _skew(w: int) -> str:
    return _need(4, w, f"CASE WHEN max(qty) OVER {_prev(w)} = min(qty) OVER {_prev(w)} THEN 0 ELSE skewness(qty) OVER {_prev(w)} END")


def _cv(w: int, n: int) -> str:
    mean, std = _agg("avg", w, n), _agg("stddev_samp", w, n)
    return f"coalesce(({std}) / (({mean}) + 0.01), 1)" if w > 4 else f"coalesce({std}, 0) / (coalesce({mean}, 0) + 0.01)"


@query("rolling_skew_cv", _with(_PANEL) + f" SELECT {_K}, " + ", ".join([*(_r(f"coalesce({_skew(w)}, 0)", f"rskew_{w}") for w in (4, 8, 12)), *(_r(_cv(w, 4), f"rcv_{w}") for w in (4, 8, 12))]) + " FROM pn")
def rolling_skew_cv(spark, sf_dir):
    df = features.advanced_features(features.basic_features(weekly(spark, sf_dir), PARAMS), PARAMS)
    return rounded(df, *_KEYS, *(f"{k}_{w}" for k in ("rskew", "rcv") for w in (4, 8, 12)))


_INDEXED = _PANEL + f", ix AS (SELECT *, CAST(row_number() OVER ({_W}) AS DOUBLE) AS i FROM pn)"


def _trend(w: int) -> str:
    n = f"count(qty) OVER {_prev(w)}"
    return f"CASE WHEN {n} >= 3 THEN regr_slope(qty, i) OVER {_prev(w)} * {n} / ({n} - 1) END"


@query("trend_accel", _with(_INDEXED) + f" SELECT {_K}, " + ", ".join([*(_r(f"coalesce({_trend(w)}, 0)", f"trend_{w}") for w in (4, 8, 12)), *(_r(f"coalesce(({_trend(a)}) - ({_trend(b)}), 1)", f"accel_{a}_{b}") for a, b in ((4, 8), (8, 12)))]) + " FROM ix")
def trend_accel(spark, sf_dir):
    df = features.advanced_features(features.basic_features(weekly(spark, sf_dir), PARAMS), PARAMS)
    return rounded(df, *_KEYS, "trend_4", "trend_8", "trend_12", "accel_4_8", "accel_8_12")


def _mean(w: int) -> str:
    return f"coalesce({_agg('avg', 4, 4)}, 0)" if w == 4 else f"({_agg('avg', w, 4)})"


@query("momentum", _with(_PANEL) + f" SELECT {_K}, " + ", ".join(_r(f"coalesce({_mean(a)} / ({_mean(b)} + 0.01), 1)", f"momentum_{a}_{b}") for a, b in ((4, 8), (8, 12), (4, 12))) + " FROM pn")
def momentum(spark, sf_dir):
    df = features.advanced_features(features.basic_features(weekly(spark, sf_dir), PARAMS), PARAMS)
    return rounded(df, *_KEYS, "momentum_4_8", "momentum_8_12", "momentum_4_12")


@query("pct_change", _with(_PANEL) + f" SELECT {_K}, " + ", ".join(_r(f"({_lag(1)} - {_lag(k)}) / greatest(abs({_lag(k)}), 0.01)", f"pct_change_{k}") for k in (1, 2, 4, 8)) + " FROM pn")
def pct_change(spark, sf_dir):
    df = features.basic_features(weekly(spark, sf_dir), PARAMS)
    return rounded(df.select(*_KEYS, *(c.alias(k) for k, c in features.percent_changes().items())))


_WEEKS = _PANEL + ", w AS (SELECT DISTINCT week_of_year FROM pn), m AS (SELECT week_of_year, CAST(least(greatest(floor((week_of_year - 1) / 4.33::DOUBLE) + 1, 1), 12) AS INTEGER) AS month FROM w), mq AS (SELECT *, CAST(floor((month - 1) / 3) + 1 AS INTEGER) AS quarter FROM m)"


@query(
    "seasonality",
    _with(_WEEKS)
    + f""" SELECT week_of_year, month, quarter, CAST(least(greatest(floor((week_of_year - 1)::DOUBLE % 4.33::DOUBLE) + 1, 1), 4) AS INTEGER) AS week_of_month,
  {_r('sin(2 * pi() * month / 12)', 'month_sin')}, {_r('cos(2 * pi() * month / 12)', 'month_cos')}, {_r('sin(2 * pi() * quarter / 4)', 'quarter_sin')}, {_r('cos(2 * pi() * quarter / 4)', 'quarter_cos')} FROM mq""",
)
def seasonality(spark, sf_dir):
    weeks = weekly(spark, sf_dir).select("week_of_year").distinct()
    return rounded(weeks.select("week_of_year", *(c.alias(k) for k, c in scalar.seasonality(F.col("week_of_year")).items())))


@query(
    "calendar_flags",
    _with(_PANEL, "w AS (SELECT DISTINCT week_of_year AS w, (week_of_year - 1)::DOUBLE % 4.33::DOUBLE AS m, (week_of_year - 1) % 13 AS q, (SELECT max(week_of_year) FROM pn) AS last FROM pn)")
    + " SELECT w AS week_of_year, CAST(m >= 3.5 AS INTEGER) AS is_end_of_month, CAST(m <= 0.5 AS INTEGER) AS is_start_of_month, CAST(q >= 11 AS INTEGER) AS is_end_of_quarter, CAST(q <= 1 AS INTEGER) AS is_start_of_quarter, CAST(w >= last - 4 AS INTEGER) AS is_holiday_season FROM w",
)
def calendar_flags(spark, sf_dir):
    weeks = weekly(spark, sf_dir).select("week_of_year").distinct()
    last = weeks.agg(F.max("week_of_year").alias("last"))
    return weeks.crossJoin(F.broadcast(last)).select("week_of_year", *(c.alias(k) for k, c in scalar.calendar_flags(F.col("week_of_year"), F.col("last")).items()))


@query(
    "calendar_dates",
    "SELECT o_orderdate AS ts, count(*) AS n, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(weekofyear(o_orderdate) AS INTEGER) AS semana_do_ano, dayname(o_orderdate) AS dia_da_semana, CAST(least((day(o_orderdate) - 1) // 7 + 1, 5) AS INTEGER) AS week_of_month FROM orders GROUP BY o_orderdate",
)
def calendar_dates(spark, sf_dir):
    ts = F.col("o_orderdate")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(ts.alias("ts")).agg(F.count("*").alias("n"))
    at, parts = scalar.calendar_of_date(F.col("ts")), scalar.date_parts(F.col("ts"))
    return df.select("ts", "n", at["month"].alias("month"), at["quarter"].alias("quarter"), parts["semana_do_ano"].alias("semana_do_ano"), parts["dia_da_semana"].alias("dia_da_semana"), at["week_of_month"].alias("week_of_month"))


# ---- outliers ----------------------------------------------------------------------------------------------------


def _stats_sql(least: int) -> str:
    return (
        _PANEL
        + f""",
s0 AS (SELECT pdv, internal_product_id, count(*) AS n, avg(qty) AS m, CASE WHEN max(qty) = min(qty) THEN 1 ELSE stddev_pop(qty) END AS s,
    avg(CASE WHEN qty = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS z, quantile_cont(qty, 0.02) AS p2, quantile_cont(qty, 0.98) AS p98, quantile_cont(qty, 0.1) AS p10, quantile_cont(qty, 0.9) AS p90 FROM pn GROUP BY ALL),
s1 AS (SELECT *, s / (m + 1e-8) AS cv FROM s0),
s2 AS (SELECT *, 4.0 * CASE WHEN n < 3 THEN 1 WHEN n < {least} THEN CASE WHEN cv > 2 THEN 1.3 WHEN z > 0.7 THEN 1.2 ELSE 1 END
    ELSE (CASE WHEN cv > 2 THEN 1.5 WHEN cv > 1 THEN 1.2 ELSE 0.8 END) * (CASE WHEN z > 0.7 THEN 1.3 ELSE 1 END) * (CASE WHEN m > 100 THEN 0.9 ELSE 1 END) END AS t FROM s1),
r AS (SELECT *, count(qty) OVER {_prev(12)} AS c12, avg(qty) OVER {_prev(12)} AS m12, stddev_samp(qty) OVER {_prev(12)} AS s12 FROM pn),
f AS (SELECT r.*, n, m, s, z, cv, t, p2, p98, p10, p90, CASE WHEN n < 3 THEN false WHEN n < {least} THEN abs(qty - m) > t * s
    ELSE abs((qty - CASE WHEN c12 >= 3 THEN m12 ELSE m END) / coalesce(nullif(CASE WHEN c12 >= 3 THEN s12 END, 0), s)) > t END AS is_outlier
  FROM r JOIN s2 USING (pdv, internal_product_id)),
fa AS (SELECT *, max(CAST(is_outlier AS INTEGER)) OVER (PARTITION BY pdv, internal_product_id) AS has, least(qty, m * 5) AS cut FROM f)"""
    )


_FLAGS = _stats_sql(PARAMS.least_observations)
#: A low threshold, so that treatments have something to treat in these tables.
SENSITIVE = replace(PARAMS, z_threshold=2.0)
_SENSITIVE_FLAGS = _FLAGS.replace("4.0 * CASE", "2.0 * CASE")


@query("outlier_zscore_flags", _with(_FLAGS) + f" SELECT {_K}, is_outlier, {_r('t', 'threshold_used')}, {_r('cv', 'cv')} FROM f")
def outlier_zscore_flags(spark, sf_dir):
    return rounded(outliers.z_score_flags(weekly(spark, sf_dir), PARAMS), *_KEYS, "is_outlier", "threshold_used", "cv")


def _treated(treatment):
    def run(spark, sf_dir):
        flagged = outliers.z_score_flags(weekly(spark, sf_dir), SENSITIVE)
        return rounded(outliers.treat_z_score(flagged, SENSITIVE, treatment), *_KEYS, "qty")

    return run


def _treat_sql(new: str, where: str = "") -> str:
    return _with(_SENSITIVE_FLAGS) + f" SELECT {_K}, {_r(f'CASE WHEN has = 1 THEN CASE WHEN is_outlier THEN {new} ELSE cut END ELSE qty END', 'qty')} FROM fa {where}"


_HIGH = f"(CASE WHEN n >= {PARAMS.least_observations} THEN least(p90, m + 1.5 * s) ELSE m + 1.5 * s END)"
_LOW = f"greatest(0, CASE WHEN n >= {PARAMS.least_observations} THEN p10 ELSE m - 1.5 * s END)"
query("outlier_winsorize", _treat_sql("least(greatest(cut, greatest(0, p2)), least(p98, m * 3))"))(_treated("winsorize"))
query("outlier_cap", _treat_sql(f"CASE WHEN cut > {_HIGH} THEN {_HIGH} WHEN cut < {_LOW} THEN {_LOW} ELSE cut END"))(_treated("cap"))
query("outlier_remove", _treat_sql("cut", "WHERE NOT is_outlier"))(_treated("remove"))

_PAST = _PANEL + f", lim AS (SELECT *, least(coalesce({_need(3, 12, f'quantile_cont(qty, 0.9) OVER {_prev(12)}')}, 220), 220) AS lim, {_need(3, 12, f'quantile_cont(qty, 0.5) OVER {_prev(12)}')} AS med FROM pn)"


@query("outlier_percentile_cap", _with(_PAST) + f" SELECT {_K}, {_r('CASE WHEN qty > lim THEN lim ELSE qty END', 'qty')} FROM lim")
def outlier_percentile_cap(spark, sf_dir):
    return rounded(outliers.treat_percentile_cap(weekly(spark, sf_dir), 90.0), *_KEYS, "qty")


@query("outlier_median_impute", _with(_PAST) + f" SELECT {_K}, {_r('CASE WHEN qty > lim THEN coalesce(med, 1) ELSE qty END', 'qty')} FROM lim")
def outlier_median_impute(spark, sf_dir):
    return rounded(outliers.treat_median(weekly(spark, sf_dir), 90.0), *_KEYS, "qty")


@query(
    "outlier_volume_change",
    _with(_PAST, "t AS (SELECT qty, qty > lim AS o, CASE WHEN qty > lim THEN lim ELSE qty END AS a FROM lim)")
    + f" SELECT {_r('sum(qty)', 'volume_before')}, {_r('sum(a)', 'volume_after')}, count(*) FILTER (WHERE o) AS total_outliers, {_r('max(a)', 'final_max')}, {_r('avg(a)', 'final_mean')}, {_r('(sum(qty) - sum(a)) * 100 / sum(qty)', 'volume_reduction_pct')} FROM t",
)
def outlier_volume_change(spark, sf_dir):
    df = weekly(spark, sf_dir)
    return rounded(outliers.volume_change(df, outliers.treat_percentile_cap(df, 90.0)))


_GROUPS = _SENSITIVE_FLAGS + """,
g AS (SELECT pdv, internal_product_id, n AS n_obs, CASE WHEN n < 3 THEN 0 ELSE m END AS mean_qty, CASE WHEN n < 3 THEN 0 ELSE s END AS std_qty, CASE WHEN n < 3 THEN 0 ELSE cv END AS cv,
    CASE WHEN n < 3 THEN 0 ELSE z END AS zero_pct, t AS threshold_used, count(*) FILTER (WHERE is_outlier) AS n_outliers FROM f GROUP BY ALL)"""


def _group_stats(spark, sf_dir):
    return outliers.group_stats(outliers.z_score_flags(weekly(spark, sf_dir), SENSITIVE))


@query("outlier_group_stats", _with(_GROUPS) + f" SELECT pdv, internal_product_id, n_obs, {_r('mean_qty', 'mean_qty')}, {_r('std_qty', 'std_qty')}, {_r('cv', 'cv')}, {_r('zero_pct', 'zero_pct')}, {_r('threshold_used', 'threshold_used')}, n_outliers, {_r('n_outliers / n_obs * 100', 'outlier_pct')} FROM g")
def outlier_group_stats(spark, sf_dir):
    return rounded(_group_stats(spark, sf_dir))


_COUNTS = [("groups_with_outliers", "n_outliers > 0"), ("cv_low", "cv < 1"), ("cv_mid", "cv >= 1 AND cv < 2"), ("cv_high", "cv >= 2"), ("zeros_low", "zero_pct <= 0.3"), ("zeros_mid", "zero_pct > 0.3 AND zero_pct <= 0.7"), ("zeros_high", "zero_pct > 0.7"), ("volume_low", "mean_qty < 10"), ("volume_mid", "mean_qty >= 10 AND mean_qty < 100"), ("volume_high", "mean_qty >= 100")]


@query("outlier_report", _with(_GROUPS) + " SELECT count(*) AS total_groups, CAST(sum(n_outliers) AS BIGINT) AS total_outliers, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _COUNTS) + f", {_r('min(threshold_used)', 'threshold_min')}, {_r('avg(threshold_used)', 'threshold_mean')}, {_r('max(threshold_used)', 'threshold_max')}, {_r('stddev_samp(threshold_used)', 'threshold_std')} FROM g")
def outlier_report(spark, sf_dir):
    return rounded(outliers.report(_group_stats(spark, sf_dir)))


@query("outlier_top_keys", _with(_GROUPS) + " SELECT pdv, CAST(sum(n_outliers) AS BIGINT) AS n_outliers, count(*) AS n_groups FROM g GROUP BY pdv ORDER BY n_outliers DESC, pdv LIMIT 10")
def outlier_top_keys(spark, sf_dir):
    return outliers.top_by_outliers(_group_stats(spark, sf_dir), "pdv")


# ---- attributes --------------------------------------------------------------------------------------------------


def _rank_sql(column: str, as_: str) -> str:
    return f"{as_} AS (SELECT {column} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min((pdv, internal_product_id, week_of_year)), {column}) AS freq_rank FROM pn WHERE {column} IS NOT NULL GROUP BY {column})"


def _melted(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, total) of each column, in one aggregation."""
    pairs = [F.struct(F.lit(n).alias("name"), F.sum(F.col(n).cast("double")).alias("total")) for n in names]
    return rounded(df.agg(F.array(*pairs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*"))


def _dummy_sql(column: str) -> str:
    return f"SELECT replace(replace('{column}_' || value, ' ', '_'), '-', '_') AS name, {_r('n', 'total')} FROM {column}_r WHERE freq_rank <= 10"


@query("one_hot_top10", _with(_PANEL, _rank_sql("categoria", "categoria_r"), _rank_sql("premise", "premise_r")) + f" {_dummy_sql('categoria')} UNION ALL {_dummy_sql('premise')}")
def one_hot_top10(spark, sf_dir):
    return _melted(*categorical.one_hot(settle(weekly(spark, sf_dir, "categoria", "premise")), PARAMS))


@query(
    "freq_features",
    _with(_PANEL, _rank_sql("subcategoria", "a"), _rank_sql("fabricante", "b"))
    + f" SELECT {_K}, {_r('ln(1 + a.n)', 'subcategoria_log_freq')}, a.freq_rank AS subcategoria_freq_rank, {_r('ln(1 + b.n)', 'fabricante_log_freq')}, b.freq_rank AS fabricante_freq_rank FROM pn LEFT JOIN a ON a.value = subcategoria LEFT JOIN b ON b.value = fabricante",
)
def freq_features(spark, sf_dir):
    df, names = categorical.frequencies(settle(weekly(spark, sf_dir, "subcategoria", "fabricante")), PARAMS)
    return rounded(df, *_KEYS, *names)


@query(
    "interactions",
    _with(_PANEL, _rank_sql("categoria", "c"))
    + f""", x AS (SELECT categoria, {_lag(1)} AS lag_1, {_lag(2)} AS lag_2, coalesce({_agg('avg', 4, 4)}, 0) AS rmean_4, coalesce({_agg('avg', 8, 4)}, 0) AS rmean_8 FROM pn),
u AS (UNPIVOT x ON lag_1, lag_2, rmean_4, rmean_8 INTO NAME num VALUE v),
p AS (SELECT freq_rank * 4 + CASE num WHEN 'lag_1' THEN 0 WHEN 'lag_2' THEN 1 WHEN 'rmean_4' THEN 2 ELSE 3 END AS pos, replace(replace('categoria_' || value, ' ', '_'), '-', '_') || '_x_' || num AS name, sum(v) AS total FROM u JOIN c ON c.value = categoria WHERE freq_rank <= 5 GROUP BY ALL)
SELECT name, {_r('total', 'total')} FROM p ORDER BY pos LIMIT 15""",
)
def interactions(spark, sf_dir):
    df = settle(weekly(spark, sf_dir, "categoria"))
    wide = features.rolling(8, 4)["rmean_8"]
    df = features.basic_features(df, PARAMS).withColumn("rmean_8", F.coalesce(wide, F.lit(0.0)))
    df, dummies = categorical.one_hot(df, PARAMS)
    return _melted(*categorical.interactions(df, dummies, PARAMS.most_interactions))


@query("category_context", _with(_PANEL) + f" SELECT categoria AS value, {_r('avg(qty)', 'mean')}, {_r('coalesce(stddev_samp(qty), 0)', 'std')}, count(qty) AS count, {_r('quantile_cont(qty, 0.5)', 'median')}, {_r('quantile_cont(qty, 0.25)', 'q1')}, {_r('quantile_cont(qty, 0.75)', 'q3')} FROM pn GROUP BY categoria")
def category_context(spark, sf_dir):
    return rounded(categorical.category_context(settle(weekly(spark, sf_dir, "categoria")), "categoria", wide=True))


# ---- prices ------------------------------------------------------------------------------------------------------

_PRICED = _PANEL + ", pr AS (SELECT *, CASE WHEN qty > 0 AND gross > 0 THEN round_even(gross / qty * 100, 0) / 100 ELSE 0 END AS p FROM pn)"


@query("unit_price", _with(_PRICED) + f" SELECT {_K}, {_r('p', 'unit_price')} FROM pr")
def unit_price(spark, sf_dir):
    return rounded(prices.unit_price(weekly(spark, sf_dir)), *_KEYS, "unit_price")


@query(
    "price_lags",
    _with(_PRICED, f"l AS (SELECT *, lag(p) OVER ({_W}) AS p1 FROM pr)")
    + f" SELECT {_K}, "
    + ", ".join(_r(f"coalesce(lag(p, {k}) OVER ({_W}), 0)", f"unit_price_lag_{k}") for k in (1, 2, 4))
    + f", {_r('CASE WHEN p1 IS NULL OR p = p1 THEN 0 WHEN p1 = 0 THEN CAST(1e308 AS DOUBLE) * 10 ELSE round_even((p / p1 - 1) * 10000, 0) / 10000 END', 'unit_price_change_pct')}, {_r(f'coalesce(round_even(avg(p) OVER {_prev(4)} * 100, 0) / 100, 0)', 'unit_price_rolling_mean_4')} FROM l",
)
def price_lags(spark, sf_dir):
    df = prices.price_features(prices.unit_price(weekly(spark, sf_dir)))
    return rounded(df, *_KEYS, "unit_price_lag_1", "unit_price_lag_2", "unit_price_lag_4", "unit_price_change_pct", "unit_price_rolling_mean_4")


@query(
    "price_forecast",
    _with(
        _PRICED,
        "b AS (SELECT *, row_number() OVER (PARTITION BY pdv, internal_product_id ORDER BY week_of_year DESC) AS k FROM pr WHERE p > 0)",
        "l AS (SELECT pdv, internal_product_id, arg_max(p, week_of_year) AS last, CASE WHEN count(*) > 1 THEN regr_slope(p, -CAST(k AS DOUBLE)) ELSE 0 END AS slope FROM b WHERE k <= 6 GROUP BY ALL)",
        "o AS (SELECT pdv, internal_product_id, round_even(least(greatest(last + slope, last * 0.8), last * 1.3) * 100, 0) / 100 AS predicted FROM l)",
    )
    + f" SELECT {_K}, {_r('coalesce(predicted, p)', 'unit_price_predicted')} FROM pr LEFT JOIN o USING (pdv, internal_product_id)",
)
def price_forecast(spark, sf_dir):
    return rounded(prices.with_price_forecast(prices.unit_price(weekly(spark, sf_dir))), *_KEYS, "unit_price_predicted")


# ---- joins and filters -------------------------------------------------------------------------------------------

_DIMS = """dp AS (SELECT p_partkey AS produto, p_type AS categoria, p_brand AS marca FROM part WHERE p_size > 10),
ds AS (SELECT s_suppkey AS pdv, n_name AS premise, r_name AS categoria_pdv FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 <> 0)"""


def _facts_and_dims(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    facts = read("lineitem").select(F.col("l_partkey").alias("internal_product_id"), F.col("l_suppkey").alias("internal_store_id"), F.col("l_quantity").alias("quantity"))
    products = read("part").filter("p_size > 10").select(F.col("p_partkey").alias("produto"), F.col("p_type").alias("categoria"), F.col("p_brand").alias("marca"))
    stores = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("s_suppkey % 3 <> 0")
    return facts, products, stores.select(F.col("s_suppkey").alias("pdv"), F.col("n_name").alias("premise"), F.col("r_name").alias("categoria_pdv"))


@query("join_dims_left", _with(_DIMS) + f" SELECT categoria, categoria_pdv, count(*) AS n, {_r('sum(l_quantity)', 'quantity')} FROM lineitem LEFT JOIN dp ON l_partkey = produto LEFT JOIN ds ON l_suppkey = pdv GROUP BY ALL")
def join_dims_left(spark, sf_dir):
    df = explore.with_dims(*_facts_and_dims(spark, sf_dir))
    return rounded(df.groupBy("categoria", "categoria_pdv").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity")))


@query("fill_nulls_by_type", _with(_DIMS) + " SELECT coalesce(categoria, 'desconhecido') AS categoria, coalesce(premise, 'desconhecido') AS premise, coalesce(pdv, 0) AS pdv, count(*) AS n FROM lineitem LEFT JOIN dp ON l_partkey = produto LEFT JOIN ds ON l_suppkey = pdv GROUP BY ALL")
def fill_nulls_by_type(spark, sf_dir):
    df = explore.fill_nulls(explore.with_dims(*_facts_and_dims(spark, sf_dir)))
    return df.groupBy("categoria", "premise", "pdv").agg(F.count("*").alias("n"))


@query("distinct_dims", _with(_TX) + " SELECT DISTINCT prod AS produto, categoria, subcategoria AS marca FROM cl")
def distinct_dims(spark, sf_dir):
    return transactions(spark, sf_dir).select(F.col("internal_product_id").alias("produto"), "categoria", F.col("subcategoria").alias("marca")).distinct()


@query("first_per_key", _with(_TX) + " SELECT prod AS produto, categoria, ts FROM (SELECT prod, categoria, ts, row_number() OVER (PARTITION BY prod ORDER BY ts, categoria) AS k FROM cl) WHERE k = 1")
def first_per_key(spark, sf_dir):
    df = transactions(spark, sf_dir).select(F.col("internal_product_id").alias("produto"), "categoria", F.col("transaction_date").alias("ts"))
    return explore.first_per_key(df, ["produto"], ["ts", "categoria"])


@query("last_per_key", _with(_PANEL) + f" SELECT pdv, internal_product_id, max(week_of_year) AS week_of_year, {_r('arg_max(qty, week_of_year)', 'qty')}, arg_max(categoria, week_of_year) AS categoria FROM pn GROUP BY ALL")
def last_per_key(spark, sf_dir):
    return rounded(explore.last_per_key(weekly(spark, sf_dir, "categoria")), *panel.KEYS, "week_of_year", "qty", "categoria")


@query("cross_weeks", _with(_TX) + " SELECT t.pdv, t.produto, CAST(w AS INTEGER) AS semana_do_ano FROM (SELECT pdv, prod AS produto FROM cl GROUP BY ALL ORDER BY sum(q) DESC, pdv, prod LIMIT 250) t, generate_series(1, 5) s(w)")
def cross_weeks(spark, sf_dir):
    top = explore.top_totals(transactions(spark, sf_dir).withColumnRenamed("internal_product_id", "produto"), ["pdv", "produto"], 250, "quantity")
    return top.select("pdv", "produto", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("semana_do_ano"))


@query("active_keys_semi", _with(_PANEL) + " SELECT pdv, count(*) AS n FROM pn WHERE (pdv, internal_product_id) IN (SELECT (pdv, internal_product_id) FROM pn GROUP BY pdv, internal_product_id HAVING sum(qty) > 0) GROUP BY pdv")
def active_keys_semi(spark, sf_dir):
    return explore.only_active(weekly(spark, sf_dir)).groupBy("pdv").agg(F.count("*").alias("n"))


@query("history_filter", _with(_PANEL) + " SELECT pdv, internal_product_id, count(*) AS n_weeks FROM pn GROUP BY ALL HAVING count(*) >= 80")
def history_filter(spark, sf_dir):
    return explore.long_histories(weekly(spark, sf_dir), 80)


@query("numeric_ids", "SELECT regexp_replace(p_brand, 'Brand#', CASE WHEN p_size > 25 THEN '' ELSE 'x' END) AS produto, count(*) AS n FROM part WHERE p_size > 25 GROUP BY ALL")
def numeric_ids(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    df = part.select(F.when(F.col("p_size") > 25, F.regexp_replace("p_brand", "Brand#", "")).otherwise(F.regexp_replace("p_brand", "Brand#", "x")).alias("produto"))
    return panel.numeric_ids(df, "produto").groupBy("produto").agg(F.count("*").alias("n"))


@query("flags_product", _with(_TX) + " SELECT categoria, premise, CAST(categoria = 'PROMO' AS INTEGER) AS is_package_category, CAST(premise = 'NATION_3' AS INTEGER) AS is_package_liquor_pdv, CAST(categoria = 'PROMO' AND premise = 'NATION_3' AS INTEGER) AS is_package_in_package_liquor, count(*) AS n FROM cl GROUP BY ALL")
def flags_product(spark, sf_dir):
    df = transactions(spark, sf_dir).withColumn("categoria_pdv", F.col("premise"))
    df = df.groupBy("categoria", "premise", "categoria_pdv").agg(F.count("*").alias("n"))
    return categorical.package_flags(df, "PROMO", "NATION_3").drop("categoria_pdv")


# ---- calendar weeks ----------------------------------------------------------------------------------------------

_RESAMPLED = _TX + """,
wk AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, sum(q) AS total FROM cl GROUP BY 1),
rs AS (SELECT CAST(s.d AS DATE) AS week_end, coalesce(total, 0) AS total FROM (SELECT unnest(generate_series((SELECT min(week_end) FROM wk)::TIMESTAMP, (SELECT max(week_end) FROM wk)::TIMESTAMP, INTERVAL 7 DAY)) AS d) s LEFT JOIN wk ON CAST(s.d AS DATE) = wk.week_end),
pk AS (SELECT week_end AS peak, total FROM rs ORDER BY total DESC, week_end LIMIT 1)"""
_IN_PEAK = "ts BETWEEN (SELECT peak::TIMESTAMP - INTERVAL 6 DAY FROM pk) AND (SELECT peak::TIMESTAMP FROM pk)"


@query("weekly_resample", _with(_RESAMPLED) + f" SELECT CAST(week_end AS VARCHAR) AS week_end, {_r('total', 'total')} FROM rs")
def weekly_resample(spark, sf_dir):
    return rounded(panel.resample_weeks(transactions(spark, sf_dir)).withColumn("week_end", F.col("week_end").cast("string")))


@query("peak_week", _with(_RESAMPLED) + f" SELECT CAST(peak AS VARCHAR) AS peak, {_r('total', 'total')} FROM pk")
def peak_week(spark, sf_dir):
    return rounded(panel.peak_week(transactions(spark, sf_dir)).withColumn("peak", F.col("peak").cast("string")))


@query("drop_peak_week", _with(_RESAMPLED) + f" SELECT pdv, count(*) AS n, {_r('sum(q)', 'quantity')} FROM cl WHERE NOT ({_IN_PEAK}) GROUP BY pdv")
def drop_peak_week(spark, sf_dir):
    df = panel.without_peak_week(transactions(spark, sf_dir))
    return rounded(df.groupBy("pdv").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity")))


@query("peak_top_products", _with(_RESAMPLED) + f" SELECT prod AS internal_product_id, {_r('sum(q)', 'total')} FROM cl WHERE {_IN_PEAK} GROUP BY prod ORDER BY sum(q) DESC, prod LIMIT 10")
def peak_top_products(spark, sf_dir):
    return rounded(explore.top_totals(panel.in_peak_week(transactions(spark, sf_dir)), ["internal_product_id"], 10, "quantity"))


@query(
    "interpolate_linear",
    _with(
        _RESAMPLED,
        "gap AS (SELECT week_end, row_number() OVER (ORDER BY week_end) AS i, CASE WHEN week(week_end) % 5 = 0 THEN NULL ELSE nullif(total, 0) END AS v FROM rs)",
        "pq AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS pi, min(CASE WHEN v IS NOT NULL THEN i END) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qi FROM gap)",
    )
    + f" SELECT CAST(pq.week_end AS VARCHAR) AS week_end, {_r('CASE WHEN pq.v IS NOT NULL OR pq.pi IS NULL THEN pq.v WHEN pq.qi IS NULL THEN p.v ELSE p.v + (q.v - p.v) * (pq.i - pq.pi) / (pq.qi - pq.pi) END', 'total')} FROM pq LEFT JOIN gap p ON p.i = pq.pi LEFT JOIN gap q ON q.i = pq.qi",
)
def interpolate_linear(spark, sf_dir):
    totals = panel.resample_weeks(transactions(spark, sf_dir))
    gaps = totals.withColumn("total", F.when(F.weekofyear("week_end") % 5 == 0, 0.0).otherwise(F.col("total")))
    return rounded(panel.interpolated_totals(gaps).withColumn("week_end", F.col("week_end").cast("string")))


_ISO = _TX + ", iso AS (SELECT CAST(week(ts) AS INTEGER) AS semana_do_ano, pdv, prod AS produto, sum(q) AS quantity_total, min(subcategoria) AS marca FROM cl GROUP BY 1, 2, 3)"


@query(
    "notebook_rolling",
    _with(_ISO)
    + " SELECT semana_do_ano, pdv, produto, "
    + ", ".join(
        [*(_r(f"lag(quantity_total, {k}) OVER w", f"lag_{k}") for k in (1, 2, 3, 4)), *(_r(f"{f}(quantity_total) OVER (PARTITION BY pdv, produto ORDER BY semana_do_ano ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", name) for f, n, name in (("avg", 4, "media_movel_4"), ("avg", 2, "media_movel_2"), ("stddev_samp", 4, "std_movel_4")))]
    )
    + " FROM iso WINDOW w AS (PARTITION BY pdv, produto ORDER BY semana_do_ano)",
)
def notebook_rolling(spark, sf_dir):
    return rounded(features.notebook_features(panel.iso_panel(transactions(spark, sf_dir))).drop("quantity_total"))


@query("brand_week_mean", _with(_ISO) + f" SELECT semana_do_ano, pdv, produto, {_r('avg(quantity_total) OVER (PARTITION BY marca, semana_do_ano)', 'media_vendas_marca_semana')} FROM iso")
def brand_week_mean(spark, sf_dir):
    df = transactions(spark, sf_dir)
    brands = df.groupBy(F.col("internal_product_id").alias("produto")).agg(F.min("subcategoria").alias("marca"))
    df = panel.iso_panel(df).join(brands, "produto", "left")
    return rounded(explore.group_mean(df, ["marca", "semana_do_ano"], "quantity_total", "media_vendas_marca_semana"), "semana_do_ano", "pdv", "produto", "media_vendas_marca_semana")


# ---- summaries ---------------------------------------------------------------------------------------------------


@query("basic_stats", _with(_PANEL) + f" SELECT count(*) AS total_records, count(DISTINCT pdv) AS unique_pdvs, count(DISTINCT internal_product_id) AS unique_products, {_r('avg(qty)', 'mean_sales')}, {_r('median(qty)', 'median_sales')}, {_r('avg(CASE WHEN qty = 0 THEN 100.0 ELSE 0.0 END)', 'zero_percentage')}, {_r('avg(gross)', 'mean_gross_value')}, min(week_of_year) AS first_week, max(week_of_year) AS last_week FROM pn")
def basic_stats(spark, sf_dir):
    return rounded(explore.basic_stats(settle(weekly(spark, sf_dir))))


_UNIQUE = ("pdv", "internal_product_id", "categoria")


@query(
    "distinct_by_quarter",
    _with(_PANEL, "q AS (SELECT *, CAST((week_of_year - 1) // 13 AS BIGINT) AS quarter FROM pn)")
    + " "
    + " UNION ALL ".join(f"SELECT quarter, '{c}' AS name, count(DISTINCT {c}) AS n FROM q GROUP BY quarter UNION ALL SELECT CAST(-1 AS BIGINT), '{c}', count(DISTINCT {c}) FROM q" for c in _UNIQUE),
)
def distinct_by_quarter(spark, sf_dir):
    """Distinct values by quarter, and, as -1, of all time, from bitmaps by week, which are merged without the rows."""
    weeks = settle(explore.distinct_bitmaps(settle(weekly(spark, sf_dir, "categoria")), list(_UNIQUE), "week_of_year"))
    quarters = weeks.withColumn("quarter", F.floor((F.col("by") - 1) / 13).cast("long"))
    return explore.merged_distinct(quarters, "quarter").unionByName(explore.merged_distinct(quarters).select(F.lit(-1).cast("long").alias("quarter"), "name", "n"))


def _describe_sql(source: str, columns: list[str]) -> str:
    one = lambda c: f"SELECT '{c}' AS feature_name, count({c}) AS count, {_r(f'avg({c})', 'mean')}, {_r(f'stddev_samp({c})', 'std')}, {_r(f'min({c})', 'min')}, {_r(f'quantile_cont({c}, 0.25)', 'p25')}, {_r(f'quantile_cont({c}, 0.5)', 'p50')}, {_r(f'quantile_cont({c}, 0.75)', 'p75')}, {_r(f'max({c})', 'max')} FROM {source}"
    return " UNION ALL ".join(map(one, columns))


@query("describe_features", _with(_PANEL, f"bf AS (SELECT {_K}, {_BASIC} FROM pn)") + " " + _describe_sql("bf", ["week_of_year", *_BASIC_COLUMNS]))
def describe_features(spark, sf_dir):
    df = features.basic_features(weekly(spark, sf_dir), PARAMS)
    return rounded(explore.describe(rounded(df, *_KEYS, *_BASIC_COLUMNS), ["week_of_year", *_BASIC_COLUMNS]))


@query("nonzero_stats", _with(_PANEL) + f" SELECT count(*) AS n, {_r('avg(qty)', 'mean')}, {_r('stddev_samp(qty)', 'std')}, {_r('quantile_cont(qty, 0.5)', 'p50')}, {_r('quantile_cont(qty, 0.75)', 'p75')}, {_r('quantile_cont(qty, 0.95)', 'p95')}, {_r('max(qty)', 'max')} FROM pn WHERE qty > 0")
def nonzero_stats(spark, sf_dir):
    return rounded(explore.nonzero_stats(settle(weekly(spark, sf_dir))))


@query("top_stores", _with(_PANEL) + f" SELECT pdv, {_r('sum(qty)', 'total')} FROM pn GROUP BY pdv ORDER BY sum(qty) DESC, pdv LIMIT 10")
def top_stores(spark, sf_dir):
    return rounded(explore.top_totals(weekly(spark, sf_dir), ["pdv"], 10))


@query("total_by_week", _with(_PANEL) + f" SELECT week_of_year, {_r('sum(qty)', 'total')} FROM pn GROUP BY week_of_year")
def total_by_week(spark, sf_dir):
    return rounded(explore.total_by(weekly(spark, sf_dir), "week_of_year"))


@query("total_by_category", _with(_TX) + f" SELECT categoria, {_r('sum(q)', 'total')} FROM cl GROUP BY categoria")
def total_by_category(spark, sf_dir):
    return rounded(explore.total_by(transactions(spark, sf_dir), "categoria", "quantity"))


@query("by_month", _with(_TX) + f" SELECT CAST(month(ts) AS INTEGER) AS mes, {_r('sum(q)', 'total')} FROM cl GROUP BY 1")
def by_month(spark, sf_dir):
    return rounded(explore.by_month(transactions(spark, sf_dir).withColumn("mes", F.month("transaction_date"))))


@query("by_quarter", _with(_PANEL) + f" SELECT CAST((week_of_year - 1) // 13 + 1 AS BIGINT) AS trimestre, {_r('sum(qty)', 'total')} FROM pn GROUP BY 1")
def by_quarter(spark, sf_dir):
    return rounded(explore.by_quarter(weekly(spark, sf_dir)))


@query("histogram_log", _with(_PANEL, "x AS (SELECT ln(1 + qty) AS x FROM pn WHERE qty > 0)", "e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM x)") + " SELECT CAST(least(floor((x - lo) / w), 49) AS BIGINT) AS bin, count(*) AS n FROM x, e GROUP BY 1")
def histogram_log(spark, sf_dir):
    return explore.histogram(weekly(spark, sf_dir))


@query("iqr_extremes", _with(_PANEL, "t AS (SELECT quantile_cont(qty, 0.75) + 3 * (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25)) AS t FROM pn WHERE qty > 0)") + f" SELECT count(*) FILTER (WHERE qty > t) AS n_extreme, {_r('max(t)', 'threshold')} FROM pn, t WHERE qty > 0")
def iqr_extremes(spark, sf_dir):
    return rounded(explore.extreme_values(settle(weekly(spark, sf_dir))))


_CORR = ["qty", "lag_1", "lag_2", "lag_3", "lag_4"]


@query("corr_matrix", _with(_PANEL, "c AS (SELECT qty, " + ", ".join(f"{_lag(k)} AS lag_{k}" for k in (1, 2, 3, 4)) + " FROM pn)") + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_r(f'corr({a}, {b})', 'corr')} FROM c" for a in _CORR for b in _CORR))
def corr_matrix(spark, sf_dir):
    return rounded(explore.correlations(features.basic_features(weekly(spark, sf_dir), PARAMS), _CORR))


@query("zero_share", _with(_PANEL) + f" SELECT {_r('avg(CASE WHEN qty = 0 THEN 100.0 ELSE 0.0 END)', 'zero_pct')}, {_r('100 - avg(CASE WHEN qty = 0 THEN 100.0 ELSE 0.0 END)', 'nonzero_pct')} FROM pn")
def zero_share(spark, sf_dir):
    return rounded(explore.zero_share(weekly(spark, sf_dir)))


@query(
    "data_quality",
    _with(_TX, "r AS (SELECT ts, pdv, prod, q, CASE WHEN q = 1 THEN NULL ELSE categoria END AS categoria FROM cl)")
    + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE categoria IS NULL) AS n_null, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS n_duplicate, count(*) FILTER (WHERE q < 0) AS n_negative, CAST(0 AS BIGINT) AS n_bad_date FROM r",
)
def data_quality(spark, sf_dir):
    df = transactions(spark, sf_dir).select("transaction_date", "pdv", "internal_product_id", "quantity", F.when(F.col("quantity") != 1, F.col("categoria")).alias("categoria"))
    return explore.data_quality(df)


# ---- split, metrics, submissions ---------------------------------------------------------------------------------


def _part(first: bool):
    return lambda spark, sf_dir: rounded(explore.split(weekly(spark, sf_dir))[0 if first else 1], *_KEYS, "qty")


query("split_train", _with(_PANEL) + f" SELECT {_K}, {_r('qty', 'qty')} FROM pn WHERE week_of_year <= 44")(_part(True))
query("split_valid", _with(_PANEL) + f" SELECT {_K}, {_r('qty', 'qty')} FROM pn WHERE week_of_year BETWEEN 45 AND 52")(_part(False))


@query(
    "metrics_wmape",
    _with(_PANEL, f"s AS (SELECT qty AS y, coalesce({_agg('avg', 4, 4)}, 0) AS p FROM pn)")
    + f" SELECT {_r('sum(abs(y - p)) / sum(abs(y))', 'wmape')}, {_r('avg(abs(y - p))', 'mae')}, {_r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {_r('1 - avg((y - p) * (y - p)) / var_pop(y)', 'r2')} FROM s",
)
def metrics_wmape(spark, sf_dir):
    df = features.basic_features(weekly(spark, sf_dir), PARAMS)
    return rounded(explore.metrics(df.select(F.col("qty").alias("y"), F.col("rmean_4").alias("p"))))


def _naive_submission(spark, sf_dir):
    """A forecast without a model: the rounded mean of the last four weeks of a key, for five weeks."""
    df = features.basic_features(weekly(spark, sf_dir), PARAMS)
    last = explore.last_per_key(df.select(*_KEYS, "rmean_4"))
    weeks = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("semana")
    return last.select(weeks, "pdv", F.col("internal_product_id").alias("produto"), forecast.thresholded(F.col("rmean_4")).alias("quantidade"))


_NAIVE = _PANEL + f""",
nf AS (SELECT {_K}, coalesce({_agg('avg', 4, 4)}, 0) AS r FROM pn),
sub AS (SELECT CAST(w AS INTEGER) AS semana, pdv, internal_product_id AS produto, CAST(round_even(CASE WHEN r >= 0.5 THEN r ELSE 0 END, 0) AS INTEGER) AS quantidade FROM (SELECT pdv, internal_product_id, arg_max(r, week_of_year) AS r FROM nf GROUP BY ALL), generate_series(1, 5) s(w))"""


@query("submission_frame", _with(_NAIVE) + " SELECT * FROM sub")
def submission_frame(spark, sf_dir):
    return _naive_submission(spark, sf_dir)


@query("submission_check", _with(_NAIVE) + " SELECT CAST(sum(quantidade) AS BIGINT) AS total, count(*) FILTER (WHERE quantidade = 0) AS n_zero FROM sub")
def submission_check(spark, sf_dir):
    return explore.submission_check(_naive_submission(spark, sf_dir))


@query("submission_summary", _with(_NAIVE) + f" SELECT count(*) AS total_predictions, count(DISTINCT pdv) AS unique_pdvs, count(DISTINCT produto) AS unique_products, CAST(sum(quantidade) AS BIGINT) AS total_quantity, {_r('avg(quantidade)', 'avg_quantity')} FROM sub")
def submission_summary(spark, sf_dir):
    return rounded(explore.submission_summary(_naive_submission(spark, sf_dir)), "total_predictions", "unique_pdvs", "unique_products", "total_quantity", "avg_quantity")


@query("prediction_stats", _with(_NAIVE) + f" SELECT semana, CAST(sum(quantidade) AS BIGINT) AS total, {_r('avg(quantidade)', 'mean')}, {_r('stddev_samp(quantidade)', 'std')} FROM sub GROUP BY semana")
def prediction_stats(spark, sf_dir):
    return rounded(explore.prediction_stats(_naive_submission(spark, sf_dir)))


@query(
    "direct_forecast_frame",
    _with(
        _PANEL,
        "nb AS (SELECT *, avg(qty) OVER (PARTITION BY pdv, internal_product_id ORDER BY week_of_year ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS mm FROM pn)",
        "top AS (SELECT pdv, internal_product_id FROM pn GROUP BY ALL ORDER BY sum(qty) DESC, pdv, internal_product_id LIMIT 250)",
    )
    + f" SELECT top.pdv, top.internal_product_id, CAST(w AS INTEGER) AS semana_do_ano, {_r('coalesce(qty, 0)', 'lag_1_semana')}, {_r('coalesce(mm, 0)', 'media_movel_4_semanas')} FROM top CROSS JOIN generate_series(1, 5) s(w) LEFT JOIN nb ON nb.pdv = top.pdv AND nb.internal_product_id = top.internal_product_id AND week_of_year = 52",
)
def direct_forecast_frame(spark, sf_dir):
    return rounded(_direct_frame(spark, sf_dir))


def _direct_frame(spark, sf_dir):
    df = weekly(spark, sf_dir).withColumn("media_movel_4", F.avg("qty").over(features.before(4)))
    return forecast.direct_frame(df, tables.forecast_weeks(spark, 5), 250, 52)


@query("sample_deterministic", _with(_PANEL) + f" SELECT {_K}, {_r('qty', 'qty')}, {_r('gross', 'gross')} FROM pn ORDER BY md5(concat_ws('|', week_of_year, pdv, internal_product_id, 42)), {_K} LIMIT 1000")
def sample_deterministic(spark, sf_dir):
    return rounded(explore.hash_sample(weekly(spark, sf_dir), _KEYS, 1000), *_KEYS, "qty", "gross")


# ---- serving features, models and forecasts ----------------------------------------------------------------------


@query(
    "history_features",
    _with(
        _PANEL,
        "o AS (SELECT * FROM pn WHERE (pdv, internal_product_id) IN (SELECT (pdv, internal_product_id) FROM pn GROUP BY pdv, internal_product_id HAVING count(*) >= 12))",
        "nx AS (SELECT pdv, internal_product_id, week_of_year, qty FROM o UNION ALL SELECT DISTINCT pdv, internal_product_id, 100000, 0 FROM o)",
        f"ix AS (SELECT *, CAST(row_number() OVER ({_W}) AS DOUBLE) AS i FROM nx)",
        f"ft AS (SELECT {_K}, {_lag(1)} AS lag_1, {_lag(24)} AS lag_24, {_agg('avg', 4, 4)} AS rmean_4, {_agg('stddev_samp', 4, 4)} AS rstd_4, {_agg('stddev_samp', 20, 4)} AS rstd_20, {_skew(8)} AS rskew_8, {_trend(12)} AS trend_12 FROM ix)",
    )
    + f" SELECT pdv, internal_product_id, {', '.join(_r(c, c) for c in ('lag_1', 'lag_24', 'rmean_4', 'rstd_4', 'rstd_20', 'rskew_8', 'trend_12'))} FROM ft WHERE week_of_year = 100000",
)
def history_features(spark, sf_dir):
    state = forecast.histories(weekly(spark, sf_dir), 24, 12)
    df = forecast.history_features(state, F.lit(1).cast("bigint"), F.lit(357), PARAMS)
    return rounded(df, *panel.KEYS, "lag_1", "lag_24", "rmean_4", "rstd_4", "rstd_20", "rskew_8", "trend_12")


#: The rounds and depth of PARAMS; the split fits the 357 weeks of the tables.
_MODEL = replace(PARAMS, train_until=300, valid_from=301, valid_until=357)


def _model_frame(spark, sf_dir):
    df = settle(features.basic_features(weekly(spark, sf_dir), _MODEL))
    return df, ["week_of_year", *_BASIC_COLUMNS]


def _fitted(spark, sf_dir):
    df, names = _model_frame(spark, sf_dir)
    train, valid = explore.split(df, _MODEL.train_until, _MODEL.valid_from, _MODEL.valid_until)
    return df, names, train, valid, forecast.train_trees(train, names, valid=valid, params=_MODEL)


@query("gbt_train_score")
def gbt_train_score(spark, sf_dir):
    *_, valid, model = _fitted(spark, sf_dir)
    return forecast.validate(model, valid)


@query("feature_importance")
def feature_importance(spark, sf_dir):
    _, names, _, _, model = _fitted(spark, sf_dir)
    return forecast.importances(spark, model, names)


@query("recursive_forecast")
def recursive_forecast(spark, sf_dir):
    df, _, _, _, model = _fitted(spark, sf_dir)
    state = forecast.histories(df, _MODEL.history_kept, _MODEL.least_history)
    return forecast.recursive_forecast(state, model.transform, _MODEL.forecast_weeks, 357, _MODEL, advanced=False)


@query("iterative_forecast")
def iterative_forecast(spark, sf_dir):
    df = weekly(spark, sf_dir).select(F.col("week_of_year").cast("int").alias("semana_do_ano"), *panel.KEYS, "qty", F.coalesce(F.lag("qty", 1).over(features.by_key()), F.lit(0.0)).alias("lag_1_semana"), F.coalesce(F.avg("qty").over(features.before(4)), F.lit(0.0)).alias("media_movel_4_semanas"))
    model = forecast.train_trees(df, ["semana_do_ano", "lag_1_semana", "media_movel_4_semanas"], params=_MODEL)
    frame = _direct_frame(spark, sf_dir).filter("semana_do_ano = 1").drop("semana_do_ano")
    return forecast.frozen_mean_forecast(frame, model.transform, (1, 2, 3, 4, 5), {5: 3 / 7})


@query("loss_tournament")
def loss_tournament(spark, sf_dir):
    df, names = _model_frame(spark, sf_dir)
    train, valid = explore.split(df, _MODEL.train_until, _MODEL.valid_from, _MODEL.valid_until)
    return forecast.tournament(train, valid, names, params=_MODEL)


# ---- windows over the whole order --------------------------------------------------------------------------------


def _run_on(w: int) -> str:
    return f"(ORDER BY pdv, internal_product_id, week_of_year ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _run_on_need(n: int, w: int, expr: str, of: str = "pq") -> str:
    return f"CASE WHEN count({of}) OVER {_run_on(w)} >= {n} THEN {expr} OVER {_run_on(w)} END"


_PREVIOUS = _PANEL + f", pv AS (SELECT *, lag(qty) OVER ({_W}) AS pq FROM pn)"


def _run_on_skew(w: int) -> str:
    same = f"max(pq) OVER {_run_on(w)} = min(pq) OVER {_run_on(w)}"
    return f"CASE WHEN count(pq) OVER {_run_on(w)} >= 4 THEN CASE WHEN {same} THEN 0 ELSE skewness(pq) OVER {_run_on(w)} END END"


@query(
    "compat_rolling",
    _with(_PREVIOUS)
    + f" SELECT {_K}, "
    + ", ".join(_r(_run_on_need(4, w, f"{f}(pq)"), n) for n, f, w in _MOMENTS)
    + ", "
    + ", ".join(_r(f"{_run_on_need(4, w, 'max(pq)')} - {_run_on_need(4, w, 'min(pq)')}", f"rrange_{w}") for w in PARAMS.rolling_windows)
    + ", "
    + ", ".join(_r(_run_on_skew(w), f"rskew_{w}") for w in (8, 12))
    + " FROM pv",
)
def compat_rolling(spark, sf_dir):
    """Rolling columns whose windows run on from one key into the next."""
    df = features.compat_rolling(weekly(spark, sf_dir), PARAMS.rolling_windows)
    return rounded(df, *_KEYS, *(n for n, _, _ in _MOMENTS), *(f"rrange_{w}" for w in PARAMS.rolling_windows), "rskew_8", "rskew_12")


_RUN_ON_PAST = _PREVIOUS + f", lim AS (SELECT *, least(coalesce({_run_on_need(3, 12, 'quantile_cont(pq, 0.9)')}, 220), 220) AS lim, {_run_on_need(3, 12, 'quantile_cont(pq, 0.5)')} AS med FROM pv)"


@query("compat_percentile_cap", _with(_RUN_ON_PAST) + f" SELECT {_K}, {_r('CASE WHEN qty > lim THEN lim ELSE qty END', 'qty')} FROM lim")
def compat_percentile_cap(spark, sf_dir):
    return rounded(outliers.treat_percentile_cap(weekly(spark, sf_dir), 90.0, compat=True), *_KEYS, "qty")


@query("compat_median_impute", _with(_RUN_ON_PAST) + f" SELECT {_K}, {_r('CASE WHEN qty > lim THEN coalesce(med, 1) ELSE qty END', 'qty')} FROM lim")
def compat_median_impute(spark, sf_dir):
    return rounded(outliers.treat_median(weekly(spark, sf_dir), 90.0, compat=True), *_KEYS, "qty")


@query(
    "compat_price_mean",
    _with(_PRICED, f"pv AS (SELECT *, lag(p) OVER ({_W}) AS pp FROM pr)") + f" SELECT {_K}, {_r(f'coalesce(round_even(avg(pp) OVER {_run_on(4)} * 100, 0) / 100, 0)', 'unit_price_rolling_mean_4')} FROM pv",
)
def compat_price_mean(spark, sf_dir):
    return rounded(prices.compat_price_mean(prices.unit_price(weekly(spark, sf_dir))), *_KEYS, "unit_price_rolling_mean_4")


def _carried_sql(c: str) -> str:
    return f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY pdv, internal_product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY pdv, internal_product_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"


@query(
    "interpolate_week_compat",
    _with(_PANEL)
    + f""", a AS (SELECT * FROM pn WHERE week_of_year = 36), b AS (SELECT * FROM pn WHERE week_of_year = 38),
j AS (SELECT coalesce(a.pdv, b.pdv) AS pdv, coalesce(a.internal_product_id, b.internal_product_id) AS internal_product_id, (coalesce(a.qty, 0) + coalesce(b.qty, 0)) / 2 AS qty,
  (coalesce(a.gross, 0) + coalesce(b.gross, 0)) / 2 AS gross, a.categoria, a.premise, a.subcategoria, a.fabricante
  FROM a FULL JOIN b ON a.pdv = b.pdv AND a.internal_product_id = b.internal_product_id)
SELECT CAST(37 AS BIGINT) AS week_of_year, pdv, internal_product_id, {_r('qty', 'qty')}, {_r('gross', 'gross')}, {', '.join(map(_carried_sql, ('categoria', 'premise', 'subcategoria', 'fabricante')))} FROM j""",
)
def interpolate_week_compat(spark, sf_dir):
    """The missing week with attributes carried on from the key before."""
    return rounded(panel.interpolated_week(weekly(spark, sf_dir, *panel.ATTRIBUTES), 37, compat_fill=True))


@query(
    "top_fifth_of_keys",
    _with(_PANEL, "g AS (SELECT pdv, internal_product_id, sum(qty) AS total FROM pn GROUP BY pdv, internal_product_id)", "t AS (SELECT *, row_number() OVER (ORDER BY total DESC, pdv, internal_product_id) AS nth, count(*) OVER () AS n FROM g)")
    + f" SELECT pdv, internal_product_id, {_r('total', 'total')} FROM t WHERE nth <= n // 5",
)
def top_fifth_of_keys(spark, sf_dir):
    """The fifth of all keys that sells most, chosen by places in ranges of the order."""
    totals = settle(weekly(spark, sf_dir).groupBy(*panel.KEYS).agg(F.sum("qty").alias("total")))
    return rounded(ordered.first_rows(totals, [F.desc("total"), *panel.KEYS], totals.count() // 5))


# ---- leaf-wise trees ---------------------------------------------------------------------------------------------

_FEW = ("season", "pdv", "product", "lag_tens")
_FEW_SQL = f"fr AS MATERIALIZED (SELECT CAST(week_of_year % 52 AS DOUBLE) AS season, CAST(pdv AS DOUBLE) AS pdv, CAST(internal_product_id AS DOUBLE) AS product, CAST(least(floor({_lag(1)} / 10), 40) AS DOUBLE) AS lag_tens, qty AS y FROM pn)"


def _few_valued(spark, sf_dir):
    """Rows with features of at most 52 values, which are bins of their own."""
    df = weekly(spark, sf_dir).withColumn("lag", F.coalesce(F.lag("qty", 1).over(features.by_key()), F.lit(0.0)))
    return df.select(F.expr("week_of_year % 52").cast("double").alias("season"), F.col("pdv").cast("double").alias("pdv"), F.col("internal_product_id").cast("double").alias("product"), F.least(F.floor(F.col("lag") / 10), F.lit(40)).cast("double").alias("lag_tens"), F.col("qty").alias("y"))


def _trees_sql(rounds: int, leaves: int, step: float, least: int = 20) -> str:
    """Best-first trees by squared loss, split after split: p{r} has the scores after r rounds, s{r}_{k} the k-th split and
    v{r} the leaves' values of round r."""
    parts = ["p0 AS MATERIALIZED (SELECT *, avg(y) OVER () AS s FROM fr)"]
    value = "CASE f WHEN " + " WHEN ".join(f"{i} THEN {c}" for i, c in enumerate(_FEW)) + " END"
    for r in range(1, rounds + 1):
        parts.append(f"a{r}_0 AS MATERIALIZED (SELECT *, s - y AS g, 0 AS leaf FROM p{r - 1})")
        for k in range(1, leaves):
            long = " UNION ALL ".join(f"SELECT leaf, {i} AS f, {c} AS v, g FROM a{r}_{k - 1}" for i, c in enumerate(_FEW))
            parts += [
                f"h{r}_{k} AS (SELECT leaf, f, v, sum(g) AS g, count(*) AS n FROM ({long}) GROUP BY ALL)",
                f"c{r}_{k} AS (SELECT leaf, f, v, sum(g) OVER upto AS gl, sum(n) OVER upto AS nl, sum(g) OVER whole AS ga, sum(n) OVER whole AS na FROM h{r}_{k} WINDOW upto AS (PARTITION BY leaf, f ORDER BY v), whole AS (PARTITION BY leaf, f))",
                f"s{r}_{k} AS MATERIALIZED (SELECT leaf AS split_leaf, f, v, gl * gl / nl + (ga - gl) * (ga - gl) / (na - nl) - ga * ga / na AS gain, na FROM c{r}_{k} WHERE nl >= {least} AND na - nl >= {least} ORDER BY gain DESC, f, v LIMIT 1)",
                f"a{r}_{k} AS MATERIALIZED (SELECT a.* EXCLUDE (leaf), CASE WHEN leaf = split_leaf AND {value} > v THEN {k} ELSE leaf END AS leaf FROM a{r}_{k - 1} a CROSS JOIN s{r}_{k})",
            ]
        last = f"a{r}_{leaves - 1}"
        parts += [f"v{r} AS MATERIALIZED (SELECT leaf, -avg(g) * {step} AS value, count(*) AS n FROM {last} GROUP BY leaf)", f"p{r} AS MATERIALIZED (SELECT a.* EXCLUDE (g, leaf, s), s + value AS s FROM {last} a JOIN v{r} USING (leaf))"]
    return ",\n".join(parts)


def _split_rows(rounds: int, leaves: int) -> str:
    name = "CASE f WHEN " + " WHEN ".join(f"{i} THEN '{c}'" for i, c in enumerate(_FEW)) + " END"
    nothing = "CAST(NULL AS DOUBLE)"
    parts = [f"SELECT CAST({r} AS INTEGER) AS round, {name} AS feature, v AS edge, {_r('gain', 'gain')}, CAST(na AS BIGINT) AS rows, {nothing} AS value FROM s{r}_{k}" for r in range(1, rounds + 1) for k in range(1, leaves)]
    parts += [f"SELECT CAST({r} AS INTEGER), CAST(NULL AS VARCHAR), {nothing}, {nothing}, CAST(n AS BIGINT), {_r('value', 'value')} FROM v{r}" for r in range(1, rounds + 1)]
    return " UNION ALL ".join(parts)


@query("leafwise_splits", _with(_PANEL, _FEW_SQL, _trees_sql(3, 5, 0.3)) + " " + _split_rows(3, 5))
def leafwise_splits(spark, sf_dir):
    """Splits with their gains and leaves with their values of three best-first trees."""
    growth = boosting.Growth(rounds=3, step=0.3, leaves=5)
    model = boosting.fit(_few_valued(spark, sf_dir), list(_FEW), "y", objective=boosting.squared(), growth=growth)
    return rounded(model.nodes(spark).drop("node"))


@query("model_round_trip", _with(_PANEL, _FEW_SQL, _trees_sql(2, 4, 0.5)) + f" SELECT {_r('s', 'prediction')}, count(*) AS n FROM p2 GROUP BY 1")
def model_round_trip(spark, sf_dir):
    """Scores of a model that was written and read again."""
    df, path = _few_valued(spark, sf_dir), f"{_folder(spark, 'model')}/model.json"
    sinks.write_model(spark, boosting.fit(df, list(_FEW), "y", objective=boosting.squared(), growth=boosting.Growth(rounds=2, step=0.5, leaves=4)), path)
    scored = sinks.read_model(spark, path).transform(df)
    return rounded(scored.groupBy(F.round("prediction", PLACES).alias("prediction")).agg(F.count("*").alias("n")))


def _slopes_sql() -> str:
    r = "(s - y)"
    heavy = "CASE WHEN y = 0 THEN 1.5 ELSE 1 END"
    of = {"squared": (r, "1"), "absolute": (f"sign({r})", "1"), "huber": (f"greatest(-0.9, least(0.9, {r}))", "1"), "asymmetric_log_cosh": (f"tanh({r}) * {heavy}", f"(1 - tanh({r}) * tanh({r})) * {heavy}")}
    return " UNION ALL ".join(f"SELECT '{k}' AS objective, week_of_year, {_r(f'sum({g})', 'gradient')}, {_r(f'sum({h})', 'curvature')} FROM ys GROUP BY week_of_year" for k, (g, h) in of.items())


@query("objective_slopes", _with(_PANEL) + f", ys AS (SELECT week_of_year, CASE WHEN qty < 10 THEN 0 ELSE qty END / 8.0 AS y, {_lag(1)} / 8.0 AS s FROM pn) " + _slopes_sql())
def objective_slopes(spark, sf_dir):
    """Gradients and curvatures of all objectives at each row's last value, by week."""
    df = weekly(spark, sf_dir).select("week_of_year", (F.when(F.col("qty") < 10, 0).otherwise(F.col("qty")) / 8.0).alias("y"), (F.coalesce(F.lag("qty", 1).over(features.by_key()), F.lit(0.0)) / 8.0).alias("s"))
    rows = None
    for name, objective in boosting.OBJECTIVES.items():
        some = boosting.slopes(df, objective(), "y", "s").select(F.lit(name).alias("objective"), "week_of_year", "gradient", "curvature")
        rows = some if rows is None else rows.unionByName(some)
    return rounded(rows.groupBy("objective", "week_of_year").agg(F.sum("gradient").alias("gradient"), F.sum("curvature").alias("curvature")))


@query("leafwise_tournament")
def leafwise_tournament(spark, sf_dir):
    df, names = _model_frame(spark, sf_dir)
    train, valid = explore.split(df, _MODEL.train_until, _MODEL.valid_from, _MODEL.valid_until)
    return forecast.leafwise_tournament(train, valid, names)


@query("autoencoder_embedding")
def autoencoder_embedding(spark, sf_dir):
    return embedding.of_column(weekly(spark, sf_dir, "categoria"), "categoria")


@query("supervised_embedding")
def supervised_embedding(spark, sf_dir):
    return embedding.supervised(weekly(spark, sf_dir, "categoria"), "categoria")


@query("random_search")
def random_search(spark, sf_dir):
    """All draws of a search with what each one's parameters were, how long it stayed in, and its error, best first."""
    df, names = _model_frame(spark, sf_dir)
    train, _ = explore.split(df, _MODEL.train_until, _MODEL.valid_from, _MODEL.valid_until)
    found = boosting.search(train, names, seed=PARAMS.seed)
    rows = [(place, d.number, d.growth.rounds, d.growth.step, d.growth.leaves, d.growth.deepest, d.growth.ridge, d.growth.least_rows, d.rounds, d.error) for place, d in enumerate(found, 1)]
    return rounded(spark.createDataFrame(rows, "place int, draw int, most_rounds int, step double, leaves int, deepest int, ridge double, least_rows int, rounds int, mae double"))


@query("leafwise_train_score")
def leafwise_train_score(spark, sf_dir):
    df, names = _model_frame(spark, sf_dir)
    train, valid = explore.split(df, _MODEL.train_until, _MODEL.valid_from, _MODEL.valid_until)
    return forecast.validate(boosting.fit(train, names, valid=valid), valid)


# ---- further operators -------------------------------------------------------------------------------------------


@query(
    "repair_week",
    _with(_PANEL, "p36 AS (SELECT * FROM pn WHERE week_of_year = 36), p38 AS (SELECT * FROM pn WHERE week_of_year = 38)")
    + f""", al AS (SELECT week_of_year, qty, gross FROM pn UNION ALL
  SELECT 37, (coalesce(a.qty, 0) + coalesce(b.qty, 0)) / 2, (coalesce(a.gross, 0) + coalesce(b.gross, 0)) / 2 FROM p36 a FULL JOIN p38 b ON a.pdv = b.pdv AND a.internal_product_id = b.internal_product_id)
SELECT CAST(week_of_year AS BIGINT) AS week_of_year, count(*) AS n, {_r('sum(qty)', 'qty')}, {_r('sum(gross)', 'gross')} FROM al GROUP BY 1""",
)
def repair_week(spark, sf_dir):
    df = panel.repair_week(weekly(spark, sf_dir), 37)
    return rounded(df.groupBy("week_of_year").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum("gross").alias("gross")))


@query("value_counts", _with(_PANEL, _rank_sql("fabricante", "v")) + " SELECT value, n, CAST(freq_rank AS INTEGER) AS freq_rank FROM v")
def value_counts(spark, sf_dir):
    return categorical.value_counts(weekly(spark, sf_dir, "fabricante"), "fabricante")


_CONTEXT = """
cx AS (SELECT categoria AS value, avg(qty) AS mean, coalesce(stddev_samp(qty), 0) AS std, count(qty) AS count FROM pn GROUP BY categoria)"""


def _scaled(c: str) -> str:
    return _r(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)", c)


@query("scaled_context", _with(_PANEL, _CONTEXT) + f" SELECT value, {_scaled('mean')}, {_scaled('std')}, {_scaled('count')} FROM cx")
def scaled_context(spark, sf_dir):
    return rounded(categorical.scaled_context(categorical.category_context(weekly(spark, sf_dir, "categoria"), "categoria")))


@query(
    "context_lookup",
    _with(_PANEL, _CONTEXT)
    + f""" SELECT p_partkey, p_type AS categoria, {_r("coalesce(mean, 0)", "categoria_mean")}, {_r("coalesce(std, 0)", "categoria_std")}, coalesce(count, 0) AS categoria_count
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'unseen' ELSE p_type END AS p_type FROM part) LEFT JOIN cx ON value IS NOT DISTINCT FROM p_type""",
)
def context_lookup(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "unseen").otherwise(F.col("p_type")).alias("categoria"))
    return rounded(categorical.with_context(parts, categorical.category_context(weekly(spark, sf_dir, "categoria"), "categoria"), "categoria"))


@query("label_codes", "SELECT p_type AS categoria, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS categoria_code, count(*) AS n FROM part GROUP BY p_type")
def label_codes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_type").alias("categoria")).agg(F.count("*").alias("n"))
    return categorical.label_codes(df, ["categoria"]).transform(df).select("categoria", "categoria_code", "n")


@query("category_embedding")
def category_embedding(spark, sf_dir):
    df = categorical.category_embedding(weekly(spark, sf_dir, "categoria"), "categoria")
    from pyspark.ml.functions import vector_to_array

    return df.select("value", vector_to_array("embedding").alias("embedding"))


_STORES = "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'desconhecido' WHEN 3 THEN 'x' || s_suppkey ELSE CAST(s_suppkey AS {}) END"


@query("valid_stores", f"SELECT CAST(pdv AS BIGINT) AS pdv FROM (SELECT {_STORES.format('VARCHAR')} AS pdv FROM supplier) WHERE regexp_full_match(pdv, '[0-9]+')")
def valid_stores(spark, sf_dir):
    return panel.valid_stores(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr(_STORES.format("STRING")).alias("pdv")))


@query("rejected_stores", "SELECT CASE s_suppkey % 5 WHEN 0 THEN 'null' WHEN 3 THEN 'junk' ELSE 'unknown' END AS reason, count(*) AS count FROM supplier WHERE s_suppkey % 5 < 4 GROUP BY 1")
def rejected_stores(spark, sf_dir):
    return panel.rejected_stores(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr(_STORES.format("STRING")).alias("pdv")))


@query("null_counts", _with(_DIMS) + " SELECT count(*) FILTER (WHERE categoria IS NULL) AS categoria, count(*) FILTER (WHERE premise IS NULL) AS premise FROM lineitem LEFT JOIN dp ON l_partkey = produto LEFT JOIN ds ON l_suppkey = pdv")
def null_counts(spark, sf_dir):
    return explore.null_counts(explore.with_dims(*_facts_and_dims(spark, sf_dir)).select("categoria", "premise"))


@query("total_by_premise", _with(_TX) + f" SELECT premise, {_r('sum(q)', 'total')} FROM cl GROUP BY premise ORDER BY sum(q) DESC, premise LIMIT 5")
def total_by_premise(spark, sf_dir):
    return rounded(explore.top_totals(transactions(spark, sf_dir), ["premise"], 5, "quantity"))


@query("histogram_density", _with(_PANEL, "x AS (SELECT ln(1 + qty) AS x FROM pn WHERE qty > 0)", "e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w, count(*) AS n FROM x)") + f" SELECT CAST(least(floor((x - lo) / w), 49) AS BIGINT) AS bin, {_r('count(*) / (any_value(e.n) * any_value(w))', 'n')} FROM x, e GROUP BY 1")
def histogram_density(spark, sf_dir):
    return rounded(explore.histogram(weekly(spark, sf_dir), density=True))


@query("events_weekly", "SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_weekly(spark, sf_dir):
    df = stream_weekly.weekly_totals(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return df.select("event_type", F.col("week.start").cast("timestamp_ntz").alias("week_start"), "n", F.round("total", 4).alias("total"))


@query("stream_features", _with(_PANEL.replace("WHERE wk <> 37 ", "")) + f" SELECT {_K}, {_r('qty', 'qty')}, {_BASIC} FROM pn")
def stream_features(spark, sf_dir):
    """The features of all weeks from a stream of the transactions: four batches of files, in order of time, and a last row
    that closes all weeks. All weeks of the keys are there, the anomalous one too."""
    path, df = _folder(spark, "stream"), transactions(spark, sf_dir).select("transaction_date", *panel.KEYS, "quantity")
    df = settle(df)
    first, last = df.agg(F.to_date(F.min("transaction_date")), F.to_date(F.max("transaction_date"))).first()
    part = F.least(F.floor(F.datediff("transaction_date", F.lit(first)) * 4 / (F.datediff(F.lit(last), F.lit(first)) + 1)), F.lit(3))
    for k in range(4):
        df.filter(part == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    end = df.limit(1).select(F.date_add(F.lit(last), 60).cast(df.schema["transaction_date"].dataType).alias("transaction_date"), *(F.lit(-1).cast("long").alias(c) for c in panel.KEYS), F.lit(0).cast(df.schema["quantity"].dataType).alias("quantity"))
    end.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in")
    found = stream_histories.weekly_features(stream, first)
    run = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").filter("pdv >= 0"), *_KEYS, "qty", *_BASIC_COLUMNS)


@query("comprehensive_features")
def comprehensive_features(spark, sf_dir):
    df, names = pipeline.comprehensive_features(settle(weekly(spark, sf_dir, *panel.ATTRIBUTES)), PARAMS)
    return df.select(*_KEYS, "qty", *(n for n in names if n not in _KEYS))


_NUMERIC = sorted({"week_of_year", *(f"lag_{k}" for k in (*PARAMS.basic_lags, *PARAMS.extra_lags)), "nonzero_frac_8", "rmean_4", "rstd_4"} | {f"r{k}_{w}" for k in ("mean", "std", "max", "min", "range") for w in PARAMS.rolling_windows} | {f"{k}_{w}" for k in ("rskew", "rcv", "trend") for w in (4, 8, 12)} | {f"pct_change_{k}" for k in (1, 2, 4, 8)} | {"accel_4_8", "accel_8_12", "momentum_4_8", "momentum_8_12", "momentum_4_12", "month", "quarter", "week_of_month", "month_sin", "month_cos", "quarter_sin", "quarter_cos"} | {"is_start_of_month", "is_end_of_month", "is_start_of_quarter", "is_end_of_quarter", "is_holiday_season"} | {f"{c}_{k}" for c in ("subcategoria", "fabricante") for k in ("log_freq", "freq_rank")})
_DUMMY_NAMES = """dn AS (SELECT c, freq_rank, c || '_' || value AS raw, replace(replace(c || '_' || value, ' ', '_'), '-', '_') AS name
  FROM (SELECT 'categoria' AS c, * FROM ca UNION ALL SELECT 'premise', * FROM pm) WHERE freq_rank <= 10)"""


@query(
    "feature_kinds",
    _with(_PANEL, _rank_sql("categoria", "ca"), _rank_sql("premise", "pm"), _DUMMY_NAMES)
    + f""", few AS (SELECT name, row_number() OVER (ORDER BY c, freq_rank) AS place FROM dn ORDER BY place LIMIT 5),
cr AS (SELECT name || '_x_' || n AS name FROM few CROSS JOIN (VALUES (1, 'lag_1'), (2, 'lag_2'), (3, 'rmean_4'), (4, 'rmean_8')) t(i, n) ORDER BY place, i LIMIT {PARAMS.most_interactions})
SELECT unnest({_NUMERIC}) AS feature_name, 'numerical' AS feature_type UNION ALL SELECT name, 'categorical' FROM dn UNION ALL SELECT name, 'categorical' FROM cr""",
)
def feature_kinds(spark, sf_dir):
    """The names of all features of the panel, as far as they come from its values, and their kinds."""
    _, names = pipeline.comprehensive_features(settle(weekly(spark, sf_dir, *panel.ATTRIBUTES)), PARAMS)
    return sinks.feature_kinds(spark, names)


# ---- forecasts with a linear score, which SQL can say -------------------------------------------------------------


def _linear(df):
    return df.withColumn("prediction", F.col("lag_1") * 0.3717391843 + F.col("rmean_4") * 0.2913284719 + F.col("lag_2") * 0.3111729183)


@query(
    "recursive_forecast_linear",
    "WITH RECURSIVE "
    + _PANEL
    + f""", h AS (SELECT pdv, internal_product_id, list(qty ORDER BY week_of_year) AS h FROM pn GROUP BY ALL HAVING count(*) >= 12),
st AS (SELECT 0 AS w, pdv, internal_product_id, h[-24:] AS h, CAST(0 AS DOUBLE) AS p FROM h UNION ALL
  SELECT w + 1, pdv, internal_product_id, list_append(h, q), q FROM (SELECT *, greatest(h[-1] * 0.3717391843::DOUBLE + list_avg(h[-4:]) * 0.2913284719::DOUBLE + h[-2] * 0.3111729183::DOUBLE, 0) AS q FROM st WHERE w < 5))
SELECT CAST(w AS INTEGER) AS semana, pdv, internal_product_id AS produto, CAST(round_even(CASE WHEN p >= 0.5 THEN p ELSE 0 END, 0) AS INTEGER) AS quantidade, {_r('p', 'predicted')} FROM st WHERE w > 0""",
)
def recursive_forecast_linear(spark, sf_dir):
    state = forecast.histories(weekly(spark, sf_dir), _MODEL.history_kept, _MODEL.least_history)
    return rounded(forecast.recursive_forecast(state, _linear, _MODEL.forecast_weeks, 357, _MODEL, advanced=False))


@query(
    "frozen_mean_forecast_linear",
    "WITH RECURSIVE "
    + _PANEL
    + f""", nb AS (SELECT *, avg(qty) OVER (PARTITION BY pdv, internal_product_id ORDER BY week_of_year ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS mm FROM pn),
top AS (SELECT pdv, internal_product_id FROM pn GROUP BY ALL ORDER BY sum(qty) DESC, pdv, internal_product_id LIMIT 250),
st AS (SELECT 0 AS w, top.pdv, top.internal_product_id, coalesce(qty, 0) AS lag, coalesce(mm, 0) AS mm FROM top LEFT JOIN nb ON nb.pdv = top.pdv AND nb.internal_product_id = top.internal_product_id AND week_of_year = 52 UNION ALL
  SELECT w + 1, pdv, internal_product_id, greatest(lag * 0.3717391843::DOUBLE + mm * 0.4113284719::DOUBLE + (w + 1) * 0.1311729183::DOUBLE, 0), mm FROM st WHERE w < 5)
SELECT CAST(w AS INTEGER) AS semana, pdv, internal_product_id AS produto, CAST(round_even(lag * CASE WHEN w = 5 THEN 3.0::DOUBLE / 7 ELSE 1 END, 0) AS INTEGER) AS quantidade FROM st WHERE w > 0""",
)
def frozen_mean_forecast_linear(spark, sf_dir):
    frame = _direct_frame(spark, sf_dir).filter("semana_do_ano = 1").drop("semana_do_ano")
    score = lambda df: df.withColumn("prediction", F.col("lag_1_semana") * 0.3717391843 + F.col("media_movel_4_semanas") * 0.4113284719 + F.col("semana_do_ano") * 0.1311729183)
    return forecast.frozen_mean_forecast(frame, score, (1, 2, 3, 4, 5), {5: 3 / 7})


@query("zero_weight", _with(_PANEL) + f" SELECT pdv, {_r('sum(CASE WHEN qty = 0 THEN 1.5 ELSE 1 END)', 'weight')} FROM pn GROUP BY pdv")
def zero_weight(spark, sf_dir):
    return rounded(forecast.zero_weight(weekly(spark, sf_dir)).groupBy("pdv").agg(F.sum("weight").alias("weight")))


# ---- sources and sinks: what is written is what is read -----------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_TOTALS = f" SELECT pdv, count(*) AS n, {_r('sum(qty)', 'qty')} FROM pn GROUP BY pdv"


def _totals(df):
    return rounded(df.groupBy("pdv").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")))


@query("table_round_trip", _with(_TX) + f" SELECT pdv, count(*) AS n, {_r('sum(q)', 'qty')} FROM cl GROUP BY pdv")
def table_round_trip(spark, sf_dir):
    """Transactions written, and read with the declared schema, which the file need not fill."""
    path = _folder(spark, "transactions")
    df = transactions(spark, sf_dir).withColumn("pdv", F.col("pdv").cast("string"))
    df.write.parquet(path)
    back = tables.read_table(spark, path, tables.TRANSACTIONS)
    return _totals(back.withColumn("pdv", F.col("pdv").cast("bigint")).withColumnRenamed("quantity", "qty"))


@query("raw_folder_roles", "SELECT 'transactions' AS role, count(*) AS n FROM lineitem UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'stores', count(*) FROM supplier")
def raw_folder_roles(spark, sf_dir):
    """Three unnamed raw tables, told apart by their columns."""
    path, read = _folder(spark, "raw"), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    read("lineitem").select(F.col("l_partkey").alias("internal_product_id"), F.col("l_quantity").alias("quantity")).write.parquet(f"{path}/a.parquet")
    read("part").select(F.col("p_partkey").alias("produto"), F.col("p_type").alias("categoria")).write.parquet(f"{path}/b.parquet")
    read("supplier").select(F.col("s_suppkey").alias("pdv"), F.col("s_name").alias("zipcode")).write.parquet(f"{path}/c.parquet")
    found = tables.read_raw_folder(spark, f"{path}/*.parquet")
    out = [df.agg(F.count("*").alias("n")).select(F.lit(role).alias("role"), "n") for role, df in sorted(found.items())]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _submission_round_trip(kind):
    def run(spark, sf_dir):
        path = _folder(spark, "submission")
        sinks.write_submission(_naive_submission(spark, sf_dir), path, kind)
        return tables.read_submission(spark, path) if kind == "csv" else spark.read.parquet(path)

    return run


query("submission_csv", _with(_NAIVE) + " SELECT * FROM sub")(_submission_round_trip("csv"))
query("submission_parquet", _with(_NAIVE) + " SELECT * FROM sub")(_submission_round_trip("parquet"))


@query("matrix_csv", _with(_PANEL, f"bf AS (SELECT qty, {_BASIC} FROM pn)") + f" SELECT lag_1, rmean_4, count(*) AS n, {_r('sum(qty)', 'qty')} FROM bf GROUP BY ALL")
def matrix_csv(spark, sf_dir):
    """The training matrix as text: features, and the target last."""
    path = _folder(spark, "matrix")
    sinks.write_matrix(rounded(features.basic_features(weekly(spark, sf_dir), PARAMS), *_KEYS, "qty", *_BASIC_COLUMNS), _BASIC_COLUMNS, path)
    back = spark.read.option("header", True).csv(path)
    if back.columns != [*_BASIC_COLUMNS, "qty"]:
        raise ValueError(f"columns of the matrix: {back.columns}")
    back = back.select(*(F.col(c).cast("double").alias(c) for c in back.columns))
    return rounded(back.groupBy("lag_1", "rmean_4").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")))


@query("stage_cache", _with(_PANEL) + _TOTALS)
def stage_cache(spark, sf_dir):
    """The newest of three stages; two are kept, the oldest is gone, and other parameters or inputs find nothing."""
    cache = sinks.StageCache(spark, _folder(spark, "cache"), keep=2)
    for z in (1.0, 2.0, 3.0):
        cache.save(weekly(spark, sf_dir), replace(PARAMS, z_threshold=z), sf_dir)
    gone = [cache.load(replace(PARAMS, z_threshold=1.0), sf_dir), cache.load(replace(PARAMS, z_threshold=3.0), "other")]
    if gone != [None, None]:
        raise ValueError("a stage was found that should not be there")
    return _totals(cache.load(replace(PARAMS, z_threshold=3.0), sf_dir))


@query("stage_cache_cleared", "SELECT CAST(2 AS INTEGER) AS cleared, (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) AS n_rows, CAST(0 AS INTEGER) AS found")
def stage_cache_cleared(spark, sf_dir):
    """How many stages were cleared, the rows that they had, and how many are found after."""
    cache, inputs = sinks.StageCache(spark, _folder(spark, "cache")), ("nation", "orders")
    n = sum(cache.save(spark.read.parquet(f"{sf_dir}/{name}.parquet"), PARAMS, name).count() for name in inputs)
    cleared = cache.clear()
    return spark.createDataFrame([(cleared, n, sum(cache.load(PARAMS, name) is not None for name in inputs))], "cleared int, n_rows long, found int")


def _wmape_sql(p: str) -> str:
    return f"SELECT sum(abs(qty - {p})) / sum(abs(qty)) AS wmape, count(*) AS total_predictions FROM fc"


@query(
    "experiment_logs",
    _with(_PANEL, f"fc AS (SELECT qty, {_lag(1)} AS a, coalesce({_agg('avg', 4, 4)}, 0) AS b FROM pn)")
    + f", w AS ({_wmape_sql('a')} UNION ALL {_wmape_sql('b')}) SELECT CAST(row_number() OVER (ORDER BY wmape) AS INTEGER) AS place, {_r('wmape', 'wmape')}, total_predictions FROM w",
)
def experiment_logs(spark, sf_dir):
    """Logs of two forecasts of the panel, best first; one that is not there is passed over."""
    df, path = settle(features.basic_features(weekly(spark, sf_dir), PARAMS)), _folder(spark, "logs")
    for name in ("lag_1", "rmean_4"):
        score = explore.metrics(df.select(F.col("qty").alias("y"), F.col(name).alias("p"))).first()
        sinks.write_experiment(spark, f"{path}/{name}.json", PARAMS, score.wmape, df.count())
    logs = sinks.read_experiments(spark, [f"{path}/{n}.json" for n in ("lag_1", "none", "rmean_4")])
    return rounded(spark.createDataFrame([(i, x["wmape"], x["total_predictions"]) for i, x in enumerate(logs, 1)], "place int, wmape double, total_predictions long"))


@query("summary_json", _with(_NAIVE) + " SELECT count(*) AS total_predictions, CAST(sum(quantidade) AS BIGINT) AS total_quantity FROM sub")
def summary_json(spark, sf_dir):
    path = f"{_folder(spark, 'summary')}.json"
    sinks.write_summary(explore.submission_summary(_naive_submission(spark, sf_dir)), path)
    return spark.read.option("multiLine", True).json(path).select("total_predictions", "total_quantity")


# ---- names, flags and steps of the pipeline -----------------------------------------------------------------------


@query("digit_stores", f"SELECT CAST(pdv AS BIGINT) AS pdv FROM (SELECT {_STORES.format('VARCHAR')} AS pdv FROM supplier) WHERE regexp_full_match(pdv, '[0-9]+')")
def digit_stores(spark, sf_dir):
    return panel.digit_stores(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr(_STORES.format("STRING")).alias("pdv")))


@query(
    "safe_names",
    _with(_PANEL, _rank_sql("categoria", "ca"), _rank_sql("premise", "pm"), _DUMMY_NAMES)
    + ", t AS (SELECT raw || ' (%)' AS name FROM dn) SELECT name, trim(regexp_replace(regexp_replace(replace(name, '%', 'pct'), '[^0-9A-Za-z_]', '_', 'g'), '_+', '_', 'g'), '_') AS safe FROM t",
)
def safe_names(spark, sf_dir):
    """Names of columns, of the ten most frequent values of two attributes, made safe; these stay distinct."""
    found = categorical.all_counts(weekly(spark, sf_dir, "categoria", "premise"), ["categoria", "premise"]).filter(F.col("freq_rank") <= PARAMS.top_values)
    names = sorted(f"{r.name}_{r.value} (%)" for r in found.collect())  # twenty at most
    return spark.createDataFrame(list(zip(names, scalar.safe_names(names))), "name string, safe string")


@query("stable_bucket", "SELECT s_name AS name, CAST(('0x' || substr(md5(s_name), 1, 8)) AS BIGINT) % 1000000 AS bucket FROM supplier")
def stable_bucket(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name"), scalar.stable_bucket(F.col("s_name")).alias("bucket"))


@query("with_features", _with(_PANEL) + f" SELECT pdv, {_r('sum(qty)', 'qty')}, {_r('0', 'missing_a')}, {_r('0', 'missing_b')} FROM pn GROUP BY pdv")
def with_features(spark, sf_dir):
    """A frame for a model that wants features which the frame lacks."""
    df = explore.with_features(weekly(spark, sf_dir), ["qty", "missing_a", "missing_b"])
    return rounded(df.groupBy("pdv").agg(*(F.sum(c).alias(c) for c in ("qty", "missing_a", "missing_b"))))


@query("treat_by_method", _with(_PAST.replace("220", f"'{PARAMS.absolute_cap}'::DOUBLE")) + f" SELECT {_K}, {_r('CASE WHEN qty > lim THEN coalesce(med, 1) ELSE qty END', 'qty')} FROM lim")
def treat_by_method(spark, sf_dir):
    """The treatment that the parameters name."""
    return rounded(outliers.treat(weekly(spark, sf_dir), replace(PARAMS, outlier_method="median_imputation", percentile_cap=90.0)), *_KEYS, "qty")


@query(
    "build_panel",
    _with(_PANEL, "p36 AS (SELECT * FROM pn WHERE week_of_year = 36), p38 AS (SELECT * FROM pn WHERE week_of_year = 38)")
    + f""", al AS (SELECT week_of_year, qty FROM pn UNION ALL SELECT 37, (coalesce(a.qty, 0) + coalesce(b.qty, 0)) / 2 FROM p36 a FULL JOIN p38 b ON a.pdv = b.pdv AND a.internal_product_id = b.internal_product_id)
SELECT CAST(week_of_year AS BIGINT) AS week_of_year, count(*) AS n, {_r('sum(qty)', 'qty')} FROM al WHERE week_of_year <> 53 GROUP BY 1""",
)
def build_panel(spark, sf_dir):
    df = pipeline.build_panel(transactions(spark, sf_dir), PARAMS)
    return rounded(df.groupBy("week_of_year").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_basic(spark, sf_dir)
