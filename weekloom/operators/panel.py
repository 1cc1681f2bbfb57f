"""From transactions to the weekly panel: cleaning, aggregation, and the repair of a missing week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.scalar import date_parts, relative_week, week_end
from weekloom.operators.ordered import carried
from weekloom.params import Params

KEYS = ["pdv", "internal_product_id"]
#: What the panel takes over from the transactions where it is there.
ATTRIBUTES = ["categoria", "premise", "subcategoria", "tipos", "label", "fabricante"]


def valid_stores(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows with a known store, its id a number; junk ids go."""
    known = F.col("pdv").isNotNull() & ~F.col("pdv").cast("string").isin("", params.unknown_store)
    return df.filter(known).withColumn("pdv", F.col("pdv").cast("string").try_cast("bigint")).filter(F.col("pdv").isNotNull())


def rejected_stores(df: DataFrame, params: Params = Params()) -> DataFrame:
    """How many rows valid_stores leaves out, by reason."""
    text = F.col("pdv").cast("string")
    reason = F.when(text.isNull(), "null").when(text.isin("", params.unknown_store), "unknown").when(text.try_cast("bigint").isNull(), "junk")
    return df.groupBy(reason.alias("reason")).count().filter(F.col("reason").isNotNull())


def digit_stores(df: DataFrame) -> DataFrame:
    return df.filter(F.col("pdv").cast("string").rlike("^[0-9]+$")).withColumn("pdv", F.col("pdv").cast("bigint"))


def numeric_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns read as numbers."""
    for c in columns:
        df = df.filter(F.col(c).cast("string").try_cast("double").isNotNull())
    return df


def clean(transactions: DataFrame, params: Params = Params()) -> DataFrame:
    """Valid rows with week_of_year, counted from the first date there is; null quantity is 0, the anomalous week goes."""
    df = transactions.drop("semana_do_ano").withColumn("quantity", F.coalesce(F.col("quantity"), F.lit(0.0)))
    df = valid_stores(df, params)
    first = df.agg(F.min("transaction_date").alias("_first"))  # one row
    df = df.crossJoin(F.broadcast(first)).withColumn("week_of_year", relative_week(F.col("transaction_date"), F.col("_first"))).drop("_first")
    if params.anomalous_week is not None:
        df = df.filter(F.col("week_of_year").isNull() | (F.col("week_of_year") != params.anomalous_week))
    return df


def first_value(column: str, order: str | None) -> Column:
    """The first value that isn't null in the given order; without one the least, which is the same in any order."""
    if order is None:
        return F.min(column)
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def weekly_panel(cleaned: DataFrame, order: str | None = None, attributes: list[str] | tuple = tuple(ATTRIBUTES)) -> DataFrame:
    """One row for each week, store and product: qty (never under 0), gross, first attributes. Null keys go."""
    df = cleaned.dropna(subset=["week_of_year", *KEYS])
    attributes = [c for c in attributes if c in df.columns]
    if order is None and attributes:
        # the least of strings needs sorted rows; sums by keys and attributes don't, and leave few rows to sort
        df = df.groupBy("week_of_year", *KEYS, *attributes).agg(F.sum("quantity").alias("quantity"), F.sum("gross_value").alias("gross_value"))
    sums = [F.greatest(F.coalesce(F.sum("quantity"), F.lit(0.0)), F.lit(0.0)).alias("qty"), F.coalesce(F.sum("gross_value"), F.lit(0.0)).alias("gross")]
    return df.groupBy("week_of_year", *KEYS).agg(*sums, *(first_value(c, order).alias(c) for c in attributes))


def iso_panel(df: DataFrame) -> DataFrame:
    """Totals by ISO week of the year, store and product."""
    return df.groupBy(date_parts(F.col("transaction_date"))["semana_do_ano"].alias("semana_do_ano"), "pdv", F.col("internal_product_id").alias("produto")).agg(F.sum("quantity").alias("quantity_total"))


def interpolated_week(panel: DataFrame, week: int, compat_fill: bool = False) -> DataFrame:
    """The rows of a missing week: means of the weeks before and after, a missing side counting 0.

    Attributes come from the week before, else the one after. compat_fill takes them from the nearest earlier key, then
    later key, instead; the keys are dealt into ranges, and each hands its last values on.
    """
    attributes = [c for c in panel.columns if c in ATTRIBUTES]
    side = lambda w, s: panel.filter(F.col("week_of_year") == w).select(*KEYS, *(F.col(c).alias(c + s) for c in ("qty", "gross", *attributes)))
    both = side(week - 1, "_prev").join(side(week + 1, "_next"), KEYS, "full")
    mean = lambda c: ((F.coalesce(c + "_prev", F.lit(0.0)) + F.coalesce(c + "_next", F.lit(0.0))) / 2).alias(c)
    if compat_fill:
        both = carried(both, KEYS, [c + "_prev" for c in attributes]) if attributes else both
        fill = lambda c: F.col(c + "_prev").alias(c)
    else:
        fill = lambda c: F.coalesce(c + "_prev", c + "_next").alias(c)
    return both.select(F.lit(week).cast("bigint").alias("week_of_year"), *KEYS, mean("qty"), mean("gross"), *map(fill, attributes))


def repair_week(panel: DataFrame, week: int, compat_fill: bool = False) -> DataFrame:
    """panel with the week interpolated if it is missing and both its neighbours are there."""
    there = {r.week_of_year for r in panel.filter(F.col("week_of_year").between(week - 1, week + 1)).select("week_of_year").distinct().collect()}
    if there != {week - 1, week + 1}:
        return panel
    return panel.unionByName(interpolated_week(panel, week, compat_fill))


def densify(panel: DataFrame) -> DataFrame:
    """A row for every week between a key's first and last, qty and gross 0 where there was none."""
    span = panel.groupBy(*KEYS).agg(F.min("week_of_year").alias("a"), F.max("week_of_year").alias("b"))
    weeks = span.select(*KEYS, F.explode(F.sequence("a", "b")).alias("week_of_year"))
    return weeks.join(panel, [*KEYS, "week_of_year"], "left").fillna(0.0, ["qty", "gross"])


def resample_weeks(df: DataFrame, value: str = "quantity", ts: str = "transaction_date") -> DataFrame:
    """(week_end, total) for every calendar week between the first and the last, 0 where there is nothing."""
    sums = df.filter(F.col(ts).isNotNull()).groupBy(week_end(F.col(ts)).alias("week_end")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    spine = sums.agg(F.min("week_end").alias("a"), F.max("week_end").alias("b")).filter(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week_end"))
    return spine.join(sums, "week_end", "left").select("week_end", F.coalesce("total", F.lit(0.0)).alias("total"))


def peak_week(df: DataFrame) -> DataFrame:
    """One row: the week_end of the largest total, the first one if several tie."""
    return resample_weeks(df).agg(F.max_by("week_end", F.struct("total", -F.unix_date("week_end"))).alias("peak"), F.max("total").alias("total"))


def _with_peak(df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(peak_week(df).select("peak")))  # one row


def in_peak_week(df: DataFrame, ts: str = "transaction_date") -> DataFrame:
    """Rows from six days before the peak date to its first instant."""
    peak = F.col("peak").cast("timestamp")
    return _with_peak(df).filter(F.col(ts).between(peak - F.expr("interval 6 days"), peak)).drop("peak")


def without_peak_week(df: DataFrame, ts: str = "transaction_date") -> DataFrame:
    peak = F.col("peak").cast("timestamp")
    return _with_peak(df).filter(~F.col(ts).between(peak - F.expr("interval 6 days"), peak)).drop("peak")


def interpolated_totals(totals: DataFrame) -> DataFrame:
    """Totals by week with zeros replaced on the line between their neighbours; after the last value it holds.

    The table has one row a week, so one order over all of it is small.
    """
    order = Window.orderBy("week_end")
    at = totals.withColumn("i", F.row_number().over(order)).withColumn("v", F.nullif("total", F.lit(0.0)))
    point = F.when(F.col("v").isNotNull(), F.struct("i", "v"))
    at = at.withColumn("p", F.last(point, True).over(order)).withColumn("q", F.first(point, True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("i") - F.col("p.i")) / (F.col("q.i") - F.col("p.i"))
    value = F.when(F.col("v").isNotNull() | F.col("p").isNull(), F.col("v")).when(F.col("q").isNull(), F.col("p.v")).otherwise(line)
    return at.select("week_end", value.alias("total"))
