"""Summaries: totals, distributions, quality, and the data behind charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.lookup import MOST_BROADCAST
from weekloom.operators.ordered import ordered
from weekloom.operators.panel import KEYS
from weekloom.sources.stages import settle


def total_by(df: DataFrame, key, value: str = "qty", name: str = "total") -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(name))


def top_totals(df: DataFrame, keys: list[str], k: int, value: str = "qty") -> DataFrame:
    """The k largest totals; ties by key."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), *keys).limit(k)


def by_quarter(panel: DataFrame) -> DataFrame:
    quarter = (F.floor((F.col("week_of_year") - 1) / F.lit(13)) + 1).cast("bigint")
    return panel.groupBy(quarter.alias("trimestre")).agg(F.sum("qty").alias("total"))


def by_month(transactions: DataFrame, month: str = "mes") -> DataFrame:
    return transactions.groupBy(month).agg(F.sum("quantity").alias("total"))


def active_keys(panel: DataFrame) -> DataFrame:
    """Keys with something sold."""
    return panel.groupBy(*KEYS).agg(F.sum("qty").alias("total")).filter(F.col("total") > 0)


def only_active(panel: DataFrame) -> DataFrame:
    return panel.join(active_keys(panel).select(*KEYS), KEYS, "left_semi")


def long_histories(panel: DataFrame, least: int = 12) -> DataFrame:
    return panel.groupBy(*KEYS).agg(F.count("*").alias("n_weeks")).filter(F.col("n_weeks") >= least)


def percentiles(values: DataFrame, ps: dict[str, float]) -> DataFrame:
    """(name, and a column for each of ps): exact percentiles, between neighbours by straight line, of (name, x) rows.

    Equal values are counted first. The distinct ones are ranged by name and value over all tasks, each range sums up its
    counts, and the few range totals move the sums on: no task holds the values of a name. Nulls don't count.
    """
    counts = values.filter(F.col("x").isNotNull()).groupBy("name", F.col("x").cast("double").alias("x")).agg(F.count("*").alias("n"))
    parts = settle(counts.repartitionByRange("name", "x").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("name").orderBy("part")
    sums = parts.groupBy("name", "part").agg(F.sum("n").alias("m"))
    moved = sums.select(F.col("name").alias("_name"), F.col("part").alias("_part"), (F.sum("m").over(own) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("name")).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("name", "part").orderBy("x")) + F.col("before")
    at = parts.join(moved, F.col("name").eqNullSafe(F.col("_name")) & (F.col("part") == F.col("_part"))).withColumn("upto", upto)

    def value(rank):
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("x")))

    place = {k: F.lit(float(q)) * (F.col("total") - 1) for k, q in ps.items()}
    ends = [c.alias(f"{k}_{side}") for k, r in place.items() for side, c in (("low", value(F.floor(r))), ("high", value(F.ceil(r))))]
    found = at.groupBy("name", "total").agg(*ends)
    line = {k: F.when(F.floor(r) == F.ceil(r), F.col(f"{k}_low")).otherwise((F.ceil(r) - r) * F.col(f"{k}_low") + (r - F.floor(r)) * F.col(f"{k}_high")) for k, r in place.items()}
    return found.select("name", *(c.alias(k) for k, c in line.items()))


#: Buckets that an interval is parted into when percentiles are looked for.
BUCKETS = 4096


def column_percentiles(df: DataFrame, ends: dict[str, tuple[int, float, float]], ps: dict[str, float]) -> DataFrame:
    """(name, and a column for each of ps): exact percentiles, between neighbours by straight line, of df's columns.

    ends has the number of values, the least and the greatest of each column. A pass counts the values of all columns in
    buckets of the intervals that are still looked into, in one aggregation that sends a bounded number of rows a task; the
    bucket that has a wanted place is the next interval, from its least value to its greatest, until these are the same. df is
    read once a pass, nearly always two or three times; nulls don't count.
    """
    spark = df.sparkSession
    wanted = {c: {k: q * (n - 1) for k, q in ps.items()} for c, (n, _, _) in ends.items() if n}
    found: dict[tuple[str, int], float] = {}
    # places looked for, with the interval that has each and how many values are below it
    left = {(c, place): (float(ends[c][1]), float(ends[c][2]), 0) for c, ranks in wanted.items() for r in ranks.values() for place in (math.floor(r), math.ceil(r))}
    columns = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in wanted]
    while left:
        found |= {k: lo for k, (lo, hi, _) in left.items() if lo == hi}
        left = {k: v for k, v in left.items() if v[0] < v[1]}
        if not left:
            break
        parts = spark.createDataFrame(sorted({(c, *v) for (c, _), v in left.items()}), "_name string, lo double, hi double, below long")
        places = spark.createDataFrame([(c, place, *v[:2]) for (c, place), v in left.items()], "_name string, place long, _lo double, _hi double")
        long = df.select(F.explode(F.array(*columns)).alias("v")).select("v.*").filter(F.col("x").isNotNull())
        inside = long.join(F.broadcast(parts), (F.col("name") == F.col("_name")) & F.col("x").between(F.col("lo"), F.col("hi")))
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counts = inside.groupBy("name", "lo", "hi", "below", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("name", "lo", "hi").orderBy("bucket"))  # BUCKETS rows at most
        at = counts.withColumn("upto", upto)
        has = (F.col("name") == F.col("_name")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))
        next_ones = at.join(F.broadcast(places), has).select("name", "place", "least", "most", (F.col("upto") - F.col("n")).alias("below")).collect()  # a row a place
        left = {(r.name, r.place): (r.least, r.most, r.below) for r in next_ones}

    def line(c: str, r: float) -> float:
        low, high = found[c, math.floor(r)], found[c, math.ceil(r)]
        return low if math.floor(r) == math.ceil(r) else (math.ceil(r) - r) * low + (r - math.floor(r)) * high

    rows = [(c, *(line(c, r) for r in ranks.values())) for c, ranks in wanted.items()]
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"{k} double" for k in ps))


def _of_one(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.lit(column).alias("name"), F.col(column).alias("x"))


def basic_stats(panel: DataFrame) -> DataFrame:
    q = F.col("qty")
    one = panel.agg(
        F.count("*").alias("total_records"), F.count_distinct("pdv").alias("unique_pdvs"), F.count_distinct("internal_product_id").alias("unique_products"), F.avg(q).alias("mean_sales"),
        (F.avg((q == 0).cast("double")) * 100).alias("zero_percentage"), F.avg("gross").alias("mean_gross_value"), F.min("week_of_year").alias("first_week"), F.max("week_of_year").alias("last_week"),
    )
    median = percentiles(_of_one(panel, "qty"), {"median_sales": 0.5}).drop("name")
    return one.join(F.broadcast(median), how="left")  # one row each


def distinct_bitmaps(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, name, bucket, bits): for each value of by, which values of each column it has, one bit a value, so that counts of
    distinct values of any part of the table come from these rows alone (merged_distinct).

    A column's values are numbered densely first, by their place in order, so that bitmaps are no longer than there are values.
    Nulls don't count.
    """
    out = None
    for c in columns:
        values = ordered(df.select(F.col(c).alias("_key")).filter(F.col("_key").isNotNull()).distinct(), "_key")
        n = values.rows.count()
        dense = values.rows.select("_key", F.col("_nth").alias("_id"))
        seen = df.select(F.col(by).alias("by"), F.col(c).alias("_key")).groupBy("by", "_key").agg(F.lit(1).alias("_one"))  # each pair once
        at = seen.join(F.broadcast(dense) if n <= MOST_BROADCAST else dense, "_key")
        bits = at.groupBy("by", F.lit(c).alias("name"), F.bitmap_bucket_number("_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))
        out = bits if out is None else out.unionByName(bits)
    return out


def merged_distinct(bitmaps: DataFrame, *by: str) -> DataFrame:
    """(by, name, n): how many distinct values the bitmaps have together, for each of by, or of all rows."""
    merged = bitmaps.groupBy(*by, "name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by, "name").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_name, count, mean, std, min, p25, p50, p75, max) of each column, percentiles exact."""
    one = lambda c: F.struct(F.lit(c).alias("feature_name"), F.count(c).alias("count"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"))
    df = settle(df.select(*columns))  # read several times
    rows = settle(df.agg(F.array(*map(one, columns)).alias("rows")).select(F.explode("rows").alias("r")).select("r.*"))
    ends = {r["feature_name"]: (r["count"], r["min"], r["max"]) for r in rows.collect()}  # a row a column
    quartiles = column_percentiles(df, ends, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumnRenamed("name", "feature_name")
    return rows.join(F.broadcast(quartiles), "feature_name", "left").select("feature_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def nonzero_stats(panel: DataFrame) -> DataFrame:
    q = F.col("qty")
    sold = panel.filter(q > 0)
    one = sold.agg(F.count("*").alias("n"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("std"), F.max(q).alias("max"))
    return one.join(F.broadcast(percentiles(_of_one(sold, "qty"), {"p50": 0.5, "p75": 0.75, "p95": 0.95}).drop("name")), how="left")  # one row each


def extreme_values(panel: DataFrame, times: float = 3.0) -> DataFrame:
    """One row: how many values above zero exceed the third quartile by times the quartiles' distance, and that limit."""
    sold = panel.filter(F.col("qty") > 0).select("qty")
    q1, q3 = F.col("q1"), F.col("q3")
    limit = percentiles(_of_one(sold, "qty"), {"q1": 0.25, "q3": 0.75}).select((q3 + (q3 - q1) * times).alias("threshold"))  # one row
    return sold.crossJoin(F.broadcast(limit)).agg(F.count_if(F.col("qty") > F.col("threshold")).alias("n_extreme"), F.max("threshold").alias("threshold"))


def histogram(panel: DataFrame, bins: int = 50, density: bool = False) -> DataFrame:
    """(bin, n): values above zero as log1p, in equal bins from the least to the greatest, the last one closed. With
    density, n is divided by the total and the bins' width."""
    logs = panel.filter(F.col("qty") > 0).select(F.log1p("qty").alias("x"))
    ends = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))  # one row
    cut = logs.crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1)).cast("bigint")
    out = cut.groupBy(F.coalesce(at, F.lit(0).cast("bigint")).alias("bin"), (F.col("total") * width).alias("area")).agg(F.count("*").alias("n"))
    return out.select("bin", F.try_divide(F.col("n"), F.col("area")).alias("n")) if density else out.select("bin", "n")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, in one aggregation."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(1.0) if a == b else F.corr(a, b)).alias("corr")) for a in columns for b in columns]
    return df.agg(F.array(*pairs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def zero_share(panel: DataFrame) -> DataFrame:
    zero = F.avg((F.col("qty") == 0).cast("double")) * 100
    return panel.agg(zero.alias("zero_pct"), (F.lit(100.0) - zero).alias("nonzero_pct"))


def data_quality(df: DataFrame, quantity: str = "quantity", ts: str = "transaction_date") -> DataFrame:
    """One row: nulls, repeated rows, negative quantities, and dates that don't parse."""
    nulls = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns), F.lit(0))
    counts = df.agg(nulls.cast("bigint").alias("n_null"), F.count_if(F.col(quantity) < 0).alias("n_negative"), F.count_if(F.col(ts).isNotNull() & F.try_to_timestamp(F.col(ts).cast("string")).isNull()).alias("n_bad_date"), F.count("*").alias("n_rows"))
    distinct = df.groupBy(*df.columns).count().agg(F.count("*").alias("n_distinct"))
    return counts.crossJoin(F.broadcast(distinct)).select("n_rows", "n_null", (F.col("n_rows") - F.coalesce("n_distinct", F.lit(0))).alias("n_duplicate"), "n_negative", "n_bad_date")  # one row each


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))


def metrics(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: wmape, mae, rmse, r2 of predictions; wmape is 0 where y sums to 0."""
    e = F.col(y) - F.col(p)
    wmape = F.coalesce(F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(y))), F.lit(0.0))
    mse = F.avg(e * e)
    return scored.agg(wmape.alias("wmape"), F.avg(F.abs(e)).alias("mae"), F.sqrt(mse).alias("rmse"), (F.lit(1.0) - F.try_divide(mse, F.var_pop(y))).alias("r2"))


def prediction_stats(predictions: DataFrame) -> DataFrame:
    q = F.col("quantidade")
    return predictions.groupBy("semana").agg(F.sum(q).alias("total"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("std"))


def submission_summary(submission: DataFrame, k: int = 10) -> DataFrame:
    """One row with totals, a map of totals by week, and one of the k stores of most volume."""
    q = F.col("quantidade")
    one = submission.agg(F.count("*").alias("total_predictions"), F.count_distinct("pdv").alias("unique_pdvs"), F.count_distinct("produto").alias("unique_products"), F.sum(q).alias("total_quantity"), F.avg(q).alias("avg_quantity"), F.sort_array(F.collect_set("semana")).alias("weeks"))
    pairs = lambda df, key: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "total")))).alias(f"by_{key}"))
    weeks = pairs(submission.groupBy("semana").agg(F.sum(q).alias("total")), "semana")
    stores = pairs(submission.groupBy("pdv").agg(F.sum(q).alias("total")).orderBy(F.desc("total"), "pdv").limit(k), "pdv")
    return one.crossJoin(F.broadcast(weeks)).crossJoin(F.broadcast(stores))  # one row each


def submission_check(submission: DataFrame) -> DataFrame:
    return submission.agg(F.sum("quantidade").alias("total"), F.count_if(F.col("quantidade") == 0).alias("n_zero"))


def fill_nulls(df: DataFrame, number: float = 0, text: str = "desconhecido") -> DataFrame:
    """Nulls of numbers and of strings replaced, by type."""
    return df.fillna(number).fillna(text)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    win = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(win)).filter(F.col("_n") == 1).drop("_n")


def last_per_key(panel: DataFrame, keys: list[str] = KEYS, order: str = "week_of_year") -> DataFrame:
    return panel.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in panel.columns if c not in keys)), order).alias("r")).select(*keys, "r.*")


def group_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys)))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, the same on every run: those of smallest hash."""
    return df.orderBy(F.md5(F.concat_ws("|", *keys, F.lit(seed)).cast("binary")), *keys).limit(n)


def with_dims(facts: DataFrame, products: DataFrame, stores: DataFrame, product: str = "internal_product_id", store: str = "internal_store_id") -> DataFrame:
    """facts with the columns of their product and store, which may be missing."""
    df = facts.join(products, facts[product] == products["produto"], "left")
    return df.join(stores, df[store] == stores["pdv"], "left")


def split(panel: DataFrame, train_until: int = 44, valid_from: int = 45, valid_until: int = 52) -> tuple[DataFrame, DataFrame]:
    w = F.col("week_of_year")
    return panel.filter(w <= train_until), panel.filter(w.between(valid_from, valid_until))


def with_features(df: DataFrame, names: list[str]) -> DataFrame:
    """df with all the named feature columns: those it lacks are 0."""
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})


def plan_size(df: DataFrame) -> int:
    """Bytes that the optimiser expects of df, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
