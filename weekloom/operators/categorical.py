"""Features of attributes: dummies of frequent values, frequencies and their ranks, interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.scalar import dummy_name
from weekloom.operators.explore import percentiles
from weekloom.operators.lookup import MOST_BROADCAST, looked_up
from weekloom.operators.panel import KEYS
from weekloom.params import Params
from weekloom.sources.stages import settle

INTERACTING = ("lag_1", "lag_2", "rmean_4", "rmean_8", "trend_4", "momentum_4_8")


def all_counts(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n, freq_rank) of the non-null values of all columns, in one aggregation of the panel; most frequent
    first, ties by first appearance in order of key and week. Ranks of a column meet in one task, a row a value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    long = panel.select(F.struct(*KEYS, "week_of_year").alias("at"), F.explode(pairs).alias("v")).select("at", "v.*").filter(F.col("value").isNotNull())
    counts = long.groupBy("name", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "first", "value"))
    return counts.withColumn("freq_rank", rank).select("name", "value", "n", "freq_rank")


def value_counts(panel: DataFrame, column: str) -> DataFrame:
    """(value, n, freq_rank) of one column."""
    return all_counts(panel, [column]).drop("name")


def dummies(panel: DataFrame, column: str, values: list) -> dict[str, Column]:
    return {dummy_name(column, v): F.coalesce((F.col(column) == F.lit(v)).cast("tinyint"), F.lit(0).cast("tinyint")) for v in values}


def one_hot(panel: DataFrame, params: Params = Params()) -> tuple[DataFrame, list[str]]:
    """panel with 0/1 columns for the frequent values of the dummy attributes it has, and their names. The panel is read
    once for the values, of which at most top_values a column come to the driver, for names of columns."""
    columns = [c for c in params.dummy_columns if c in panel.columns]
    if not columns:
        return panel, []
    top = all_counts(panel, columns).filter(F.col("freq_rank") <= params.top_values).orderBy("freq_rank").collect()
    new: dict[str, Column] = {}
    for c in columns:
        new |= dummies(panel, c, [r.value for r in top if r.name == c])
    return panel.select("*", *(v.alias(k) for k, v in new.items())), list(new)


def frequencies(panel: DataFrame, params: Params = Params()) -> tuple[DataFrame, list[str]]:
    """panel with log frequency and frequency rank of the attributes it has; null values get 0 and the rank after the last.
    The panel is read once for all counts."""
    columns = [c for c in params.frequency_columns if c in panel.columns]
    if not columns:
        return panel, []
    counts = settle(all_counts(panel, columns))
    last = {r.name: r.n for r in counts.groupBy("name").agg(F.count("*").alias("n")).collect()}  # a row a column
    names: list[str] = []
    for c in columns:
        found = counts.filter(F.col("name") == c).select(F.col("value").alias("_value"), "n", F.log1p("n").alias("_log"), F.col("freq_rank").cast("bigint").alias("_rank"))
        panel = looked_up(panel, c, found, last.get(c, 0), "n")
        new = {f"{c}_log_freq": F.coalesce("_log", F.lit(0.0)), f"{c}_freq_rank": F.coalesce("_rank", F.lit(last.get(c, 0) + 1).cast("bigint"))}
        panel = panel.withColumns(new).drop("_log", "_rank")
        names += list(new)
    return panel, names


def interactions(featured: DataFrame, dummy_names: list[str], most: int = 15) -> tuple[DataFrame, list[str]]:
    """featured with products of the first 5 dummies and the first 4 of the main numbers there are."""
    numbers = [c for c in INTERACTING if c in featured.columns][:4]
    pairs = [(d, n) for d in dummy_names[:5] for n in numbers][:most]
    return featured.select("*", *((F.col(d) * F.col(n)).alias(f"{d}_x_{n}") for d, n in pairs)), [f"{d}_x_{n}" for d, n in pairs]


def package_flags(df: DataFrame, category: str = "Package", store_category: str = "Package/Liquor") -> DataFrame:
    a, b = (F.col("categoria") == category).cast("int"), (F.col("categoria_pdv") == store_category).cast("int")
    return df.withColumns({"is_package_category": a, "is_package_liquor_pdv": b, "is_package_in_package_liquor": a * b})


def category_context(panel: DataFrame, column: str, target: str = "qty", wide: bool = False) -> DataFrame:
    """Mean, deviation and count of the target by value of an attribute, nulls 0; wide adds the quartiles."""
    t = F.col(target)
    context = panel.groupBy(F.col(column).alias("value")).agg(F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.count(t).alias("count"))
    if wide:
        quartiles = percentiles(panel.select(F.col(column).alias("name"), t.alias("x")), {"median": 0.5, "q1": 0.25, "q3": 0.75})
        quartiles = quartiles.withColumnRenamed("name", "_value")
        context = context.join(quartiles, F.col("value").eqNullSafe(F.col("_value")), "left").drop("_value")
    return context.fillna(0)


def scaled_context(context: DataFrame) -> DataFrame:
    """Statistics of values, each less its mean over the values and in units of its population deviation; 0 where all agree."""
    names = [c for c in context.columns if c != "value"]
    whole = context.agg(*(f(c).alias(f"_{k}_{c}") for c in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))))  # one row
    scaled = (F.coalesce(F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_std_{c}")), F.lit(0.0)).alias(c) for c in names)
    return context.crossJoin(F.broadcast(whole)).select("value", *scaled)


def with_context(df: DataFrame, context: DataFrame, column: str) -> DataFrame:
    """df with the statistics of each row's value as {column}_{statistic}; 0 for values that the context has not seen.
    Nulls are a value if the context has it."""
    names = {c: f"{column}_{c}" for c in context.columns if c != "value"}
    context = settle(context)
    found = context.withColumnsRenamed(names | {"value": "_value"})
    few = context.count() <= MOST_BROADCAST
    joined = df.join(F.broadcast(found) if few else found, F.col(column).eqNullSafe(F.col("_value")), "left")
    return joined.select(*df.columns, *(F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)).alias(c) for c in names.values()))


def category_embedding(panel: DataFrame, column: str, size: int = 3) -> DataFrame:
    """(value, embedding): principal components of the standardised context of each value of an attribute. A lone value is its
    own mean: zeros. So is every value where all have the same statistics."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import array_to_vector

    context = settle(category_context(panel, column, wide=True))  # a row a value, read several times
    numbers = [c for c in context.columns if c != "value"]
    size = min(size, len(numbers))
    if context.limit(2).count() < 2:  # PCA wants two rows
        return context.select("value", array_to_vector(F.array(*[F.lit(0.0)] * size)).alias("embedding"))
    stages = [VectorAssembler(inputCols=numbers, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=size, inputCol="scaled", outputCol="embedding")]
    return Pipeline(stages=stages).fit(context).transform(context).select("value", "embedding")


def label_codes(df: DataFrame, columns: list[str]):
    """A fitted model that adds a code column for each column; values not seen in fitting share the code after the last."""
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCols=columns, outputCols=[f"{c}_code" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc").fit(df)
