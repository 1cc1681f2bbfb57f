"""Joins of a large table with what is known of an attribute's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values up to which their table is broadcast; rows of one value from which on they are dealt over tasks, and most such
#: values, by which the number of rows grows; tasks that rows without a value are dealt over.
MOST_BROADCAST, HOT_ROWS, MOST_HOT, NULL_PARTS = 100_000, 100_000, 10_000, 64


def looked_up(df: DataFrame, column: str, values: DataFrame, n: int, rows: str) -> DataFrame:
    """df with the columns of values but _value and rows: those of the value (as text) in each row's column, null where there
    is none.

    values: one row for each _value, n of them, which is counted, and how many rows of df have it. Few values are broadcast,
    and df stays where it is. Of more, the rows of a frequent value are dealt over tasks, and so are rows without one.
    """
    key = F.col(column).cast("string")
    if n <= MOST_BROADCAST:
        return df.join(F.broadcast(values.drop(rows)), key == F.col("_value"), "left").drop("_value")
    total = values.agg(F.sum(rows)).first()[0] or 0
    limit = max(HOT_ROWS, total // MOST_HOT)
    parts = F.ceil(F.col(rows) / F.lit(limit))
    hot = values.filter(F.col(rows) > limit).select(F.col("_value").alias("_hot"), parts.alias("_parts"))  # at most MOST_HOT
    at = df.join(F.broadcast(hot), key == F.col("_hot"), "left")
    among = F.when(key.isNull(), NULL_PARTS).otherwise(F.coalesce("_parts", F.lit(1)))
    at = at.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), among)).drop("_hot", "_parts")
    copies = values.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.when(F.col(rows) > limit, parts), F.lit(1).cast("long")) - 1))).drop(rows)
    return at.join(copies, (key == F.col("_value")) & (F.col("_salt") == F.col("_copy")), "left").drop("_value", "_salt", "_copy")
