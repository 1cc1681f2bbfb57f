"""What needs one order over a whole table, without one task that has it all.

Rows are dealt into ranges of the order, once, and written to the checkpoint folder. A row's place in the table is its place
in its range plus what the ranges before hold. Windows over the order work range by range: each range is lent the last rows
of those before it (a halo), and values that go on and on are handed over as one row a range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.sources.stages import settle


@dataclass
class Ordered:
    """rows with _range, _nth (place in the table, from 0) and _back (from the range's end, from 0); ranges has a row for each
    range that isn't empty: _range, _before (rows before it) and _rows."""

    rows: DataFrame
    ranges: DataFrame
    columns: list[str]


def ordered(df: DataFrame, *order, parts: int | None = None) -> Ordered:
    """df in ranges of the order, as many as shuffle partitions. Rows that tie in all of it have some order, which stays."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = settle(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    at = at.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    sizes = at.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = settle(sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), "_rows"))
    rows = at.join(F.broadcast(ranges), "_range").withColumns({"_nth": F.col("_before") + F.col("_at"), "_back": F.col("_rows") - F.col("_at") - 1})
    return Ordered(rows.select(*df.columns, "_range", "_nth", "_back"), ranges, df.columns)


def with_halo(o: Ordered, rows: int) -> DataFrame:
    """o's rows, marked _own, and for each range so many rows that stand before it, not _own, in whatever ranges these are."""
    tails = o.rows.filter(F.col("_back") < rows).withColumn("_before", F.explode(F.sequence(F.col("_nth") + 1, F.col("_nth") + rows)))
    starts = o.ranges.select("_before", F.col("_range").alias("_to"))
    lent = tails.join(F.broadcast(starts), "_before").filter(F.col("_to") != F.col("_range"))
    lent = lent.select(*o.columns, F.col("_to").alias("_range"), "_nth", F.lit(False).alias("_own"))
    return o.rows.select(*o.columns, "_range", "_nth", F.lit(True).alias("_own")).unionByName(lent)


def last_rows(n: int):
    """The window of a row and the n - 1 before it, of the table's order, over rows that with_halo lends at least so many."""
    return Window.partitionBy("_range").orderBy("_nth").rowsBetween(-(n - 1), 0)


def rolled(df: DataFrame, order: list[str], most: int, new: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with new columns, expressions over windows last_rows(n) of n up to most rows of the whole order."""
    rows = with_halo(ordered(df, *order, parts=parts), most - 1)
    return rows.select("*", *(c.alias(k) for k, c in new.items())).filter("_own").select(*df.columns, *new)


def carried(df: DataFrame, order: list[str], columns: list[str], parts: int | None = None) -> DataFrame:
    """df with each column's nulls replaced by the last value before them in the order, or where there is none by the first
    one after."""
    o = ordered(df, *order, parts=parts)
    value = lambda c: F.when(F.col(c).isNotNull(), F.col(c))
    when = lambda c: F.when(F.col(c).isNotNull(), F.col("_nth"))
    ends = o.rows.groupBy("_range").agg(*(f(value(c), when(c)).alias(f"{side}_{c}") for c in columns for side, f in (("_l", F.max_by), ("_f", F.min_by))))
    up, down = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    # one row a range
    handed = ends.select("_range", *(F.last(f"_l_{c}", True).over(up).alias(f"_l_{c}") for c in columns), *(F.first(f"_f_{c}", True).over(down).alias(f"_f_{c}") for c in columns))
    own = Window.partitionBy("_range").orderBy("_nth")
    ahead = own.rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, True).over(own), F.col(f"_l_{c}"), F.first(c, True).over(ahead), F.col(f"_f_{c}")) for c in columns}
    at = o.rows.join(F.broadcast(handed), "_range")
    return at.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def first_rows(df: DataFrame, order: list, k: int, parts: int | None = None) -> DataFrame:
    """The first k rows of the order, for a k of any size: no task merges them."""
    o = ordered(df, *order, parts=parts)
    return o.rows.filter(F.col("_nth") < k).select(*df.columns)
