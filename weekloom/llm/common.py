"""Helpers shared by the corpus operators: lineage cuts, Arrow batches and pair tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.sources.stages import checkpoint_dir, settle

__all__ = ["SLICE", "checkpoint_dir", "forest", "head", "numbered", "ranked", "raw", "repeated", "settle", "slices", "spread_join", "strings", "tiled"]

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 512


#: Rows of one key from which on a join deals them over tasks, and most such keys, by which the former grows.
HOT_ROWS, MOST_HOT = 2048, 10_000
#: Keys of pairs up to which their counts, a few numbers each, are broadcast.
MOST_TILED = 100_000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text without decoding it; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each key; how is inner or left. many is settled, as it is read twice.

    The rows of a key that more than HOT_ROWS rows have (or, of a very large table, a MOST_HOT-th of them) are dealt over
    as many tasks as that, and the key's row of one is repeated for each: no task gets a hot key whole. There can be no
    more than MOST_HOT such keys, so that their table may be broadcast.
    """
    limit = max(HOT_ROWS, many.count() // MOST_HOT)
    hot = settle(many.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).alias("_parts")))
    if hot.isEmpty():
        return many.join(one, keys, how)
    hot, parts = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    left = many.withColumn("_nth", F.monotonically_increasing_id()).join(hot, keys, "left").withColumn("_salt", F.pmod("_nth", parts)).drop("_nth", "_parts")
    right = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def head(column: str) -> Column:
    """A text's first characters, to cut ranges by: of those, the driver gets a sample."""
    return F.substring(column, 1, 32)


def ranked(df: DataFrame, order: list[str], name: str, cut: list | None = None) -> DataFrame:
    """df with its place in the order, from 1 on, of rows that differ in it. Ranges of the order are numbered each by itself,
    and then moved on by what is before them: one row a range meets in one task, not the table. Ranges are cut by the order's
    columns, or by cut: some of the first ones, the last of which may be a text's head."""
    parts = settle(df.repartitionByRange(*(cut or order)).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, nth).join(F.broadcast(moved), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, cut: list | None = None) -> DataFrame:
    """df with each row's place, from 0 on, among the rows of its keys, which are not null. No task gets a key's rows whole:
    ranges of all rows are numbered (ranked; cut as there, after the keys), and a key's first place is taken away."""
    at = settle(ranked(df, [*keys, *order], "_rank", cut and [*keys, *cut]))
    starts = at.groupBy(*keys).agg(F.min("_rank").alias("_start"))
    return spread_join(at, starts, keys).withColumn(name, F.col("_rank") - F.col("_start")).drop("_rank", "_start")


def repeated(df: DataFrame, times: str, at_once: int = 10_000) -> DataFrame:
    """Each row as often as its number of times says, which goes; none of no times. No array is longer than at_once."""
    lots = df.filter(F.col(times) > 0).withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / F.lit(at_once)))))
    some = F.least(F.lit(at_once).cast("long"), F.col(times) - F.col("_lot") * at_once)
    return lots.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), some))).drop("_lot", "_one", times)


def tiled(left: DataFrame, right: DataFrame, keys: list[str], ident: str, block: int) -> DataFrame:
    """Deal the pairs left x right of equal keys into tiles (keys, ti, tj) of about block rows a side.

    left and right have the same columns, keys among them. A key with many rows becomes many tiles, so no task
    holds more than one tile's rows; each row is repeated once for each block of the other side.
    """
    n = left.groupBy(*keys).agg(F.count("*").alias("nl")).join(right.groupBy(*keys).agg(F.count("*").alias("nr")), keys)
    n = n.select(*keys, *(F.ceil(F.col(c) / F.lit(block)).cast("int").alias(b) for c, b in (("nl", "bl"), ("nr", "br"))))
    n = settle(n)
    few = n.count() <= MOST_TILED
    columns = [c for c in left.columns if c not in keys]

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str, side: int) -> DataFrame:
        chunk = F.pmod(F.xxhash64(ident), F.col(own)).cast("int").alias(mine)
        counted = df.join(F.broadcast(n), keys) if few else spread_join(settle(df), n, keys)
        return counted.select(*keys, *columns, F.lit(side).alias("side"), chunk, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs)).select(*keys, *columns, "side", "ti", "tj")

    return dealt(left, "bl", "br", "ti", "tj", 0).unionByName(dealt(right, "br", "bl", "tj", "ti", 1))


def forest(pairs) -> list[tuple[int, int]]:
    """(node, smaller node) edges that connect what pairs connects, one for each node but the smallest of a component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]
