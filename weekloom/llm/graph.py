"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import MOST_HOT, forest, settle

#: Edges around one node from which on they are dealt over tasks, or a MOST_HOT-th of all edges, if that is more.
HOT_EDGES = 65_536


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch of edges by a spanning forest of it: no more edges than nodes, same components."""
    for batch in batches:
        found = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        edges = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])


def _toward_minima(edges: DataFrame, limit: int, keep) -> DataFrame:
    """Attach every neighbour of a node u to the smallest node around it. The edges of a node that has more than limit of
    them are dealt over as many tasks as that, and its minimum is repeated for each. As limit is no less than a
    MOST_HOT-th of the edges, such nodes are few, and their table may be broadcast."""
    around = edges.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / F.lit(limit)).alias("parts"))
    hot = F.broadcast(around.filter("parts > 1").select("u", "parts"))
    salted = edges.join(hot, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    least = around.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    return keep(salted.join(least, ["u", "salt"]))


def components(edges: DataFrame, most_rounds: int = 60, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Nodes without an edge to another node are absent. Each round is one large-star and one small-star step over the
    distributed table, written to the checkpoint folder; it ends when a round changes nothing. Self-loops, repeated
    edges and an empty table are fine; rows with a null end are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v"))
    e = settle(e.mapInArrow(_forests, "u long, v long").distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = state(e)
    for _ in range(most_rounds):
        limit = max(hot_edges, 2 * now[0] // MOST_HOT)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minima(both, limit, lambda j: j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = _toward_minima(large, limit, lambda j: j.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter(F.col("u") > F.col("v"))).distinct()
        e, before = settle(small), now
        now = state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
