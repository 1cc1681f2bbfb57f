"""SimHash near-duplicates by multi-index hashing.

Fingerprints: one pass over the texts, XXH64 of word shingles, bit majorities in numpy. Search: the 64 bits are two
segments of 32. Of two fingerprints that differ in at most 3 bits, one segment differs in at most 1 bit, so a table of
segment values, probed with the ball of radius 1 around each segment, meets every such pair; whole distances are then
verified. Only distinct fingerprints are searched, so exact copies cost nothing. A segment value that very many
fingerprints have, or that very many have in reach, is dealt out as tiles of bounded size (common.tiled) whose task emits
a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.llm.common import forest, raw, settle, slices, spread_join, tiled
from weekloom.llm.graph import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Fingerprints or probes of one segment value from which on its pairs are dealt out as tiles.
HEAVY = 256
TILE = 1024
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: words are runs of other than ASCII white space, A-Z lower-cased; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    starts, stops = ends[:-1], [x - 1 for x in ends[min(width, len(words)) :]]
    xx = xxhash.xxh64_intdigest
    total, counts = len(stops), np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        h = np.array([xx(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fps = np.array([fingerprint(x) for x in raw(batch.column(1))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def _close(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def _tile_links(bits: int):
    def links(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, fp = table.column("node").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: list[tuple[int, int]] = []
        for at in range(0, len(a), 256):
            part = a[at : at + 256]
            i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[b][None, :]) <= bits)
            found = forest([*found, *zip(node[part[i]].tolist(), node[b[j]].tolist())])
        edges = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": edges[:, 0], "v": edges[:, 1]})

    return links


def _ball(key: Column) -> Column:
    """The values one bit apart from key that have the bit: each pair of neighbours is met from the one that lacks it."""
    other = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: key.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return F.filter(other, lambda v: v != key)


def _crowded(table: DataFrame) -> DataFrame:
    """(seg, key): the segment values that more than HEAVY rows of the table have, or that very many rows probe.

    A value has up to 33 values in reach. Those that few rows have bring it no more than HEAVY probes in all; the rows of
    the others are added up for each value that they reach. So every value left out has at most 2 * HEAVY probes.
    """
    counts = settle(table.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY // 33))
    probes = counts.select("seg", F.explode(F.concat(F.array("key"), _ball(F.col("key")))).alias("key"), "n").groupBy("seg", "key").agg(F.sum("n").alias("n"))
    return settle(probes.filter(F.col("n") > HEAVY).select("seg", "key"))


def links(fingerprints: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """Edges (u, v) between the nodes of (node, fp) rows, of distinct fp, that connect all with <= bits (at most 3) bits between."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of radius 1 find at most 3 differing bits")
    table = fingerprints.select("node", "fp", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), k.alias("key")) for s, k in ((0, _low(F.col("fp"))), (1, F.shiftrightunsigned("fp", 32)))))).alias("x")).select("x.seg", "x.key", "node", "fp")
    probes = table.select("seg", F.explode(F.concat(F.array("key"), _ball(F.col("key")))).alias("key"), F.col("node").alias("a"), F.col("fp").alias("fa"))
    heavy = _crowded(table)
    none = heavy.isEmpty()
    rest, asked = (table, probes) if none else (x.join(heavy, ["seg", "key"], "left_anti") for x in (table, probes))
    own = F.when(F.col("seg") == 0, _low(F.col("fa"))).otherwise(F.shiftrightunsigned("fa", 32)) == F.col("key")
    light = asked.join(rest, ["seg", "key"]).filter(_close("fa", "fp", bits) & (~own | (F.col("a") < F.col("node")))).select(F.col("a").alias("u"), F.col("node").alias("v"))
    if none:
        return light
    left = probes.select("seg", "key", F.col("a").alias("node"), F.col("fa").alias("fp")).join(heavy, ["seg", "key"], "left_semi")
    tiles = tiled(left, table.join(heavy, ["seg", "key"], "left_semi").select(*left.columns), ["seg", "key"], "node", TILE)
    return light.unionByName(tiles.groupBy("seg", "key", "ti", "tj").applyInArrow(_tile_links(bits), "u long, v long"))


def simhash_components(docs: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of docs (doc_id, text).

    component_id: the smallest doc_id reachable over links of <= bits differing bits, itself included. Null text counts
    as empty; empty texts have fingerprint 0 and link like any other. Repeated rows stay. A row without doc_id takes the
    component of the rows with its fingerprint, null if none of them has an id. Other columns of docs are ignored.
    """
    ids = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"))
    nodes = settle(ids.groupBy("fp").agg(F.min("doc_id").alias("node")).filter(F.col("node").isNotNull()))
    found = components(links(nodes, bits))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return spread_join(ids, classes, ["fp"], "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """docs with one row for each component: that of its smallest doc_id; of rows repeating that id, the one of least text hash and text.

    Rows without doc_id stay only if their component has no doc_id, one for each such fingerprint. Columns may have any
    names: rows travel as one struct.
    """
    found = settle(simhash_components(docs, bits))
    chosen = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).filter("kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    least = F.min_by("row", F.struct(F.xxhash64("row.text"), F.col("row.text"))).alias("row")
    once = rows.join(chosen.filter("n = 1").select("doc_id"), "doc_id", "left_semi").select("row.*")
    again = rows.join(chosen.filter("n > 1").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(least).select("row.*")
    kept = once.unionByName(again)
    alone = found.filter(F.col("doc_id").isNull() & F.col("component_id").isNull()).select("fp").distinct()
    if alone.isEmpty():
        return kept
    bare = rows.filter(F.col("doc_id").isNull()).select("row", "row.text")
    schema = T.StructType([bare.schema["row"], T.StructField("fp", T.LongType())])
    bare = bare.mapInArrow(_with_fingerprint, schema).join(alone, "fp", "left_semi")
    return kept.unionByName(bare.groupBy("fp").agg(least).select("row.*"))


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fps = np.array([fingerprint(x) for x in raw(batch.column(1))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["row", "fp"])


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
