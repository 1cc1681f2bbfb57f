"""Nearest neighbours by a block matrix join.

Each vector is coded once, in two layers of int8: components in units of the largest, and what that leaves in units of
its own largest. Codes travel, with scales, norms and the norms of what each layer leaves. Queries are dealt into blocks
and candidates into strips; a task holds one block of queries and streams a strip past it in tiles. In a tile, one matrix
product of first layers gives all approximate inner products, each with a bound on its error made of those norms. A
candidate whose upper bound is below the k-th best lower bound met cannot be among the k nearest; those left get the
narrower bounds of both layers and face the same test again.

What survives in all strips is a little more than k pairs a query. Only these fetch the original vectors; their inner
products are computed in double precision and merged by a heap for each query. No candidate is lost: the result is exact.
Exact copies can't be told apart by bounds, but only the k + 1 smallest ids of a vector can be among k nearest; the
others take no part in the join. Near copies can't either: a query with a crowd of them is given up by the bounds, and
meets all candidates once more with original vectors, of which a task keeps the k best by score and id.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.llm.common import settle, spread_join
from weekloom.llm.vectors import clean, matrix

NEAREST = 20
EVERY = 20
#: Queries in a block, candidates in a tile, candidates in a strip at least, and most strips.
BLOCK, TILE, STRIP, MOST_STRIPS = 8192, 2048, 8192, 64
#: Tasks that few queries are dealt over at most, by more strips.
MOST_TASKS = 4096
#: Surviving pairs that a task holds before it tests them again, and those of one query in a strip from which on its bounds
#: are taken to tell nothing: such a query is scored anew with original vectors.
MOST_PAIRS, CROWD = 1 << 20, 4096
_CODES = ("scale1", "scale2", "norm", "rest1", "rest2")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, and the remainders x - scale * int8."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, x - q * scale[:, None]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, vec_id, code, numbers) of (dim, vec_id, vec): two layers of int8, and what _CODES names, as float64."""
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = pa.array(np.flatnonzero(dims == dim))
            x = matrix(batch.column(2).take(rows))
            q1, s1, r1 = quantised(x)
            q2, s2, r2 = quantised(r1)
            numbers = np.stack([s1, s2, *(np.linalg.norm(v, axis=1) for v in (x, r1, r2))], axis=1)
            code = np.concatenate([q1, q2], axis=1)
            columns = [pa.array([row.tobytes() for row in v], pa.binary()) for v in (code, numbers)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names=["dim", "vec_id", "code", "numbers"])


class Coded:
    """Codes of some vectors of one length, read back."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.ids = batch.column("vec_id").to_numpy()
        code, numbers = batch.column("code").to_pylist(), batch.column("numbers").to_pylist()
        self.q = np.frombuffer(b"".join(code), np.int8).reshape(len(code), 2, -1)
        self.numbers = np.frombuffer(b"".join(numbers), np.float64).reshape(len(numbers), len(_CODES))

    @classmethod
    def together(cls, some: list[Coded]) -> Coded:
        own = cls.__new__(cls)
        own.ids, own.q, own.numbers = (np.concatenate([getattr(x, n) for x in some]) for n in ("ids", "q", "numbers"))
        return own

    def unpack(self) -> Coded:
        """First layers as floats whose sums of products are exact, and both layers added up."""
        self.scale, scale2, self.norm, self.rest1, self.rest2 = self.numbers.T
        self.first = self.q[:, 0].astype(np.float32 if self.q.shape[2] * 127 * 127 < 1 << 24 else np.float64)
        self.both = self.q[:, 0] * self.scale[:, None] + self.q[:, 1] * scale2[:, None]
        return self


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up from the first component on: equal vectors get equal scores."""
    return np.add.accumulate(x * y, axis=1)[:, -1]


class Block:
    """A block of queries, the k best lower bounds of each, and the pairs that may be among its nearest."""

    def __init__(self, queries: Coded, k: int, most: int, crowd: int) -> None:
        self.x, self.k, self.most, self.crowd = queries.unpack(), k, most, crowd
        self.crowded = np.zeros(len(queries.ids), bool)
        self.best = np.full((len(queries.ids), k), -np.inf)
        self.least = np.full(len(queries.ids), -np.inf)
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, tile: Coded) -> None:
        x, y = self.x, tile.unpack()
        right = np.ascontiguousarray(y.first.T)
        for at in range(0, len(x.ids), 128):
            p = slice(at, at + 128)
            near = (x.first[p] @ right).astype(np.float64) * x.scale[p, None] * y.scale
            slack = (x.norm[p, None] + x.rest1[p, None]) * y.rest1 + x.rest1[p, None] * y.norm + 1e-12 * x.norm[p, None] * y.norm
            own = x.ids[p, None] == y.ids[None, :]
            kth = self.least[p]
            if near.shape[1] > self.k:
                kth = np.maximum(kth, np.partition(np.where(own, -np.inf, near - slack), -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((near + slack >= kth[:, None]) & ~own)
            for cut in range(0, len(i), 1 << 16):
                self._narrow(at + i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)], y)

    def _narrow(self, i: np.ndarray, j: np.ndarray, y: Coded) -> None:
        """Bounds of both layers for pairs of query i and candidate j, sorted by query."""
        x = self.x
        near = np.einsum("ij,ij->i", x.both[i], y.both[j])
        slack = (x.norm[i] + x.rest2[i]) * y.rest2[j] + x.rest2[i] * y.norm[j] + 1e-12 * x.norm[i] * y.norm[j]
        low, high = near - slack, near + slack
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for q, a, b in zip(i[first].tolist(), first.tolist(), [*first[1:].tolist(), len(i)]):
            lows = np.concatenate([self.best[q], low[a:b]])
            self.best[q] = np.partition(lows, -self.k)[-self.k :]
            self.least[q] = self.best[q].min()
        keep = high >= self.least[i]
        self.pairs.append((i[keep], y.ids[j[keep]], low[keep], high[keep]))
        self.held += int(keep.sum())
        if self.held > self.most:
            self._settle()
            while self.held > self.most // 2:  # no bound tells candidates of so many queries apart: those of most pairs go
                self._give_up(np.bincount(self.pairs[0][0], minlength=len(x.ids)).argmax())

    def _settle(self) -> None:
        """Test all pairs again; queries of too many are given up."""
        self.pairs = [self.survivors()]
        self._give_up(np.bincount(self.pairs[0][0], minlength=len(self.x.ids)) > self.crowd)

    def _give_up(self, queries) -> None:
        self.crowded[queries] = True
        self.least[self.crowded] = self.best[self.crowded] = np.inf  # nothing of theirs survives from now on
        self.pairs = [self.survivors()]
        self.held = len(self.pairs[0][0])

    def survivors(self) -> tuple[np.ndarray, ...]:
        i, ids, low, high = (np.concatenate(c) for c in zip(*self.pairs)) if self.pairs else (np.zeros(0, t) for t in (np.int64, np.int64, float, float))
        keep = high >= self.least[i]
        return i[keep], ids[keep], low[keep], high[keep]

    def batch(self) -> pa.RecordBatch:
        """The pairs, and a row without vec_id for each query that was given up."""
        self._settle()
        i, ids, low, high = self.pairs[0]
        given = self.x.ids[self.crowded]
        none = np.full(len(given), np.inf)
        return _pairs(np.concatenate([self.x.ids[i], given]), pa.array([*ids.tolist(), *[None] * len(given)], pa.int64()), np.concatenate([low, none]), np.concatenate([high, none]))


class Originals:
    """Vectors of one length themselves."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.ids, self.vec = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))

    @classmethod
    def together(cls, some: list[Originals]) -> Originals:
        own = cls.__new__(cls)
        own.ids, own.vec = (np.concatenate([getattr(x, n) for x in some]) for n in ("ids", "vec"))
        return own


class ExactBlock:
    """A block of queries with the k best candidates of each, by exact score and then by id: nothing else is held."""

    def __init__(self, queries: Originals, k: int) -> None:
        self.x, self.k = queries, k
        self.norm = np.linalg.norm(queries.vec, axis=1)
        self.score, self.who = np.full((len(queries.ids), k), -np.inf), np.full((len(queries.ids), k), np.iinfo(np.int64).max)

    def add(self, tile: Originals) -> None:
        right, norm = np.ascontiguousarray(tile.vec.T), np.linalg.norm(tile.vec, axis=1)
        rounding = 4e-16 * (len(right) + 8)
        for at in range(0, len(self.x.ids), 64):
            p = slice(at, at + 64)
            near, slack = self.x.vec[p] @ right, rounding * self.norm[p, None] * norm
            own = self.x.ids[p, None] == tile.ids[None, :]
            kth = self.score[p, -1]
            if near.shape[1] > self.k:
                kth = np.maximum(kth, np.partition(np.where(own, -np.inf, near - slack), -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((near + slack >= kth[:, None]) & ~own)
            for cut in range(0, len(i), 8192):
                self._merge(at + i[cut : cut + 8192], j[cut : cut + 8192], tile)

    def _merge(self, i: np.ndarray, j: np.ndarray, tile: Originals) -> None:
        score, ids = exact(self.x.vec[i], tile.vec[j]), tile.ids[j]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for q, a, b in zip(i[first].tolist(), first.tolist(), [*first[1:].tolist(), len(i)]):
            scores, who = np.concatenate([self.score[q], score[a:b]]), np.concatenate([self.who[q], ids[a:b]])
            best = np.lexsort((who, -scores))[: self.k]
            self.score[q], self.who[q] = scores[best], who[best]

    def batch(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.x.ids[i]), pa.array(self.who[i, j]), pa.array(self.score[i, j])], names=["query_id", "vec_id", "score"])


def _pairs(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "low", "high"])


def _strips(tile: int, kind: type, block_of: Callable):
    """Rows come sorted by (dim, ti, tj, side): first a block's queries, then the candidates of a strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, block, waiting = None, [], None, []

        def flush(least: int) -> None:
            nonlocal block, queries, waiting
            if block is None and queries:
                block, queries = block_of(kind.together(queries)), []
            if waiting and sum(len(w.ids) for w in waiting) >= least:
                if block is not None:
                    block.add(kind.together(waiting))
                waiting = []

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "ti", "tj", "side")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                now, side = tuple(keys[a, :3].tolist()), keys[a, 3]
                if now != key:
                    flush(1)
                    if block is not None:
                        yield block.batch()
                    key, block, queries, waiting = now, None, [], []
                for at in range(a, b, tile):
                    data = kind(batch.slice(at, min(tile, b - at)))
                    if side == 0:
                        queries.append(data)
                    else:
                        waiting.append(data)
                        flush(tile)
        flush(1)
        if block is not None:
            yield block.batch()

    return run


def _over_all_strips(k: int):
    """Rows come sorted by query and falling lower bound: the k-th of them is what others' upper bounds must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, met, least = None, 0, -np.inf
        for batch in batches:
            ids, low, high = (batch.column(c).to_numpy() for c in ("query_id", "low", "high"))
            keep = np.zeros(len(ids), bool)
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if ids[a] != query:
                    query, met, least = ids[a], 0, -np.inf
                if met < k <= met + b - a:
                    least = low[a + k - met - 1]
                met += b - a
                keep[a:b] = high[a:b] >= least
            yield batch.filter(pa.array(keep)).select(["query_id", "vec_id"])

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            score = np.concatenate([_scores(batch.slice(at, 8192)) for at in range(0, batch.num_rows, 8192)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])


def _scores(batch: pa.RecordBatch) -> np.ndarray:
    out, dims = np.empty(batch.num_rows), np.array([len(x) for x in batch.column(2).to_pylist()])
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        out[rows] = exact(*(matrix(batch.column(c).take(pa.array(rows))) for c in (2, 3)))
    return out


def _merge(k: int):
    """Rows come sorted by query; a heap of the k best is all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("query_id", "rank", "vec_id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.float64())

        def ranked(query: int, heap: list) -> list[tuple]:
            return [(query, r, -v, s) for r, (s, v) in enumerate(sorted(heap, reverse=True), 1)]

        query, heap, held = None, [], set()
        for batch in batches:
            out = []
            for q, v, s in zip(*(c.to_pylist() for c in batch.columns)):
                if q != query:
                    if query is not None:
                        out += ranked(query, heap)
                    query, heap, held = q, [], set()
                if v in held:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                    held.add(v)
                elif (s, -v) > heap[0]:
                    held.discard(-heapq.heapreplace(heap, (s, -v))[1])
                    held.add(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds)], names=names)
        if query is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ranked(query, heap)), kinds)], names=names)

    return run


def _of_crowds(rows: DataFrame, keys: list[str], most: int, handle) -> DataFrame:
    """rows, those of keys that more than most rows have being handled. Only keys and counts are shuffled for the others."""
    crowds = settle(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*keys))
    if crowds.isEmpty():
        return rows
    return settle(rows.join(crowds, keys, "left_anti").unionByName(handle(rows.join(crowds, keys, "left_semi"))))


def _one_each(vectors: DataFrame) -> DataFrame:
    """(dim, vec_id, vec, hash), one row a vec_id."""
    rows = settle(vectors.select("dim", "vec_id", "vec", F.xxhash64("vec").alias("hash")))
    least = F.min(F.struct("dim", "vec", "hash")).alias("v")
    return _of_crowds(rows, ["vec_id"], 1, lambda some: some.groupBy("vec_id").agg(least).select("v.dim", "vec_id", "v.vec", "v.hash"))


def _without_needless_copies(rows: DataFrame, k: int) -> DataFrame:
    """rows, of each vector only those of the k + 1 smallest ids."""
    nth = F.row_number().over(Window.partitionBy("dim", "vec").orderBy("vec_id"))
    return _of_crowds(rows, ["hash"], k + 1, lambda some: some.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth"))


def _dealt(x: DataFrame, y: DataFrame, blocks: int, strips: int, columns: list[str]) -> DataFrame:
    """Each block of x with each strip of y: (dim, ti, tj), first x's rows, then y's."""
    chunk = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    dealt = x.select("dim", chunk(blocks).alias("ti"), every(strips).alias("tj"), F.lit(0).alias("side"), "vec_id", *columns)
    dealt = dealt.unionByName(y.select("dim", every(blocks).alias("ti"), chunk(strips).alias("tj"), F.lit(1).alias("side"), "vec_id", *columns))
    return dealt.repartition("dim", "ti", "tj").sortWithinPartitions("dim", "ti", "tj", "side")


def _in_strips(blocks: int, rows: int, strip: int) -> int:
    return min(max(MOST_STRIPS, MOST_TASKS // max(1, blocks)), -(-rows // strip))


def _by_originals(left: DataFrame, right: DataFrame, k: int, block: int, tile: int, strip: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in each strip, exactly; original vectors travel."""
    blocks = -(-left.count() // block)
    dealt = _dealt(left, right, blocks, _in_strips(blocks, right.count(), strip), ["vec"])
    return dealt.mapInArrow(_strips(tile, Originals, lambda q: ExactBlock(q, k)), "query_id long, vec_id long, score double")


def nearest(queries: DataFrame, candidates: DataFrame, k: int = NEAREST, block: int = BLOCK, tile: int = TILE, strip: int = STRIP, most: int = MOST_PAIRS, crowd: int = CROWD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product with each query, itself left out.

    Both have (vec_id, embedding) rows. Ties go to the smaller vec_id, fewer than k candidates give fewer rows, and
    vectors meet only those of their own length. Unusable vectors (null, zero, null or non-finite components) and rows
    without vec_id take no part. A vec_id that repeats counts once, with its shortest usable vector, of equally long ones
    the least in bytes. Other columns are ignored. Queries whose candidates lie so near to each other that more than crowd of
    a strip survive all bounds are scored by original vectors, k of a strip being held; so are those of most pairs where a
    task would hold more than most.
    """
    left, right = (_one_each(clean(x)) for x in (queries, candidates))
    right = _without_needless_copies(right, k)
    x, y = (settle(v.select("dim", "vec_id", "vec").mapInArrow(_coded, "dim int, vec_id long, code binary, numbers binary")) for v in (left, right))
    blocks = -(-left.count() // block)
    dealt = _dealt(x, y, blocks, _in_strips(blocks, y.count(), strip), ["code", "numbers"])
    found = settle(dealt.mapInArrow(_strips(tile, Coded, lambda q: Block(q, k, max(most, 1), max(crowd, k))), "query_id long, vec_id long, low double, high double"))
    crowded = settle(found.filter(F.col("vec_id").isNull()).select("query_id").distinct())
    some = not crowded.isEmpty()
    if some:
        found = found.join(crowded, "query_id", "left_anti")
    found = found.repartition("query_id").sortWithinPartitions("query_id", F.desc("low")).mapInArrow(_over_all_strips(k), "query_id long, vec_id long")
    pairs = spread_join(settle(found), right.select("vec_id", F.col("vec").alias("y")), ["vec_id"])
    pairs = pairs.join(left.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("x")), "query_id").select("query_id", "vec_id", "x", "y")
    scored = pairs.mapInArrow(_scored, "query_id long, vec_id long, score double")
    if some:
        again = settle(left.join(crowded.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_semi").select("dim", "vec_id", "vec"))
        scored = scored.unionByName(_by_originals(again, right.select("dim", "vec_id", "vec"), k, max(1, block // 4), tile, strip))
    return scored.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors.filter(F.col("vec_id") % EVERY == 0), vectors)
