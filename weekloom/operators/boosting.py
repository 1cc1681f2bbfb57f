"""Boosted trees that grow leaf by leaf, over binned features.

Features become bins once; rows travel as blocks of bins, targets and scores in the checkpoint folder. A pass over the blocks
adds up gradients and curvatures by leaf, feature and bin on the executors; what comes to the driver is one table of that
size, whatever the number of rows. Trees grow best first: the leaf of the largest gain is split next, until there are enough
leaves. One pass reads the histograms for all leaves that may be split before the tree is full, of the smaller child of each;
the other child's is the difference. Objectives give a gradient and a curvature; those whose leaf value is a quantile of the
residuals get it exactly, by counts over buckets that narrow to the value.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.sources.stages import reachable, settle

#: Rows of a block, tables that are added up at once, rounds after which scores are written anew, buckets of a quantile.
BLOCK, FAN, REBASE, BUCKETS = 16_384, 64, 10, 1024


@dataclass(frozen=True)
class Objective:
    """What is minimised: gradient and curvature of the loss at (y, score), where scores start, and, if leaf values are a
    quantile of the residuals instead of a Newton step, which."""

    name: str
    slopes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    start: str = "mean"
    quantile: float | None = None


def squared() -> Objective:
    return Objective("squared", lambda y, s: (s - y, np.ones_like(y)))


def absolute() -> Objective:
    return Objective("absolute", lambda y, s: (np.sign(s - y), np.ones_like(y)), "median", 0.5)


def huber(limit: float = 0.9) -> Objective:
    """Squared loss near, absolute loss beyond the limit."""
    return Objective("huber", lambda y, s: (np.clip(s - y, -limit, limit), np.ones_like(y)))


def asymmetric_log_cosh(heavy: float = 1.5) -> Objective:
    """Log-cosh of the residual, which counts heavy times where the true value is zero."""

    def slopes(y, s):
        t = np.tanh(s - y)
        times = np.where(y == 0, heavy, 1.0)
        return t * times, (1.0 - t * t) * times

    return Objective("asymmetric_log_cosh", slopes, "median")


OBJECTIVES: dict[str, Callable[..., Objective]] = {f.__name__: f for f in (squared, absolute, huber, asymmetric_log_cosh)}


def slopes(df: DataFrame, objective: Objective, y: str, score: str) -> DataFrame:
    """df with gradient and curvature of the objective at each row's y and score, which are not null."""
    reachable(df.sparkSession)

    @F.pandas_udf("gradient double, curvature double")
    def both(y: pd.Series, score: pd.Series) -> pd.DataFrame:
        g, h = objective.slopes(y.to_numpy(float), score.to_numpy(float))
        return pd.DataFrame({"gradient": g, "curvature": h})

    return df.withColumn("_slopes", both(F.col(y).cast("double"), F.col(score).cast("double"))).select(*df.columns, "_slopes.*")


@dataclass(frozen=True)
class Growth:
    """How trees grow. most_step bounds Newton steps, which run off where the curvature is near zero. Of rounds without a
    better score on validation rows, patience are made before fitting stops."""

    rounds: int = 60
    step: float = 0.1
    leaves: int = 31
    deepest: int = 8
    least_rows: int = 20
    ridge: float = 0.0
    least_gain: float = 1e-9
    most_step: float = math.inf
    bins: int = 64
    patience: int = 5


@dataclass
class Tree:
    """Nodes by number, the root 0; a node of feature -1 is a leaf. Values of a feature up to the edge go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at_bin: list[int] = field(default_factory=lambda: [0])
    edge: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def leaf(self, rows: int) -> int:
        for column, x in ((self.feature, -1), (self.at_bin, 0), (self.edge, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0), (self.rows, rows)):
            column.append(x)
        return len(self.feature) - 1

    def reach(self, goes_left: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
        """The leaf of each of n rows; goes_left says it for rows at inner nodes."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        at, rows = np.zeros(n, np.int64), np.arange(n)
        while True:
            rows = rows[feature[at[rows]] >= 0]
            if not len(rows):
                return at
            here = at[rows]
            at[rows] = np.where(goes_left(rows, feature[here], here), left[here], right[here])

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        cut = np.array(self.at_bin)
        return self.reach(lambda rows, f, node: bins[f, rows] <= cut[node], bins.shape[1])

    def of_values(self, x: np.ndarray) -> np.ndarray:
        """x: rows by features; a missing value goes left."""
        edge = np.array(self.edge)
        return self.reach(lambda rows, f, node: ~(x[rows, f] > edge[node]), len(x))


# ---- blocks --------------------------------------------------------------------------------------------------------


def bin_edges(df: DataFrame, features: list[str], bins: int, more: list[Column] | None = None) -> tuple[list[list[float]], list]:
    """For each feature, the upper edges of its bins but the last: its values if they are few, else its quantiles. And the
    values of more aggregates over df. A feature brings at most bins numbers to the driver."""
    x = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    places = [i / bins for i in range(1, bins)]
    one = df.agg(*(F.struct(F.approx_count_distinct(x(c), 0.02).alias("n"), F.percentile_approx(x(c), places, 10_000).alias("q")).alias(f"f{i}") for i, c in enumerate(features)), *(more or [])).first()
    few = [i for i in range(len(features)) if one[i]["n"] <= bins * 0.9]
    values = dict(zip(few, df.agg(*(F.sort_array(F.collect_set(x(features[i]))).alias(f"f{i}") for i in few)).first())) if few else {}
    return [values[i][:-1] if i in values else sorted(set(one[i]["q"] or [])) for i in range(len(features))], list(one)[len(features) :]


_BLOCK = "n int, bins binary, y binary, weight binary, fold binary, score binary"


def _to_blocks(edges: list[list[float]]):
    """Rows of features, target, weight and fold as blocks, each column of which is one value."""
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            values = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in t.columns]
            # a missing value is in bin 0, with what is below the first edge
            bins = np.stack([np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left")) for x, e in zip(values, cuts)]).astype(np.uint8)
            y, weight, fold = values[-3:]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(y)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (bins, y, weight, fold.astype(np.uint8), np.zeros(len(y))))],
                names=["n", "bins", "y", "weight", "fold", "score"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return run


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(bins, y, weight, fold, score) of each block."""
    kinds = (np.uint8, np.float64, np.float64, np.uint8, np.float64)
    for batch in batches:
        for i in range(batch.num_rows):
            n, *data = (batch.column(j)[i] for j in range(6))
            bins, *columns = (np.frombuffer(d.as_buffer(), t) for d, t in zip(data, kinds))
            yield bins.reshape(-1, n.as_py()), *columns


def _rescored(trees: list[Tree], bins: np.ndarray, score: np.ndarray) -> np.ndarray:
    for t in trees:
        score = score + np.array(t.value)[t.of_bins(bins)]
    return score


def _rebased(trees: list[Tree]):
    def run(batches):
        for batch in batches:
            scores = [_rescored(trees, bins, score).tobytes() for bins, _, _, _, score in _each_block([batch])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.binary())], names=batch.schema.names)

    return run


# ---- passes --------------------------------------------------------------------------------------------------------


@dataclass
class _Request:
    """What one fit wants of a pass: histograms of nodes of a draft tree, or counts of leaves' residuals within ranges. The fit
    learns from all rows but those of the held fold, whose errors histograms tell."""

    trees: list[Tree]  # that the blocks' scores lack
    tree: Tree
    held: int
    objective: Objective
    wanted: list[int] = field(default_factory=list)
    ranges: dict[int, tuple[float, float]] | None = None


class _Histograms:
    """features x bins x (gradient, curvature, rows) of each wanted node, and under -1 the held rows' errors."""

    def __init__(self, r: _Request, bins: int) -> None:
        self.r, self.bins, self.total, self.errors = r, bins, None, np.zeros(3)
        self.place = np.full(len(r.tree.feature), -1)
        self.place[r.wanted] = range(len(r.wanted))

    def add(self, b: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, score: np.ndarray) -> None:
        held = fold == self.r.held
        self.errors += (np.abs(np.maximum(score[held], 0) - y[held]).sum(), np.abs(y[held]).sum(), held.sum())
        node = self.place[self.r.tree.of_bins(b)]
        rows = np.flatnonzero((node >= 0) & ~held)
        if not len(rows):
            return
        if self.total is None:
            self.total = np.zeros((len(self.r.wanted), len(b), self.bins, 3))
        g, h = self.r.objective.slopes(y[rows], score[rows])
        g, h, node = g * weight[rows], h * weight[rows], node[rows] * self.bins
        for f in range(len(b)):
            key = node + b[f, rows]
            for k, w in enumerate((g, h, None)):
                self.total[:, f, :, k] += np.bincount(key, w, len(self.r.wanted) * self.bins).reshape(-1, self.bins)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        yield -1, self.errors.tobytes()
        if self.total is not None:
            yield from ((k, t.tobytes()) for k, t in zip(self.r.wanted, self.total))


class _Counts:
    """Under -2: (leaf x BUCKETS + bucket, weight, least, greatest) of the residuals in each bucket that isn't empty."""

    def __init__(self, r: _Request, bins: int) -> None:
        self.r, self.held = r, []
        self.lo, self.hi = (np.full(len(r.tree.feature), x) for x in (math.inf, -math.inf))
        for leaf, (a, b) in r.ranges.items():
            self.lo[leaf], self.hi[leaf] = a, b

    def add(self, b, y, weight, fold, score) -> None:
        leaf, x = self.r.tree.of_bins(b), y - score
        keep = (x >= self.lo[leaf]) & (x <= self.hi[leaf]) & (fold != self.r.held)
        leaf, x, weight = leaf[keep], x[keep], weight[keep]
        lo, width = self.lo[leaf] / 2, self.hi[leaf] / 2 - self.lo[leaf] / 2
        bucket = np.clip(((x / 2 - lo) / np.where(width > 0, width, 1.0) * BUCKETS).astype(np.int64), 0, BUCKETS - 1)
        self.held.append(_grouped((leaf * BUCKETS + bucket).astype(np.float64), weight, x, x))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            yield -2, np.stack(_grouped(*map(np.concatenate, zip(*self.held)))).tobytes()


def _grouped(key: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(key):
        return key, n, low, high
    order = np.argsort(key, kind="stable")
    key, n, low, high = key[order], n[order], low[order], high[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _answers(requests: list[_Request], bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_Histograms(r, bins) if r.ranges is None else _Counts(r, bins) for r in requests]
        for b, y, weight, fold, score in _each_block(batches):
            for part in own:
                part.add(b, y, weight, fold, _rescored(part.r.trees, b, score))
        for k, part in enumerate(own):
            keys, tables = list(zip(*part.rows())) or [(), ()]
            yield _sums([k] * len(keys), keys, tables)

    return run


_SUMS = "request int, key int, sums binary"


def _sums(requests, keys, tables) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(requests, pa.int32()), pa.array(keys, pa.int32()), pa.array(tables, pa.binary())], names=["request", "key", "sums"])


def _added(rows) -> dict[tuple[int, int], np.ndarray]:
    """Sums by request and key; counts are put together by bucket."""
    out: dict[tuple[int, int], np.ndarray] = {}
    for request, key, data in rows:
        x, at = np.frombuffer(data, np.float64), (request, key)
        if at not in out:
            out[at] = x
        elif key == -2:
            out[at] = np.stack(_grouped(*np.hstack([out[at].reshape(4, -1), x.reshape(4, -1)]))).ravel()
        else:
            out[at] = out[at] + x
    return out


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _added(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    keys = list(zip(*out)) or [(), ()]
    yield _sums(*keys, [x.tobytes() for x in out.values()])


class _Passes:
    """The blocks of some fits. One pass answers a request of each."""

    def __init__(self, blocks: DataFrame, bins: int) -> None:
        self.blocks, self.bins, self.parts = blocks, bins, blocks.rdd.getNumPartitions()

    def ask(self, requests: list[_Request]) -> list[dict[int, np.ndarray]]:
        rows, parts = self.blocks.mapInArrow(_answers(requests, self.bins), _SUMS), self.parts
        while parts > FAN:  # so that the driver gets a bounded number of tables
            parts = -(-parts // FAN)
            rows = rows.repartition(parts).mapInArrow(_add, _SUMS)
        out: list[dict[int, np.ndarray]] = [{} for _ in requests]
        for (request, key), x in _added(rows.collect()).items():
            out[request][key] = x
        return out


# ---- growth --------------------------------------------------------------------------------------------------------


@dataclass
class _Node:
    sums: np.ndarray
    depth: int
    gain: float = 0.0
    feature: int = -1
    at_bin: int = 0
    children: tuple[int, int] | None = None

    @property
    def whole(self) -> np.ndarray:
        return self.sums[0].sum(axis=0)

    def split(self, growth: Growth) -> None:
        """The best split: of equal gains, that of the first feature and the lowest bin."""
        left = np.cumsum(self.sums, axis=1)[:, :-1]
        right = left[:, -1:] + self.sums[:, -1:] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            score = lambda s: np.where(s[..., 1] + growth.ridge > 0, s[..., 0] ** 2 / (s[..., 1] + growth.ridge), 0.0)
            gains = score(left) + score(right) - score(self.whole)
        gains[(left[..., 2] < growth.least_rows) | (right[..., 2] < growth.least_rows)] = -math.inf
        best = int(gains.argmax())
        if self.depth < growth.deepest and gains.size and gains.flat[best] > growth.least_gain:
            self.gain, (self.feature, self.at_bin) = float(gains.flat[best]), divmod(best, gains.shape[1])


class _Fit:
    """One fit: a generator of requests that is sent their answers. Its model has the trees up to the best score so far."""

    def __init__(self, features: list[str], edges: list[list[float]], bins: int, objective: Objective, growth: Growth, held: int, ends: tuple[float, float]) -> None:
        self.edges, self.bins, self.objective, self.growth, self.held, self.ends = edges, bins, objective, growth, held, ends
        self.trees: list[Tree] = []  # that the blocks' scores lack
        self.made: list[Tree] = []
        self.low = self.high = 0.0  # what scores are between
        self.model = Model(features, 0.0, [])
        self.error: list[float] = []  # mean absolute errors on held rows, as model.wmape

    def _histograms(self, tree: Tree, wanted: list[int]):
        sums = yield _Request(self.trees, tree, self.held, self.objective, wanted)
        errors = sums.pop(-1, np.zeros(3))
        return {k: x.reshape(-1, self.bins, 3) for k, x in sums.items()}, errors

    def _quantiles(self, tree: Tree, leaves: list[int], q: float):
        """The q-th quantile of the residuals of each leaf: between the two values in the middle if the weights part there."""
        whole = (self.ends[0] - self.high, self.ends[1] - self.low)
        pad = 1e-9 * (abs(whole[0]) + abs(whole[1]))
        ranges, found, below, totals = dict.fromkeys(leaves, (whole[0] - pad, whole[1] + pad)), {}, dict.fromkeys(leaves, 0.0), {}
        while ranges:
            sums = yield _Request(self.trees, tree, self.held, self.objective, ranges=ranges)
            key, n, low, high = sums.get(-2, np.zeros(0)).reshape(4, -1)
            leaf, new = key // BUCKETS, {}
            for one in ranges:
                at = leaf == one
                if not at.any():
                    continue
                want, upto = q * totals.setdefault(one, float(n[at].sum())), below[one] + np.cumsum(n[at])
                k = min(int(np.searchsorted(upto, want, side="left")), len(upto) - 1)
                lo, hi = float(low[at][k]), float(high[at][k])
                if upto[k] == want and k + 1 < len(upto):
                    found[one] = (hi + float(low[at][k + 1])) / 2
                elif lo == hi:
                    found[one] = lo
                else:
                    below[one], new[one] = float(upto[k] - n[at][k]), (lo, hi)
            ranges = new
        return found

    def _grow(self):
        """One tree, and the held rows' errors before it; None if there are no rows."""
        growth, draft = self.growth, Tree()  # all nodes whose histograms are known, split or not
        sums, errors = yield from self._histograms(draft, [0])
        if 0 not in sums:
            return None, errors
        self._scored(errors)
        nodes = {0: _Node(sums[0], 0)}
        nodes[0].split(growth)
        while True:
            heap, splits = [(-nodes[0].gain, 0)], []
            while heap and len(splits) < growth.leaves - 1 and nodes[heap[0][1]].children:
                node = heapq.heappop(heap)[1]
                splits.append(node)
                for child in nodes[node].children:
                    if nodes[child].gain > 0:
                        heapq.heappush(heap, (-nodes[child].gain, child))
            if not heap or nodes[heap[0][1]].gain <= 0 or len(splits) == growth.leaves - 1:
                return _kept(nodes, set(splits), self.edges), errors
            # the one that is next, and others that may be: their children cost less than another pass
            ahead = [k for _, k in heapq.nsmallest(growth.leaves - 1, ((-n.gain, k) for k, n in nodes.items() if n.gain > 0 and not n.children))]
            ahead = [heap[0][1], *(k for k in ahead if k != heap[0][1])]
            smaller = []
            for k in ahead:
                node = nodes[k]
                rows = node.sums[node.feature, : node.at_bin + 1, 2].sum(), node.sums[node.feature, node.at_bin + 1 :, 2].sum()
                draft.feature[k], draft.at_bin[k] = node.feature, node.at_bin
                node.children = draft.left[k], draft.right[k] = draft.leaf(int(rows[0])), draft.leaf(int(rows[1]))
                smaller.append(node.children[int(rows[0] > rows[1])])
            sums, _ = yield from self._histograms(draft, smaller)
            for k, small in zip(ahead, smaller):
                a, b = nodes[k].children
                other = nodes[k].sums - sums[small]
                for child in (a, b):
                    nodes[child] = _Node(sums[small] if child == small else other, nodes[k].depth + 1)
                    nodes[child].split(growth)

    def _leaf_values(self, tree: Tree):
        leaves = [k for k, f in enumerate(tree.feature) if f < 0]
        growth = self.growth
        if self.objective.quantile is not None:
            found = yield from self._quantiles(tree, leaves, self.objective.quantile)
            for k in leaves:
                tree.value[k] = growth.step * found.get(k, 0.0)
            return
        for k in leaves:
            g, h = tree.value[k]
            newton = -g / (h + growth.ridge) if h + growth.ridge > 0 else 0.0
            tree.value[k] = growth.step * max(-growth.most_step, min(growth.most_step, newton))

    def _scored(self, errors: np.ndarray) -> None:
        if errors[2] and len(self.model.wmape) == len(self.made) - 1:  # the first one is the start
            self.model.wmape.append(float(errors[0] / errors[1]) if errors[1] else 0.0)
            self.error.append(float(errors[0] / errors[2]))
            best = int(np.argmin(self.model.wmape))
            self.model.trees = self.made[1 : best + 1]

    def _made(self, tree: Tree) -> None:
        self.trees.append(tree)
        self.made.append(tree)
        self.low, self.high = self.low + min(tree.value), self.high + max(tree.value)
        if not self.model.wmape:
            self.model.trees = self.made[1:]

    def run(self):
        if self.objective.start == "median":
            self.model.start = (yield from self._quantiles(Tree(), [0], 0.5)).get(0, 0.0)
        else:
            whole = (yield _Request([], Tree(), self.held, squared(), [0])).get(0)
            g, h, _ = whole.reshape(-1, self.bins, 3)[0].sum(axis=0) if whole is not None else (0.0, 0.0, 0)
            self.model.start = float(-g / h) if h else 0.0
        self._made(Tree(value=[self.model.start]))
        for _ in range(self.growth.rounds):
            tree, _ = yield from self._grow()
            if tree is None or self.model.wmape and len(self.model.wmape) - 1 - int(np.argmin(self.model.wmape)) >= self.growth.patience:
                return
            yield from self._leaf_values(tree)
            if not any(tree.value):
                return
            self._made(tree)
        if self.held >= 0:
            self._scored((yield from self._histograms(Tree(), []))[1])


def _kept(nodes: dict[int, _Node], splits: set[int], edges: list[list[float]]) -> Tree:
    tree = Tree()
    tree.rows[0] = int(nodes[0].whole[2])
    open_nodes = [(0, 0)]
    while open_nodes:
        k, at = open_nodes.pop(0)
        node = nodes[k]
        if k in splits:
            tree.feature[at], tree.at_bin[at], tree.edge[at], tree.gain[at] = node.feature, node.at_bin, edges[node.feature][node.at_bin], node.gain
            for side, child in zip((tree.left, tree.right), node.children):
                side[at] = tree.leaf(int(nodes[child].whole[2]))
                open_nodes.append((child, side[at]))
        else:
            g, h, _ = node.whole
            tree.value[at] = (float(g), float(h))  # becomes the leaf's value
    return tree


@dataclass
class Model:
    features: list[str]
    start: float
    trees: list[Tree]
    wmape: list[float] = field(default_factory=list)  # on validation rows: before the first tree, and after each one

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += np.array(t.value)[t.of_values(x)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a column prediction; a missing feature goes left."""
        reachable(df.sparkSession)
        return df.withColumn("prediction", _prediction(self)(F.struct(*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)))))

    def importances(self) -> dict[str, float]:
        """Each feature's share of all splits' gains."""
        gains = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gains[self.features[f]] += g
        total = sum(gains.values())
        return {k: g / total if total else 0.0 for k, g in gains.items()}

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(round, node, feature, edge, gain, rows, value): every node of every tree, inner ones without a value."""
        rows = [
            (r, k, self.features[f] if f >= 0 else None, t.edge[k] if f >= 0 else None, t.gain[k] if f >= 0 else None, t.rows[k], None if f >= 0 else t.value[k])
            for r, t in enumerate(self.trees, 1)
            for k, f in enumerate(t.feature)
        ]
        return spark.createDataFrame(rows, "round int, node int, feature string, edge double, gain double, rows long, value double")

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Model:
        return cls(d["features"], d["start"], [Tree(**t) for t in d["trees"]], d["wmape"])


def _prediction(model: Model):
    @F.pandas_udf("double")
    def prediction(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.values(x.to_numpy(dtype=float)))

    return prediction


@dataclass
class Binned:
    """Rows as blocks of bins, and what fits have to know of them."""

    passes: _Passes
    features: list[str]
    edges: list[list[float]]
    ends: tuple[float, float]

    def fit(self, objective: Objective, growth: Growth, held: int = -1) -> _Fit:
        return _Fit(self.features, self.edges, self.passes.bins, objective, growth, held, self.ends)

    def rebase(self, fit: _Fit) -> None:
        """Write the blocks with a fit's scores; of one fit only."""
        self.passes.blocks = settle(self.passes.blocks.mapInArrow(_rebased(fit.trees), _BLOCK))
        fit.trees = []


def binned(df: DataFrame, features: list[str], target: str = "qty", bins: int = 64, weight: str | None = None, fold: Column | None = None, known: Column | None = None) -> Binned:
    """df's rows that have a target as blocks, with their fold, from 0 to 255. Edges of bins come from the rows that known
    says."""
    if not 2 <= bins <= 256:
        raise ValueError("from 2 to 256 bins")
    reachable(df.sparkSession)
    y = F.col(target).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.filter(y.isNotNull() & ~F.isnan(y))
    seen = rows.filter(known) if known is not None else rows
    edges, (least, most) = bin_edges(seen, features, bins, [F.min(y), F.max(y)])
    columns = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    blocks = rows.select(*columns, y.alias("y"), w.alias("w"), (fold if fold is not None else F.lit(0)).cast("double").alias("fold")).mapInArrow(_to_blocks(edges), _BLOCK)
    widest = max([2, *(len(e) + 1 for e in edges)])
    return Binned(_Passes(settle(blocks), widest), list(features), edges, (least or 0.0, most or 0.0))


def fit(train: DataFrame, features: list[str], target: str = "qty", valid: DataFrame | None = None, objective: Objective | None = None, growth: Growth = Growth(), weight: str | None = None) -> Model:
    """Leaf-wise boosted trees. Rows without a target don't count; negative weights are an error of the caller.

    With valid rows (not none of them) fitting stops after growth.patience rounds without a lower wmape, and the rounds up to
    the lowest are kept. A table without rows gives a model without trees.
    """
    wanted = list(dict.fromkeys([*features, target, *([weight] if weight else [])]))
    rows = train.select(*wanted, F.lit(0).alias("_fold"))
    if valid is not None:
        rows = rows.unionByName(valid.select(*wanted, F.lit(1).alias("_fold")))
    data = binned(rows, features, target, growth.bins, weight, F.col("_fold"), F.col("_fold") == 0)
    one = data.fit(objective or absolute(), growth, 1 if valid is not None else -1)
    steps = one.run()
    try:
        request = next(steps)
        while True:
            request = steps.send(data.passes.ask([request])[0])
            if len(one.trees) >= REBASE:
                data.rebase(one)
                request.trees = one.trees
    except StopIteration:
        return one.model


@dataclass(frozen=True)
class Draw:
    """One draw of a search: its number, growth, mean absolute error by fold, and the rounds after which it was left."""

    number: int
    growth: Growth
    errors: tuple[float, ...]
    rounds: int

    @property
    def error(self) -> float:
        return sum(self.errors) / len(self.errors)


def random_growths(draws: int, seed: int, rounds: tuple[int, int] = (8, 16)) -> list[Growth]:
    """Parameters drawn at random, the same for a seed."""
    rng = random.Random(seed)
    return [Growth(rounds=rng.randint(*rounds), step=rng.uniform(0.05, 0.4), leaves=rng.randint(4, 24), deepest=rng.choice([3, 4, 6]), ridge=rng.uniform(0.1, 0.9), least_rows=rng.choice([5, 20, 50]), patience=1 << 30) for _ in range(draws)]


def search(df: DataFrame, features: list[str], target: str = "qty", objective: Objective | None = None, growths: list[Growth] | None = None, folds: int = 3, rungs: tuple[int, ...] = (1, 3, 6), seed: int = 42, fold: Column | None = None) -> list[Draw]:
    """Draws of parameters by their mean absolute error on held folds, best first.

    Rows are binned once, and a row's fold is a hash of its features and target unless fold says it. All draws and folds grow
    side by side: a pass over the blocks answers one request of each. After so many rounds as a rung says, the worse half of
    the draws that are left is given up; a draw of fewer rounds stays at its last error. Draws that went further come first.
    """
    growths = growths if growths is not None else random_growths(25, seed)
    by_hash = F.pmod(F.xxhash64(*(F.col(c) for c in [*features, target]), F.lit(seed)), F.lit(folds))
    data = binned(df, features, target, max(g.bins for g in growths), fold=fold if fold is not None else by_hash)
    fits = {(d, f): data.fit(objective or squared(), g, f) for d, g in enumerate(growths) for f in range(folds)}
    steps = {k: fit.run() for k, fit in fits.items()}
    asked = {k: next(s) for k, s in steps.items()}
    left, gone_at = set(range(len(growths))), {}

    def known(draw: int) -> int:
        """Rounds whose error is known in all folds."""
        return min(len(fits[draw, f].error) - 1 for f in range(folds))

    def error(draw: int, rounds: int) -> float:
        return sum(fits[draw, f].error[min(rounds, len(fits[draw, f].error) - 1)] if fits[draw, f].error else math.inf for f in range(folds))

    for rung in (*rungs, max(g.rounds for g in growths)):
        while True:
            some = [k for k in asked if k[0] in left and len(fits[k].error) - 1 < rung]
            if not some:
                break
            for k, answer in zip(some, data.passes.ask([asked[k] for k in some])):
                try:
                    asked[k] = steps[k].send(answer)
                except StopIteration:
                    asked.pop(k)
        order = sorted(left, key=lambda d: (error(d, rung), d))
        for d in order[-(-len(order) // 2) :] if rung in rungs else []:
            left.discard(d)
            gone_at[d] = rung
    results = []
    for d, growth in enumerate(growths):
        rounds = min(gone_at.get(d, growth.rounds), max(known(d), 0))
        results.append(Draw(d, growth, tuple(fits[d, f].error[min(rounds, len(fits[d, f].error) - 1)] if fits[d, f].error else math.nan for f in range(folds)), rounds))
    return sorted(results, key=lambda r: (-gone_at.get(r.number, 1 << 30), r.error, r.number))
