"""Embeddings of attribute values: an autoencoder of their statistics, and a supervised one of their mean demand.

Rows, one a value of the attribute, stay on the executors in blocks; a step sends the weights out and gets sums of gradients
back, which are of the size of the weights. Adam then moves the weights on the driver. Nothing is drawn at random: the
autoencoder begins as the principal components, so that it never ends above their error, and supervised vectors begin at a
hash of their value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.categorical import category_context, scaled_context
from weekloom.sources.stages import reachable, settle

#: Rows of a block, which is a minibatch, and tables of sums that are added up at once.
BLOCK, FAN = 8192, 64
_SUMS = "loss double, rows long, sums binary"
Weights = list[np.ndarray]


def _to_blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = np.stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) for c in some.columns], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "x"])
                k += 1

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """rows, all of numbers, as blocks, numbered within their part; missing numbers are 0."""
    reachable(rows.sparkSession)
    return settle(rows.mapInArrow(_to_blocks(len(rows.columns)), "block int, x binary"))


def _gradients(slope: Callable, weights: Weights, width: int, turn: int, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, sums = 0.0, 0, np.zeros(sum(w.size for w in weights))
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k % turns == turn:
                    x = np.frombuffer(data.as_buffer()).reshape(-1, width)
                    some, parts = slope(weights, x)
                    loss, n, sums = loss + some, n + len(x), sums + np.concatenate([g.ravel() for g in parts])
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["loss", "rows", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    if rows:
        total = np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([sum(r["loss"] for r in rows)]), pa.array([sum(r["rows"] for r in rows)], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["loss", "rows", "sums"])


def descend(blocks: DataFrame, weights: Weights, slope: Callable, width: int, steps: int, rate: float, turns: int = 1) -> tuple[Weights, list[float]]:
    """Adam over the blocks' gradients; each step reads every turns-th block. Gives the weights of the least loss seen over all
    rows (those of the last step if no step reads all of them), and the mean loss before each step and after the last."""
    parts, mean, square, best, losses = blocks.rdd.getNumPartitions(), None, None, None, []
    for t in range(steps + 1):
        rows, left = blocks.mapInArrow(_gradients(slope, weights, width, t % turns, turns), _SUMS), parts
        while left > FAN:
            left = -(-left // FAN)
            rows = rows.repartition(left).mapInArrow(_add, _SUMS)
        found = rows.collect()
        n = sum(r.rows for r in found)
        if not n:
            return weights, losses
        losses.append(sum(r.loss for r in found) / n)
        if best is None or losses[-1] <= best[0] or turns > 1:
            best = losses[-1], weights
        if t == steps:
            break
        flat = np.sum([np.frombuffer(r.sums) for r in found], axis=0) / n
        g = [p.reshape(w.shape) for p, w in zip(np.split(flat, np.cumsum([w.size for w in weights])[:-1]), weights)]
        mean = [0.1 * a for a in g] if mean is None else [0.9 * m + 0.1 * a for m, a in zip(mean, g)]
        square = [0.001 * a * a for a in g] if square is None else [0.999 * s + 0.001 * a * a for s, a in zip(square, g)]
        weights = [w - rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(s / (1 - 0.999 ** (t + 1))) + 1e-8) for w, m, s in zip(weights, mean, square)]
    return best[1], losses


# ---- autoencoder ---------------------------------------------------------------------------------------------------


def _forward(weights: Weights, x: np.ndarray):
    a, b, c, d, p, q, r, s = weights
    h = x @ a + b
    code = np.maximum(h, 0) @ c + d
    k = code @ p + q
    return h, code, k, np.maximum(k, 0) @ r + s


def _autoencoder_slope(weights: Weights, x: np.ndarray):
    """Sum of squared errors of rows, a mean over columns each, and its gradient: two hidden layers of rectified units around
    a linear code."""
    a, _, c, _, p, _, r, _ = weights
    h, code, k, out = _forward(weights, x)
    e = (out - x) / x.shape[1]
    to_k = 2 * e @ r.T * (k > 0)
    to_code = to_k @ p.T
    to_h = to_code @ c.T * (h > 0)
    return float((e * (out - x)).sum()), [x.T @ to_h, to_h.sum(0), np.maximum(h, 0).T @ to_code, to_code.sum(0), code.T @ to_k, to_k.sum(0), 2 * np.maximum(k, 0).T @ e, 2 * e.sum(0)]


def _as_components(covariance: np.ndarray, size: int, hidden: int) -> Weights:
    """Weights that code a row as its principal components and back: a unit for each side of a column, and spare ones."""
    d = len(covariance)
    values, vectors = np.linalg.eigh(covariance)
    axes = vectors[:, np.argsort(-values)[:size]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    spare = hidden - 2 * max(d, axes.shape[1])
    if spare < 0:
        raise ValueError("too few hidden units to begin at the principal components")
    wave = lambda n, m: np.sin(np.arange(1, n * m + 1).reshape(n, m) * 1.7) / max(n, 1) ** 0.5  # noqa: E731  any fixed directions

    def sided(n: int) -> np.ndarray:
        return np.hstack([np.eye(n), -np.eye(n), wave(n, hidden - 2 * n)])

    def back(m: np.ndarray) -> np.ndarray:
        return np.vstack([m, -m, np.zeros((hidden - 2 * len(m), m.shape[1]))])

    k = axes.shape[1]
    return [sided(d), np.zeros(hidden), back(axes), np.zeros(k), sided(k), np.zeros(hidden), back(axes.T), np.zeros(d)]


def _coded(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) for c in batch.columns[1:]], axis=1)
            _, code, _, out = _forward(weights, x)
            error = ((out - x) ** 2).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.tolist(), pa.list_(pa.float64())), pa.array(error)], names=["value", "embedding", "error"])

    return run


def autoencoder(context: DataFrame, size: int = 3, hidden: int = 32, steps: int = 60, rate: float = 0.003, turns: int = 1) -> DataFrame:
    """(value, embedding, error) for each row of context (value and numbers): codes of an autoencoder of the standardised
    numbers, and how far off each row's reconstruction is, as a mean square over columns.

    Equal rows get equal codes; null numbers count as 0 before standardising, a null value is a value. The code has at most as
    many places as there are numbers. An empty table gives an empty one.
    """
    rows = settle(scaled_context(context.fillna(0)))
    names = [c for c in rows.columns if c != "value"]
    size = min(size, len(names))
    products = rows.agg(*(F.avg(F.col(a) * F.col(b)) for a in names for b in names)).first()  # one row
    covariance = np.array([x or 0.0 for x in products]).reshape(len(names), -1)
    weights, _ = descend(_blocks(rows.select(*names)), _as_components(covariance, size, max(hidden, 2 * len(names))), _autoencoder_slope, len(names), steps, rate, turns)
    return rows.select(F.col("value").cast("string").alias("value"), *names).mapInArrow(_coded(weights), "value string, embedding array<double>, error double")


# ---- supervised ----------------------------------------------------------------------------------------------------


def _supervised_slope(size: int):
    """Weights are the head (size) and its offset; a row is (rows of the value, their mean, vector). The vector best for the
    head, held near its start, is put in; so the head's gradient is that of the whole loss."""

    def slope(weights: Weights, x: np.ndarray):
        head, offset = weights
        n, y, start = x[:, 0], x[:, 1], x[:, 2:]
        vector = _moved(head, offset, n, y, start)
        e = vector @ head + offset[0] - y
        loss = n * e * e + ((vector - start) ** 2).sum(1)
        return float(loss.sum()), [2 * (n * e) @ vector, np.array([2 * (n * e).sum()])]

    return slope


def _moved(head: np.ndarray, offset: np.ndarray, n: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The vectors that make n (v·head + offset - y)^2 + |v - start|^2 least."""
    away = start @ head + offset[0] - y
    return start - (n * away / (1 + n * (head @ head)))[:, None] * head


def _vectors(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], axis=1)
            head, offset = weights
            v = _moved(head, offset, x[:, 0], x[:, 1], x[:, 2:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(v @ head + offset[0])], names=["value", "embedding", "predicted"])

    return run


def supervised(df: DataFrame, column: str, target: str = "qty", size: int = 3, steps: int = 40, rate: float = 0.05) -> DataFrame:
    """(value, embedding, predicted) of each value of a column: vectors from which a linear head tells the value's target.

    The loss, squared errors over all rows and the vectors' distance from where a hash of the value put them, depends on the
    rows only by number and mean of each value, which are counted first. Rows without a target don't count; a null is a value.
    """
    y = F.col(target).cast("double")
    counts = df.filter(y.isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").cast("double").alias("n"), F.avg(y).alias("y"))
    start = [(F.pmod(F.xxhash64(F.coalesce("value", F.lit("")), F.lit(i)), F.lit(20_001)) / 10_000.0 - 1).alias(f"v{i}") for i in range(size)]
    rows = settle(counts.select("value", "n", "y", *start))
    mean = rows.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).first()[0]
    begin = [np.full(size, 1.0), np.array([mean or 0.0])]
    weights, _ = descend(_blocks(rows.drop("value")), begin, _supervised_slope(size), size + 2, steps, rate)
    return rows.mapInArrow(_vectors(weights), "value string, embedding array<double>, predicted double")


def of_column(panel: DataFrame, column: str, size: int = 3) -> DataFrame:
    """The autoencoder's (value, embedding, error) of the wide statistics of an attribute."""
    return autoencoder(category_context(panel, column, wide=True), size)
