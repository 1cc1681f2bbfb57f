"""Periodic runs of words, and texts without the repeats.

A run is a stretch of words with smallest period q and at least LEAST_POWER periods, that no neighbouring word extends. For each
power of two B, the aligned blocks of B words are the keys of an Aho-Corasick automaton over word numbers, which is searched
across the text. A run of period q, B <= q < 2B, of four periods holds an aligned block that occurs again q words on; so each
occurrence at a distance from B to below 2B of an aligned block with the same words is a seed. A seed is extended word by word
in both directions, which gives the whole stretch of that period. Small periods come first: what lies inside a known run at a
multiple of its period is that run again.

Only stretches that can hold a run are searched. In a run of a period below 2B, all short groups of words but the last ones
occur again less than 2B words on, so that long stretches of such groups are all there is to search; and a run of another
period overlaps a known run by less than both periods, so that the known one's inside is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import raw, slices

LEAST_POWER, LEAST_LENGTH = 4, 6
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Words in a group whose next place decides what is searched.
_GROUP = 4


def _next(x: np.ndarray) -> np.ndarray:
    """How far on each value occurs again; beyond the end if never."""
    order = np.argsort(x, kind="stable")
    gap = np.full(len(x), len(x) + 1, np.int64)
    same = x[order[1:]] == x[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _groups(words: np.ndarray, size: int) -> np.ndarray:
    """A number for the group of size words from each place on: equal groups have equal numbers."""
    out, n = words.astype(np.uint64), 1
    while n < size:
        step = min(n, size - n)
        out = (out[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (out[step:] + (out[:-step] >> np.uint64(29)))
        n += step
    return out


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(from, to) of each stretch of at least so many true places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    a, b = edges[::2], edges[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist()))


def _same_until(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values of x and y agree."""
    at, step, n = 0, 32, min(len(x), len(y))
    while at < n:
        differ = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), step * 2
    return n


def _seeds(words: np.ndarray, a: int, b: int, size: int) -> Iterator[tuple[int, int]]:
    """(place of an aligned block of so many words, distance to the same words size to 2 size - 1 on) within words a to b."""
    first = -(-a // size)
    blocks = [tuple(words[k * size : (k + 1) * size].tolist()) for k in range(first, b // size)]
    automaton, numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
    own = [numbers.setdefault(x, len(numbers)) for x in blocks]
    for x, k in numbers.items():
        automaton.add_word(x, k)
    if not blocks:
        return
    automaton.make_automaton()
    for end, number in automaton.iter(tuple(words[a:b].tolist())):
        at = a + end - size + 1
        k = at // size - 1 - first  # the one aligned block at such a distance before
        if 0 <= k < len(own) and own[k] == number:
            yield (first + k) * size, at - (first + k) * size


def find_runs(words: np.ndarray, power: int = LEAST_POWER, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least power periods (4 or more) and least words, by start and period."""
    n, found, inside = len(words), {}, []
    gaps: dict[int, np.ndarray] = {}
    number = np.full(n, -1, np.int64)  # of the run that a word is in
    size = 1
    while power * size <= n:
        group = min(size, _GROUP)
        if group not in gaps:
            gaps[group] = _next(_groups(words, group))
        mask = gaps[group] < 2 * size
        if not mask.any():
            size *= 2
            continue
        for start, end, period in inside:
            mask[start + 2 * size + period : max(0, end - 2 * size - period)] = False
        searched: dict[int, int] = {}  # by distance, until where its stretches are known
        done = 0
        for a, b in _stretches(mask, (power - 1) * size - group + 1):
            a, b = max(a, done), min(n, b + 2 * size + group)
            done = max(a, b - 2 * (2 * size + group))
            for at, q in _seeds(words, a, b, size):
                if at < searched.get(q, 0):
                    continue
                k = number[at]
                if k >= 0 and k == number[at + size + q - 1] and q % inside[k][2] == 0 and inside[k][0] <= at and at + size + q <= inside[k][1]:
                    continue
                right = at + size + _same_until(words[at + size : n - q], words[at + size + q :])
                left = at - _same_until(words[:at][::-1], words[: at + q][::-1][: at])
                searched[q] = right
                if right + q - left >= max(least, power * q):
                    found.setdefault((left, right + q), q)
        for (start, end), q in found.items():
            if q >= size:
                number[start:end] = len(inside)
                inside.append((start, end, q))
        size *= 2
    return sorted((start, end - start, q) for (start, end), q in found.items())


def _find(power: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            runs, texts = [], []
            for text in raw(batch.column(batch.num_columns - 1)):
                words, numbers = text.split(), {}  # bytes are split at ASCII white space only
                own = find_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), power, least)
                if own:
                    kept = np.ones(len(words), bool)
                    for start, length, period in own:
                        kept[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(kept).tolist()]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(runs, _RUN), pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, power: int = LEAST_POWER, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of each text's words, by start and period, and the text of the words that no run
    repeats, one space between them.

    Words are what stands between ASCII white space. A null or empty text has no runs and an empty collapsed text; rows of a
    null or repeated doc_id are documents of their own; other columns are ignored; an empty table gives an empty one. A word
    goes if any run has it after the run's first period. Periods of any length are found, in texts of any length; power must
    be at least 4, by which the method is complete.
    """
    if power < LEAST_POWER:
        raise ValueError("runs of under four periods are not found")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(power, least), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents made periodic from some word on. A null doc_id's text stays as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.element_at(words, (a + F.pmod(i - a, p) + 1).cast("int")))), " ")

    new = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise(F.lit(""))), 1)
    return F.when(doc_id.isNotNull() & (F.pmod(h, F.lit(10)) == 0), new).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run of the greatest length/period of runs in order, the first one of several; null if there is none."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(more(best, r), r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("best")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), listed.alias("listed"), "collapsed")
    return found.select(
        "doc_id", "n_runs", best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
