"""Best-fit packing of token sequences.

Token counts become a histogram by length, of one row a length. Best fit in order of falling length is planned over that
histogram: sequences that look alike (same contents, same room left) are one entry with a number, so that the plan has a
few rows a length, however many documents there are. Documents then take the planned slots of their length in the order
of their ranks within it. A rank is a place among the pieces of that length in its task's part of the table, plus those
of the parts before: no length meets in one task, and neither texts nor ids are shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.llm.common import settle, slices, strings

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, END_ID = 2048, 0
#: Parts of texts that a worker's cache holds, and the longest ones that it takes.
MOST_PARTS, LONGEST_PART = 1_500_000, 40
#: Spaces that not every library counts as such; texts with one are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_SPACES_BEFORE = re.compile(r"\s ")
_PART = re.compile(r"\s*\S+|\s+")
#: Many words are encoded in one call, each known again by the token that has its space.
_WORD = re.compile(r"[^\s<]+")
_TOGETHER = 512


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A pre-token never goes on from what isn't white space into a white-space run, so a text's ids are those of its parts, each
    a run of white space and what follows up to the next. Parts come from the tokenizers library and are cached; those after a
    single space, which are nearly all, without it.
    """

    def __init__(self, path: str = VOCABULARY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.after_space = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # the byte-level alphabet's space

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        words = list(filter(_WORD.fullmatch, new))
        others = [x for x in new if not _WORD.fullmatch(x)]
        self.after_space.update(zip(others, self._library([" " + x for x in others])))
        for at in range(0, len(words), _TOGETHER):
            some = words[at : at + _TOGETHER]
            (ids,) = self._library([" " + " ".join(some)])
            starts = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])).tolist()
            each = [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]
            self.after_space.update(zip(some, each if len(each) == len(some) else self._library([" " + x for x in some])))

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._library([text])[0]
        if _SPACES_BEFORE.search(text):
            return b"".join(self._library(_PART.findall(text)))
        first, *parts = text.split(" ")
        known = self.after_space
        if new := {*parts}.difference(known):
            if len(known) + len(new) > MOST_PARTS:
                known.clear()
                new = {*parts}
            self._learn(list(new))
        out = b"".join([self._library([first])[0], *map(known.__getitem__, parts)])
        for part in new:
            if len(part) > LONGEST_PART:
                del known[part]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of capacity tokens but the first one, which has what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in slices(batches, 256):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                ids = own.encode(text) + last
                out += [(doc, k, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cuts(len(ids) // 4, capacity))]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with the end id, cut where they exceed the capacity.

    Null and empty texts are the end id alone; rows of a repeated or null doc_id are documents of their own. Other columns
    of docs are ignored. Texts are encoded whole; a special token's string in a text is that token, as the library has it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(vocabulary, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, of so many pieces of each length: (length, lo, hi, each, first, offset).

    Pieces lo to hi - 1 of a length lie in sequences from first on, each (the last one of them maybe fewer) in a sequence,
    one after another from offset on. Best fit fills a sequence with a length as long as it has room, since after each piece
    it is the fullest that fits; so like sequences are filled alike, and only the last one of a lot can differ.
    A lot is touched at most once for each length that it holds, and a sequence of 2048 tokens holds at most 63 different ones;
    each length makes at most one lot more and one last sequence. That bounds the plan, whatever the number of pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out, made = [], 0
    for length in sorted(counts, reverse=True):
        left, lo, r = counts[length], 0, length
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit into {capacity}")
        while left:
            while r <= capacity and not room[r]:
                r += 1
            if r > capacity:
                r = capacity
                n = -(-left // (capacity // length))
                room[capacity].append((made, n))
                made += n
            first, n = room[r].pop()
            each = r // length
            used = min(n, -(-left // each))
            if used < n:
                room[r].append((first + used, n - used))
            some = min(left, used * each)
            over = some - (used - 1) * each  # pieces in the last of these sequences
            if over < each:
                room[r - over * length].append((first + used - 1, 1))
            if full := used - (over < each):
                room[r - each * length].append((first, full))
            out.append((length, lo, lo + some, each, first, capacity - r))
            left, lo = left - some, lo + some
    return out


def _ranks(column: int, capacity: int, schema: pa.Schema):
    """Adds each row's task and its place among the rows of its length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = np.asarray(batch.column(column).to_numpy(zero_copy_only=False))
            if len(lengths) and (batch.column(column).null_count or lengths.min() < 1 or lengths.max() > capacity):
                raise ValueError(f"lengths must be from 1 to {capacity}")
            order = np.argsort(lengths, kind="stable")
            counts = np.bincount(lengths, minlength=capacity + 1)
            nth = np.empty(len(lengths), np.int64)
            nth[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
            nth += seen[lengths]
            seen += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(nth), part, np.int32)), pa.array(nth)], names=[*schema.names, "_part", "_nth"])

    return run


def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """rows with sequence_id and offset: best-fit packing of rows by their length, from 1 to capacity (others are an error).

    Each sequence is filled from offset 0 on without gaps. Sequences are numbered from 0 without gaps; which of the pieces of
    one length takes which slot follows the order of the table's parts. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = to_arrow_schema(rows.schema)
    kinds = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_nth", LongType())])
    placed = settle(rows.mapInArrow(_ranks(rows.columns.index(length), capacity, schema), kinds))
    by_part = settle(placed.groupBy("_part", F.col(length).alias("_length")).agg(F.count("*").alias("_n")))
    counts = {r._length: r.n for r in by_part.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}  # a row a length, at most capacity
    slots = plan(counts, capacity)
    columns = ("_length", "_lo", "_hi", "_each", "_first", "_offset")
    table = pa.table({c: pa.array([s[i] for s in slots], pa.int64()) for i, c in enumerate(columns)})
    slots = rows.sparkSession.createDataFrame(table)
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    moved = by_part.select("_part", "_length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = placed.withColumn("_length", F.col(length)).join(moved, ["_part", "_length"]).withColumn("_rank", F.col("_nth") + F.col("_before"))
    fits = (at["_length"] == slots["_length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    nth = F.col("_rank") - F.col("_lo")
    place = F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col(length)
    # the plan's rows are bounded by the capacity alone
    return at.join(F.broadcast(slots), fits).select(*rows.columns, (F.col("_first") + F.floor(nth / F.col("_each"))).alias("sequence_id"), place.alias("offset"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
