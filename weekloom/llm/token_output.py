"""Token ids as Parquet list columns.

Texts are range-partitioned and sorted by doc_id, encoded with a public word-level BPE, and written by Spark's Parquet
writer: ids dictionary-encoded in a list column, doc_id, start and n_tokens delta-encoded (writer version 2), row
groups of bounded size with page indexes. Readers that want metadata only, or some documents only, read just those
columns and pages. Each file knows its place in the order; a manifest of one row a file, written beside the files, turns
offsets within a file into offsets within the table.

Encoding is cached by parts of a text: no pre-token of the vocabulary spans white space, so the ids of a text are those
of its words in a row. Each part's ids come from the tokenizers library; the cache is bounded.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.llm.common import checkpoint_dir, slices, strings

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Characters of a text by which rows of one doc_id are dealt over files.
BEGINNING = 32
#: Folder of the manifest within that of the files; readers of the files pass over names that start so.
MANIFEST = "_manifest"
#: Parts of texts that a worker's cache holds before it drops the less used.
MOST_PARTS = 400_000
#: Files up to which the manifest, of 12 bytes a file, is broadcast.
MOST_BROADCAST = 100_000
WRITE_OPTIONS = {
    "compression": "snappy",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
}
#: Texts without any of these are cut as the pre-tokenizer cuts them, by _PART; others only at blanks and newlines.
_ODD = re.compile(r"[^\n -&(-~À-ÖØ-öø-ÿ]|<\|")
_PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Words of letters that are encoded in one call, each known again by the end of its last token.
_TOGETHER = 2048


class _Parts(dict):
    """Index of each part of a text; an unknown one is queued."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = at = len(self)
        self.new.append(part)
        return at


class Encoder:
    def __init__(self, path: str = VOCABULARY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.parts = _Parts()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        """Keep the half of the parts that was used most."""
        n = len(self.parts)
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: MOST_PARTS // 2])
        names, lengths, ids = list(self.parts), self.lengths[keep], self._ids(keep)
        self._reset()
        self.parts.update({names[i]: at for at, i in enumerate(keep.tolist())})
        self._store(np.arange(len(keep)), ids, lengths)

    def _ids(self, index: np.ndarray) -> np.ndarray:
        """The ids of parts, in a row."""
        n = self.lengths[index]
        return self.flat[np.repeat(self.starts[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _store(self, at: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.parts) > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[at], self.lengths[at] = self.used + np.cumsum(lengths) - lengths, lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words of letters, which are one pre-token each."""
        encoded = self.tokenizer.encode_batch_fast([" ".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)], add_special_tokens=False)
        ids = np.array([i for e in encoded for i in e.ids], np.int32)
        n = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        return (ids, n) if len(n) == len(words) else self._any(words)

    def _any(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return np.array([i for e in encoded for i in e.ids], np.int32), np.array([len(e.ids) for e in encoded], np.int64)

    def _learn(self) -> None:
        """Encode the queued parts."""
        first, new = len(self.parts) - len(self.parts.new), self.parts.new
        is_word = np.fromiter((_LETTERS.fullmatch(x) is not None for x in new), bool, len(new))
        for where, how in ((is_word, self._words), (~is_word, self._any)):
            at = np.flatnonzero(where)
            if len(at):
                self._store(first + at, *how([new[i] for i in at]))
        self.parts.new = []

    @staticmethod
    def _cut(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ") if _ODD.search(text) else _PART.findall(text.lower())

    def encode(self, texts: list[str], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of each text (one more than texts). With end, each text ends with that id."""
        if len(self.parts) > MOST_PARTS:
            self._shrink()
        take = self.parts.__getitem__
        index = [np.fromiter(map(take, self._cut(t)), np.int64) for t in texts]
        if self.parts.new:
            self._learn()
        counts = [len(x) for x in index]
        every = np.concatenate(index) if index else np.zeros(0, np.int64)
        self.uses[: len(self.parts)] += np.bincount(every, minlength=len(self.parts))
        ids, ends = self._ids(every), np.cumsum(self.lengths[every])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        if end is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], end).astype(np.int32, copy=False), bounds + np.arange(len(bounds))


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, own = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in slices(batches, 256):
            ids, at = own.encode(strings(batch.column(1)), end)
            n = np.diff(at)
            tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n.astype(np.int64)), tokens], names=["doc_id", "part", "start", "n_tokens", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) as token files in ascending doc_id order, null ids first, repeated ids by text. Rows of one id
    or of none are dealt over files like others; only texts that agree in their first BEGINNING characters stay together.

    Null and empty texts hold the end id only. Other columns of docs are ignored; an empty table gives an empty one.
    """
    begin, shorter = F.substring("text", 1, BEGINNING), F.coalesce(F.length("text"), F.lit(0)) < BEGINNING
    # rows of one id that begin alike and are shorter are the same
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), begin.alias("_begin"), F.when(shorter, F.monotonically_increasing_id()).alias("_nth"))
    dealt = dealt.repartitionByRange("doc_id", "_begin", "_nth").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    encoded = dealt.mapInArrow(_encode(vocabulary, end_id), "doc_id long, part int, start long, n_tokens long, tokens array<int>")
    encoded.write.options(**WRITE_OPTIONS).parquet(path)
    totals = docs.sparkSession.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/{MANIFEST}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): tokens in the files before each file. One row a file."""
    return spark.read.schema("part int, base long").parquet(f"{path}/{MANIFEST}")


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("n_tokens", "tokens")) -> DataFrame:
    """doc_id, start in the whole table, and the wanted columns; a filter on doc_id reaches row groups and pages."""
    files = spark.read.parquet(path).select("doc_id", "part", F.col("start").alias("local"), *columns)
    bases = manifest(spark, path)
    if bases.count() <= MOST_BROADCAST:  # one row a file; beyond this an ordinary join
        bases = F.broadcast(bases)
    return files.join(bases, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), *columns)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(2)
        at, ids = tokens.offsets.to_numpy(), memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path, ("tokens",)).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
