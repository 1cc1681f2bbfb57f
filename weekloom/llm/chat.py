"""Chat formatting by columnar byte assembly.

Conversations become rows of formatted text with the byte spans that carry loss. The bytes of a batch are assembled at
once: segment lengths and their cumulative sums give each segment's place, and numpy copies all headers and all contents
by scatter indices into one buffer, which becomes the Arrow string column as it is.

Template, for each turn: <|turn|>ROLE, a newline, TEXT, <|end|>, a newline. In TEXT and ROLE a backslash is doubled, and
control strings (these, and those of common public templates) get a backslash after their first character, so that no
control string is left and reading back gives the very same text.

Conversations stream through a task in order of turn. One of more than PART_TURNS turns is cut into parts of that many, by
its turns' places, which are formatted by any tasks: no task gets such a conversation whole. Long texts make more parts, and a
batch goes out as soon as it holds BATCH_BYTES, so memory is bounded by these and by one turn. Sizes are those of the formatted
bytes. Index arrays of the scatter are made for SCATTER_BYTES at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import head, numbered, settle, slices, spread_join

OPEN, CLOSE = b"<|turn|>", b"<|end|>\n"
PART_TURNS, PART_BYTES, BATCH_BYTES = 4096, 16 << 20, 32 << 20
SCATTER_BYTES = 1 << 20
#: Offsets of an Arrow string column are 32 bits wide, and so is the length of a string in Spark.
MOST_BYTES = (1 << 31) - 1
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"<\||\|>|</?s>|\[/?INST\]|<</?SYS>>")
_SPECIAL = re.compile(r"[\\<|\[]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.DOTALL)
_FORMAT = "conv_id long, part long, n_turns int, formatted string, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    if not _SPECIAL.search(text):
        return text
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """As escape, and newlines, which end the role, become backslash n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def _scatter(buffer: np.ndarray, places: np.ndarray, data: bytes, lengths: np.ndarray) -> None:
    """Copy the segments that lie in a row in data to their places in the buffer, many short ones at once by their indices;
    a segment of SCATTER_BYTES or more is one copy."""
    source, ends = np.frombuffer(data, np.uint8), np.cumsum(lengths)
    starts = ends - lengths
    short = lengths < SCATTER_BYTES
    for i in np.flatnonzero(~short).tolist():
        buffer[places[i] : places[i] + lengths[i]] = source[starts[i] : ends[i]]
    places, starts, lengths = places[short], starts[short], lengths[short]
    lot = np.cumsum(lengths) // SCATTER_BYTES
    for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(lot)) + 1):
        n = lengths[part]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        buffer[np.repeat(places[part], n) + within] = source[np.repeat(starts[part], n) + within]


def assemble(head: list[bytes], body: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, row offsets, content starts, content ends) of rows of counts[i] turns each, starts within the buffer.

    head and body: escaped role and text of each turn, in UTF-8.
    """
    n_head, n_body = (np.fromiter(map(len, x), np.int64, len(x)) for x in (head, body))
    size = len(OPEN) + n_head + 1 + n_body + len(CLOSE)
    ends = np.cumsum(size)
    start = ends - size
    buffer = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    content = start + len(OPEN) + n_head + 1
    one = np.ones(len(size), np.int64)
    for places, data, lengths in ((start, OPEN * len(size), one * len(OPEN)), (start + len(OPEN), b"".join(head), n_head), (content - 1, b"\n" * len(size), one), (content, b"".join(body), n_body), (content + n_body, CLOSE * len(size), one * len(CLOSE))):
        _scatter(buffer, places, data, lengths)
    rows = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return buffer, rows, content, content + n_body


class _Open:
    """Parts of conversations that wait to be emitted."""

    def __init__(self) -> None:
        self.convs, self.parts, self.counts, self.loss, self.head, self.body, self.size = [], [], [], [], [], [], 0

    def add(self, conv, part: int, turns: list[tuple[bool, bytes, bytes]], size: int) -> None:
        self.convs.append(conv)
        self.parts.append(part)
        self.counts.append(len(turns))
        for target, own in zip((self.loss, self.head, self.body), zip(*turns)):
            target.extend(own)
        self.size += size

    def batch(self) -> pa.RecordBatch:
        counts = np.array(self.counts, np.int64)
        buffer, rows, starts, ends = assemble(self.head, self.body, counts)
        formatted = pa.StringArray.from_buffers(len(counts), pa.py_buffer(rows.astype(np.int32)), pa.py_buffer(buffer))
        loss, row = np.array(self.loss, bool), np.repeat(np.arange(len(counts)), counts)
        at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[loss], minlength=len(counts)))]).astype(np.int32))
        spans = [pa.ListArray.from_arrays(at, pa.array((x - rows[:-1][row])[loss].astype(np.int32))) for x in (starts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(self.convs, pa.int64()), pa.array(self.parts, pa.int64()), pa.array(counts.astype(np.int32)), formatted, *spans], names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: conv_id, role, text and, where conversations are cut, the place of the first turn of the part."""
    conv, begin, part, turns, size, done = None, 0, 0, [], 0, _Open()
    for batch in slices(batches, 256):
        begins = batch.column(3).to_pylist() if batch.num_columns > 3 else itertools.repeat(0)
        for c, role, text, first in zip(*(batch.column(i).to_pylist() for i in range(3)), begins):
            head, body = escape_role(role or "").encode(), escape(text or "").encode()
            own = len(OPEN) + len(head) + 1 + len(body) + len(CLOSE)
            if own > MOST_BYTES:
                raise ValueError(f"a turn of conversation {c} is {own} bytes long when formatted; a string holds {MOST_BYTES}")
            new = c != conv or first != begin
            if turns and (new or len(turns) >= PART_TURNS or size + own > PART_BYTES):
                if done.size and done.size + size > BATCH_BYTES:
                    yield done.batch()
                    done = _Open()
                done.add(conv, part, turns, size)
                part, turns, size = part + 1, [], 0
            if new:
                conv, begin, part = c, first, first
            turns.append(((role or "") == LOSS_ROLE, head, body))
            size += own
    if turns:
        if done.size and done.size + size > BATCH_BYTES:
            yield done.batch()
            done = _Open()
        done.add(conv, part, turns, size)
    if done.size:
        yield done.batch()


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss_starts, loss_ends, is_cut): conversations in the template, turns in order.

    turns: rows (conv_id, turn, role, text). Null role and text count as empty; turns that tie go by role and text, null
    turns first; rows without conv_id are one conversation with a null id. loss_starts and loss_ends are UTF-8 offsets in
    formatted of the assistant's contents. Nearly always a conversation is one part, 0. Those of more than PART_TURNS turns are
    cut (is_cut) into more, dealt over tasks; a part's number is its first turn's place, or, where long texts make several of
    it, one of those up to the next part's: their order is that of the turns. A single turn of 2 GiB or more is an error. An
    empty table gives an empty one. Other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").isNull().alias("_none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_conv"), "turn", "role", "text")
    conv, conv_id = ["_none", "_conv"], F.when(~F.col("_none"), F.col("_conv")).alias("conv_id")
    long = settle(rows.groupBy(*conv).agg(F.count("*").alias("_n")).filter(F.col("_n") > PART_TURNS).select(*conv))
    whole, some = rows, not long.isEmpty()
    if some:
        told = settle(spread_join(settle(rows), long.withColumn("_long", F.lit(True)), conv, "left"))
        whole = told.filter(F.col("_long").isNull())
    whole = whole.select(conv_id, "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = whole.select("conv_id", "role", "text").mapInArrow(_format, _FORMAT).withColumn("is_cut", F.lit(False))
    if not some:
        return out
    placed = numbered(told.filter("_long").drop("_long"), conv, ["turn", "role", "text"], "_at", ["turn", "role", head("text")])
    parts = placed.select(conv_id, "role", "text", (F.col("_at") - F.pmod(F.col("_at"), F.lit(PART_TURNS))).alias("_first"), "_at")
    parts = parts.repartition("conv_id", "_first").sortWithinPartitions("conv_id", "_first", "_at").select("conv_id", "role", "text", "_first")
    return out.unionByName(parts.mapInArrow(_format, _FORMAT).withColumn("is_cut", F.lit(True)))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_READ = "conv_id long, part long, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each formatted part says, of few bytes at a time."""
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _READ.split(", "))])
    for batch in slices(batches, 256):
        out, size = [], 0
        for conv, part, formatted, starts, ends in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
            turns, data = read_turns(formatted), formatted.encode()
            loss = "".join(unescape(data[a:b].decode()) for a, b in zip(starts, ends))
            said = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
            if out and size + len(said) > BATCH_BYTES:
                yield _rows_batch(out, schema)
                out, size = [], 0
            out.append((conv, part, len(turns), said, len(loss), loss.encode(), len(formatted)))
            size += len(said)
        yield _rows_batch(out, schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation whose parts, as read, follow each other."""
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.split() for c in _DIGESTS.split(", "))])
    now = None
    for batch in slices(batches, 256):
        out = []
        for conv, part, n_turns, turns, loss_chars, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
            if part == 0:
                if now is not None:
                    out.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for i, n in ((1, n_turns), (3, loss_chars), (5, chars)):
                now[i] += n
            now[2].update(turns)
            now[4].update(loss)
        yield _rows_batch(out, schema)
    if now is not None:
        yield _rows_batch([now], schema)


def _rows_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    rows = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _digested(_read(batches))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of format_chat's rows, which must come as format_chat leaves them. Parts of cut
    conversations are read by any tasks; a digest follows the order, so that what they say then streams through one."""
    whole, parts = formatted.filter(~F.col("is_cut")), formatted.filter("is_cut")
    parts = parts.mapInArrow(_read, _READ).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.mapInArrow(_read_back, _DIGESTS).unionByName(parts.mapInArrow(_digested, _DIGESTS))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(said).alias("text"))
    return read_back(format_chat(turns.unionByName(extra)))
