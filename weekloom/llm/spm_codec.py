"""SentencePiece encoding with offsets, and decoding.

Normalisation is done here: the longest prefix in the model's compiled character map (a double-array trie followed by
replacement strings) is replaced, blanks become U+2581, a blank may be put in front, and each byte made records the
source bytes it came from. The normalised text is what is encoded, by the library with the model's own normalisation
taken out; it is compared with the library's normalisation of each text first, and a text for which they differ is left
to the library, spans and all. Pieces follow each other without a gap in the normalised text, so their byte lengths add
up to spans in it and, through the record, in the source. A piece that is one byte of a character spans that byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2

from weekloom.llm.common import slices, strings

MODEL = public_tokenizers.path("piece_bpe_32k.model")
_SPACE = "▁".encode()


class CharacterMap:
    """The compiled map: uint32 size of the trie, its units, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """(length, place of the replacement) of the longest key that text has at this place."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = i - at + 1, units[node] & 0x7FFFFFFF
        return found

    def replacement(self, place: int) -> bytes:
        return self.replacements[place : self.replacements.index(b"\0", place)]


class Normalizer:
    def __init__(self, spec) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.known: dict[bytes, tuple[int, bytes]] = {}

    def normalize(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the source byte at which its unit starts."""
        if not self.map.units and not self.squeeze:
            return self._plain(source)
        return self._general(source)

    def _plain(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map nothing but blanks changes: sizes, offsets and copies in numpy."""
        if not source:
            return b"", np.zeros(1, np.int64)
        space = _SPACE if self.escape else b" "
        text = np.frombuffer(source, np.uint8)
        sizes = np.where(text == 32, len(space), 1)
        front = len(space) if self.prefix else 0
        start = np.empty(front + int(sizes.sum()) + 1, np.int32 if len(text) < 1 << 31 else np.int64)
        start[:front] = 0
        start[front:-1] = np.repeat(np.arange(len(text)), sizes)
        start[-1] = len(text)
        return (space if self.prefix else b"") + source.replace(b" ", space), start

    def _unit(self, source: bytes, at: int) -> tuple[int, bytes, int]:
        """(bytes read, bytes made, step: 1 if each byte made is its own, 0 if all stand for the whole)."""
        if found := self.map.longest(source, at):
            return found[0], self.map.replacement(found[1]), 0
        lead = source[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, source[at : at + n], 1

    def _general(self, source: bytes) -> tuple[bytes, np.ndarray]:
        space = _SPACE if self.escape else b" "
        units, at = [], 0
        while at < len(source):
            n, new, step = self._unit(source, at)
            units.append((at, new, step))
            at += n
        if self.squeeze:
            while units and units[0][1].strip(b" ") == b"":
                units.pop(0)
        out, starts, after_space = bytearray(), [], False
        if units and self.prefix:
            out += space
            starts += [units[0][0]] * len(space)
            after_space = self.squeeze
        for at, new, step in units:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            for i, c in enumerate(new):
                made = space if c == 32 else bytes([c])
                out += made
                starts += [at + i * step] * len(made)
            if new:
                after_space = self.squeeze and new.endswith(b" ")
        end = len(source)
        while self.squeeze and out.endswith(space):
            end = starts[-len(space)]
            del out[-len(space) :], starts[-len(space) :]
        return bytes(out), np.array([*starts, end], np.int64)


class Codec:
    def __init__(self, path: str = MODEL) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(self.processor.serialized_model_proto())
        self.normalizer = Normalizer(model.normalizer_spec)
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = self.processor.unk_id()
        self.names = [str(i) for i in range(len(model.pieces))]
        plain = model.normalizer_spec
        plain.precompiled_charsmap = b""
        plain.add_dummy_prefix = plain.remove_extra_whitespaces = plain.escape_whitespaces = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text: ids as the library gives them, source byte spans of the pieces."""
        made = [self.normalizer.normalize(t.encode()) for t in texts]
        normal = [m.decode() for m, _ in made]
        ids = self.inner.encode(normal, num_threads=1)
        checked = self.processor.normalize(texts)
        return [
            (some, *self._spans(some, len(m), start)) if mine == theirs and self.unknown not in some else self._library(text)
            for text, some, (m, start), mine, theirs in zip(texts, ids, made, normal, checked)
        ]

    def _library(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        pieces = self.processor.encode(text, return_type="proto").pieces
        return [p.id for p in pieces], *(np.fromiter((getattr(p, n) for p in pieces), np.int64, len(pieces)) for n in ("begin", "end"))

    def _spans(self, ids: list[int], size: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte spans (starts, ends) of the pieces of a normalised text; pieces of one replaced unit share its bytes."""
        ends = np.cumsum(self.sizes[np.fromiter(ids, np.int64, len(ids))])
        if (int(ends[-1]) if len(ids) else 0) != size:
            raise ValueError("the pieces do not add up to the normalised text")
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ids)]
        stops = start[ends].astype(np.int64)
        # a piece that ends inside a unit reaches to the unit's end
        inside = (ends < size) & (start[np.maximum(ends - 1, 0)] == stops) if len(ids) else np.zeros(0, bool)
        if inside.any():
            unit = np.unique(start)
            stops = np.where(inside & (begins < ends), unit[np.minimum(np.searchsorted(unit, stops, "right"), len(unit) - 1)], stops)
            front = len(_SPACE if self.normalizer.escape else b" ") if self.normalizer.prefix else 0
            stops = np.where(ends <= front, start[0], stops)  # the blank put in front has no source
        return start[begins].astype(np.int64), stops

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)


_codecs: dict[str, Codec] = {}


def codec(path: str = MODEL) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_batch(batch: pa.RecordBatch, path: str = MODEL) -> list[tuple[object, list[int], np.ndarray, np.ndarray, str]]:
    """(doc_id, ids, span starts, span ends, decoded text) of each row of (doc_id, text). A text that repeats in the batch,
    as copies of a mix do, is encoded once."""
    own, texts = codec(path), strings(batch.column(1))
    each = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    made = own.encode(list(each))
    decoded = own.decode([ids for ids, _, _ in made])
    return [(doc_id, *made[each[t]], decoded[each[t]]) for doc_id, t in zip(batch.column(0).to_pylist(), texts)]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = encode_batch(batch, path)
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "ids", "starts", "ends", "decoded"])

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) of every row of docs (doc_id, text): ids of the whole text as the library
    gives them, the byte span of each in the text's UTF-8, and the library's decoding of the ids. Null counts as empty;
    an empty text has no ids. Rows repeat as they do in docs; other columns are ignored."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_encoded(path), "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, own = lambda b: hashlib.sha256(b).hexdigest(), codec(path)
        name = own.names.__getitem__
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()))
        for batch in slices(batches, 64):
            out = []
            for doc_id, ids, starts, ends, decoded in encode_batch(batch, path):
                spans = np.stack([starts, ends], axis=1).astype("<i8").tobytes()
                out.append((doc_id, len(ids), sha(",".join(map(name, ids)).encode()), sha(decoded.encode()), sha(spans), ids))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "ids"])

    return run


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """What encode() gives of each row, as digests made in the same pass, and the ids; spans_sha256 is that of each piece's
    start and end byte in the source, as little-endian 64-bit integers in turn."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, ids array<int>")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
