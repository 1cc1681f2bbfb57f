"""Secrets in text: assignments, access keys and long hex runs, and random strings found by token efficiency.

The test for random strings: prose and identifiers take few tokens of a public byte-level vocabulary, 3 or more
characters each; random base64, hex or key material takes about one token for every 1.5 characters. Runs of key
characters are encoded with tiktoken; those with few characters a token are secrets, unless they are digests of known
lengths, UUIDs, numbers, lists of one or two characters, or names made of words. Words joined to a key dilute it: of a
run that is not random as a whole, what lies between its words is scored, and each part between separators.

Long runs are found in numpy over the UTF-8 bytes; regular expressions then look at those runs only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import slices, strings

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order in which spans that start together are listed; the last is what the token test adds.
KINDS = ("assign", "access", "hex", "dense")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
#: Shortest run that the token test looks at, and the characters per token up to which it is random.
LEAST_RUN, MOST_CHARS_PER_TOKEN = 20, 2.0
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_ANY_HEX = re.compile(r"[0-9a-fA-F]+")
#: Words of one case, or capitalised, with separators and numbers between them. Each run of letters and digits is taken
#: whole, in one way only, so that the time is linear in the length.
_NAME = re.compile(r"(?:[A-Z]*+[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[0-9]++)(?:[_/=+-]*+(?:[A-Z]*+[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[0-9]++))*+[_/=+-]*+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What separators delimit; a UUID is one part.
_PART = re.compile(rf"{_UUID.pattern}|[A-Za-z0-9]+")
#: Shortest name that parts a run, and least longest part of several that are scored as one.
LEAST_NAME, LEAST_PART = 4, 8
_SEPARATORS = "+/_=-"
_KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + _SEPARATORS
_IN_RUN = np.zeros(256, bool)
_IN_RUN[np.frombuffer(_KEY_CHARACTERS.encode(), np.uint8)] = True

_encodings: dict[str, object] = {}


def encoding(path: str = RANKS):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _long_runs(data: bytes, least: int = 16) -> list[tuple[int, int]]:
    """(start, end) bytes of the maximal runs of key characters of at least this many."""
    inside = _IN_RUN[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0], edges, [len(data)]])
    first = 0 if inside[0] else 1
    starts, ends = edges[first:-1:2], edges[first + 1 :: 2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def is_name(core: str, ranks: str = RANKS, most: float = MOST_CHARS_PER_TOKEN) -> bool:
    """Made of words in the usual spellings of names, and these, in lower case, take as few tokens as words do."""
    digits_apart = re.sub(r"[0-9]+", lambda m: m[0] if len(m[0]) < 5 else "_", core)
    if not _NAME.fullmatch(digits_apart):
        return False
    words = [w.lower() for w in _WORD.findall(core)]
    return sum(map(len, words)) >= most * sum(len(encoding(ranks).encode_ordinary(w)) for w in words)


def is_known(run: str, ranks: str = RANKS, most: float = MOST_CHARS_PER_TOKEN) -> bool:
    """A digest of a usual length, a UUID, a number, a list of one or two characters, or a name made of words."""
    core = run.strip(_SEPARATORS)
    if _ANY_HEX.fullmatch(core):
        return core.isdigit() or len(core) in DIGEST_LENGTHS
    if _UUID.fullmatch(core) or not re.search(r"[A-Za-z]", core):
        return True
    words = re.findall(r"[A-Za-z]+", core)
    if not re.search(r"[0-9]", core) and max(map(len, words)) <= 2:
        return True
    return max(map(len, words)) >= 5 and sum(map(len, words)) / len(words) >= 3.5 and is_name(core, ranks, most)


def is_dense(run: str, ranks: str = RANKS, most: float = MOST_CHARS_PER_TOKEN) -> bool:
    """Few characters a token, and not a known digest or identifier."""
    return len(run) <= most * len(encoding(ranks).encode_ordinary(run)) and not is_known(run, ranks, most)


def _parts_run(part: str, ranks: str) -> bool:
    """Whether a part of a run is no piece of a key: a UUID, a digest, or a name."""
    if _UUID.fullmatch(part) or (_ANY_HEX.fullmatch(part) and len(part) in DIGEST_LENGTHS):
        return True
    return len(part) >= LEAST_NAME and not part.isdigit() and is_name(part, ranks)


def dense_spans(run: str, ranks: str = RANKS) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run of key characters: all of it; else what lies between names, if that is
    random with its separators; else single parts. Each has LEAST_RUN characters or more."""

    def fits(a: int, b: int) -> bool:
        return b - a >= LEAST_RUN and is_dense(run[a:b], ranks)

    if fits(0, len(run)):
        return [(0, len(run))]
    groups: list[list[tuple[int, int]]] = [[]]
    for m in _PART.finditer(run):
        if _parts_run(m[0], ranks):
            groups += [[m.span()], []]
        else:
            groups[-1].append(m.span())
    found = []
    for some in filter(None, groups):
        whole = (some[0][0], some[-1][1])
        if len(some) > 1 and max(b - a for a, b in some) >= LEAST_PART and fits(*whole):
            found.append(whole)
        else:
            found += [span for span in some if fits(*span)]
    return found


def _rest(runs: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of the runs beside the spans taken, both in order of start; LEAST_RUN characters or more."""
    spans = iter([*taken, (1 << 62, 1 << 62)])
    x, y = next(spans)
    for a, b in runs:
        while y <= a:
            x, y = next(spans)
        while x < b:
            if x - a >= LEAST_RUN:
                yield a, x
            a = max(a, y)
            if y > b:
                break
            x, y = next(spans)
        if b - a >= LEAST_RUN:
            yield a, b


def scan_text(text: str, ranks: str = RANKS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets in a text, in code points, by start and then kind as KINDS lists them.

    The token test sees what the other kinds leave of each run: their spans are reported already. Null and empty texts
    have no secrets; the time is linear in the text, whatever it holds.
    """
    found: list[tuple[str, int, int]] = []
    if not text:
        return found
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    data = text.encode()
    if runs := _long_runs(data):
        if len(data) != len(text):  # code points before each byte
            at = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
            runs = [(int(at[a]), int(at[a]) + b - a) for a, b in runs]
        for a, b in runs:
            run = text[a:b]
            found += [("access", a + m.start(), a + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= LEAST_ACCESS]
            found += [("hex", a + m.start(), a + m.end()) for m in HEX.finditer(run)]
        for a, b in _rest(runs, sorted((a, b) for _, a, b in found)):
            if a and text[a - 1] in _KEY_CHARACTERS:  # a span ends here: the mark after it is no part of a key
                a = b - len(text[a:b].lstrip(_SEPARATORS))
            found += [("dense", a + p, a + q) for p, q in dense_spans(text[a:b], ranks)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "<secret>") -> str:
    """text with each span, or run of overlapping spans, replaced by the mask."""
    out, at, until = [], 0, -1
    for _, a, b in spans:
        if a >= max(until, at):
            out += [text[at:a], mask]
            at = until = b
        else:
            at = until = max(until, b)
    return "".join([*out, text[at:]])


def _scan(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan_text(t, ranks)] for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, spans) of every row of docs (doc_id, text), spans as scan_text gives them. Null text counts as empty;
    a text without secrets has an empty list; rows repeat as in docs; other columns are ignored. No shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(ranks), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """docs with each secret replaced by a mask; texts without one, nulls and all other columns stay as they are
    (but n_chars, where there is one, follows a changed text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns, names = list(batch.columns), batch.schema.names
            texts = batch.column("text").to_pylist()
            spans = [scan_text(t or "", ranks) for t in texts]
            if any(spans):
                texts = [redact(t, s) if s else t for t, s in zip(texts, spans)]
                columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    old = columns[at].to_pylist()
                    columns[at] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, old)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = KINDS[:3]
    for batch in slices(batches, 4096):
        spans = [[(s["kind"], s["start"], s["end"]) for s in some] for some in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in some) for some in spans], pa.int64()) for k in base]
        digest = [hashlib.sha256(joined(s for s in some if s[0] in base).encode()).hexdigest() for some in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([joined(s) for s in spans], pa.string())], names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.mapInArrow(_report, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
