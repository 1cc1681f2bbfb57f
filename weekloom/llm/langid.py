"""Language identification by unigram pieces with segmentations summed out.

A word (a run of letters, lower-cased, with U+2581 in front) can be cut into pieces of a fixed public vocabulary in many
ways. Each language has a probability for every piece; the probability of a word is the sum over all its segmentations,
by the forward algorithm, and that of a text the product over its words. Piece probabilities are learned by expectation
maximisation: forward and backward sums over distinct words with their counts give expected piece counts, summed over
the cluster. Characters that no piece covers have one small probability in every language.

Pieces are those of the vocabulary that are lower-case letters, with or without the word mark: 22 239 of the 32 000 of the
default one. Words are worked on in numpy, many of one length at a time, and a worker keeps the scores of words it has
met. A word of any length is one lattice: sums are brought back into range every few characters, by factors that are kept
as logarithms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.llm.common import settle, slices, strings

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Labelled texts of each language that a model is fitted on, about, at most (those of smallest hash), and rounds.
SAMPLE, ROUNDS = 2000, 3
#: Languages that a model tells apart, at most: those of most labelled rows. A column of it has 180 kB.
MOST_LANGUAGES = 256
#: Count added to every piece; probability of a character without a piece.
SMOOTHING, UNKNOWN = 0.02, 1e-8
#: Letters up to which words of one length are worked on together; longer ones are worked on one by one.
SHORT_WORD = 40
#: Scale of each character's probability, against underflow of short words; it cancels out.
_SCALE = 1e3
#: Words, letters of them, and scores (words by languages), that a worker's memory of scores holds.
MOST_WORDS, MOST_LETTERS, MOST_SCORES = 300_000, 20_000_000, 1 << 24
NONE = "und"
_WORD = re.compile(r"[^\W\d_]+")
_RADIX = 0x9E3779B97F4A7C15


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower())


def has_letter(text: str, found: list[str]) -> bool:
    return bool(found) and (any(w.isalpha() for w in found[:20]) or any(map(str.isalpha, text)))


class Lattice:
    """All places of the vocabulary's pieces in words, found by hashing substrings."""

    def __init__(self, path: str = VOCABULARY) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        pieces = sorted(p for p in pieces if (p[1:] if p[0] == "▁" else p + "a").isalpha() and p == p.lower())
        codes = [np.array([self._hash(p)], np.uint64)[0] for p in pieces]
        order = np.argsort(codes)
        self.pieces, self.codes = [pieces[i] for i in order], np.array(codes, np.uint64)[order]
        self.longest = max(map(len, self.pieces))
        # what a substring of equal hash must agree in besides
        self.size = np.fromiter(map(len, self.pieces), np.int64, len(pieces))
        self.ends = np.array([(ord(p[0]) + 1, ord(p[-1]) + 1) for p in self.pieces], np.uint64)
        self.powers = np.array([pow(_RADIX, i, 1 << 64) for i in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _RADIX + ord(c) + 1) % (1 << 64)
        return h

    def _known(self, code: np.ndarray, length: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, pieces) of the hashes that are those of pieces."""
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        rows = np.flatnonzero(self.codes[at] == code)
        if len(rows):
            found = at[rows]
            rows = rows[(self.size[found] == length) & (self.ends[found, 0] == first[rows]) & (self.ends[found, 1] == last[rows])]
        return rows, at[rows]

    def _prefixes(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m = len(some[0]) + 1
        points = np.frombuffer("".join("▁" + w for w in some).encode("utf-32-le"), "<u4").reshape(len(some), m).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((m + 1, len(some)), np.uint64)
        for i in range(m):
            prefix[i + 1] = prefix[i] * np.uint64(_RADIX) + points[:, i]
        return points, prefix

    def places(self, some: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, rows, pieces) of each place in words of one length, by end; piece -1 is any other character."""
        points, prefix = self._prefixes(some)
        for end in range(1, len(prefix)):
            for length in range(1, min(end, self.longest) + 1):
                rows, pieces = self._known(prefix[end] - prefix[end - length] * self.powers[length], length, points[:, end - length], points[:, end - 1])
                if length == 1:
                    single = np.full(len(some), -1)
                    single[rows] = pieces
                    yield end, 1, np.arange(len(some)), single
                elif len(rows):
                    yield end, length, rows, pieces

    def long_places(self, word: str) -> list[list[tuple[int, int]]]:
        """(length, piece) of the places that end at each character of one word; piece -1 is any other character."""
        points, prefix = (x.ravel() for x in self._prefixes([word]))
        found: list[list[tuple[int, int]]] = [[] for _ in prefix]
        for length in range(1, min(len(points), self.longest) + 1):
            rows, pieces = self._known(prefix[length:] - prefix[:-length] * self.powers[length], length, points[: len(points) - length + 1], points[length - 1 :])
            for row, piece in zip(rows.tolist(), pieces.tolist()):
                found[row + length].append((length, piece))
        for some in found[1:]:
            if not some or some[0][0] != 1:
                some.insert(0, (1, -1))
        return found

    def _long_sums(self, found: list[list[tuple[int, int]]], table: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """(sums, logarithms of their factors) at each place of a long word, over all segmentations before it (after it)."""
        m, reach = len(found) - 1, self.longest
        sums, logs, now = np.zeros((m + 1, table.shape[1])), np.zeros((m + 1, table.shape[1])), np.zeros(table.shape[1])
        sums[m if back else 0] = 1
        for step in range(1, m + 1):
            at = m + 1 - step if back else step
            for length, piece in found[at]:
                if back:
                    sums[at - length] += sums[at] * table[piece]
                else:
                    sums[at] += sums[at - length] * table[piece]
            if step % reach == 0:  # what lies within reach of later places
                part = slice(max(0, at - reach), at) if back else slice(at - reach + 1, at + 1)
                size = sums[part].max(axis=0)
                sums[part] /= size
                now = now + np.log(size)
                logs[part] = now
            elif not back:
                logs[at] = now
            else:
                logs[max(0, at - reach) : at] = now
        return sums, logs

    def _forward_long(self, word: str, table: np.ndarray) -> np.ndarray:
        sums, logs = self._long_sums(self.long_places(word), table, False)
        return np.log(sums[-1]) + logs[-1]

    def _expected_long(self, word: str, n: float, column: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, own = self.long_places(word), table[:, [column]]
        (before, log_before), (after, log_after) = (self._long_sums(found, own, back) for back in (False, True))
        whole = np.log(before[-1, 0]) + log_before[-1, 0]
        places = [(end, length, piece) for end, some in enumerate(found) for length, piece in some if piece >= 0]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        end, length, piece = np.array(places).T
        with np.errstate(divide="ignore"):
            logs = np.log(before[end - length, 0]) + log_before[end - length, 0] + np.log(own[piece, 0]) + np.log(after[end, 0]) + log_after[end, 0] - whole
        return piece * table.shape[1] + column, np.exp(logs) * n

    def forward(self, some: list[str], table: np.ndarray) -> np.ndarray:
        """Log probability of each word under each column of table (pieces and, last, the unknown character)."""
        if len(some[0]) > SHORT_WORD:
            return np.array([self._forward_long(w, table) for w in some])
        m = len(some[0]) + 1
        alpha = np.zeros((m + 1, len(some), table.shape[1]))
        alpha[0] = 1
        for end, length, rows, pieces in self.places(some):
            alpha[end, rows] += alpha[end - length, rows] * table[pieces] * _SCALE**length
        return np.log(alpha[m]) - m * np.log(_SCALE)

    def expected(self, some: list[str], n: np.ndarray, column: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells piece * columns + column, expected counts) of words of one length, each n times, in their own column."""
        if len(some[0]) > SHORT_WORD:
            cells, counts = zip(*(self._expected_long(w, k, c, table) for w, k, c in zip(some, n.tolist(), column.tolist())))
            return np.concatenate(cells), np.concatenate(counts)
        m, wide = len(some[0]) + 1, table.shape[1]
        found = list(self.places(some))
        alpha, beta = np.zeros((m + 1, len(some))), np.zeros((m + 1, len(some)))
        alpha[0], beta[m] = 1, 1
        for end, length, rows, pieces in found:
            alpha[end, rows] += alpha[end - length, rows] * table[pieces, column[rows]] * _SCALE**length
        for end, length, rows, pieces in reversed(found):
            beta[end - length, rows] += beta[end, rows] * table[pieces, column[rows]] * _SCALE**length
        share = n / alpha[m]
        cells, counts = [], []
        for end, length, rows, pieces in found:
            if length == 1:
                rows, pieces = rows[pieces >= 0], pieces[pieces >= 0]
            cells.append(pieces * wide + column[rows])
            counts.append(alpha[end - length, rows] * beta[end, rows] * table[pieces, column[rows]] * _SCALE**length * share[rows])
        return np.concatenate(cells), np.concatenate(counts)


_lattices: dict[str, Lattice] = {}


def lattice(path: str = VOCABULARY) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def by_length(some: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of one length, at most 8192 at a time."""
    size = np.fromiter(map(len, some), np.int64, len(some))
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        for at in range(0, len(group), 8192):
            yield group[at : at + 8192]


class Model:
    """Languages and the probabilities of pieces in each; table has a row for the unknown character at its end."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str = VOCABULARY) -> None:
        self.languages, self.table, self.path = languages, table, path


class Scorer:
    """Log probabilities of texts, with a bounded memory of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, lattice(model.path)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((1 << 12, len(self.model.languages)))

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """A row for each list of words."""
        wide = len(self.model.languages)
        if len(self.index) > MOST_WORDS or self.letters > MOST_LETTERS or len(self.index) * wide > MOST_SCORES:
            self.reset()
        known = len(self.index)
        index = self.index
        place = [[index.setdefault(w, len(index)) for w in some] for some in texts]
        new = list(index)[known:] if len(index) > known else []
        self.letters += sum(map(len, new))
        while len(index) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for rows in by_length(new):
            self.scores[known + rows] = self.lattice.forward([new[i] for i in rows], self.model.table)
        lot = max(1, MOST_SCORES // wide)  # words whose scores are taken out at a time
        return np.array([sum((self.scores[p[at : at + lot]].sum(axis=0) for at in range(0, len(p), lot)), np.zeros(wide)) for p in place])


def _word_counts(languages: list[str]):
    column = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}

        def rows() -> pa.RecordBatch:
            flat = [(c, w, n) for c, some in counts.items() for w, n in some.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*flat)) or [()] * 3, (pa.int32(), pa.string(), pa.int64()))], names=["language", "word", "n"])

        for batch in slices(batches, 64):
            for text, lang in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                counts.setdefault(column[lang], Counter()).update(words(text))
            if sum(map(len, counts.values())) > MOST_WORDS:
                yield rows()
        yield rows()

    return run


def _expectation(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = lattice(model.path), np.zeros(model.table.size)
        for batch in batches:
            column, some, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for rows in by_length(some):
                cells, counts = own.expected([some[i] for i in rows], n[rows], column[rows], model.table)
                total += np.bincount(cells, counts, len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells])], names=["cell", "n"])

    return run


def _probabilities(counts: np.ndarray) -> np.ndarray:
    counts = counts + SMOOTHING
    return np.vstack([counts / counts.sum(axis=0), np.full((1, counts.shape[1]), UNKNOWN)])


def train(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str = VOCABULARY, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """A model of (text, lang, hash) rows without null lang; None if there are none.

    Of a language with more than sample rows, those of smallest hash count: about sample of them. Of more than most_languages
    languages, those of most rows are learned, ties by name. What the driver holds is one row a learned language, and the table
    of pieces by languages.
    """
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    n = {r.lang: r.n for r in most.collect()}
    if not n:
        return None
    languages = sorted(n)
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / n[lang])))))[F.col("lang")]
    chosen = labelled.filter(F.pmod(F.col("hash"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    counts = settle(chosen.select("text", "lang").mapInArrow(_word_counts(languages), "language int, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n")))
    pieces, wide = len(lattice(path).pieces), len(languages)
    model = Model(languages, _probabilities(np.ones((pieces, wide))), path)
    for _ in range(rounds):
        got = counts.mapInArrow(_expectation(model), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros((pieces + 1) * wide)
        table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        model = Model(languages, _probabilities(table.reshape(-1, wide)[:pieces]), path)
    return model


_scorers: dict[int, Scorer] = {}


def _predict(shared):
    """(row, lang_pred, score) of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if (scorer := _scorers.get(shared.id)) is None:
            _scorers.clear()
            scorer = _scorers[shared.id] = Scorer(model)
        for batch in slices(batches, 256):
            texts = strings(batch.column(1))
            found = [words(t) for t in texts]
            log = scorer(found)
            best = log.argmax(axis=1)
            score = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
            ok = [has_letter(t, w) for t, w in zip(texts, found)]
            lang = [model.languages[b] if y else NONE for b, y in zip(best, ok)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0))], names=["row", "lang_pred", "score"])

    return run


class _Shared:
    """A broadcast model with a name that workers know it by."""

    def __init__(self, spark: SparkSession, model: Model) -> None:
        self.broadcast = spark.sparkContext.broadcast(model)
        self.id = (spark.sparkContext.applicationId, self.broadcast._jbroadcast.id())

    def __reduce__(self):
        return _Received, (self.broadcast, self.id)


class _Received:
    def __init__(self, broadcast, name) -> None:
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> Model:
        return self.broadcast.value


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predicted(docs: DataFrame, sample: int = SAMPLE, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """(row, lang_pred, score): each row of docs as one struct, so that its columns may have any names, in its partitions.

    Learned from text and lang of the rows of docs with a lang whose crc32(doc_id as text) mod 5 is not 0 (a row without
    doc_id never is learned from), of the most_languages languages that have most of them. Prediction sees the text only. "und" with score 0: no letter, null or empty text, or
    nothing to learn from. score is the posterior of the prediction with equal priors; ties go to the first language.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    model = train(rows.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("hash")), sample, most_languages=most_languages)
    whole = docs.select(F.struct("*").alias("row"), F.col("text"))
    if model is None:
        return whole.select("row", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([whole.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return whole.mapInArrow(_predict(_Shared(docs.sparkSession, model)), schema)


def accepted(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """docs without those whose language cannot be told: "und", or a posterior under least_score."""
    return predicted(docs).filter((F.col("lang_pred") != NONE) & (F.col("score") >= least_score)).select("row.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predicted(docs).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
