"""Language identification with segmentation-marginalised unigram models.

Every language has a probability for each piece of one fixed public
vocabulary. A word's probability is the sum over all ways to cut it into
pieces, found by the forward algorithm, and a text's is the product over its
words. The probabilities are learned by expectation-maximisation: a job per
round adds up the expected piece counts of each language.

A word is a run of letters, in lower case, with the word-start mark of the
vocabulary before it. Longer runs than ``RUN`` letters are taken in parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.common import chunks, fold, held_out, keyed

START = "▁"
RUN = 48
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-5
SMOOTHING = 0.1
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, in parts of at most ``RUN``; none if the text has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    if not any(w[0].isalpha() or any(map(str.isalpha, w)) for w in words):
        return []
    if max(map(len, words)) > RUN:
        words = [w[i:i + RUN] for w in words for i in range(0, len(w), RUN)]
    return words


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model that lower-case words can use."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p == p.lower() and (p == START or p.removeprefix(START).isalpha())})


class Lattice:
    """Finds the pieces inside many words at once, by rolling hashes of their substrings."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        for length, ids in by_length.items():
            codes = np.array([[ord(c) for c in pieces[i]] for i in ids], dtype=np.uint64)
            hashes = np.zeros(len(ids), dtype=np.uint64)
            for k in range(length):
                hashes = hashes * _MULTIPLIER + codes[:, k]
            order = np.argsort(hashes)
            self.tables[length] = hashes[order], np.array(ids, dtype=np.int32)[order]

    def edges(self, words: list[str]) -> list[np.ndarray | None]:
        """For words of one length: piece ids by substring length (index) and [word, start]; ``size`` where there is none."""
        width = len(words[0]) + 1
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width).astype(np.uint64)
        out: list[np.ndarray | None] = [None]
        hashes = np.zeros_like(codes)
        for length in range(1, min(width, max(self.tables, default=1)) + 1):
            hashes = hashes[:, :width - length + 1] * _MULTIPLIER + codes[:, length - 1:]
            if length not in self.tables:
                out.append(None)
                continue
            keys, ids = self.tables[length]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            out.append(np.where(keys[at] == hashes, ids[at], self.size))
        return out


def _weights(edges: list[np.ndarray | None], prob: np.ndarray, length: int, start: int) -> np.ndarray:
    found = prob[edges[length][:, start]]
    return np.maximum(found, UNKNOWN) if length == 1 else found


def forward(edges: list[np.ndarray | None], prob: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    """Sums over all segmentations of each prefix: one [word, language] array per prefix length."""
    alpha = [np.ones((n, prob.shape[1]))]
    for end in range(1, width + 1):
        total = np.zeros((n, prob.shape[1]))
        for length in range(1, min(end, len(edges) - 1) + 1):
            if edges[length] is not None:
                total += alpha[end - length] * _weights(edges, prob, length, end - length)
        if edges[1] is None:
            total += alpha[end - 1] * UNKNOWN
        alpha.append(total)
    return alpha


def by_length(words: list[str], most: int = 40_000) -> Iterator[np.ndarray]:
    """Places of words of one length, in bounded groups."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        for at in range(0, len(places), most):
            yield places[at:at + most]


def word_scores(lattice: Lattice, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log probability of each word under each language."""
    out = np.empty((len(words), prob.shape[1]))
    for places in by_length(words):
        group = [words[i] for i in places]
        out[places] = np.log(forward(lattice.edges(group), prob, len(group), len(group[0]) + 1)[-1])
    return out


def expected_counts(lattice: Lattice, prob: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words with the given counts, for one language's probabilities (a column)."""
    out = np.zeros(lattice.size + 1)
    for places in by_length(words):
        group = [words[i] for i in places]
        width, edges = len(group[0]) + 1, lattice.edges(group)
        alpha = forward(edges, prob, len(group), width)
        beta = [np.ones((len(group), 1)) for _ in range(width + 1)]
        for start in range(width - 1, -1, -1):
            total = np.zeros((len(group), 1))
            for length in range(1, min(width - start, len(edges) - 1) + 1):
                if edges[length] is not None:
                    weight = _weights(edges, prob, length, start) * beta[start + length]
                    total += weight
                    used = (alpha[start] * weight / alpha[width])[:, 0] * counts[places]
                    out += np.bincount(edges[length][:, start], weights=used, minlength=lattice.size + 1)
            if edges[1] is None:
                total += UNKNOWN * beta[start + 1]
            beta[start] = total
    return out[:-1]


def train(labelled: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang", rounds: int = 3,
          rows_per_language: int = 1500) -> tuple[list[str], np.ndarray]:
    """Languages in order and their [piece, language] probabilities.

    Fits on a sample of about ``rows_per_language`` whole texts a language,
    drawn by a hash of the text; languages with fewer rows give all. Rows with
    a null text or language are left out.
    """
    rows = keyed(labelled, text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((len(pieces) + 1, 0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / sizes[k]))])
    drawn = (F.pmod(F.xxhash64(text_col), F.lit(1_000_003)) / 1_000_003.0) < share[F.col(lang_col)]
    lattice = Lattice(pieces)

    def word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            seen: dict[tuple[str, str], int] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word in words_of(text):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                              pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    words = rows.where(drawn).mapInArrow(word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    prob = np.full((len(pieces) + 1, len(languages)), 1.0 / max(1, len(pieces)))
    prob[-1] = 0.0
    try:
        for _ in range(rounds):
            current = prob

            def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(pieces), len(languages)))
                for batch in batches:
                    lang, word, n = (np.array(c.to_pylist(), dtype=object) for c in batch.columns)
                    for k, name in enumerate(languages):
                        mine = np.flatnonzero(lang == name)
                        if len(mine):
                            total[:, k] += expected_counts(lattice, current[:, k:k + 1], list(word[mine]), n[mine].astype(np.float64))
                at = np.argwhere(total > 0)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[at[:, 0], at[:, 1]])], names=["piece", "k", "n"])

            sums = words.mapInArrow(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).collect()
            counts = np.full((len(pieces), len(languages)), SMOOTHING)
            for piece, k, n in sums:
                counts[piece, k] += n
            prob = np.vstack([counts / counts.sum(axis=0), np.zeros((1, len(languages)))])
    finally:
        words.unpersist()
    return languages, prob


def identify(docs: DataFrame, pieces: list[str], languages: list[str], prob: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of every row, from the text alone.

    ``score`` is the winner's share of the likelihoods, flattened by the root
    of the word count. A null text, one without letters, and any text under an
    empty model is ``und`` with score 0. Equal likelihoods give the first
    language by name. Repeated rows and null ids give a row each.
    """
    source = keyed(docs, id_col, text_col)
    schema = T.StructType([source.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast((Lattice(pieces), prob))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, table = model.value
        for batch in chunks(batches, text_col, 8 << 20):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            flat = [w for words in texts for w in words]
            if flat and languages:
                places = {w: i for i, w in enumerate(dict.fromkeys(flat))}
                codes = np.fromiter(map(places.__getitem__, flat), dtype=np.int64, count=len(flat))
                sums = np.vstack([np.zeros((1, len(languages))), np.cumsum(word_scores(lattice, table, list(places))[codes], axis=0)])
                ends = np.cumsum(sizes)
                total = sums[ends] - sums[ends - sizes]
                best = np.argmax(np.round(total, 6), axis=1)
                flat_total = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(sizes, 1))[:, None]
                share = 1.0 / np.exp(flat_total).sum(axis=1)
                for i in np.flatnonzero(sizes):
                    names[i], scores[i] = languages[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return source.mapInArrow(run, schema)


def identify_held_out(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      folds: int = 4, held: int = 2) -> DataFrame:
    """Train on the folds of the key that are not held out, and identify every row; adds ``held_out``."""
    pieces = read_pieces(vocabulary)
    training = docs.where(F.coalesce(fold(F.col(id_col), folds) != held, F.lit(True)))
    out = identify(docs, pieces, *train(training, pieces, text_col, lang_col), id_col, text_col)
    return out.withColumn("held_out", held_out(F.col(id_col), folds, held))
