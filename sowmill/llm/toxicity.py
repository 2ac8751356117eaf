"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on the
wording that sets toxic text apart from it. A text is cut into windows of a
few words; every window is compressed with the ordinary dictionary, and with
the ordinary one followed by the toxic one. Bytes that the toxic dictionary
saves show toxic wording. How many bytes count, and how many windows, is
calibrated on labelled rows; the score is a probability whose best threshold
is moved to ``CUT``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.common import chunks, fold, held_out, keyed

WINDOW_WORDS = 3
CUT = 0.3
#: Bytes before every window that both dictionaries end with. They make each window compressible, where zstandard would store it as it is.
LEAD = b"0123456789#0123456789#0123456789#"
#: Prefix lengths (with the space before the word) that count as wording beside whole words.
PREFIXES = (5, 6, 7, 8)
ORDINARY_BYTES, TOXIC_BYTES = 600, 4000
FEATURES = 7
SIGNATURE = 6

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows(words: list[str]) -> list[bytes]:
    return [LEAD + f" {' '.join(words[i:i + WINDOW_WORDS])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW_WORDS)]


def wording(words: list[str]) -> set[str]:
    """Distinct words of a text and their beginnings, each after a space."""
    out = set()
    for word in set(words):
        padded = f" {word} "
        out.add(padded)
        out.update(padded[:k] for k in PREFIXES if len(padded) > k)
    return out


def distinct_marks(counts: dict[str, int]) -> dict[str, int]:
    """Marks without those that a longer one nearly always continues, and without rare continuations of a shorter one."""
    longest = {m: n for m, n in counts.items() if not any(o != m and o.startswith(m) and k >= 0.7 * n for o, k in counts.items())}
    return {m: n for m, n in longest.items() if not any(o != m and m.startswith(o) and n < 0.5 * k for o, k in longest.items())}


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _compressor(content: bytes) -> zs.ZstdCompressor:
    settings = zs.ZstdCompressionParameters(
        window_log=13, hash_log=13, chain_log=13, search_log=6, min_match=4, target_length=64, strategy=zs.STRATEGY_BTOPT,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT) if content else None
    return zs.ZstdCompressor(dict_data=held, compression_params=settings)


class Distances:
    """Bytes saved by the toxic dictionary, window by window, and the features made of them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = _compressor(ordinary + LEAD).compress, _compressor(ordinary + toxic + LEAD).compress

    def features(self, text: str | None) -> list[float]:
        saved = np.array([len(self.plain(w)) - len(self.both(w)) for w in windows(words_of(text))] or [0])
        top = np.sort(saved)[-3:]
        return [float(saved.max()), float(top.sum()) / 3, float((saved >= 2).mean()), float((saved >= 3).mean()), math.log1p((saved >= 2).sum()),
                math.log1p((saved >= 3).sum()), math.log1p(len(saved))]


def _dictionary(samples: list[bytes], size: int, fallback: bytes) -> bytes:
    """Content of a trained dictionary; with too few samples to train on, the samples themselves."""
    try:
        return zs.train_dictionary(size, samples).as_bytes()[-size:]
    except zs.ZstdError:
        return fallback[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant last) by Newton steps with a ridge; ``rows`` has how many rows each one stands for."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (rows * (p * (1 - p) + 1e-9))[:, None]).T @ x + penalty, x.T @ (rows * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_cut(p: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> float:
    """Threshold of the highest F1 among those of which at least half are hits; above all if there is none.

    ``rows`` has how many rows each one stands for, one if it is left out.
    """
    rows = np.ones(len(y)) if rows is None else rows
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum((rows * y)[order]), np.cumsum(rows[order])
    f1 = 2 * hits / (taken + (rows * y).sum())
    sound = np.append(np.diff(p[order]) != 0, True) & (2 * hits >= taken)
    if not sound.any():
        return float(1 + p.max()) / 2
    at = int(np.argmax(np.where(sound, f1, -1)))
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def signature(text: str) -> list[int]:
    """Smallest hashes of a text's three-word runs under ``SIGNATURE`` orders; near copies share one at least, as a rule."""
    words = words_of(text)
    runs = {xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))}
    hashes = np.fromiter(runs, dtype=np.uint64, count=len(runs))
    return [int(((hashes ^ (hashes >> np.uint64(29 + k))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)).min().view(np.int64)) for k in range(SIGNATURE)]


def without_copies(sample: DataFrame, text_col: str, label_col: str, weight_col: str) -> DataFrame:
    """One row of each group of near copies in a bounded sample, whose signatures the driver goes through.

    Equal texts become one row first, with the label that stands for more rows
    (the greater of equal ones) and the sum of their weights.
    """
    hashed = sample.withColumn("__text", F.xxhash64(text_col))
    by_label = hashed.groupBy("__text", text_col, label_col).agg(F.sum(weight_col).alias(weight_col))
    hashed = by_label.groupBy("__text").agg(F.max_by(F.struct(text_col, label_col), F.struct(weight_col, label_col, text_col)).alias("__row"), F.sum(weight_col).alias(weight_col)) \
        .select("__text", "__row.*", weight_col)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            found = [signature(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "signature"])

    seen: set[int] = set()
    kept = []
    for key, signs in sorted((r.key, r.signature) for r in hashed.select("__text", text_col).mapInArrow(sign, "key long, signature array<long>").collect()):
        if not seen.intersection(signs):
            kept.append((key,))
        seen.update(signs)
    chosen = sample.sparkSession.createDataFrame(kept, "__text long")
    return hashed.join(F.broadcast(chosen), "__text").drop("__text")


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", dictionary_rows: int = 400, contrast: float = 40.0,
        weight_col: str = "weight") -> Model | None:
    """Train dictionaries and calibration; None without rows of both classes.

    ``labelled`` has a text and a 0/1 label, in a bounded number of rows (see
    ``training_rows``); rows with a null in one of them are left out. Toxic
    wording is what ``contrast`` times as many toxic as ordinary texts hold;
    near copies are counted once, or their own words would look like wording.
    A row counts ``weight_col`` times in the calibration, and once where
    ``labelled`` lacks that column.
    """
    if weight_col not in labelled.columns:
        labelled = labelled.withColumn(weight_col, F.lit(1.0))
    usable = keyed(labelled, text_col, label_col, weight_col).where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1))
    sample = without_copies(usable, text_col, label_col, weight_col).persist()
    try:
        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, text_col):
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                    seen[int(label)].update(wording(words_of(text)))
                for label in (0, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen[label]), pa.string()), pa.array([label] * len(seen[label]), pa.int32()),
                                                      pa.array(list(seen[label].values()), pa.int64())], names=["part", "label", "n"])

        n = {int(r[label_col]): r["count"] for r in sample.groupBy(label_col).count().collect()}
        if len(n) < 2:
            return None
        def of(label: int) -> Column:
            return F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))

        parts = sample.mapInArrow(count, "part string, label int, n long").groupBy("part").agg(of(1).alias("toxic"), of(0).alias("ordinary")).persist()
        found = parts.where((F.col("toxic") >= 4) & (F.col("toxic") / n[1] > contrast * (F.col("ordinary") + 2) / n[0])).collect()
        parts.unpersist()
        marks = distinct_marks({p.part: p.toxic for p in found})
        drawn = sorted((zlib.crc32(f"{part}{k}".encode("utf-8", "replace")), part) for part, times in marks.items() for k in range(min(times, 200)))
        samples = [b"".join(part.encode("utf-8", "replace") for _, part in drawn[i:i + 4]) for i in range(0, len(drawn), 4)]
        by_use = b"".join(part.encode("utf-8", "replace") for part in sorted(marks, key=lambda m: (marks[m], m)))
        toxic = by_use if len(by_use) <= TOXIC_BYTES else _dictionary(samples, TOXIC_BYTES, by_use)
        plain = sample.where(F.col(label_col) == 0).orderBy(F.xxhash64(text_col), text_col).limit(dictionary_rows).collect()
        texts = [w.removeprefix(LEAD) for r in plain for w in windows(words_of(r[text_col]))]
        ordinary = _dictionary(texts, 4 * ORDINARY_BYTES, b"".join(texts))[-ORDINARY_BYTES:]

        def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            saved = Distances(ordinary, toxic)
            for batch in chunks(batches, text_col):
                found = [saved.features(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array([int(x) for x in batch.column(1).to_pylist()], pa.int32()),
                                                  batch.column(2).cast(pa.float64())], names=["features", "label", "weight"])

        found = sample.mapInArrow(measure, "features array<double>, label int, weight double").orderBy("features", "label", "weight").collect()
    finally:
        sample.unpersist()
    x, y = np.array([r.features for r in found]), np.array([r.label for r in found], dtype=float)
    rows = np.array([r.weight for r in found])
    mean = np.average(x, axis=0, weights=rows)
    scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=rows)), 1e-9)
    weights = _logistic((x - mean) / scale, y, rows)
    p = _probability(Model(ordinary, toxic, mean, scale, weights), x)
    cut = min(max(_best_cut(p, y, rows), 1e-6), 1 - 1e-6)
    weights[-1] += math.log(CUT / (1 - CUT)) - math.log(cut / (1 - cut))
    return Model(ordinary, toxic, mean, scale, weights)


def _probability(model: Model, x: np.ndarray) -> np.ndarray:
    z = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns with the score (0 to 1) of the text in ``score_col``.

    A null or empty text is scored like a text without windows of note; without
    a model every score is 0. A column named ``score_col`` is replaced. The
    score depends on the text alone, so repeated texts get equal scores.
    """
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.schema.names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saved = Distances(model.ordinary, model.toxic)
        for batch in chunks(batches, text_col):
            x = np.array([saved.features(t) for t in batch.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_probability(model, x))], names=schema.names)

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4,
                  held: int = 2, rows_per_class: int = 6000) -> DataFrame:
    """Text and label of labelled rows outside the held-out fold, at most ``rows_per_class`` labels of each class, drawn by a hash of the key.

    ``weight`` has how many labels of its class a drawn one stands for, so that
    the classes keep the shares they have among all labels. The labels drawn
    are bounded, so they go to the documents as a broadcast and no text is shuffled.
    """
    marked = labels.where(F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held)).select(F.col(id_col).alias("labelled"), F.col(label_col).alias("label"))
    counts = marked.agg(*[F.count_if(F.col("label") == value) for value in (0, 1)]).first()
    drawn = [marked.where(F.col("label") == value).orderBy(F.xxhash64("labelled"), "labelled").limit(rows_per_class)
             .withColumn("weight", F.lit(max(1.0, counts[value] / rows_per_class))) for value in (0, 1)]
    return keyed(docs, id_col, text_col).join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col(id_col) == F.col("labelled")) \
        .select(F.col(text_col).alias("text"), F.col("label").alias("toxic"), "weight")


def score_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every row, learned from labelled rows outside the held-out fold."""
    model = fit(training_rows(docs, labels, id_col, text_col))
    out = score(keyed(docs, id_col, text_col), model, text_col)
    return out.select(id_col, held_out(F.col(id_col), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose text scores under ``CUT``, with their columns.

    A null or empty text is judged like a text without windows of note;
    repeated rows are judged alike; without labels of both classes every row
    stays; an empty table gives no rows.
    """
    model = fit(training_rows(docs, labels, id_col, text_col))
    return score(docs, model, text_col, "__toxic_score").where(F.col("__toxic_score") < CUT).drop("__toxic_score")
