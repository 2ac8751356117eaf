"""Language identification: the forward sums against all segmentations, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from sowmill.llm.language import RUN, START, UNKNOWN, Lattice, expected_counts, identify, identify_held_out, read_pieces, train, word_scores, words_of

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
PIECES = [START, "a", "b", "ab", "ba", START + "a", START + "ab", "aba", START + "abab", "c"]


def segmentations(text, known):
    if not text:
        yield []
        return
    for n in range(1, len(text) + 1):
        if text[:n] in known or n == 1:
            for rest in segmentations(text[n:], known):
                yield [text[:n], *rest]


def model(seed):
    draw = random.Random(seed)
    prob = np.array([[draw.random() for _ in range(2)] for _ in PIECES])
    return np.vstack([prob / prob.sum(axis=0), np.zeros((1, 2))])


def weight(pieces, prob, k):
    return math.prod(max(prob[PIECES.index(p), k], UNKNOWN if len(p) == 1 else 0) if p in PIECES else UNKNOWN for p in pieces)


def test_forward_sums_all_segmentations():
    prob, lattice = model(1), Lattice(PIECES)
    words = ["a", "b", "ab", "abab", "bac", "ababab", "xab", "ccc", "abxba"]
    scores = word_scores(lattice, prob, words)
    for word, found in zip(words, scores, strict=True):
        for k in range(2):
            total = sum(weight(s, prob, k) for s in segmentations(START + word, PIECES))
            assert abs(found[k] - math.log(total)) < 1e-9


def test_expected_counts_weigh_segmentations():
    prob, lattice = model(2), Lattice(PIECES)
    words, counts = ["ab", "abab", "cab"], np.array([3.0, 1.0, 2.0])
    expected = np.zeros(len(PIECES))
    for word, n in zip(words, counts, strict=True):
        every = [(s, weight(s, prob, 0)) for s in segmentations(START + word, PIECES)]
        total = sum(w for _, w in every)
        for pieces, w in every:
            for p in pieces:
                if p in PIECES:
                    expected[PIECES.index(p)] += n * w / total
    assert np.allclose(expected_counts(lattice, prob[:, :1], words, counts), expected)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = identify_held_out(docs, VOCABULARY).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_reads_the_text_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    pieces = read_pieces(VOCABULARY)
    learned = train(docs, pieces)
    first = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, pieces, *learned).collect()}
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in identify(changed, pieces, *learned).collect()} == first


def test_odd_rows(odd, nothing):
    rows = identify_held_out(odd, VOCABULARY).collect()
    assert len(rows) == odd.count()
    found = {r.doc_id: r.lang_pred for r in rows}
    assert {k for k, v in found.items() if v == "und"} == {1, 2, 3, 9}
    assert set(found.values()) <= {"und", "en", "fr"}
    assert identify_held_out(nothing, VOCABULARY).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in identify_held_out(unlabelled, VOCABULARY).collect()} == {("und", 0.0)}


def test_words():
    assert words_of("It's ÉTÉ 12a_b") == ["it", "s", "été", "a", "b"]
    assert words_of("x" * (RUN + 5)) == ["x" * RUN, "x" * 5]
    assert words_of(None) == words_of("½ 12 _") == []
