"""Language-model scores: counts and both scores against plain Python."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.cases import similar_texts

from sowmill.llm import scoring
from sowmill.llm.blocks import packed, packed_sorted, unpacked, unpacked_sorted
from sowmill.llm.scoring import bucket, learn_mixture, score_documents, words_of


def check(docs, monkeypatch):
    kept = []
    learn = scoring.learn_mixture
    monkeypatch.setattr(scoring, "learn_mixture", lambda cells, distinct: kept.append(learn(cells, distinct)) or kept[-1])
    rows = docs.collect()
    found = score_documents(docs).collect()
    assert len(found) == len(rows)
    texts = [(r.doc_id, [*words_of(r.text), None], r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows]
    training = [t for _, t, held in texts if not held]
    words = Counter(w for t in training for w in t)
    pairs = Counter(p for t in training for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(words.values()), len(words)
    expected = Counter()
    for key, tokens, held in texts:
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        score = 0.0
        for h, w in zip(["<s>", *tokens], tokens, strict=False):
            context = len(training) if h == "<s>" else words[h]
            a, b, c = kept[0][int(bucket(np.array([context]))[0])]
            score += math.log10(a * pairs[h, w] / max(1, context) + b * words[w] / max(1, n) + c / (v + 1))
        expected[key, held, len(tokens), sum(words[w] > 0 for w in tokens), n, round(base, 4), round(score, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in found) == expected
    return found


def test_against_plain_counts(spark, monkeypatch):
    check(spark.createDataFrame(list(similar_texts().items()), "doc_id long, text string").repartition(5), monkeypatch)


def test_several_blocks_and_ranges(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 2000), ("RANGE_BYTES", 1000)):
        monkeypatch.setattr(scoring, name, value)
    monkeypatch.setattr(scoring.token_blocks, "__defaults__", (2000,))
    check(spark.createDataFrame(list(similar_texts(seed=8).items()), "doc_id long, text string").repartition(2), monkeypatch)


def test_odd_rows(odd, nothing, monkeypatch):
    check(odd, monkeypatch)
    assert score_documents(nothing).count() == 0


def test_model_beats_the_base_on_held_out_rows(spark, sf_dir):
    rows = [r for r in score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_em_raises_the_likelihood():
    cells = [(3, 8, 40, 5.0), (3, -1, 30, 7.0), (3, 0, 60, 2.0), (5, -1, -1, 4.0), (5, 16, 24, 9.0), (0, -1, 20, 3.0)]
    mix = learn_mixture(cells, 1000)
    assert np.allclose(mix.sum(axis=1), 1) and mix[0, 0] == 0

    def likelihood(weights):
        total = 0.0
        for g, pair, word, n in cells:
            parts = [0 if pair < 0 or g == 0 else 2 ** (-pair / scoring.STEPS), 0 if word < 0 else 2 ** (-word / scoring.STEPS), 1 / 1001]
            total += n * math.log(float(np.dot(weights[g], parts)))
        return total

    assert likelihood(mix) > likelihood(np.full((66, 3), 1 / 3))


@pytest.mark.parametrize("values", [[], [0], [1, 2, 2, 2**63, 2**64 - 1]])
def test_packed_columns(values):
    data = np.array(values, dtype=np.uint64)
    assert unpacked(packed(data), np.uint64).tolist() == values
    assert unpacked_sorted(packed_sorted(data)).tolist() == values
