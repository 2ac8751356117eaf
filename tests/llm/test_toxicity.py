"""Toxicity: held-out quality, scores that depend on the text alone, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sowmill.llm.toxicity import LEAD, Distances, _best_cut, fit, reject_toxic, score, score_held_out, training_rows, windows, words_of

INSULTS = ["glorbish", "snarkface", "dunderhead", "vilescum", "wretchpig"]


def texts(seed, n, start=0):
    draw = random.Random(seed)
    syllables = ["an", "er", "in", "the", "on", "re", "at", "en", "nd", "ti", "es", "or"]
    out = []
    for i in range(n):
        words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 12)):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        out.append((start + i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = texts(1, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic long")
    return docs, labels


def test_held_out_quality(tables):
    docs, labels = tables
    rows = score_held_out(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(tables):
    docs, labels = tables
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    turned = labels.withColumn("toxic", F.when(fold == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first = {r.doc_id: r.score for r in score_held_out(docs, labels).collect()}
    assert {r.doc_id: r.score for r in score_held_out(docs, turned).collect()} == first


def test_training_sample_is_bounded(tables):
    docs, labels = tables
    rows = training_rows(docs, labels, rows_per_class=30).groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in rows} == {0: 30, 1: 30}


def test_rejects_toxic_and_keeps_columns(tables):
    docs, labels = tables
    wide = docs.withColumn("score", F.lit("mine")).withColumn("label", F.lit(3))
    kept = reject_toxic(wide, labels)
    assert kept.columns == wide.columns
    left = {r.doc_id for r in kept.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(left & toxic) < 0.05 * len(toxic)
    assert len(left - toxic) > 0.98 * (docs.count() - len(toxic))


def test_odd_rows(tables, odd, nothing, spark):
    docs, labels = tables
    model = fit(training_rows(docs, labels))
    rows = score(odd, model, score_col="mark").collect()
    assert len(rows) == odd.count() and all(0 <= r.mark <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.mark) == r.mark
    assert score(nothing, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic long")
    assert {r.score for r in score_held_out(odd, none).collect()} == {0.0}
    assert reject_toxic(odd, none).count() == odd.count()
    strange = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 1), (5, 0), (6, 0)], "doc_id long, toxic long")
    assert score_held_out(odd, strange).count() == odd.count()


def test_windows_hold_every_word():
    words = words_of("One, two; THREE four-five 66 six")
    assert words == ["one", "two", "three", "four", "five", "six"]
    assert b"".join(w.removeprefix(LEAD) for w in windows(words)).split() == [w.encode() for w in words]
    saved = Distances(b" ordinary words ", b" glorbish ")
    assert saved.features("a b c")[0] <= 0 < saved.features("any glorbish here glorbish")[0]


def test_best_cut():
    p, y = np.array([0.9, 0.8, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0, 0])
    cut = _best_cut(p, y)
    scores = [2 * y[p >= c].sum() / ((p >= c).sum() + y.sum()) for c in (0.15, 0.5, 0.85)]
    assert 2 * y[p >= cut].sum() / ((p >= cut).sum() + y.sum()) == max(scores)


def test_best_cut_counts_what_rows_stand_for():
    p, y = np.array([0.9, 0.8, 0.7, 0.6, 0.1]), np.array([1, 1, 0, 1, 0])
    rows = np.array([1.0, 2, 9, 1, 30])
    many = rows.astype(int)
    assert _best_cut(p, y, rows) == _best_cut(np.repeat(p, many), np.repeat(y, many)) == pytest.approx(0.75)
    assert _best_cut(p, y) < 0.6


def test_drawn_labels_keep_the_shares_of_the_classes(spark):
    """Ordinary texts that quote one insult outnumber toxic texts with one, but not in a sample of as many toxic as ordinary rows."""
    draw = random.Random(7)
    insults = [*INSULTS, "mudbrained", "clodhopper", "foulgob"]
    rows = []
    for i in range(4000):
        toxic = draw.random() < 0.08
        words = ["".join(draw.choice(["an", "er", "in", "the", "on", "re"]) for _ in range(draw.randint(1, 4))) for _ in range(60)]
        n = (1 if draw.random() < 0.3 else 8) if toxic else int(draw.random() < 0.06)
        for insult in draw.sample(insults, n):
            words.insert(draw.randrange(len(words)), insult)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic long")
    clean = docs.join(labels.where("toxic = 0"), "doc_id")
    shares = []
    for most in (6000, 1000):
        drawn = training_rows(docs, labels, rows_per_class=most)
        shares.append(score(clean, fit(drawn)).agg(F.avg((F.col("score") >= 0.3).cast("int"))).first()[0])
    assert abs(shares[0] - shares[1]) < 0.02


def test_equal_texts_with_different_labels_have_one_row(spark):
    from sowmill.llm.toxicity import without_copies

    rows = [("one text that stands with both labels", 1, 1.0), ("one text that stands with both labels", 0, 2.0), ("one text that stands with both labels", 1, 1.5),
            ("another text of two equal shares here", 0, 1.0), ("another text of two equal shares here", 1, 1.0), ("quite some other words again", 0, 3.0)]
    sample = spark.createDataFrame(rows * 1, "text string, toxic int, weight double").repartition(4)
    got = sorted(tuple(r) for r in without_copies(sample, "text", "toxic", "weight").select("text", "toxic", "weight").collect())
    assert got == [("another text of two equal shares here", 1, 2.0), ("one text that stands with both labels", 1, 4.5), ("quite some other words again", 0, 3.0)]
