"""Quality rules: base counts and distances against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sowmill.llm.quality import COMMON_WORDS, js_distance, quality_verdicts, text_features


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def check(docs):
    texts = {(r.doc_id): r.text for r in docs.collect()}
    rows = quality_verdicts(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        expected = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.base_failed and r.kept)
    return rows


def test_base_counts_over_table(spark, sf_dir):
    rows = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert any(r.kept for r in rows) and any(not r.kept and not r.base_failed for r in rows)


def test_odd_rows(odd, nothing):
    check(odd)
    assert quality_verdicts(nothing).count() == 0


def test_repeats_and_blanks(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice(["a ", "b ", "c\n", "a\n", "\x0b", "é ", "#|"]) for _ in range(draw.randint(0, 60))) for _ in range(120)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")))


def test_histograms(spark):
    docs = spark.createDataFrame([(1, "The cat and THE dog: 12 é#\nla", "en")], "doc_id long, text string, lang string")
    row = text_features(docs).first()
    assert row.char_hist == [len("hecatanddogla"), 7.0, 4.0, 2.0, 1.0, 1.0, 1.0, 0.0]
    words = dict(zip([*COMMON_WORDS, "other"], row.word_hist, strict=True))
    assert (words["the"], words["and"], words["la"], words["other"], sum(row.word_hist)) == (2, 1, 1, 4, 8)


def test_distance(spark):
    draw = random.Random(5)
    pairs = [([float(draw.choice([0, 0, 1, 5])) for _ in range(6)], [float(draw.choice([0, 1, 3])) for _ in range(6)]) for _ in range(50)]
    for p, q, d in spark.createDataFrame(pairs, "p array<double>, q array<double>").select("p", "q", js_distance(F.col("p"), F.col("q"))).collect():
        if not sum(p) or not sum(q):
            assert d == 0
            continue
        a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
        half = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
        value = sum(x * math.log2(x / m) for x, m in zip(a, half, strict=True) if x) / 2 + sum(y * math.log2(y / m) for y, m in zip(b, half, strict=True) if y) / 2
        assert abs(d - math.sqrt(max(0, value))) < 1e-9
