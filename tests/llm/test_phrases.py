"""Phrases against a plain count, and Misra-Gries summaries against their guarantee."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.cases import ODD_SCHEMA, similar_texts
from oracle_check import compare, connect

from sowmill.llm import phrases, queries
from sowmill.llm.phrases import Summary, collocations, frequent_grams, survivors

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counts_of(docs):
    """Occurrences of n-grams of one to three words, by language."""
    count = defaultdict(Counter)
    for lang, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                count[lang or "und"].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    return count


def brute(docs, threshold=10, top=2000):
    out = []
    for lang, f in counts_of(docs).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < threshold:
                continue
            if len(p) == 2 and any(len(q) == 3 and c >= threshold and p in (q[:2], q[1:]) and 100 * c >= 50 * a for q, c in f.items()):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, phrase.decode(), -a, left, right, n, -score) for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(phrases, "PART_MASS", 500)


@pytest.mark.parametrize("threshold, top", [(10, 2000), (2, 7), (3, 2000)])
def test_many_blocks_and_parts(spark, tiny, threshold, top):
    texts = list(similar_texts(4, 9).values())
    data = [(random.Random(i).choice(["en", "fr", None, "en"]), t.title() if i % 5 == 0 else t.replace("kel", "kel,", 2)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "lang string, text string").repartition(5)
    want = brute(data, threshold, top)
    assert rows(collocations(docs, threshold, top)) == want and len(want) > 6


def test_frequent_grams_are_all_there(spark, tiny):
    data = [("en", t) for t in similar_texts(8, 6).values()]
    grams, per_lang = frequent_grams(spark.createDataFrame(data, "lang string, text string").repartition(3), 4)
    f = counts_of(data)["en"]
    assert sorted((r.phrase, r.size, r.f) for r in grams.collect()) == sorted((" ".join(p), len(p), c) for p, c in f.items() if c >= 4)
    assert per_lang.collect()[0].n == sum(c for p, c in f.items() if len(p) == 1)


def test_odd_rows_and_empty_table(odd, nothing):
    data = [(r.lang, r.text) for r in odd.collect()]
    assert rows(collocations(odd, 2, 50)) == brute(data, 2, 50)
    assert rows(collocations(nothing)) == []


def test_pieces_and_blanks(spark):
    text = "A b\tc  d. a B c d;a b\x0bc d\x0cE f: a b! c? d\r\na\x1cb a b naïve x" + "\xff ÿ y\0z"
    data = [("en", text)] * 12 + [("de", "")] * 3 + [(None, "x y z"), ("und", "x y z")] * 5
    docs = spark.createDataFrame(data, "lang string, text string")
    assert rows(collocations(docs)) == brute(data)


def test_one_language_and_one_phrase_hold_most(spark, tiny):
    data = [("en", f"over and over {i} again and again")for i in range(3000)] + [("fr", "over and over again")] * 11
    docs = spark.createDataFrame(data, "lang string, text string").repartition(6)
    assert rows(collocations(docs)) == brute(data)


def test_scores_beyond_64_bits(spark):
    big = [("en", "x", 1, 3 * 10**12), ("en", "y", 1, 10**13), ("en", "x y", 2, 2 * 10**12)]
    saved = phrases.frequent_grams
    phrases.frequent_grams = lambda *a: (spark.createDataFrame(big, "lang string, phrase string, size int, f long"), spark.createDataFrame([("en", 4 * 10**13)], "lang string, n long"))
    try:
        got = rows(collocations(spark.range(0)))
    finally:
        phrases.frequent_grams = saved
    assert got == [("en", 1, "x y", 2 * 10**12, 3 * 10**12, 10**13, 4 * 10**13, 10**6 * 4 * 10**24 // (3 * 10**25))]


def test_summaries_keep_what_is_frequent():
    draw = np.random.default_rng(5)
    for _ in range(40):
        items = draw.zipf(1.3, 4000) % 700
        true = Counter(items.tolist())
        mass, threshold = len(items), int(draw.integers(5, 200))
        capacity = mass // threshold + 1
        parts = []
        for chunk in np.array_split(items, 7):
            part = Summary(capacity)
            for some in np.array_split(chunk, 3):
                part.merge(*np.unique(some, return_counts=True))
            parts.append(part)
        whole = parts[0]
        for other in parts[1:]:
            whole.merge(other.keys, other.counts, other.taken)
        assert len(whole.keys) <= capacity and whole.taken * (capacity + 1) <= mass
        held = dict(zip(whole.keys.tolist(), whole.counts.tolist(), strict=True))
        assert all(c - whole.taken <= held.get(k, 0) <= c for k, c in true.items())
        assert {k for k, c in true.items() if c >= threshold} <= set(whole.reaching(threshold).tolist())
        assert whole.reaching(threshold).tolist() == sorted(whole.reaching(threshold).tolist())
    assert survivors([], 0, 10).tolist() == []


def test_query_and_its_sql(spark, sf_dir):
    got, _, problem = compare(spark, connect(sf_dir), queries.QUERIES["op12_phrases"], queries.ORACLE["op12_phrases"], sf_dir)
    assert got and not problem, problem


def test_extra_columns_clash(spark):
    docs = spark.createDataFrame([(1, "to be or not to be " * 9, "en", "a", 1, "s", 1, 0.5, 7, 7, "no")], ODD_SCHEMA)
    assert rows(collocations(docs, 4)) == brute([("en", "to be or not to be " * 9)], 4)
