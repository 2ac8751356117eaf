"""Decontamination: the Hamming index and the leaks against brute force over all windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sowmill.llm import decontaminate as D
from sowmill.llm.decontaminate import Benchmark, HammingIndex, find_leaks, shingle_hashes, words_of


def test_index_finds_all_within_radius():
    draw = np.random.default_rng(1)
    stored = draw.integers(0, 2**64, 400, dtype=np.uint64)
    queries = np.concatenate([stored[:60], draw.integers(0, 2**64, 40, dtype=np.uint64)])
    for q in range(60):
        for bit in draw.choice(64, draw.integers(0, 24), replace=False):
            queries[q] ^= np.uint64(1) << np.uint64(bit)
    for radius, blocks in ((19, 5), (7, 4), (3, 8), (0, 1 << 3)):
        expected = {(q, s) for q in range(len(queries)) for s in range(len(stored)) if int(np.bitwise_count(queries[q] ^ stored[s])) <= radius}
        assert set(HammingIndex(stored, radius, blocks).search(queries)) == expected


def brute(texts, items, least=0.8):
    """Best weighted similarity of each text and item over all windows of the item's length."""
    described = {k: words_of(t) for k, t in items.items() if words_of(t)}

    def bag(words, size):
        return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))

    seen = Counter(s for w in described.values() for s in set(bag(w, min(5, len(w)))))
    rarest = 1 + np.log(len(described))
    out = {}
    for key, text in texts.items():
        words = words_of(text)
        for item, own in described.items():
            size, span = min(5, len(own)), min(len(own), len(words))
            target = bag(own, size)
            for at in range(len(words) - span + 1 if span >= size else 0):
                window = bag(words[at:at + span], size)
                both = either = 0.0
                for s in window.keys() | target.keys():
                    w = 1 + np.log(len(described) / seen[s]) if s in target else rarest
                    both += w * min(window[s], target[s])
                    either += w * max(window[s], target[s])
                if both / either >= least - 1e-12 and both / either > out.get((key, item), (0,))[0] + 1e-12:
                    out[key, item] = both / either, at, at + span
    return out


def cases():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 5, 8, 20, 40]))) for i in range(25)}
    items[90], items[91], items[92] = items[4], "", "  ...  "
    texts = {}
    for k in range(60):
        words = [f"z{draw.randint(0, 400)}" for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            passage = items[draw.choice(range(25))].split()
            for _ in range(draw.choice([0, 0, 1])):
                passage[draw.choice([0, -1])] = "edited"
            at = draw.randint(0, len(words))
            words[at:at] = [w.upper() + draw.choice(["", ",", "!"]) for w in passage]
        texts[k] = " ".join(words)
    return texts, items


def test_leaks_against_all_windows(spark):
    texts, items = cases()
    expected = brute(texts, items)
    assert len(expected) > 40 and any(v[0] < 1 for v in expected.values())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.end) for r in find_leaks(docs, bench).collect()}
    assert found == {k: (round(float(v[0]), 9), *v[1:]) for k, v in expected.items()}
    kept = D.decontaminate(docs.withColumn("similarity", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "similarity"]
    assert {r.doc_id for r in kept.collect()} == set(texts) - {k for k, _ in expected}


def test_large_benchmark_takes_several_passes(spark, monkeypatch):
    texts, items = cases()
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    parts = list(D.passes(bench, "item_id", "text", most=100))
    assert len(parts) > 3
    assert sorted(k for p in parts for g in p.groups.values() for k in g.ids) == sorted(k for k, t in items.items() if words_of(t))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in find_leaks(docs, bench).collect()}
    monkeypatch.setattr(D.passes, "__defaults__", (100,))
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in find_leaks(docs, bench).collect()} == whole


def test_table(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    plain = {r.doc_id: f" {b' '.join(words_of(r.text)).decode()} " for r in docs.collect()}
    literal = {(k, r.item_id) for r in bench.collect() for k, t in plain.items() if f" {b' '.join(words_of(r.text)).decode()} " in t}
    assert literal and literal <= found


def test_odd_rows(odd, nothing, spark):
    bench = spark.createDataFrame([(1, "the same short text of a few words"), (1, "the same short text of a few words"), (None, "one"), (2, None), (3, ""), (4, "ONE"),
                                   (5, "a row without an id of its own")], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id, r.similarity) for r in find_leaks(odd, bench).collect())
    assert found == [(0, 5, 1.0), (4, 4, 1.0), (5, 1, 1.0), (6, 1, 1.0), (6, 1, 1.0)]
    kept = D.decontaminate(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 8, 9, 10]
    assert find_leaks(nothing, bench).count() == 0
    empty = bench.limit(0)
    assert find_leaks(odd, empty).count() == 0 and D.decontaminate(odd, empty).count() == odd.count()


def test_short_items_match_whole_words_only():
    found = list(Benchmark([(1, "cat")]).scan(["concatenate", "a cat sat", None, ""], 0.8))
    assert [(i, list(leaks)) for i, leaks in found] == [(1, [1])]
    assert len(shingle_hashes(np.zeros(3, dtype=np.uint64), 5)) == 0


def test_an_item_with_two_texts_gives_one_row_whatever_the_passes(spark, monkeypatch):
    one, two = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight"
    bench = spark.createDataFrame([(7, one), (7, two), (8, "other words stand here for an item of its own"), (None, "a passage of an item that has no id at all")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y {two} z"), (2, "so a passage of an item that has no id at all goes"), (3, "clean")], "doc_id long, text string")
    whole = [tuple(r) for r in find_leaks(docs, bench).collect()]
    assert whole == [(1, 7, 1.0, 1, 8)]
    assert [r.doc_id for r in D.decontaminate(docs, bench).collect()] == [3]
    monkeypatch.setattr(D.passes, "__defaults__", (30,))
    assert [tuple(r) for r in find_leaks(docs, bench).collect()] == whole
    assert [r.doc_id for r in D.decontaminate(docs, bench).collect()] == [3]


def test_index_stays_small():
    import pickle

    draw = random.Random(8)
    items = [(i, " ".join(f"w{draw.randint(0, 50_000)}" for _ in range(draw.randint(5, 400)))) for i in range(1000)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(Benchmark(items))) < 16 * size + 40_000 * 396
