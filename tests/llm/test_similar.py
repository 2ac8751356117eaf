"""Similarity join: classes, components and routing against brute force over all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from llm.cases import similar_texts
from pyspark.sql import functions as F

from sowmill.llm import similar
from sowmill.llm.components import Forest, components
from sowmill.llm.similar import Threshold, cluster_links, one_of_each, similar_components, words_of


def shingles(text, size):
    words = words_of(text)
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(texts, size=4, percent=85):
    """Smallest reachable id of each id, by the links of all pairs."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    forest = Forest()
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            forest.join(a, b)
    return {k: forest.root(k) for k in sets}, sets


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_components_against_all_pairs(spark, size, percent):
    texts = similar_texts()
    roots, sets = brute(texts, size, percent)
    assert len(set(roots.values())) < len(roots) - 10
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = similar_components(docs, shingle=size, percent=percent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in rows} == {k: (roots[k], len(sets[k])) for k in texts}


def test_hot_shingles_small_blocks(spark, monkeypatch):
    """Lists of very common shingles, groups over several blocks and a join without broadcast lose no link."""
    for name, value in (("HOT", 3), ("BLOCK", 5), ("LEAF", 2), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(similar, name, value)
    monkeypatch.setattr(similar.meeting_lists, "__defaults__", (3,))
    monkeypatch.setattr(similar.in_block_pairs, "__defaults__", (5,))
    texts = similar_texts(seed=9, groups=9)
    base = "common words that stand in all of these many texts and repeat and go on"
    for i in range(40):
        texts[1000 + i] = f"{base} {' '.join(f'own{i % 13}x{k}' for k in range(i % 5))}"
    roots, sets = brute(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar_components(docs).collect()} == roots


def test_prefix_filter_is_exact():
    for percent in (80, 85, 99, 100):
        threshold = Threshold(percent)
        for n in range(1, 200):
            least = -(-percent * n // 100)
            assert threshold.prefix(n) == n - least + 1
            assert threshold.enough(n, 2 * n) and not threshold.enough(0, 2 * n)


def test_links_of_a_cluster():
    draw = random.Random(6)
    sets = []
    for _ in range(6):
        base = draw.sample(range(10**6), draw.randint(1, 80))
        sets += [np.unique(np.array([x if draw.random() > 0.06 else x + 10**7 for x in base], dtype=np.uint64)) for _ in range(40)]
    ids, threshold = np.arange(len(sets)) * 2, Threshold(85)
    forest, expected = Forest(), Forest()
    for a, b in cluster_links(ids, sets, threshold):
        forest.join(a, b)
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            expected.join(2 * i, 2 * j)
    assert [forest.root(i) for i in ids.tolist()] == [expected.root(i) for i in ids.tolist()]


def test_components_of_paths_and_stars(spark):
    draw = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(i, 500 - i) for i in range(200, 210)] + [(7, 7)]
    draw.shuffle(edges)
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: forest.root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, nothing):
    rows = similar_components(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.component_id == (5 if r.doc_id == 6 else r.doc_id)
        if r.doc_id in (1, 2, 3):
            assert r.n_shingles == 0
    assert similar_components(nothing).count() == 0


def test_one_of_each(odd, nothing, spark):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    repeated = odd.where("doc_id = 6").withColumn("doc_id", F.lit(6))
    assert one_of_each(repeated).count() == 1
    assert one_of_each(nothing).count() == 0


def test_one_of_each_keeps_unlike_texts_of_one_id(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (9, f"{b} eight", "x"), (9, f"{b} eight", "x"), (7, "Alone Here", "x"), (7, "alone here", "y"), (None, a, "x"), (None, a, "x"), (11, "", "x"), (12, None, "x"), (5, b, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(3)
    kept = one_of_each(docs, percent=70)
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    seven = [t for k, t in got if k == 7]
    assert kept.columns == docs.columns and len(seven) == 1 and seven[0].lower() == "alone here"
    assert [g for g in got if g[0] != 7] == [(0, a), (0, a), (3, a), (5, b), (11, ""), (12, "")]


def test_points_of_sets_are_read_back():
    draw = np.random.default_rng(4)
    for n in (0, 1, 31, 96, 500, 1536, 7000, 30_000):
        shingles = np.unique(draw.integers(0, 1 << 60, n, dtype=np.uint64))
        point = similar.count_vector(shingles, similar.groups_of(len(shingles)))
        assert similar.point_of(similar.point_bytes(shingles)).tolist() == point.tolist() and point.sum() == len(shingles)
    one = np.arange(40, dtype=np.uint64) * np.uint64(0)
    assert similar.point_of(similar.point_bytes(one)).max() == 40


def test_unlike_sets_are_told_apart_by_their_points():
    """Of pairs of unlike sets of one size, next to none pass the bound, so chance meetings make no clusters."""
    draw, threshold = np.random.default_rng(5), Threshold(80)
    for n in (150, 300, 500, 700, 1200, 5000):
        sets = [draw.integers(0, 1 << 60, n, dtype=np.uint64) for _ in range(60)]
        points = similar.Points([similar.count_vector(s, similar.groups_of(n)) for s in sets])
        a, b = np.triu_indices(60, 1)
        assert threshold.enough(points.bound(a, b), np.full(len(a), 2 * n)).mean() < 0.002, n


def test_entries_without_partners_of_like_size():
    draw = random.Random(8)
    for percent in (80, 85, 100):
        place = np.array([draw.randrange(60) for _ in range(200)] + [99] * 12)
        low = np.array([draw.randint(1, 60) for _ in place], dtype=np.uint32)
        high = low + np.array([draw.choice([0, 0, 0, 5]) for _ in place], dtype=np.uint32)
        counts = np.where(high > low, 2, 1).astype(np.uint32)
        got = similar.partnered(place, counts, low, high, percent, most=8)
        many = np.bincount(place)[place]
        for i in range(len(place)):
            like = any(j != i and place[j] == place[i] and 100 * min(int(high[i]), int(high[j])) >= percent * max(int(low[i]), int(low[j])) for j in range(len(place)))
            assert got[i] == (counts[i] > 1 or many[i] > 8 or like)


def test_shingles_of_the_same_classes_make_one_list(spark):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(["start", *words[1:]]), " ".join(f"v{i}" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").repartition(2)
    threshold = Threshold(85)
    blocks = similar.sketch_blocks(docs, "doc_id", "text", 4, threshold).localCheckpoint()
    rows = similar.meeting_lists(blocks, similar.head_totals(blocks, 3, threshold), threshold).collect()
    # hundreds of shared shingles, but each class stands in one list for each set of classes
    assert 0 < len(rows) <= 8 * 7
    got = {r.doc_id: r.component_id for r in similar_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 0, 6: 0, 7: 3}
