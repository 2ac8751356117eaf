"""Joins, upserts and searches against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sowmill.functions import vectors as V
from sowmill.operators import ranking as N
from sowmill.operators import relate as R
from sowmill.operators import search as E
from sowmill.sources.merge import upsert


def test_contains_pairs_is_complete(spark):
    texts = ["Account Director", "director of art", "A", "", "Senior Planner / Analyst", None, "plan"]
    phrases = ["director", "DIRECTOR OF", "plan", "a", "Analyst", "zzz", "Senior Planner / Analyst", ""]
    got = {(r.text, r.phrase) for r in R.contains_pairs(spark.createDataFrame([(t,) for t in texts], "t string"),
                                                        spark.createDataFrame([(p,) for p in phrases], "p string")).collect()}
    want = {(t, p) for t, p in itertools.product(texts, phrases) if t is not None and p and p.lower() in t.lower()}
    assert got == want


def test_upsert_is_idempotent(spark):
    cols = "id int, v int, s string"
    target = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], cols)
    batch = spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], cols)
    once = upsert(target, batch, "id", F.col("v"))
    want = {(1, 0, "a"), (2, 2, "d"), (3, 1, "e")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in upsert(once, batch, "id", F.col("v")).collect()} == want


def brute(docs, queries, k):
    out = []
    for q, qv in queries:
        scored = sorted(((-round(max(0.0, min(1.0, float(np.dot(v, qv) / (np.linalg.norm(v) * np.linalg.norm(qv))))), 9), i) for i, v in docs))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_knn_in_one_block_and_many(spark, block_bytes):
    rng = np.random.default_rng(7)
    docs = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)] + [(200 + i, [1.0] * 6) for i in range(9)]
    queries = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(5)] + [(5, [1.0] * 6)]
    d = spark.createDataFrame(docs, "vec_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    got = sorted((r.query_id, r.vec_id, r["rank"]) for r in V.knn(d, q, 7, block_bytes=block_bytes).collect())
    assert got == brute(docs, queries, 7)


def test_knn_filter_paging_text_keys_and_null_vectors(spark):
    rng = np.random.default_rng(8)
    docs = [(f"d{i:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    queries = [("qa", [1.0, 0.0, 2.0, 0.5]), ("qb", [0.1, 1.0, -1.0, 0.0])]
    d = spark.createDataFrame([*docs, ("none", None)], "vec_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([*queries, ("nothing", None)], "query_id string, query_vector array<double>")
    kept = [x for x in docs if x[0] >= "d020"]
    got = sorted((r.query_id, r.vec_id, r["rank"]) for r in V.knn(d, q, 3, where=F.col("vec_id").between("d020", "d999"), skip=4).collect())
    assert got == [x for x in brute(kept, queries, 7) if x[2] > 4]
    assert V.knn(d, q.where("query_vector is null"), 3).count() == 0
    assert V.knn(d.limit(0), q, 3).count() == 0


def test_first_strategy_owns_an_id(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id int")
    got = [tuple(r) for r in N.merge_strategies([("exact", 1.0, ids(1, 2)), ("fuzzy", 0.8, ids(2, 3)), ("term", 0.6, ids(1, 4))], "id", 3).collect()]
    assert got == [(1, 0, "exact", 1.0), (2, 0, "exact", 1.0), (3, 1, "fuzzy", 0.8)]


def test_search_star_and_unknown(spark):
    df = spark.createDataFrame([(1, "golf club"), (2, "brand")], "id int, t string")
    assert E.keyword_search(df, "*", ["t"], "id").count() == 2
    assert [r.id for r in E.near_search(df, "gulf", ["t"]).collect()] == [1]
    assert [r.id for r in E.near_search(df, "masters", ["t"], hit=lambda x, t: E.synonym_hit(x, t, {"masters": ["golf club"]})).collect()] == [1]
    with pytest.raises(ValueError):
        E.search("nothing", df)


def test_reciprocal_rank(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 4.0)], "id int, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.8)], "id int, score double")
    assert [r.id for r in E.hybrid_text_vector(a, b, "id", 3, fusion="rrf").collect()] == [2, 3, 1]


def test_numbered_items_keep_empty_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k int, xs array<string>")
    got = sorted((r.k, r.item, r.item_number) for r in N.numbered_items(df, ["k"], "xs", "none").collect())
    assert got == [(1, "a", 1), (1, "b", 2), (2, "none", None)]


def test_contains_pairs_sends_few_grams_and_sorts_none(spark):
    texts = spark.createDataFrame([(f"company_{i % 40}_sow_{i}.pdf",) for i in range(400)], "t string")
    phrases = spark.createDataFrame([(f"company_{i}_",) for i in range(60)], "p string")
    pairs = R.contains_pairs(texts, phrases)
    assert {(r.text, r.phrase) for r in pairs.collect()} == {(f"company_{i % 40}_sow_{i}.pdf", f"company_{i % 40}_") for i in range(400)}
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    # texts meet phrases without a sort, and only grams in buckets of a looked up one get there
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "LeftSemi" in plan


def test_contains_pairs_where_all_grams_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 1)
    texts, phrases = ["senior planner", "planning", "Plan B"], ["PLANN", "plan", "planner", "x"]
    got = {(r.text, r.phrase) for r in R.contains_pairs(spark.createDataFrame([(t,) for t in texts], "t string"),
                                                        spark.createDataFrame([(p,) for p in phrases], "p string")).collect()}
    assert got == {(t, p) for t, p in itertools.product(texts, phrases) if p.lower() in t.lower()}
