"""Blends, nearest joins and company views against brute force on rows that cuts would lose."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sowmill.functions import vectors as V
from sowmill.operators import relate as R
from sowmill.operators import search as E

LABELS = ("a", "b", "both")


def lists(seed, n=400):
    draw = random.Random(seed)
    a = {i: round(draw.random(), 3) for i in range(n) if draw.random() < 0.8}
    b = {i: round(draw.random(), 3) for i in range(n) if draw.random() < 0.7}
    return a, b


def frames(spark, *scores):
    return [spark.createDataFrame(sorted(s.items()), "id int, score double").repartition(3) for s in scores]


def full_join(a, b, wa, wb, k):
    total = {i: a.get(i, 0.0) * wa + b.get(i, 0.0) * wb for i in {*a, *b}}
    label = lambda i: "both" if i in a and i in b else "a" if i in a else "b"
    return [(i, round(total[i], 9), label(i)) for i in sorted(total, key=lambda i: (-total[i], i))[:k]]


@pytest.mark.parametrize("seed, k, wa, wb", [(1, 5, 0.6, 0.4), (2, 30, 0.3, 0.7), (3, 1, 0.5, 0.5), (4, 1000, 0.6, 0.4)])
def test_blend_top_is_the_top_of_the_full_join(spark, seed, k, wa, wb):
    a, b = lists(seed)
    got = [(r.id, round(r.score, 9), r.strategy) for r in R.blend_top(*frames(spark, a, b), "id", wa, wb, LABELS, k).collect()]
    assert got == full_join(a, b, wa, wb, k)


def test_blend_top_keeps_a_row_in_the_middle_of_both_lists(spark):
    a = {i: 1.0 - i / 100 for i in range(50)} | {900: 0.55}
    b = {i + 100: 1.0 - i / 100 for i in range(50)} | {900: 0.55}
    got = R.blend_top(*frames(spark, a, b), "id", 0.5, 0.5, LABELS, 1).collect()
    assert [(r.id, r.strategy) for r in got] == [(900, "both")]


def test_blend_top_of_empty_and_small_lists(spark):
    empty = spark.createDataFrame([], "id int, score double")
    one = spark.createDataFrame([(4, 0.2), (5, 0.0)], "id int, score double")
    assert R.blend_top(empty, empty, "id", 0.6, 0.4, LABELS, 3).count() == 0
    assert [(r.id, r.strategy) for r in R.blend_top(one, empty, "id", 0.6, 0.4, LABELS, 3).collect()] == [(4, "a"), (5, "a")]


@pytest.mark.parametrize("seed, k", [(5, 3), (6, 12)])
def test_reciprocal_ranks_over_whole_lists(spark, seed, k):
    a, b = lists(seed, 300)
    rank = lambda s: {i: n + 1 for n, i in enumerate(sorted(s, key=lambda i: (-s[i], i)))}
    ra, rb = rank(a), rank(b)
    total = {i: (0.3 / (60 + ra[i]) if i in ra else 0) + (0.7 / (60 + rb[i]) if i in rb else 0) for i in {*a, *b}}
    want = sorted(total, key=lambda i: (-round(total[i], 6), i))[:k]
    text, vector = frames(spark, a, b)
    assert sorted(r.id for r in E.hybrid_text_vector(text, vector, "id", k, fusion="rrf").collect()) == sorted(want)


def cos(x, y):
    if x is None or y is None or len(x) != len(y) or not np.any(x) or not np.any(y):
        return 0.0
    return max(0.0, min(1.0, float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))))


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_nearest_join_with_names_and_filters(spark, block_bytes):
    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in rng.normal(size=5)]
    rows = [(i, f"f{i % 40}" if i % 11 else None, vec(), vec() if i % 4 else None, f"c{i % 3}") for i in range(160)]
    rows += [(200 + i, "versions", rows[0][2], rows[0][3], "c0") for i in range(30)]
    asked = [(i, *rows[i][2:4], rows[i][4] if i % 2 else None) for i in range(0, 60, 7)] + [(999, None, None, None)]
    docs = spark.createDataFrame(rows, "id int, name string, v array<double>, w array<double>, client string").repartition(5)
    queries = spark.createDataFrame(asked, "asked int, v array<double>, w array<double>, client string").repartition(2)
    got = V.nearest_join(docs, queries, 4, "id", "asked", [("v", "v", 0.6), ("w", "w", 0.4)], "name", (("client", "client"),), (("id", "asked"),), block_bytes)
    want = []
    for q, v, w, client in asked:
        best = {}
        for i, name, dv, dw, c in rows:
            if i == q or (client is not None and c != client):
                continue
            entry = (-round(0.6 * cos(v, dv) + 0.4 * cos(w, dw), 9), i)
            best[name or str(i)] = min(best.get(name or str(i), entry), entry)
        want += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(best.values())[:4])]
    assert sorted((r.asked, r.id, r["rank"]) for r in got.collect()) == sorted(want)


def test_versions_of_one_file_do_not_push_others_out(spark):
    corpus = spark.createDataFrame([(i, "same file", [1.0, 0.0], [1.0, 0.01 * i]) for i in range(1, 60)] + [(100, "other", [0.6, 0.8], [0.0, 1.0]), (0, "asked", [1.0, 0.0], [1.0, 0.0])],
                                   "id int, file_name string, a array<double>, b array<double>").withColumn("staffing_plan", F.array(F.lit("display")))
    structured = spark.createDataFrame([(100, ["structured"])], "id int, staffing_structured array<string>")
    got = E.similar_sows(corpus, corpus.where("id = 0"), "id", "a", "b", top=2, structured=structured).orderBy("rank").collect()
    assert [(r.asked_key, r.id, r.staffing) for r in got] == [(0, 1, ["display"]), (0, 100, ["structured"])]


def test_two_vector_search_counts_rows_without_a_vector(spark):
    docs = spark.createDataFrame([(1, "x", [1.0, 0.0], None), (2, "y", None, [1.0, 0.0]), (3, "z", [0.6, 0.8], [0.8, 0.6]), (4, "n", None, None)],
                                 "id int, name string, a array<double>, b array<double>")
    got = [(r.id, r.strategy, round(r.score, 6)) for r in E.hybrid_two_vector(docs, [1.0, 0.0], 5, "a", "b", "id", "name").collect()]
    assert got == [(3, "hybrid_combined", 0.68), (1, "hybrid_full_text", 0.6), (2, "hybrid_parsed", 0.4)]


def test_company_with_many_projects(spark):
    rows = [(i, "Big Co", "Analytics reporting" if i < 70 else "brand launch", ["dashboard"], ["A B (Analyst): 50%"] * (i % 3)) for i in range(130)]
    rows += [(500 + i, f"Other {i}", "measurement analytics reporting" if i % 2 else "golf day", [], []) for i in range(60)]
    sow = spark.createDataFrame(rows, "sow_key int, client_name string, project_title string, deliverables array<string>, staffing_plan array<string>")
    parts = E.company_analysis(sow, "Big Co", "sow_key")
    assert parts["projects"].count() == 130 and sum(r.projects for r in parts["types"].collect()) == 130
    assert abs(parts["team"].first().per_project - sum(i % 3 for i in range(130)) / 130) < 1e-9
    assert [r.sow_key for r in parts["elsewhere"].collect()] == [501, 503, 505, 507, 509]
    assert E.company_analysis(sow, "Big Co", "sow_key", shown=None)["elsewhere"].count() == 30
    assert E.company_projects(sow, "Big Co", "sow_key").count() == 130
    assert E.similar_elsewhere(sow, "Big Co", "General/Other", ["project_title"], "sow_key").count() == 60


def test_first_strategy_owns_a_row_that_a_cut_would_have_given_away(spark):
    rows = [(i, "golf club day") for i in range(30)] + [(100, "golf only"), (101, "gulf club")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.search_strategy for r in E.multi_search(df, "golf club", "exact_first", ["t"], "id", {}, top=None, sound=False).collect()}
    assert all(got[i] == "exact_match" for i in range(30)) and got[101] == "fuzzy_match" and got[100] == "term_match"
    assert E.term_search(df, "golf club", ["t"], "id").where("term = 'golf'").count() == 31
    assert E.term_search(df, "golf club", ["t"], "id", top=10).count() == 10


def test_ranks_are_counted_by_halving(spark):
    text = spark.createDataFrame([(i, float(i % 7)) for i in range(60)] + [(5, 5.0), (None, 6.5)], "id long, score double")
    vector = spark.createDataFrame([(i, float(i % 11)) for i in range(30, 90)] + [(None, 3.5)], "id long, score double")
    out = E.hybrid_text_vector(text, vector, "id", 4, fusion="rrf")
    # no row is compared with every kept one, and the lists are shuffled for all their readers
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "RepartitionByExpression" in plan
    assert [(r.id, r.score) for r in out.collect()] == [(32, 0.01509), (54, 0.014957), (43, 0.013993), (41, 0.013937)]


def test_query_terms_are_looked_up_once_a_token(spark):
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, "Gamma, delta"), (3, "nothing"), (4, None), (5, "")], "id long, text string")
    out = E.ranked_search(rows, "alpha beta gamma omega", "id", {"text": 1.0}, top=None)
    assert [r.id for r in out.collect()] == [1, 2] and out.columns == ["id", "text", "score"]
    assert "array_contains" not in out._jdf.queryExecution().analyzed().toString()


def test_every_vector_asks_among_all(spark, tmp_path):
    """jn11: ids and labels do not decide which vectors are queries."""
    import duckdb
    from sowmill.bind import registry

    registry.load()
    draw = np.random.default_rng(12)
    rows = [(i, [float(x) for x in draw.normal(size=6)], i % 4) for i in (1, 2, 3, 5, 8, 13, 99, 100, 101, 250)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["jn11_queries_against_documents"](spark, str(tmp_path)).collect())
    assert {q for q, _, _ in got} == {i for i, _, _ in rows} and sum(n for _, _, n in got) == 5 * len(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.ORACLE["jn11_queries_against_documents"]).fetchall())
