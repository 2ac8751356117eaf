"""Small cases with known answers."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.functions import classify as C
from sowmill.functions import scalars as S
from sowmill.functions import text as X
from sowmill.functions.vectors import cosine


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [
    ("45 hours (2.50%)", "2.5%"), ("9 hours (1%)", "1.0%"), ("67 hours", "3.7%"), ("525 hrs (25% + Onboarding)", "25.0%"),
    ("5% – 60 hrs", "5.0%"), ("100%", "100.0%"), ("1,800 hrs", "100.0%"), ("", "0.0%"), ("on call", "on call")])
def test_allocation_percent(spark, text, want):
    assert one(spark, S.normalize_allocation_pct(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [
    ("45 hours", (2.5, 45.0, None)), ("25%", (25.0, 450.0, None)), ("0.5 FTE", (50.0, 900.0, None)), ("6 months", (None, None, 6.0)),
    ("25% (450 hours)", (25.0, 450.0, None)), ("6 x 11 months", (None, None, 66.0))])
def test_allocation(spark, text, want):
    assert tuple(one(spark, S.normalize_allocation(F.lit(text)))) == want


@pytest.mark.parametrize("text,want", [
    ("Person One (EVP Global lead): 2%", ("Person One", "EVP Global lead", "2.0%")),
    # blanks separate as well as dashes, so the name ends at its first blank
    ("Person One - EVP Global lead - 2%", ("Person", "One - EVP Global lead", "2.0%")),
    ("One - EVP - 2%", ("One", "EVP", "2.0%")),
    ("EVP Global lead: 2%", ("EVP Global lead", "", "2.0%")), ("Analyst: 900 hours", ("", "Analyst", "900 hours")),
    ("Person One (Lead), 10% of time", ("Person One", "Lead", "10%")), ("Person One", ("Person One", "", ""))])
def test_parse_staffing(spark, text, want):
    assert tuple(one(spark, S.parse_staffing(F.lit(text)))) == want


@pytest.mark.parametrize("title,want", [
    ("Account Manager", ("account_manager", "client_services", 3)), ("Creative Director", ("vp_creative_director", "planning_creative", 7)),
    ("Sr. Account Manager", ("sr_account_manager", "client_services", 4)), ("Strategy Lead", ("planner_sponsorship_strategy", "strategy", 2)),
    ("", None), ("Plumber", None)])
def test_map_role(spark, title, want):
    got = one(spark, C.map_role(F.lit(title)))
    assert (tuple(got) if got else None) == want
    assert C.role_of_title(title) == want


def test_fte(spark):
    assert tuple(one(spark, S.normalize_fte(F.lit(25.0), F.lit("fte_percentage"), F.lit(52)))) == (520.0, 25.0)
    assert tuple(one(spark, S.normalize_fte(F.lit(25.0), F.lit("fte_percentage"), F.lit(None).cast("int")))) == (None, 25.0)


def test_file_name(spark):
    assert tuple(one(spark, S.parse_file_name(F.lit("x/Company_4_sow_2.PDF")))) == ("Company_4", "2", "pdf")
    assert tuple(one(spark, S.parse_file_name(F.lit("notes.txt")))) == ("Unknown", "Unknown", "txt")
    assert tuple(one(spark, S.parse_file_name(F.lit("notes")))) == ("Unknown", "Unknown", "bin")


@pytest.mark.parametrize("roles,want", [
    (["Account Manager", "Creative Director", "Project Manager", "Strategy Analyst", "VP"],
     ["Account Manager", "Vice President", "Manager", "Analyst"]),
    (["Account Executive", "Sponsorship Strategy Manager", "Producer", "Creative Manager"],
     ["Account Executive", "Manager", "Producer"]),
    (["Digital Media Manager", "Social Media Analyst", "UX Designer", "Account Director"],
     ["Manager", "Analyst", "Account Director"]),
    (["Event Manager", "Production Coordinator", "Creative Director", "Account Manager"],
     ["Manager", "Producer", "Vice President", "Account Manager"])])
def test_ordered_role_wording(spark, roles, want):
    df = spark.createDataFrame([(1, roles)], "k int, r array<string>")
    found = C.map_sow_roles(df, "k", "r", "f").select(F.transform("f", lambda i: C.org_row(i)["title"])).first()[0]
    assert found == want


def test_fuzzy_org_role(spark):
    df = spark.createDataFrame([("Acount Manager",), ("account mgr",), ("Plumber",)], "t string")
    got = {r.t: r.org_title for r in C.map_org_roles(df, "t").collect()}
    assert got == {"Acount Manager": "Account Manager", "account mgr": "Account Manager", "Plumber": None}


def test_closest_roles_are_those_of_a_full_search(spark):
    draw = random.Random(2)
    names = [n for t, _, _, al in K.ORG_ROLES for n in (t, *al)]
    titles = {"", " ", "é", "Ünïcode Director", "x" * 300, "\tAccount Manager\n", *names}
    for _ in range(300):
        t = list(draw.choice(names))
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(t) + 1)
            t[at:at + draw.randint(0, 1)] = draw.choice(["", "e", "s", " ", "Q"])
        titles.add("".join(t))
    got = {r.title: r.position for r in C.closest_roles(spark.createDataFrame([(t,) for t in titles] + [(None,)], "t string")).collect()}
    low = [(n.lower(), i) for i, (t, _, _, al) in enumerate(K.ORG_ROLES) for n in (t, *al)]
    for t in titles:
        rated = [(difflib.SequenceMatcher(None, t.lower().strip(), n).ratio(), -k) for k, (n, _) in enumerate(low)]
        best = max(rated)
        assert got.get(t) == (low[-best[1]][1] if best[0] > K.FUZZY_RATIO else None), t


def test_bound_is_never_below_the_ratio(spark):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdé Z9") for _ in range(draw.randint(0, 14))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words[:20]] + [(None, "a"), ("a", None)], "a string, b string")
    want = {(a, b): difflib.SequenceMatcher(None, a, b).ratio() for a in words for b in words[:20]}
    got = {(r.a, r.b): r.ratio for r in C.similar_pairs(pairs, "a", "b", 0.5).collect()}
    assert got == {k: v for k, v in want.items() if v > 0.5} and len(got) > 50


def test_cosine_edges(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, cosine(arr(1, 0), arr(1, 0))) == 1.0
    assert one(spark, cosine(arr(1, 0), arr(-1, 0))) == 0.0
    assert one(spark, cosine(arr(1, 0), arr(1))) == 0.0
    assert one(spark, cosine(arr(0, 0), arr(1, 0))) == 0.0


SAMPLE = """SCOPE OF WORK AGREEMENT

Client: Example Corp
Contract Number: EX-2024-001
Date: January 15, 2024

Title of Project: Cloud Migration Initiative

Description: Example Corp needs services including cloud migration and staff training.

Term of Project: 6 months (March 1, 2024 - August 31, 2024)

DELIVERABLES

• Cloud migration strategy document
• Monthly progress reports

PROJECT STAFFING PLAN

Name Role Primary Role % Primary Location
Alan Alpha PM Project Management 15% New York, NY
Beth Beta TL Cloud Architecture 25% Austin, TX

TOTAL PROJECT HOURS: 2,400 hours
"""


def test_sample_text(spark):
    df = spark.createDataFrame([(SAMPLE,)], "text string")
    get = lambda e: df.select(e.alias("x")).first()[0]
    t = F.col("text")
    assert get(X.project_info_heuristic(t))["contract_number"] == "EX-2024-001"
    assert get(X.client_name(t)) == "Example Corp"
    assert get(X.client_name(t, own_names=["Example"])) is None
    assert get(X.deliverables(t))[0] == "Cloud migration strategy document"
    rows = [(r.name, r.role, r.primary_role, r.percentage) for r in get(X.staffing_rows(t))]
    assert ("Alan Alpha", "PM", "Project Management", "15%") in rows and ("Beth Beta", "TL", "Cloud Architecture", "25%") in rows
    assert any("STAFFING PLAN" in s for s in get(X.staffing_sections(t)))
    assert "**Term:** Term of Project: 6 months" in get(X.extractive_summary(t))
    assert get(C.duration_weeks(t)) == 24


def test_long_text_without_breaks(spark):
    df = spark.createDataFrame([("deliverables " + "word " * 40000,)], "text string")
    row = df.select(X.deliverables(F.col("text")).alias("d"), X.role_values(F.col("text")).alias("v"),
                    X.staffing_rows(F.col("text")).alias("s")).first()
    assert row.d == [] and row.v == [] and row.s == []


def _plan(spark, value):
    return spark.range(1).selectExpr("cast(id AS string) AS t").select(value.alias("v"))._jdf.queryExecution().optimizedPlan().toString()


def test_staffing_rows_make_their_text_once(spark):
    assert _plan(spark, X.staffing_rows(F.concat(F.col("t"), F.lit("only here")))).count("only here") == 1


def test_pipe_table_header_is_searched_once_per_column(spark):
    from sowmill.sources.tables import markdown_to_entries

    assert _plan(spark, markdown_to_entries(F.col("t"))).count("name|personnel") == 1
    table = "Name | Role | # Hours | % Time | Level | Location\n--- | ---\nAnn Lee | Planner | 1,200 | 50% | 3 | Rome\nTotal hours | | 9 | |\nBob | | | | |"
    other = "Who | What\n--- | ---\nAnn Lee | Planner | 1200 | 50% | x\nnothing | here"
    rows = spark.createDataFrame([(table,), (other,), ("one line",), (None,)], "t string").select(markdown_to_entries(F.col("t")).alias("e")).collect()
    assert [tuple(e) for e in rows[0].e] == [("Ann Lee / Planner", "3", "Rome", 1200.0, 50.0)]
    assert [tuple(e) for e in rows[1].e] == [("Ann Lee / Planner", None, None, 1200.0, 50.0)]
    assert not rows[2].e and not rows[3].e
