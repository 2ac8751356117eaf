"""Text fields: the same values as one search a pattern gives, at the cost of few searches."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.functions import text as X

TEXTS = [None, "", "Planner 40 hours and Lead  5 hrs\n2 FTE", "a 5 hours b 6 hours 7 hours", "x40hours Planner 3.5.2 FTE Lead 50 % fte",
         "Senior Director, Creative Director; Account Manager VP\n1.\nScope of Work: x\nRisk Management\nProject Scope",
         "Deliverables: report. provide a plan! Monthly fee billed by the hour, rate per hour daily", "cost full-time FTE $1,200.50 300 USD Q1 2 weeks",
         "Project: a\nlong line of text\nDeliverables:\n- item one\n\nfee x\nDescription: d\nterm of project: 3", "5-6 hrs 10 to 20 hrs 1/2/2024 Houston Vice President"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def values(spark, expr):
    return [r[0] for r in frame(spark).orderBy("id").select(expr.alias("x")).collect()]


def searches(spark, expr) -> int:
    return frame(spark).select(expr.alias("x"))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(")


def test_wording_hits(spark):
    want = {}
    for f, k, p in X.wordings():
        n = sum(bool(re.search(p, t, re.I) if set("\\[(") & set(p) else p in t.lower()) for t in TEXTS if t)
        if n:
            want[f, k, p] = n
    df = X.wording_hits(frame(spark), "text")
    assert {tuple(r)[:3]: r["documents"] for r in df.collect()} == want
    # rows of a hit are numbers, not three words
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string", "string", "bigint"]
    assert "Aggregate [i#" in df._jdf.queryExecution().optimizedPlan().toString()


def test_term_profile(spark):
    def every(ps, shape, flags, t):
        return sorted({m[1] for p in ps for m in re.finditer(shape.format(p), t, flags)})

    got = values(spark, X.term_profile(F.col("text")))
    for t, g in zip(TEXTS, got):
        if t is None:
            assert g["sections"] is None and g["roles"] is None and g["timeline"] is None and g["budget"] is None and g["deliverables"] is None
            continue
        assert g["sections"] == every(K.SECTION_TERMS, r"^(?:\d+\.?\s*)?({})", re.I | re.M, t)
        assert g["roles"] == every(K.ROLE_TERMS, r"\b({})\b", re.I, t)
        assert g["budget"] == every(K.BUDGET_TERMS, "({})", re.I, t)
        assert g["deliverables"] == [m[1].strip() for p in K.DELIVERABLE_TERMS for m in re.finditer(p, t, re.I)]
    assert searches(spark, X.term_profile(F.col("text"))) < 15


def test_summary_lowers_lines_once(spark):
    expr = X.extractive_summary(F.col("text"), 1, 4, 300, 9, 5, 3, 200)
    assert values(spark, expr)[8] == "**Project:** Project: a long line of text\n\n**Term:** term of project: 3\n\n**Description:** Description: d term of project: 3\n\n" \
        "**Key Deliverables:**\n\n• - item one\n\n• Description: d"
    assert frame(spark).select(expr.alias("x"))._jdf.queryExecution().analyzed().toString().count("lower(") == 1


def test_role_values(spark):
    want = []
    for t in TEXTS:
        found = [] if t is not None else None
        for p in K.ROLE_VALUE_TERMS if t else []:
            at = 0
            while m := re.search(p, t[at:], re.I):  # a run starts where the match before ended, or at its first letter
                whole = m[0]
                found.append((m[1].strip(), float(m[2]), "fte" if "fte" in whole.lower() or "%" in whole else "hours"))
                at += m.end()
        want.append(found)
    got = [g if g is None else [tuple(r) for r in g] for g in values(spark, X.role_values(F.col("text")))]
    assert got == want
    assert searches(spark, X.role_values(F.col("text"))) == len(K.ROLE_VALUE_TERMS)


def test_rates_take_one_search(spark):
    got = values(spark, X.parse_fields(F.col("text")))
    assert got[6]["rates"] == ["fee hour", "rate hour"] and got[0]["rates"] is None and got[1]["rates"] == []
    assert searches(spark, X.parse_fields(F.col("text"))) == 5


SECTIONS = [*TEXTS, "Deliverables", "deliverables: \n", "DELIVERABLES:: one\n  \ntwo", "Deliverables a\nb c\nStaff Plan:\nd", "x deliverables\r\n a\n1. b\n\n", "Deliverables:\n\u2022 first long item\n- second one.\n3. third listed item\n\u212aey: x",
            "deliverables\n- a\n\u00c9t\u00e9: b\n12. c\nA\n b:\n", "Deliverables: one Deliverables: two\nEnd\nof it\n:\n\n", "Deliverables:" + "\n- an item of a long list" * 20000 + "\nNext: x"]


def test_sections_are_one_search(spark):
    df = spark.createDataFrame(list(enumerate(SECTIONS)), "id int, text string").orderBy("id")

    def cut(t, end):
        rest = re.split(r"(?i)deliverables[:\s]*", t, maxsplit=1, flags=re.A)[1:] if t is not None else []
        return (re.split(end, rest[0], maxsplit=1, flags=re.A)[0] or None) if rest else None

    for numbered, end in ((False, X.SECTION_END), (True, X.SECTION_END + r"|\n\d+\.")):
        got = [r[0] for r in df.select(X.section_after(F.col("text"), "deliverables", numbered)).collect()]
        assert got == [cut(t, end) for t in SECTIONS]
    items = [r[0] for r in df.select(X.deliverables(F.col("text"))).collect()]
    assert items[15] == ["first long item", "second one.", "third listed item", "3. third listed item"] and len(items[18]) == 20000


def test_a_value_of_a_branch_is_searched_once(spark):
    # both functions name each of their patterns once a use, so a plan that repeats one evaluates it again
    for expr in (X.deliverables(F.col("text")), X.start_date(F.col("text"))):
        plan = frame(spark).select(expr.alias("x"))._jdf.queryExecution()
        assert plan.optimizedPlan().toString().count("regexp_extract(") == plan.analyzed().toString().count("regexp_extract(") > 0
