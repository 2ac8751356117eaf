from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sowmill.plans import build as P
from sowmill.plans import rules as U

TEXT = """
    Project Title: Company 1 Americas Sponsorship Hospitality Programs
    Client: Company 1
    Duration: 52 weeks

    Scope of Work:
    Develop hospitality programming for three (3) Events:
    - Race
    - Awards

    Deliverables:
    - Program budgets and reporting

    Project Staffing Plan:
    Account Director - Program Lead

    Budget: $3,380 total hours allocated across team
"""


@pytest.fixture(scope="module")
def sow(spark):
    return spark.createDataFrame([(TEXT, "Company 1", 52)], "text string, client string, weeks int")


def roles(df):
    return [(r.title, r.department, r.level, round(r.pct, 1)) for r in df.select("roles").first()[0]]


def test_before_the_rules(sow):
    from sowmill.functions.classify import with_requirements

    req = with_requirements(sow, "text", "client", "weeks")
    row = req.first()
    assert (row.project_type, row.complexity, row.client_size) == ("sponsorship_activation", "moderate", "enterprise")
    plan = P.with_totals(req.withColumn("roles", U.synthesize_roles(F.col("project_type"), F.col("complexity"))))
    assert [r[3] for r in roles(plan)] == [32.5, 25.0]
    money = U.with_financials(plan.withColumn("total_fte", U.total_fte(F.col("project_type"), F.col("complexity"), F.col("events_count"))))
    assert money.first().financial.total_budget == 832000.0


def test_six_roles_with_loose_order(sow):
    plan = P.recommend_plan(sow, "text", "client", "weeks", strict_order=False)
    assert roles(plan) == [
        ("Creative Director", "planning_creative", 6, 5.0), ("Account Manager", "client_services", 3, 25.0),
        ("Senior Account Executive", "client_services", 2, 20.0), ("Account Executive", "client_services", 1, 15.0),
        ("Account Director", "client_services", 5, 75.0), ("Strategy Director", "strategy", 5, 25.0)]
    assert plan.first().department_allocation["client_services"] == 135.0


def test_strict_order_stays_inside_the_bounds(spark, sf_dir):
    from sowmill.bind.base import sow_text

    plan = P.recommend_plan(sow_text(spark, sf_dir), "text", "client_name")
    bad = plan.select(U.compliance(F.col("roles")).alias("c"), F.size("roles").alias("n")).where(
        "c.client_services_pct > 100.000001 OR n < 3 OR NOT c.creative_director")
    assert bad.count() == 0


def test_oversight_rows(spark):
    rows = P.oversight_rows(spark.range(2).toDF("plan")).collect()
    assert len(rows) == 16 and round(sum(r.fte for r in rows), 6) == 0.8


def test_baseline(spark):
    df = spark.createDataFrame([(["Account Manager", "Creative Director"], "X", 1, 6)], "r array<string>, company string, sow int, m int")
    from sowmill.functions.classify import map_sow_roles

    plan = P.baseline_to_plan(map_sow_roles(df, "sow", "r", "f"), "f", "company", "sow", "m").first()
    assert [(r.role, r.allocation_percent) for r in plan.roles][:2] == [("Account Manager", 87), ("Vice President", 87)]
    assert plan.summary.startswith("AI DRAFT Staffing Plan for X - 1\nProject Duration: 6 months\nDepartments: Client Services")


def test_combine_keeps_recommended_first(spark, sow):
    rec = P.recommend_plan(sow.withColumn("k", F.lit(1)), "text", "client", "weeks")
    ext = P.build_plan(spark.createDataFrame([(1, "t", "c", None, 4, 1.0, [("Planner", 10.0), ("account manager", 20.0)])],
                                             "k int, project_name string, client_name string, contract_number string, duration_weeks int, "
                                             "budget double, entries array<struct<title:string,pct:double>>"), "entries", "budget")
    both = P.combine_plans(ext, rec, "k").first()
    assert both.roles[-1].title == "Planner" and both.roles[-1].confidence == 0.85
    assert sum(r.title.lower() == "account manager" for r in both.roles) == 1


def test_rules_run_once_for_each_type_and_complexity(spark, sow):
    kinds = P.roles_by_kind(spark)
    assert kinds.count() == 7 * 4 and kinds.where("roles IS NULL OR total_fte_percentage IS NULL").count() == 0
    plans = P.recommend_plan(sow.unionByName(sow.withColumn("text", F.lit(None).cast("string"))), "text", "client", "weeks")
    direct = P.with_totals(U.apply_rules(plans.select("project_type", "complexity").withColumn(
        "roles", U.synthesize_roles(F.col("project_type"), F.col("complexity")))))
    cut = lambda df: sorted(map(str, df.select("roles", "total_fte_percentage", "department_allocation").collect()))
    assert cut(plans) == cut(direct)
    # the rules stand in the small side of a broadcast join, not on every plan
    assert "BroadcastHashJoin" in plans._jdf.queryExecution().sparkPlan().toString()
