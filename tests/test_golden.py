"""Saved layers of five documents: table rows -> entries -> minimal rows -> cleaned titles."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from sowmill import schemas
from sowmill.functions.classify import normalize_titles
from sowmill.sources.files import read_org_chart
from sowmill.sources.tables import cells_to_matrix, matrix_to_markdown, markdown_to_rows, table_to_entries, to_minimal

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
LAYERS = json.load(open(os.path.join(HERE, "staffing_layers.json"), encoding="utf-8"))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(stem, 1, t["index"], i, cells) for stem, d in LAYERS.items() for t in d["tables"] for i, cells in enumerate(t["rows"])]
    return spark.createDataFrame(data, "file string, page_number int, table_index int, row_index int, cells array<string>")


@pytest.fixture(scope="module")
def saved_entries(spark):
    data = [(stem, e["name"], e["role"], e["primary_role"], e["level"], e["workstream"], e["location"],
             None if e["percentage"] is None else float(e["percentage"]), None if e["hours"] is None else float(e["hours"]),
             e["page"], e["source_table_index"], e["row_index"], e["column_values"])
            for stem, d in LAYERS.items() for e in d["entries"]]
    return spark.createDataFrame(data, schemas.STAFFING_ENTRY)


FIELDS = ["file", "name", "role", "primary_role", "level", "workstream", "location", "percentage", "hours", "source_table_index", "row_index"]


def values(df, cols):
    return sorted((tuple(str(v) for v in r) for r in df.select(*cols).collect()))


def test_table_to_entries(rows, saved_entries):
    got = table_to_entries(rows, fill_blank=False)
    assert values(got, FIELDS) == values(saved_entries, FIELDS)
    assert got.count() == 93


def test_raw_cells_are_kept(rows, saved_entries):
    key = lambda df: sorted((r.file, r.source_table_index, r.row_index, sorted(r.column_values.items()))
                            for r in df.collect())
    assert key(table_to_entries(rows, fill_blank=False)) == key(saved_entries)


MINIMAL = ["file", "name", "level", "title", "primary_role", "hours", "hours_pct"]


def test_minimal_rows(saved_entries):
    want = sorted(tuple(str(v) for v in (stem, m["name"], m["level"], m["title"], m["primary_role"],
                                         None if m["hours"] is None else float(m["hours"]),
                                         None if m["hours_pct"] is None else float(m["hours_pct"])))
                  for stem, d in LAYERS.items() for m in d["minimal"])
    assert len(want) == 86
    assert values(to_minimal(saved_entries), MINIMAL) == want


def test_cleaned_titles(spark, saved_entries):
    chart = read_org_chart(spark, os.path.join(HERE, "org_chart.csv"))
    got = normalize_titles(to_minimal(saved_entries), chart)
    text = lambda v: "" if v is None else str(v)
    have = sorted(tuple(text(v) for v in r) for r in got.select(*MINIMAL).collect())
    want = sorted((stem, n["Name"], n["Level"], n["Title"], n["Primary Role"], n["Hours"], n["Hours %"])
                  for stem, d in LAYERS.items() for n in d["normalized"])
    assert have == want


def test_org_chart(spark):
    chart = {r.key: (r.chart_title, r.chart_level) for r in read_org_chart(spark, os.path.join(HERE, "org_chart.csv")).collect()}
    assert chart["vice president"] == ("Vice President", 7)
    assert chart["account trainee"] == ("Account Trainee", 0)
    assert "client services" not in chart


def test_cells_and_markdown_round_trip(spark, rows):
    table = rows.where("file = 'company_2_sow_1'")
    cells = (table.select("file", "page_number", "table_index", "row_index", F.posexplode("cells").alias("column_index", "content"))
             .where("content <> ''").withColumn("row_count", F.lit(13)).withColumn("column_count", F.lit(8)))
    back = cells_to_matrix(cells)
    assert values(back, ["row_index", "cells"]) == values(table, ["row_index", "cells"])
    md = matrix_to_markdown(table).select(markdown_to_rows(F.col("markdown")).alias("r")).first()[0]
    assert md == [r.cells for r in table.orderBy("row_index").collect()]


def test_entries_deal_the_rows_of_a_table_once(spark):
    from pyspark.sql import functions as F

    cells = [["Name", "", "Role", "Name", "% Time", "# Hours"], ["a", "n", "Planner", "b", "50%", "1,800"], ["", "", "", "", "", ""],
             ["Total", "", "", "", "", ""], ["c", "x", "Lead", None, "2 FTE", "40 Hrs"], ["d", "y", "z", "e", "no", "1.800"]]
    data = [(f, 1, 1, i, c) for f in ("f", "g") for i, c in enumerate(cells)] + [(None, 1, 1, 0, cells[0]), (None, 1, 1, 1, cells[1])]
    rows = spark.createDataFrame(data, "file string, page_number int, table_index int, row_index int, cells array<string>")
    made = rows.withColumn("cells", F.transform("cells", lambda c: F.concat(c, F.lit(" "))))
    got = table_to_entries(made)
    want = [("a", "Planner", 50.0, 1800.0, 1, "b "), ("c", "Lead", 200.0, 40.0, 4, ""), ("d", "z", None, 1800.0, 5, "e ")]
    values = sorted(tuple(r) for r in got.select("file", "name", "role", "percentage", "hours", "row_index", F.col("column_values")["Name"]).collect())
    assert values == [(f, *w) for f in ("f", "g") for w in want]
    # cells are made once for the header and the entries, and equal names of a header are found once a table
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan and "_names#" in plan
