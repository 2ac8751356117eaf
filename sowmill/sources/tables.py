"""Detected tables: cells to rows, rows to pipe text and back, rows to staffing entries.

A table travels as one DataFrame row per table row, with its cells in a short
array, so a table of any length spreads over many tasks. Only the first eight
rows of a table, which decide about its header, are ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.functions.scalars import clean_hours, drop_thousands, extract_hours, extract_pct, let, null_if_na, reconcile

TABLE = ["file", "page_number", "table_index"]


def cells_to_matrix(cells: DataFrame) -> DataFrame:
    """Table rows (file, page_number, table_index, row_index, cells) from single cells.

    Cells outside the declared size are left out, missing ones become empty text.
    """
    size = ["row_count", "column_count"]
    inside = (F.col("row_index").between(0, F.col("row_count") - 1)
              & F.col("column_index").between(0, F.col("column_count") - 1))
    named = F.lit(True)
    for c in TABLE:
        named = named & F.col(c).isNotNull()
    cell = F.struct("column_index", F.trim(F.coalesce("content", F.lit(""))).alias("content"))
    grid = (cells.select(*TABLE, *size).distinct().where((F.col("row_count") > 0) & (F.col("column_count") > 0))
            .withColumn("row_index", F.explode(F.sequence(F.lit(0), F.col("row_count") - 1))))
    # Cells and sizes meet in one aggregate; a null never collects, and a table without a name finds no cells.
    both = cells.where(inside).select(*TABLE, "row_index", F.when(named, cell).alias("_cell")).unionByName(
        grid.select(*TABLE, "row_index", F.struct(*size).alias("_size")), allowMissingColumns=True)
    found = both.groupBy(*TABLE, "row_index").agg(F.collect_list("_cell").alias("_found"), F.collect_list("_size").alias("_sizes"))
    value = lambda i: F.coalesce(
        F.try_element_at(F.filter("_found", lambda c: c["column_index"] == i), F.lit(-1))["content"], F.lit(""))
    return (found.select(*TABLE, "row_index", "_found", F.explode("_sizes").alias("_size"))
            .select(*TABLE, "row_index",
                    F.transform(F.sequence(F.lit(0), F.col("_size.column_count") - 1), value).alias("cells")))


def markdown_lines(rows: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Pipe-table lines (file, page_number, table_index, line_no, line); the mark line follows the header."""
    cells = F.filter("cells", lambda c: c != "") if drop_empty else F.col("cells")
    named = F.transform("cells", lambda c, i: F.concat(F.lit("Col "), (i + 1).cast("string")))
    blank = F.forall("cells", lambda c: F.trim(c) == "")
    shown = cells if drop_empty else F.when((F.col("row_index") == 0) & blank, named).otherwise(cells)
    text = F.array_join(shown, " | ")
    mark = F.array_join(F.transform(shown, lambda c: F.lit("---")), " | ")
    both = F.when(F.col("row_index") == 0, F.array(text, mark)).otherwise(F.array(text))
    out = rows.select(*TABLE, F.posexplode(both).alias("_i", "line"),
                      F.when(F.col("row_index") == 0, 0).otherwise(F.col("row_index") + 1).alias("_n"))
    out = out.select(*TABLE, (F.col("_n") + F.col("_i")).alias("line_no"), "line")
    return out.where((F.col("line_no") < 2) | (F.trim("line") != "")) if drop_empty else out


def matrix_to_markdown(rows: DataFrame, drop_empty: bool = False) -> DataFrame:
    """One pipe-table text per table; use ``markdown_lines`` where the text need not be one value."""
    return (markdown_lines(rows, drop_empty).groupBy(*TABLE)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                          lambda x: x["line"]), "\n").alias("markdown")))


def lines_to_rows(lines: DataFrame) -> DataFrame:
    """Table rows (file, page_number, table_index, row_index, cells) from pipe-table lines (..., line_no, line); the long form of ``markdown_to_rows``.

    Blank lines do not count, the second line is the mark, rows are padded or
    cut to the header width, and a table of fewer than three lines has no rows.
    Lines stay rows: a table is numbered by a sort that spills, and nothing of
    it but its header is brought to its other lines.
    """
    kept = lines.withColumn("line", F.trim("line")).where("line <> ''")
    number = F.row_number().over(Window.partitionBy(*TABLE).orderBy("line_no")) - 1
    numbered = kept.select(*TABLE, "line", number.alias("_n"))
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    long_enough = numbered.where("_n = 2").select(*TABLE)
    header = numbered.where("_n = 0").join(long_enough, TABLE).select(*TABLE, F.size(F.split("line", r"\|")).alias("_width"))
    rows = numbered.where("_n <> 1").join(header, TABLE)
    fit = F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.col("_width"))), F.lit(1), F.col("_width"))
    return rows.select(*TABLE, F.greatest(F.col("_n") - 1, F.lit(0)).alias("row_index"), F.when(F.col("_n") == 0, cells).otherwise(fit).alias("cells"))


def markdown_to_rows(markdown: Column) -> Column:
    """Array of cell arrays, header first; rows are padded or cut to the header width."""
    cells = lambda line: F.transform(F.split(line, r"\|"), lambda x: F.trim(x))

    def rows(lines: Column, width: Column) -> Column:
        fit = lambda line: F.slice(F.concat(cells(line), F.array_repeat(F.lit(""), width)), F.lit(1), width)
        body = F.transform(F.slice(lines, F.lit(3), F.size(lines)), fit)
        return F.when(F.size(lines) >= 3, F.concat(F.array(cells(F.get(lines, F.lit(0)))), body)).otherwise(
            F.array().cast("array<array<string>>"))

    return let(_text_lines(markdown), lambda lines: let(
        F.size(F.split(F.get(lines, F.lit(0)), r"\|")), lambda width: rows(lines, width)))


def _text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


# --- headers -------------------------------------------------------------------------------


def _has(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def _hours_only(c: Column) -> Column:
    return F.trim(c, F.lit(" #")) == "hours"


def canonical_header(header: Column) -> Column:
    """Canonical column name of a header cell, or the cleaned cell itself."""
    def name(h: Column) -> Column:
        return (F.when(_has(h, K.NAME_WORDS), "name")
                .when(_has(h, K.TITLE_WORDS), F.when(h.contains("primary role"), "primary_role").otherwise("role"))
                .when(_has(h, ["%", "percent"]), "percentage")
                .when(_hours_only(h) | h.contains("# hours"), "hours")
                .when(h.contains("billable hours per annum"), "bhpa")
                .when(h.contains("hour"), "hours")
                .when(h.contains("location"), "location")
                .when(h.contains("level"), "level")
                .when(_has(h, K.WORKSTREAM_WORDS), "workstream")
                .otherwise(h))

    return let(F.regexp_replace(F.lower(F.trim(F.coalesce(header, F.lit("")))), r"\s+", " "), name)


def header_score(cells: Column) -> Column:
    s = K.HEADER_SCORES

    def one(t: Column) -> Column:
        return (F.when(_has(t, K.NAME_WORDS), s["name"]).otherwise(0)
                + F.when(_has(t, K.TITLE_WORDS), s["title"]).otherwise(0)
                + F.when(t.contains("level"), s["level"]).otherwise(0)
                + F.when(_has(t, ["%", "percent"]), s["percent"]).otherwise(0)
                + F.when(t.contains("# hours") | _hours_only(t), s["hours"]).otherwise(0))

    low = F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    return F.aggregate(low, F.lit(0), lambda a, t: a + one(t))


def table_headers(rows: DataFrame, fill_blank: bool = True) -> DataFrame:
    """Header of every table: (file, page_number, table_index, header_index, header_cells, header_keys).

    The best of the first three rows is the header, the first one on a tie.
    With ``fill_blank`` an empty header is named after up to five values below it.
    """
    top = rows.where(F.col("row_index") < K.HEADER_SEARCH_ROWS + K.HEADER_SAMPLE_ROWS)
    return _headers(top.groupBy(*TABLE).agg(F.collect_list(F.struct("row_index", "cells")).alias("_top")), fill_blank)


def _headers(tops: DataFrame, fill_blank: bool) -> DataFrame:
    """``table_headers`` of tables whose first rows are listed in ``_top``, in any order."""
    top = tops.withColumn("_top", F.sort_array("_top"))
    scored = F.transform(F.filter("_top", lambda r: r["row_index"] < K.HEADER_SEARCH_ROWS), lambda r: F.struct(
        header_score(r["cells"]).alias("score"), (-r["row_index"]).alias("minus"), r["cells"].alias("cells")))
    picked = (top.withColumn("_best", F.array_max(scored))
              .select(*TABLE, "_top", (-F.col("_best.minus")).alias("header_index"),
                      F.col("_best.cells").alias("header_cells"))
              .withColumn("header_keys", F.transform("header_cells", canonical_header)))
    if fill_blank:
        below = F.filter("_top", lambda r: (r["row_index"] > F.col("header_index"))
                         & (r["row_index"] <= F.col("header_index") + K.HEADER_SAMPLE_ROWS))

        def named(key: Column, i: Column) -> Column:
            samples = F.transform(below, lambda r: F.trim(F.coalesce(F.get(r["cells"], i), F.lit(""))))
            is_number = lambda v: F.regexp_replace(v, ",", "").rlike(r"^\d{1,4}(?:\.\d+)?\z")
            return (F.when(key != "", key)
                    .when(F.exists(samples, lambda v: v.contains("%")), "percentage")
                    .when(F.exists(samples, is_number), "hours").otherwise(key))

        picked = picked.withColumn("header_keys", F.transform("header_keys", named))
    return picked.drop("_top")


ENTRY_KEYS = ["name", "role", "primary_role", "level", "workstream", "location", "percentage", "hours"]


def table_to_entries(rows: DataFrame, fill_blank: bool = True) -> DataFrame:
    """Staffing entries of all tables, one per data row that is neither blank nor a total."""
    places = [F.array_position("header_keys", F.lit(k)).cast("int").alias(f"_{k}") for k in ENTRY_KEYS]
    names = F.transform("header_cells", lambda h: F.trim(F.coalesce(h, F.lit(""))))
    # What a table's header says is found once a table; of equal names the last one counts.
    last = let(names, lambda ns: F.filter(F.transform(ns, lambda n, i: F.struct(n.alias("n"), i.alias("i"))),
                                          lambda p: ~F.array_contains(F.slice(ns, p["i"] + 2, F.size(ns)), p["n"])))
    # Rows are dealt by table once, for their header and for the join; both tests stand in one condition, so that neither moves below the dealing.
    dealt = rows.repartition(*TABLE)
    first = F.when(F.col("row_index") < K.HEADER_SEARCH_ROWS + K.HEADER_SAMPLE_ROWS, F.struct("row_index", "cells"))
    tops = dealt.groupBy(*TABLE).agg(F.collect_list(first).alias("_top"))
    heads = _headers(tops, fill_blank).select(*TABLE, "header_index", *places, last.alias("_names"))
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    filled = let(low, lambda cs: F.exists(cs, lambda c: c != "") & ~F.exists(cs, lambda c: c.startswith("total")))
    data = dealt.join(heads, TABLE).where(F.when(F.col("row_index") > F.col("header_index"), filled))

    def cell(key: str) -> Column:
        at = F.col(f"_{key}")
        return F.when(at > 0, F.trim(F.coalesce(F.get("cells", at - 1), F.lit("")))).otherwise(F.lit(""))

    pct_text, hours_text = F.col("_pct"), F.col("_hrs")
    values = F.map_from_entries(F.transform("_names", lambda p: F.struct(
        p["n"].alias("k"), F.coalesce(F.get("cells", p["i"]), F.lit("")).alias("v"))))
    blank = F.lit("")
    return (data.withColumn("_pct", cell("percentage")).withColumn("_hrs", cell("hours"))
            .select(
                "file",
                F.coalesce(F.nullif(cell("name"), blank), F.lit("N/A")).alias("name"),
                F.coalesce(F.nullif(cell("role"), blank), cell("primary_role")).alias("role"),
                cell("primary_role").alias("primary_role"), cell("level").alias("level"),
                cell("workstream").alias("workstream"), cell("location").alias("location"),
                F.coalesce(extract_pct(pct_text), extract_pct(hours_text)).alias("percentage"),
                F.coalesce(extract_hours(clean_hours(hours_text)), extract_hours(pct_text)).alias("hours"),
                F.col("page_number").alias("page"), F.col("table_index").alias("source_table_index"),
                (F.col("row_index") - F.col("header_index")).alias("row_index"), values.alias("column_values")))


def to_minimal(entries: DataFrame) -> DataFrame:
    """Minimal rows (file, name, level, title, primary_role, hours, hours_pct); rows without a title go."""
    clean = {c: null_if_na(F.col(c)) for c in ("name", "level", "role", "primary_role")}
    r = reconcile(F.col("hours"), F.col("percentage"))
    keys = [c for c in ("file", "source_table_index", "row_index") if c in entries.columns]
    return (entries.select(*keys, clean["name"].alias("name"), clean["level"].alias("level"),
                           F.coalesce(clean["role"], clean["primary_role"], clean["level"]).alias("title"),
                           clean["primary_role"].alias("primary_role"), r["hours"].alias("hours"),
                           r["hours_pct"].alias("hours_pct"))
            .where(F.col("title").isNotNull()))


# --- pipe tables straight to entries ------------------------------------------------------


def is_staffing_header(line: Column) -> Column:
    parts = F.transform(F.split(line, r"\|"), lambda h: F.lower(F.trim(h)))
    return (F.exists(parts, lambda h: h.rlike("name|title|role|personnel"))
            & F.exists(parts, lambda h: h.rlike(r"hours|%\s*time|fte|allocation")))


def markdown_to_entries(markdown: Column) -> Column:
    """Array of struct(title, level, location, hours, pct_time) read from a pipe table by its header."""
    header = lambda lines: F.transform(_cells(F.get(lines, F.lit(0))), lambda h: F.lower(h))
    return let(_text_lines(markdown), lambda lines: let(header(lines), lambda h: _entries(lines, h)))


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda x: F.trim(x))


def _entries(lines: Column, header: Column) -> Column:
    body = F.filter(F.slice(lines, F.lit(3), F.size(lines)),
                    lambda x: ~x.rlike(r"(?i)total\s+sow\s+amount|total\s+hours"))
    wanted = {"title": "title|role", "name": "name|personnel", "hours": r"hours\b", "pct": r"%\s*time|percent|fte\s*allocation",
              "level": "level", "location": "location"}

    def first(pattern: str) -> Column:
        hits = F.filter(F.transform(header, lambda h, i: F.when(h.rlike(pattern), i)), lambda i: i.isNotNull())
        return F.get(hits, F.lit(0))

    whole = (r"^([A-Za-z][A-Za-z .,'’\-]+?)\s*\|.*?([A-Za-z][A-Za-z /&,'’\-]+?)\s*\|.*?(\d{2,4}(?:\.\d+)?)\b"
             r".*?(\d{1,3}(?:\.\d+)?)\s*%")
    blank = F.lit("")

    def read(cells: Column, places: Column) -> Column:
        at = lambda key: F.get(cells, places[key])
        hours = F.nullif(F.regexp_extract(drop_thousands(at("hours")), r"(\d{2,4}(?:\.\d+)?)", 1), blank).try_cast("double")
        pct = F.nullif(F.regexp_extract(at("pct"), r"(\d{1,3}(?:\.\d+)?)\s*%", 1), blank).try_cast("double")
        return F.struct(F.nullif(at("title"), blank).alias("title"), F.nullif(at("name"), blank).alias("name"), hours.alias("hours"), pct.alias("pct"),
                        at("level").alias("level"), at("location").alias("location"))

    def entry(row: Column, r: Column) -> Column:
        none = r["title"].isNull() & r["name"].isNull() & r["hours"].isNull() & r["pct"].isNull()
        return let(none, lambda n: let(n & row.rlike(whole), lambda w: shown(row, r, w)))

    def shown(row: Column, r: Column, by_line: Column) -> Column:
        part = lambda g: F.when(by_line, F.trim(F.regexp_extract(row, whole, g)))
        title, name = F.coalesce(r["title"], part(2)), F.coalesce(r["name"], part(1))
        joined = F.regexp_replace(F.concat_ws(" / ", name, F.coalesce(title, blank)), r"^[ /]+|[ /]+\z", "")
        return F.struct(joined.alias("title"), r["level"].alias("level"), r["location"].alias("location"),
                        F.coalesce(r["hours"], part(3).try_cast("double")).alias("hours"),
                        F.coalesce(r["pct"], part(4).try_cast("double")).alias("pct_time"))

    def parsed(places: Column) -> Column:
        return F.transform(F.filter(body, lambda x: ~F.forall(_cells(x), lambda c: c == "---")),
                           lambda row: let(_cells(row), lambda cells: let(read(cells, places), lambda r: entry(row, r))))

    places = F.struct(*[first(pattern).alias(key) for key, pattern in wanted.items()])
    return F.filter(let(places, parsed), lambda e: (e["title"] != "") & (e["hours"].isNotNull() | e["pct_time"].isNotNull()))
