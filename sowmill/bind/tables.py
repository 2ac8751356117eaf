"""Sources, sinks and table parsing over the given tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.bind import base as B
from sowmill.bind.registry import query
from sowmill.bind.scalars import PLAN_STRINGS, plan_strings
from sowmill.functions import scalars as S
from sowmill.sources import files, merge
from sowmill.sources import tables as X
from sowmill.sources.work import work_folder

HEAD = ["Personnel", "Title", "Level", "% Time", "# Hours"]
BLANK_HEAD = ["Name", "Position", "Level", "", ""]


def table_rows(k):
    """Rows of the staffing table of a SOW: plain header, header under a title row, or header with blank cells."""
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    hours = lambda h: F.when(h >= 1000, F.concat(F.floor(h / 1000).cast("string"), F.lit(","),
                                                 F.lpad((h % 1000).cast("long").cast("string"), 3, "0"))
                             ).otherwise(h.cast("long").cast("string"))
    row = lambda s: F.array(s["name"], s["title"], s["level"].cast("string"),
                            F.concat(s["pct"].cast("long").cast("string"), F.lit("%")), hours(s["hours"]))
    head = (F.when(k % 3 == 0, F.array(arr(HEAD))).when(k % 3 == 1, F.array(arr(["Team", "", "", "", ""]), arr(HEAD)))
            .otherwise(F.array(arr(BLANK_HEAD))))
    foot = F.when(k % 2 == 0, F.array(arr(["Total", "", "", "", ""]))).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(head, F.transform("plan", row), foot)


def matrix(spark, sf_dir):
    """One staffing table per SOW, in rows."""
    k = F.col("sow_key")
    return (B.plans(spark, sf_dir)
            .select(k.cast("string").alias("file"), F.lit(1).alias("page_number"), F.lit(1).alias("table_index"),
                    F.posexplode(table_rows(k)).alias("row_index", "cells")))


MATRIX_SQL = f"""mx AS (
  SELECT CAST(sow_key AS VARCHAR) AS file, sow_key, CAST(seq + CASE WHEN sow_key % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS row_index,
    [name, title, CAST(level AS VARCHAR), CAST(CAST(pct AS BIGINT) AS VARCHAR) || '%',
     CASE WHEN hours >= 1000 THEN CAST(hours AS BIGINT) // 1000 || ',' || lpad(CAST(CAST(hours AS BIGINT) % 1000 AS VARCHAR), 3, '0')
       ELSE CAST(CAST(hours AS BIGINT) AS VARCHAR) END] AS cells FROM ln
  UNION ALL SELECT CAST(sow_key AS VARCHAR), sow_key, 0, CASE sow_key % 3 WHEN 0 THEN {HEAD} WHEN 1 THEN ['Team', '', '', '', '']
    ELSE {BLANK_HEAD} END FROM ln_list
  UNION ALL SELECT CAST(sow_key AS VARCHAR), sow_key, 1, {HEAD} FROM ln_list WHERE sow_key % 3 = 1
  UNION ALL SELECT CAST(sow_key AS VARCHAR), sow_key, CAST(n_lines + 1 + CASE WHEN sow_key % 3 = 1 THEN 1 ELSE 0 END AS INTEGER),
    ['Total', '', '', '', ''] FROM ln_list WHERE sow_key % 2 = 0)"""


def cells(spark, sf_dir):
    """Single cells of the tables; empty ones are missing, and one per table lies outside the declared size."""
    k = F.col("sow_key")
    rows = B.plans(spark, sf_dir).select(k.cast("string").alias("file"), table_rows(k).alias("_rows"))
    cell = lambda i, j, c: F.struct(i.alias("row_index"), j.alias("column_index"), F.concat(F.lit(" "), c).alias("content"))
    each = F.flatten(F.transform("_rows", lambda r, i: F.transform(r, lambda c, j: cell(i, j, F.nullif(c, F.lit(""))))))
    one = F.concat(F.filter(each, lambda x: x["content"].isNotNull()), F.array(cell(F.lit(0), F.lit(9), F.lit("lost"))))
    return (rows.select("file", F.size("_rows").alias("row_count"), F.explode(F.when(F.col("file").isNotNull(), one)).alias("_c"))
            .select("file", F.lit(1).alias("page_number"), F.lit(1).alias("table_index"), "_c.*", "row_count", F.lit(5).alias("column_count")))


@query("sc01_parse_sow_json", B.sql("""
  SELECT sow_key, CASE WHEN sow_key % 10 = 0 THEN NULL ELSE client_name END AS client_name,
    CASE WHEN sow_key % 10 > 0 THEN n_lines END AS n_deliverables, sow_key % 10 = 0 AS corrupt FROM sow"""))
def sc01(spark, sf_dir):
    good = F.to_json(F.struct("file_name", "client_name", "project_title", "deliverables"))
    text = F.when(F.col("sow_key") % 10 == 0, F.concat(F.lit("{broken "), good)).otherwise(good)
    parsed = files.parse_sow_json(B.sow(spark, sf_dir).withColumn("_text", text), "_text", ["sow_key"])
    bad = F.col("_corrupt_record").isNotNull()
    return parsed.select("sow_key", "client_name", F.when(~bad, F.size("deliverables")).alias("n_deliverables"),
                         bad.alias("corrupt"))


@query("sc02_read_texts", "SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM documents")
def sc02(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"),
                                                      F.md5(F.col("text").cast("binary")).alias("digest"))


@query("sc03_list_documents", B.sql("SELECT file_name FROM sow_base WHERE file_name LIKE '%.docx'"))
def sc03(spark, sf_dir):
    return B.sow_base(spark, sf_dir).where(files.has_extension(F.col("file_name"), ["docx"])).select("file_name")


@F.pandas_udf(T.BinaryType())
def make_docx(texts: pd.Series) -> pd.Series:
    """A minimal zipped document around each text (test input for the reader)."""
    out = []
    for text in texts:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"<w:document><w:p><w:t>{escape(text)}</w:t></w:p></w:document>")
        out.append(buffer.getvalue())
    return pd.Series(out)


# --- files that Spark writes and reads back ---------------------------------------------------------


@query("sc01_read_sow_json", B.sql("""
  SELECT sow_key % 10 = 0 AS corrupt, CASE WHEN sow_key % 10 > 0 THEN client_name END AS client_name, CASE WHEN sow_key % 10 > 0 THEN project_title END AS project_title,
    CASE WHEN sow_key % 10 > 0 THEN n_lines END AS n_deliverables FROM sow WHERE o_orderstatus = 'P'"""))
def sc01_files(spark, sf_dir):
    """One file per running SOW, each a JSON object; every tenth is broken."""
    s = B.sow(spark, sf_dir).where("o_orderstatus = 'P'")
    good = F.to_json(F.struct("file_name", "client_name", "project_title", "deliverables"))
    path = work_folder(spark, "sow-json")
    files.write_texts(s.select(F.when(F.col("sow_key") % 10 == 0, F.concat(F.lit("{broken "), good)).otherwise(good).alias("t")), "t", path, per_file=1)
    read = files.read_sow_json(spark, path, glob="*.txt").select(F.lit(False).alias("corrupt"), "client_name", "project_title", F.size("deliverables").alias("n_deliverables"))
    none = F.lit(None).cast("string")
    bad = files.read_sow_json(spark, path, corrupt=True, glob="*.txt").select(F.lit(True).alias("corrupt"), none.alias("client_name"), none.alias("project_title"), F.lit(None).cast("int").alias("n_deliverables"))
    return read.unionByName(bad)


@query("sc02_read_text_files", "SELECT md5(text || chr(10)) AS digest, length(text) + 1 AS chars FROM documents")
def sc02_files(spark, sf_dir):
    """One text file per document."""
    path = work_folder(spark, "texts")
    files.write_texts(B.table(spark, sf_dir, "documents").select("text"), "text", path, per_file=1)
    return files.read_texts(spark, path).select(F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("chars"))


@query("sc03_list_files", "SELECT 'txt' AS extension, count(*) AS files, sum(octet_length(encode(text)) + 1) AS bytes FROM documents")
def sc03_files(spark, sf_dir):
    path = work_folder(spark, "texts")
    files.write_texts(B.table(spark, sf_dir, "documents").select("text"), "text", path, per_file=1)
    found = files.list_documents(spark, path, ["txt"])
    return found.groupBy(F.element_at(F.split("file", r"\."), -1).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("sc06_read_org_chart", """
  SELECT key, arg_min(t, o) AS chart_title, arg_min(l, o) AS chart_level FROM (
    SELECT lower(unnest([n, p_type])) AS key, n AS t, CAST(p_size AS INTEGER) AS l, p_partkey * 2 + unnest([0, 1]) AS o
    FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'Lead ' || p_type ELSE p_type END AS n FROM part)) GROUP BY key""")
def sc06(spark, sf_dir):
    """A chart of titles in one small file, found by fragments of its header."""
    part = B.table(spark, sf_dir, "part").orderBy("p_partkey")
    path = work_folder(spark, "chart")
    normal = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Lead "), F.col("p_type")))
    (part.select(F.col("p_type").alias("Role title"), F.col("p_size").alias("Level (1-50)"), normal.alias("Normalized name"))
     .coalesce(1).write.option("header", True).csv(path))
    return files.read_org_chart(spark, path)


@query("sc10_write_tables", B.sql("SELECT file, 1 AS table_index, array_to_string(cells, '/') AS cells FROM mx WHERE sow_key % 100 = 1", MATRIX_SQL))
def sc10(spark, sf_dir):
    """Tables of every hundredth customer order as CSV folders, read back with what their names say."""
    path = work_folder(spark, "csv-tables")
    files.write_tables(matrix(spark, sf_dir).where("cast(file AS bigint) % 100 = 1"), path)
    back = files.read_tables(spark, path, 5)
    value = [F.coalesce(f"c{i}", F.lit("")) for i in range(5)]
    return back.select("file", "table_index", F.concat_ws("/", *value).alias("cells"))


@query("sc11_write_json", "SELECT s_suppkey, s_name, s_acctbal, n_name AS nation, 1 AS objects FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def sc11(spark, sf_dir):
    """One JSON file per supplier; every file has one object."""
    s = B.table(spark, sf_dir, "supplier").join(B.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = work_folder(spark, "json")
    files.write_json(s.select("s_suppkey", "s_name", "s_acctbal", F.struct(F.col("n_name").alias("name")).alias("nation")), path, per_file=1)
    kind = s.schema["s_acctbal"].dataType.simpleString()
    back = spark.read.schema(f"s_suppkey bigint, s_name string, s_acctbal {kind}, nation struct<name string>, _corrupt_record string").json(path)
    rows = back.withColumn("_file", F.col("_metadata.file_path"))
    each = rows.groupBy("_file").agg(F.count(F.lit(1)).cast("int").alias("objects"))
    return rows.where("_corrupt_record IS NULL").join(each, "_file").select("s_suppkey", "s_name", "s_acctbal", F.col("nation.name").alias("nation"), "objects")


@query("sc16_combine", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def sc16(spark, sf_dir):
    """Part files and an earlier combined file in one folder; the combined file is left out."""
    c = B.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    path = work_folder(spark, "parts")
    files.write_json(c.repartition(7, "c_custkey"), path, per_file=1000)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema)
    return files.combine(spark, path, schema, skip="_combined", multi_line=False).drop("source_file")


@query("sc08_markdown_lines", B.sql("""
  SELECT file, CAST(row_index + CASE WHEN row_index > 0 THEN 1 ELSE 0 END AS INTEGER) AS line_no, array_to_string(cells, ' | ') AS line FROM mx
  UNION ALL SELECT DISTINCT file, 1, '--- | --- | --- | --- | ---' FROM mx""", MATRIX_SQL))
def sc08_lines(spark, sf_dir):
    return X.markdown_lines(matrix(spark, sf_dir)).select("file", "line_no", "line")


@query("sc09_lines_to_rows", B.sql("SELECT file, row_index, array_to_string(cells, '/') AS cells FROM mx", MATRIX_SQL))
def sc09_lines(spark, sf_dir):
    rows = X.lines_to_rows(X.markdown_lines(matrix(spark, sf_dir)))
    return rows.select("file", "row_index", F.array_join("cells", "/").alias("cells"))


@query("tx29_layout_lines", """
  WITH k AS (SELECT conv_id AS file, turn // 3 AS page, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
      dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 3) AS p FROM conversations WHERE text <> '')
  SELECT file, n + p - 1 AS position, text AS line FROM k
  UNION ALL SELECT file, min(n) + p - 2, '' FROM k WHERE p > 1 GROUP BY file, p""")
def tx29_lines(spark, sf_dir):
    from sowmill.functions.text import layout_lines

    rows = B.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("line_no"), F.col("text").alias("content"))
    return layout_lines(rows)


@query("sc04_docx_text", r"""
  SELECT CAST(doc_id AS VARCHAR) AS file, md5(trim(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'),
    '>', '&gt;'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def sc04(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"),
                                                      make_docx("text").alias("content"))
    return files.docx_text(docs).select("file", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("sc05_sniff_format", """
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' END AS format FROM documents""")
def sc05(spark, sf_dir):
    k = F.col("doc_id") % 3
    content = F.concat(F.when(k == 0, "%PDF-1.7 ").when(k == 1, "PK..").otherwise("<html>"), F.col("text")).cast("binary")
    return B.table(spark, sf_dir, "documents").select("doc_id", files.sniff_format(content).alias("format"))


@query("sc07_cells_to_matrix", B.sql("SELECT file, row_index, array_to_string(cells, '/') AS cells FROM mx", MATRIX_SQL))
def sc07(spark, sf_dir):
    return X.cells_to_matrix(cells(spark, sf_dir)).select("file", "row_index", F.array_join("cells", "/").alias("cells"))


@query("sc08_matrix_to_markdown", B.sql("""
  SELECT file, string_agg(CASE WHEN row_index = 0 THEN array_to_string(cells, ' | ') || chr(10) || '--- | --- | --- | --- | ---'
      ELSE array_to_string(cells, ' | ') END, chr(10) ORDER BY row_index) AS markdown,
    string_agg(CASE WHEN row_index = 0 THEN array_to_string(list_filter(cells, lambda c: c <> ''), ' | ') || chr(10) ||
      array_to_string(list_transform(list_filter(cells, lambda c: c <> ''), lambda c: '---'), ' | ')
      ELSE array_to_string(list_filter(cells, lambda c: c <> ''), ' | ') END, chr(10) ORDER BY row_index) AS short
  FROM mx GROUP BY file""", MATRIX_SQL))
def sc08(spark, sf_dir):
    m = matrix(spark, sf_dir)
    short = X.matrix_to_markdown(m, drop_empty=True).select("file", F.col("markdown").alias("short"))
    return X.matrix_to_markdown(m).select("file", "markdown").join(short, "file")


@query("sc09_markdown_to_rows", B.sql("SELECT file, row_index, array_to_string(cells, '/') AS cells FROM mx", MATRIX_SQL))
def sc09(spark, sf_dir):
    md = X.matrix_to_markdown(matrix(spark, sf_dir))
    return (md.select("file", F.posexplode(X.markdown_to_rows(F.col("markdown"))).alias("row_index", "c"))
            .select("file", "row_index", F.array_join("c", "/").alias("cells")))


@query("sc12_manifest", """
  SELECT doc_id, lang AS format, source AS company, length(text) AS text_chars, length(text) >= 100 AS has_record FROM documents""")
def sc12(spark, sf_dir):
    t = F.length("text")
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("format"), F.col("source").alias("company"), t.alias("text_chars"),
        (t >= 100).alias("has_record"))


@query("sc13_upsert", """
  WITH batch AS (SELECT o_custkey AS id, max(o_orderkey) AS newest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  target AS (SELECT c_custkey AS id, 'old ' || c_name AS name, CASE c_custkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 1000000000 ELSE c_custkey * 20 END AS version FROM customer)
  SELECT t.id, CASE WHEN newest >= version THEN 'new' ELSE name END AS name, CASE WHEN newest >= version THEN newest ELSE version END AS version
  FROM target t LEFT JOIN batch b ON b.id = t.id""")
def sc13(spark, sf_dir):
    """The target holds rows that are older than the batch, newer, and some of either."""
    key = F.col("c_custkey")
    version = F.when(key % 3 == 0, F.lit(-1)).when(key % 3 == 1, F.lit(1000000000)).otherwise(key * 20)
    target = B.table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("old "), "c_name").alias("name"), version.cast("long").alias("version"))
    batch = (B.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
             .select(F.col("o_custkey").alias("id"), F.lit("new").alias("name"), F.col("o_orderkey").alias("version")))
    return merge.upsert(target, batch, "id", F.col("version"))


@query("sc14_merge_field", """
  SELECT o_orderkey, coalesce(p.v, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN
    (SELECT l_orderkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) p ON p.k = o_orderkey""")
def sc14(spark, sf_dir):
    target = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("legacy"))
    patch = (B.table(spark, sf_dir, "lineitem").where("l_discount > 0.08").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.max("l_returnflag").alias("o_orderpriority")))
    return merge.merge_field(target, patch, "o_orderkey", "o_orderpriority", drop=["legacy"])


@query("sc15_delete_where", B.sql("""
  SELECT sow_key, n_lines FROM sow WHERE NOT (sow_key % 5 = 0 AND n_lines > 0)
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""))
def sc15(spark, sf_dir):
    df = B.with_counts(spark, sf_dir, B.sow_base(spark, sf_dir))
    client = F.when(F.col("sow_key") % 5 != 0, F.col("client_name"))  # stray rows: no client but a staffing list
    kept = merge.delete_where(df, client.isNull() & (F.col("n_lines") > 0))
    gone = B.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.delete_ids(kept, gone, "o_custkey").select("sow_key", "n_lines")


@query("sc17_result_markdown", B.sql(f"""
  SELECT sow_key, '# SOW Search Result' || chr(10) || chr(10) || '**Client:** ' || client_name || chr(10) || '**Project:** ' ||
    project_title || chr(10) || '**Dates:** ' || CAST(start_date AS VARCHAR) || ' to ' || coalesce(CAST(end_date AS VARCHAR), 'N/A') ||
    chr(10) || chr(10) || '## Scope Summary' || chr(10) || scope_summary || chr(10) || chr(10) || '## Deliverables' || chr(10) ||
    array_to_string(list_transform(deliverables, lambda d, i: i || '. ' || d), chr(10)) || chr(10) || chr(10) ||
    '## Staffing Plan' || chr(10) || array_to_string(list_transform(string_split({PLAN_STRINGS}, ' | '),
      lambda s, i: CASE WHEN n_lines = 0 THEN '' ELSE i || '. ' || s END), chr(10)) || chr(10) AS markdown FROM sow"""))
def sc17(spark, sf_dir):
    from sowmill.operators.report import result_markdown

    df = B.sow(spark, sf_dir)
    lines = F.transform("staffing", lambda s: S.format_entry(s["name"], s["title"], S.percent_text(s["pct"])))
    return result_markdown(df.withColumn("staffing_lines", lines)).select("sow_key", "markdown")


@query("sc18_export_plan", B.sql("""
  SELECT sow_key, seq, title AS "Role", level AS "Level", 1 AS "Quantity", CAST(pct AS INTEGER) AS "Allocation_Percent" FROM ln"""))
def sc18(spark, sf_dir):
    from sowmill.plans.build import export_plan

    roles = F.transform("staffing", lambda s: F.struct(
        s["title"].alias("role"), F.lit(None).cast("string").alias("department"), s["level"].alias("level"),
        F.lit(1).alias("quantity"), s["pct"].cast("int").alias("allocation_percent"), F.lit("").alias("notes")))
    return export_plan(B.sow(spark, sf_dir).withColumn("roles", roles), "sow_key").select(
        "sow_key", "seq", "Role", "Level", "Quantity", "Allocation_Percent")


# --- table parsing ------------------------------------------------------------------------------


_CANON = """CASE WHEN regexp_matches(h, 'name|personnel|staff') THEN 'name'
  WHEN regexp_matches(h, 'title|role|position') THEN CASE WHEN contains(h, 'primary role') THEN 'primary_role' ELSE 'role' END
  WHEN contains(h, '%') OR contains(h, 'percent') THEN 'percentage'
  WHEN trim(h, ' #') = 'hours' OR contains(h, '# hours') THEN 'hours'
  WHEN contains(h, 'billable hours per annum') THEN 'bhpa' WHEN contains(h, 'hour') THEN 'hours'
  WHEN contains(h, 'location') THEN 'location' WHEN contains(h, 'level') THEN 'level'
  WHEN regexp_matches(h, 'workstream|discipline|department') THEN 'workstream' ELSE h END"""
HEADER_FORMS = ["{} Staff", "Primary  Role {}", "{} Position", "% of {}", "# Hours", "Billable Hours Per Annum", "{} hourly",
                "Primary Location", "Level", "Discipline", "{}"]


@query("tx21_canonical_header", f"""
  SELECT p_partkey, header, {_CANON} AS canonical FROM (
    SELECT p_partkey, header, lower(regexp_replace(trim(header), '\\s+', ' ', 'g')) AS h FROM (
      SELECT p_partkey, CASE p_partkey % {len(HEADER_FORMS)} {' '.join(f"WHEN {i} THEN replace('{f}', '{{}}', p_name)"
                                                              for i, f in enumerate(HEADER_FORMS))} END AS header FROM part))""")
def tx21(spark, sf_dir):
    form = B.pick(HEADER_FORMS, F.col("p_partkey") % len(HEADER_FORMS))
    header = F.replace(form, F.lit("{}"), F.col("p_name"))
    return B.table(spark, sf_dir, "part").select("p_partkey", header.alias("header"),
                                                 X.canonical_header(header).alias("canonical"))


@query("tx22_header_row", B.sql("SELECT file, CASE WHEN sow_key % 3 = 1 THEN 1 ELSE 0 END AS header_index FROM mx GROUP BY 1, 2",
                                MATRIX_SQL))
def tx22(spark, sf_dir):
    return X.table_headers(matrix(spark, sf_dir)).select("file", "header_index")


@query("tx23_fill_headers", B.sql("""
  SELECT CAST(sow_key AS VARCHAR) AS file, CASE WHEN sow_key % 3 < 2 THEN 'name/role/level/percentage/hours'
    ELSE 'name/role/level/percentage/hours' END AS header_keys FROM ln_list"""))
def tx23(spark, sf_dir):
    return X.table_headers(matrix(spark, sf_dir)).select("file", F.array_join("header_keys", "/").alias("header_keys"))


@query("tx24_table_to_entries", B.sql("""
  SELECT CAST(sow_key AS VARCHAR) AS file, name, title AS role, CAST(level AS VARCHAR) AS level, pct AS percentage, hours,
    CAST(seq AS INTEGER) AS row_index, name AS raw_first, CASE WHEN sow_key % 3 = 2 THEN 2 ELSE 0 END AS blank_headers FROM ln"""))
def tx24(spark, sf_dir):
    first = F.coalesce(F.try_element_at("column_values", F.lit("Personnel")),
                       F.try_element_at("column_values", F.lit("Name")))
    blank = F.when(F.map_contains_key("column_values", F.lit("")), 2).otherwise(0)
    return X.table_to_entries(matrix(spark, sf_dir)).select(
        "file", "name", "role", "level", "percentage", "hours", "row_index", first.alias("raw_first"),
        blank.alias("blank_headers"))


@query("tx25_markdown_to_entries", B.sql("""
  SELECT CAST(sow_key AS VARCHAR) AS file, name || ' / ' || title AS title, CAST(level AS VARCHAR) AS level, hours, pct AS pct_time
  FROM ln WHERE sow_key % 3 = 0  -- the other tables carry no readable header in their first line"""))
def tx25(spark, sf_dir):
    md = X.matrix_to_markdown(matrix(spark, sf_dir))
    return (md.select("file", F.explode(X.markdown_to_entries(F.col("markdown"))).alias("e"))
            .select("file", "e.title", "e.level", "e.hours", "e.pct_time"))


@query("tx26_staffing_header", B.sql("""
  SELECT file, row_index, regexp_matches(lower(array_to_string(cells, '|')), 'name|title|role|personnel') AND
    regexp_matches(lower(array_to_string(cells, '|')), 'hours|%\\s*time|fte|allocation') AS is_header FROM mx""", MATRIX_SQL))
def tx26(spark, sf_dir):
    return matrix(spark, sf_dir).select("file", "row_index",
                                        X.is_staffing_header(F.array_join("cells", " | ")).alias("is_header"))


@query("tx27_to_allocation", B.sql("""
  SELECT sow_key, l_linenumber, CASE WHEN contains(title, ' ') THEN split_part(title, ' ', 1) ELSE 'N/A' END AS name,
    CASE WHEN contains(title, ' ') THEN substr(title, strpos(title, ' ') + 1) ELSE title END AS role,
    CAST(CAST(pct AS DECIMAL(20,1)) AS VARCHAR) || '%' AS allocation, pct AS pct_time, hours FROM ln"""))
def tx27(spark, sf_dir):
    from sowmill.functions.text import to_allocation

    e = B.lines(spark, sf_dir, supplier=False)
    return (e.select("sow_key", "l_linenumber", to_allocation(F.col("title"), F.col("pct"), F.lit(None).cast("double")).alias("a"))
            .select("sow_key", "l_linenumber", "a.name", "a.role", "a.allocation", "a.pct_time", "a.hours"))


@query("tx28_entry_totals", """
  SELECT l_orderkey AS file, count(*) AS entries, sum(h) AS total_hours FROM (
    SELECT l_orderkey, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_quantity * 36 END AS h,
      CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_quantity END AS p FROM lineitem)
  WHERE h IS NOT NULL OR p IS NOT NULL GROUP BY l_orderkey""")
def tx28(spark, sf_dir):
    from sowmill.operators.report import entry_totals

    k = F.col("l_partkey")
    rows = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.when(k % 4 != 0, F.col("l_quantity") * 36).alias("hours"),
        F.when(k % 8 != 0, F.col("l_quantity")).alias("pct_time"))
    return entry_totals(rows)


@query("tx29_layout_text", """
  SELECT conv_id AS file, string_agg(page_text, chr(10) || chr(10) ORDER BY page) AS text FROM (
    SELECT conv_id, turn // 3 AS page, string_agg(text, chr(10) ORDER BY turn) AS page_text FROM conversations
    WHERE text <> '' GROUP BY 1, 2) GROUP BY 1""")
def tx29(spark, sf_dir):
    from sowmill.functions.text import layout_text

    rows = B.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("line_no"),
        F.col("text").alias("content"))
    return layout_text(rows)
