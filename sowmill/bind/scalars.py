"""Projections, filters and scalar functions over SOW rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.bind import base as B
from sowmill.bind.registry import query
from sowmill.functions import scalars as S

ALLOC = ["{h} hours", "{h} hrs ({p}%)", "{p}%", "0.5 FTE", "2 x {n} months", "1,800 hrs", "", "Onboarding", "{n} months"]


def alloc_text(df):
    """Allocation text in nine spellings, chosen by part key."""
    h = F.col("hours").cast("long").cast("string")
    p = F.col("pct").cast("long").cast("string")
    n = F.col("l_linenumber").cast("string")
    case = None
    for i, form in enumerate(ALLOC):
        text = F.replace(F.replace(F.replace(F.lit(form), F.lit("{h}"), h), F.lit("{p}"), p), F.lit("{n}"), n)
        cond = F.col("l_partkey") % len(ALLOC) == i
        case = F.when(cond, text) if case is None else case.when(cond, text)
    return df.withColumn("allocation", case)


def alloc(spark, sf_dir):
    item = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sow_key"), "l_linenumber", "l_partkey",
        (F.col("l_quantity") * 36).alias("hours"), (F.col("l_quantity") * 2).alias("pct"))
    return alloc_text(item)


def _alloc_sql() -> str:
    forms = []
    for i, form in enumerate(ALLOC):
        forms.append(f"WHEN {i} THEN replace(replace(replace('{form}', '{{h}}', CAST(CAST(l_quantity*36 AS BIGINT) AS "
                     f"VARCHAR)), '{{p}}', CAST(CAST(l_quantity*2 AS BIGINT) AS VARCHAR)), '{{n}}', "
                     "CAST(l_linenumber AS VARCHAR))")
    return ("alloc AS (SELECT l_orderkey AS sow_key, l_linenumber, l_partkey, l_quantity*36 AS hours, "
            f"l_quantity*2 AS pct, CASE l_partkey % {len(ALLOC)} {' '.join(forms)} END AS allocation FROM lineitem)")


ALLOC_SQL = _alloc_sql()
RAW = "SELECT *, regexp_replace(trim(allocation), '(\\d),(\\d{3})', '\\1\\2', 'g') AS t FROM alloc"
IDS = ["sow_key", "l_linenumber", "allocation"]


def n(pattern: str, col: str = "t", group: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract({col}, '{pattern}', {group}), '') AS DOUBLE)"


def dec1(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(28,6)) AS DECIMAL(24,1))"


@query("pj01_parse_file_name", B.sql(r"""
  SELECT file_name, 'Company_' || regexp_extract(file_name, '(?i)company_(\d+).*?sow_(\d+)\.(\w+)$', 1) AS company,
    regexp_extract(file_name, '(?i)company_(\d+).*?sow_(\d+)\.(\w+)$', 2) AS sow_id,
    lower(regexp_extract(file_name, '(?i)company_(\d+).*?sow_(\d+)\.(\w+)$', 3)) AS ext FROM sow_base"""))
def pj01(spark, sf_dir):
    return B.sow_base(spark, sf_dir).select("file_name", S.parse_file_name(F.col("file_name")).alias("n")).select(
        "file_name", "n.company", "n.sow_id", "n.ext")


@query("pj02_doc_id", B.sql(r"""
  SELECT sow_key, regexp_replace(regexp_replace(
      CASE sow_key % 3 WHEN 0 THEN file_name WHEN 1 THEN project_title ELSE client_name END,
      '\.[A-Za-z0-9]+$', ''), '[^A-Za-z0-9_\-=]', '_', 'g') AS id FROM sow_base"""))
def pj02(spark, sf_dir):
    kind = F.col("sow_key") % 3
    blank = F.lit("")
    return B.sow_base(spark, sf_dir).select("sow_key", S.doc_id(
        F.when(kind == 0, F.col("file_name")).otherwise(blank),
        F.when(kind <= 1, F.col("project_title")).otherwise(blank), F.col("client_name"),
        F.col("scope_summary")).alias("id"))


@query("pj03_base_name", B.sql(r"""
  SELECT file_name, regexp_replace(file_name, '\.(pdf|docx|txt)$', '') AS base,
    regexp_replace(file_name, '\.(pdf|docx|txt)$', '') || '_parsed.json' AS parsed FROM sow_base"""))
def pj03(spark, sf_dir):
    f = F.col("file_name")
    return B.sow_base(spark, sf_dir).select(f, S.base_name(f).alias("base"),
                                            S.artifact_name(f, "_parsed.json").alias("parsed"))


_MISSING = ["N/A", " na ", "", "  x "]


@query("pj04_null_if_na", B.sql("""
  SELECT sow_key, CASE WHEN upper(trim(v)) IN ('', 'N/A', 'NA') THEN NULL ELSE trim(v) END AS v FROM (
    SELECT sow_key, CASE sow_key % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN ' na ' WHEN 2 THEN '' ELSE '  ' || client_name END AS v
    FROM sow_base)"""))
def pj04(spark, sf_dir):
    k = F.col("sow_key") % 4
    v = F.when(k == 0, "N/A").when(k == 1, " na ").when(k == 2, "").otherwise(
        F.concat(F.lit("  "), F.col("client_name")))
    return B.sow_base(spark, sf_dir).select("sow_key", S.null_if_na(v).alias("v"))


@query("pj05_project_length", B.sql("""
  SELECT sow_key, CASE WHEN d >= 365 THEN CAST(round(d / 30.44) AS BIGINT) || ' months'
    WHEN d >= 30 THEN CAST(round(d / 7.0) AS BIGINT) || ' weeks'
    WHEN d IS NOT NULL THEN d || ' days' END AS project_length
  FROM (SELECT sow_key, date_diff('day', start_date, end_date) AS d FROM sow)"""))
def pj05(spark, sf_dir):
    df = B.with_end_date(spark, sf_dir, B.sow_base(spark, sf_dir))
    return df.select("sow_key", S.project_length(F.col("start_date"), F.col("end_date")).alias("project_length"))


@query("pj06_allocation_percent", B.sql(f"""
  SELECT sow_key, l_linenumber, allocation, CASE WHEN trim(allocation) = '' THEN '0.0%'
    WHEN p IS NOT NULL THEN {dec1('p')} || '%' WHEN h IS NOT NULL THEN {dec1('h * 100.0 / 1800')} || '%'
    ELSE trim(allocation) END AS pct_text
  FROM (SELECT *, {n('(\\d+(?:\\.\\d+)?)\\s*%')} AS p, {n('(?i)(\\d+(?:\\.\\d+)?)\\s*h(?:ours?|rs?)?')} AS h FROM ({RAW}))
  """, ALLOC_SQL))
def pj06(spark, sf_dir):
    return alloc(spark, sf_dir).select(*IDS, S.normalize_allocation_pct(F.col("allocation")).alias("pct_text"))


@query("pj07_allocation_struct", B.sql(f"""
  SELECT sow_key, l_linenumber, allocation,
    CASE WHEN coalesce(h,0) <> 0 AND coalesce(p,0) = 0 THEN h * 100.0 / 1800 ELSE p END AS pct_time,
    CASE WHEN coalesce(p,0) <> 0 AND coalesce(h,0) = 0 THEN p * 1800 / 100.0 ELSE h END AS hours, months
  FROM (SELECT *, coalesce(fte * 100, p0) AS p, coalesce(fte * 1800, h0) AS h FROM (
    SELECT *, {n('(\\d+(?:\\.\\d+)?)\\s*%')} AS p0, {n('(?i)(\\d+(?:\\.\\d+)?)\\s*h(?:ours?|rs?)?')} AS h0,
      {n('(?i)(\\d+(?:\\.\\d+)?)\\s*fte')} AS fte,
      coalesce({n('(?i)(\\d+(?:\\.\\d+)?)\\s*x\\s*(\\d+(?:\\.\\d+)?)\\s*months?')} *
        {n('(?i)(\\d+(?:\\.\\d+)?)\\s*x\\s*(\\d+(?:\\.\\d+)?)\\s*months?', group=2)},
        {n('(?i)(\\d+(?:\\.\\d+)?)\\s*months?')}) AS months
    FROM ({RAW})))""", ALLOC_SQL))
def pj07(spark, sf_dir):
    a = S.normalize_allocation(F.col("allocation"))
    return alloc(spark, sf_dir).select(*IDS, a.alias("a")).select(*IDS, "a.pct_time", "a.hours", "a.months")


@query("pj08_extract_percent", B.sql(f"""
  SELECT sow_key, l_linenumber, allocation, coalesce({n('(\\d{1,3}(?:\\.\\d+)?)\\s*%', 'allocation')},
    {n('(?i)(\\d(?:\\.\\d+)?)\\s*fte', 'allocation')} * 100) AS pct FROM alloc""", ALLOC_SQL))
def pj08(spark, sf_dir):
    return alloc(spark, sf_dir).select(*IDS, S.extract_pct(F.col("allocation")).alias("pct"))


@query("pj09_extract_hours", B.sql(f"""
  SELECT sow_key, l_linenumber, allocation,
    {n('(?i)(\\d{1,4}(?:\\.\\d+)?)\\s*(?:hours|hrs|hr)\\b', 'allocation')} AS h,
    {n('^(\\d{1,4}(?:\\.\\d+)?)$', 'bare')} AS bare_h
  FROM (SELECT *, CAST(CAST(hours AS BIGINT) AS VARCHAR) AS bare FROM alloc)""", ALLOC_SQL))
def pj09(spark, sf_dir):
    bare = F.col("hours").cast("long").cast("string")
    return alloc(spark, sf_dir).select(*IDS, S.extract_hours(F.col("allocation")).alias("h"),
                                       S.extract_hours(bare).alias("bare_h"))


@query("pj10_clean_hours", r"""
  SELECT l_orderkey, l_linenumber, raw, CASE WHEN regexp_full_match(t, '\d{1,3}(?:\.\d{3})+')
    THEN replace(t, '.', '') ELSE t END AS cleaned
  FROM (SELECT *, trim(replace(raw, ',', '')) AS t FROM (
    SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN CAST(l_linenumber AS VARCHAR) || ',' ||
      lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 3, '0')
      WHEN 1 THEN CAST(l_linenumber AS VARCHAR) || '.' || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 3, '0')
      ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5 ' END AS raw FROM lineitem))""")
def pj10(spark, sf_dir):
    k, q = F.col("l_partkey") % 3, F.col("l_quantity").cast("long").cast("string")
    mark = F.when(k == 0, ",").otherwise(".")
    raw = F.when(k <= 1, F.concat(F.col("l_linenumber").cast("string"), mark, F.lpad(q, 3, "0"))).otherwise(
        F.concat(q, F.lit(".5 ")))
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"),
                                                     S.clean_hours(raw).alias("cleaned"))


@query("pj11_allocation_columns", B.sql(r"""
  SELECT sow_key, l_linenumber, allocation, regexp_extract(allocation, '(\d+(?:,\d+)?)\s*hrs?', 1) AS hours,
    regexp_extract(allocation, '(\d+(?:\.\d+)?%)', 1) AS percentage FROM alloc""", ALLOC_SQL))
def pj11(spark, sf_dir):
    return alloc(spark, sf_dir).select(*IDS, S.allocation_columns(F.col("allocation")).alias("a")).select(
        *IDS, "a.hours", "a.percentage")


@query("pj12_normalize_fte", """
  SELECT l_orderkey, l_linenumber, kind, weeks,
    CASE WHEN kind = 'hours' THEN l_quantity ELSE l_quantity / 100.0 * 40 * nullif(weeks, 0) END AS hours,
    CASE WHEN kind = 'hours' THEN l_quantity / nullif(weeks, 0) / 40 * 100 ELSE l_quantity END AS fte_percentage
  FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'hours' ELSE 'fte_percentage' END AS kind,
    CAST(l_linenumber % 5 AS INTEGER) AS weeks FROM lineitem)""")
def pj12(spark, sf_dir):
    kind = F.when(F.col("l_partkey") % 2 == 0, "hours").otherwise("fte_percentage")
    weeks = (F.col("l_linenumber") % 5).cast("int")
    return (B.table(spark, sf_dir, "lineitem")
            .select("l_orderkey", "l_linenumber", kind.alias("kind"), weeks.alias("weeks"), "l_quantity")
            .withColumn("a", S.normalize_fte(F.col("l_quantity"), F.col("kind"), F.col("weeks")))
            .select("l_orderkey", "l_linenumber", "kind", "weeks", "a.hours", "a.fte_percentage"))


@query("pj13_minimal_hours_percent", f"""
  SELECT l_orderkey, l_linenumber, CAST({dec1('CASE WHEN p IS NOT NULL THEN greatest(0.0, least(100.0, p)) * 1800 / 100.0 ELSE h END')} AS DOUBLE) AS hours,
    CAST({dec1('CASE WHEN p IS NOT NULL THEN greatest(0.0, least(100.0, p)) ELSE h * 100.0 / 1800 END')} AS DOUBLE) AS hours_pct
  FROM (SELECT l_orderkey, l_linenumber,
    CASE l_partkey % 3 WHEN 0 THEN l_quantity * 3 WHEN 1 THEN NULL ELSE NULL END AS p,
    CASE l_partkey % 3 WHEN 2 THEN NULL ELSE l_quantity * 36 END AS h FROM lineitem)""")
def pj13(spark, sf_dir):
    k = F.col("l_partkey") % 3
    p, h = F.when(k == 0, F.col("l_quantity") * 3), F.when(k != 2, F.col("l_quantity") * 36)
    return (B.table(spark, sf_dir, "lineitem")
            .select("l_orderkey", "l_linenumber", S.reconcile(h, p).alias("r"))
            .select("l_orderkey", "l_linenumber", "r.hours", "r.hours_pct"))


def plan_strings(df, sep=" | "):
    return F.array_join(F.transform("staffing", lambda s: S.format_entry(
        s["name"], s["title"], S.percent_text(s["pct"]))), sep)


PLAN_STRINGS = ("array_to_string(list_transform(staffing, lambda s: s.name || ' (' || s.title || '): ' || "
                f"{dec1('s.pct')} || '%'), ' | ')")


@query("pj14_format_staffing", B.sql(f"""
  SELECT sow_key, {PLAN_STRINGS} AS staffing_text, array_to_string(list_transform(staffing, lambda s: s.name || ' — ' ||
    s.title || ' — ' || {dec1('s.pct')} || '%'), ' | ') AS dashed FROM sow"""))
def pj14(spark, sf_dir):
    dashed = F.array_join(F.transform("staffing", lambda s: S.format_entry_dashed(
        s["name"], s["title"], S.percent_text(s["pct"]))), " | ")
    df = B.sow(spark, sf_dir)
    return df.select("sow_key", plan_strings(df).alias("staffing_text"), dashed.alias("dashed"))


@query("pj15_parse_staffing", B.sql(f"""
  SELECT sow_key, l_linenumber,
    CASE k WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN '' ELSE name END AS name,
    CASE k WHEN 3 THEN '' ELSE title END AS title,
    CASE k WHEN 2 THEN CAST(hours AS BIGINT) || ' hours' WHEN 3 THEN '' ELSE {dec1('pct')} || '%' END AS allocation
  FROM (SELECT *, l_partkey % 4 AS k FROM ln)"""))
def pj15(spark, sf_dir):
    k = F.col("l_partkey") % 4
    p, h = F.col("pct").cast("long").cast("string"), F.col("hours").cast("long").cast("string")
    text = (F.when(k == 0, F.concat("name", F.lit(" ("), "title", F.lit("): "), p, F.lit("%")))
            .when(k == 1, F.concat("name", F.lit(" - "), "title", F.lit(" - "), p, F.lit("%")))
            .when(k == 2, F.concat("title", F.lit(": "), h, F.lit(" hours"))).otherwise(F.col("name")))
    return (B.lines(spark, sf_dir).select("sow_key", "l_linenumber", S.parse_staffing(text).alias("s"))
            .select("sow_key", "l_linenumber", "s.name", "s.title", "s.allocation"))


def json_plan():
    """Plan as JSON text in three shapes: list of objects, wrapped list, list of display strings."""
    k = F.col("sow_key") % 3
    objects = F.to_json(F.transform("staffing", lambda s: F.struct(
        s["name"].alias("name"), s["title"].alias("title"), s["pct"].alias("hours_pct"))))
    strings = F.to_json(F.transform("staffing", lambda s: S.format_entry(
        s["name"], s["title"], S.percent_text(s["pct"]))))
    return (F.when(k == 0, objects).when(k == 1, F.concat(F.lit('{"entries":'), objects, F.lit("}")))
            .otherwise(strings))


@query("pj16_is_structured", B.sql("""
  SELECT sow_key, (sow_key % 3 = 1) OR (sow_key % 3 = 0 AND n_lines > 0) AS structured FROM sow"""))
def pj16(spark, sf_dir):
    return B.sow(spark, sf_dir).select("sow_key", S.is_structured(json_plan()).alias("structured"))


@query("pj17_plan_to_rows", B.sql(f"""
  SELECT s.sow_key, l.name, l.title, CASE WHEN l.sow_key IS NOT NULL THEN {dec1('l.pct')} || '%' END AS allocation
  FROM sow_base s LEFT JOIN ln l ON l.sow_key = s.sow_key"""))
def pj17(spark, sf_dir):
    return (B.sow(spark, sf_dir).select("sow_key", F.explode_outer(S.plan_items(json_plan())).alias("e"))
            .select("sow_key", "e.name", "e.title", "e.allocation"))


@query("pj18_format_results", B.sql("""
  SELECT sow_key, coalesce(client_name, 'Unknown Client') AS client_name, coalesce(project_title, 'No title') AS project_title,
    coalesce(strftime(end_date, '%Y-%m-%d'), 'N/A') AS end_date,
    CASE WHEN length(scope_summary) > 200 THEN scope_summary[1:200] || '...' ELSE scope_summary END AS scope_preview,
    array_to_string(deliverables[1:3], '; ') AS deliverables_preview, n_lines AS deliverables_count,
    n_lines AS staffing_count FROM sow"""))
def pj18(spark, sf_dir):
    return B.sow(spark, sf_dir).select(
        "sow_key", F.coalesce("client_name", F.lit("Unknown Client")).alias("client_name"),
        F.coalesce("project_title", F.lit("No title")).alias("project_title"),
        F.coalesce(F.col("end_date").cast("string"), F.lit("N/A")).alias("end_date"),
        S.scope_preview(F.col("scope_summary")).alias("scope_preview"),
        F.array_join(S.preview(F.col("deliverables"), 3), "; ").alias("deliverables_preview"),
        F.size("deliverables").alias("deliverables_count"), F.size("staffing").alias("staffing_count"))


@query("pj19_overview_row", B.sql(f"""
  SELECT file_name, client_name, project_title, scope_summary, array_to_string(deliverables, ' | ') AS deliverables,
    array_to_string(exclusions, ' | ') AS exclusions, {PLAN_STRINGS} AS staffing_plan FROM sow"""))
def pj19(spark, sf_dir):
    df = B.sow(spark, sf_dir)
    return df.select("file_name", "client_name", "project_title", "scope_summary",
                     F.array_join("deliverables", " | ").alias("deliverables"),
                     F.array_join("exclusions", " | ").alias("exclusions"), plan_strings(df).alias("staffing_plan"))


@query("pj20_filters", B.sql("""
  SELECT sow_key, client_name, CAST(start_date AS VARCHAR) AS start_date FROM sow_base
  WHERE segment = 'MACHINERY' AND client_name <> 'Customer#000000001' AND start_date >= DATE '1996-01-01'
    AND start_date <= DATE '1997-12-31'"""))
def pj20(spark, sf_dir):
    c = F.col
    return (B.sow_base(spark, sf_dir)
            .where((c("segment") == "MACHINERY") & (c("client_name") != "Customer#000000001")
                   & (c("start_date") >= F.lit("1996-01-01").cast("date"))
                   & (c("start_date") <= F.lit("1997-12-31").cast("date")))
            .select("sow_key", "client_name", c("start_date").cast("string").alias("start_date")))


@query("pj22_confidence_band", """
  SELECT l_orderkey, l_linenumber, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c >= 0.4 THEN 'low'
    ELSE 'very low' END AS band FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS c FROM lineitem)""")
def pj22(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.confidence_band(F.col("l_quantity") / 50).alias("band"))


@query("pj23_project_columns", B.sql("SELECT client_name, project_title, file_name FROM sow_base"))
def pj23(spark, sf_dir):
    return B.sow_base(spark, sf_dir).select("client_name", "project_title", "file_name")


@query("pj24_with_defaults", B.sql("""
  SELECT sow_key, coalesce(CAST(end_date AS VARCHAR), 'Not specified') AS end_date,
    CASE WHEN n_lines > 0 THEN array_to_string(deliverables, ' | ') ELSE 'No deliverables listed' END AS deliverables,
    CASE WHEN len(exclusions) > 0 THEN array_to_string(exclusions, ' | ') ELSE 'No exclusions listed' END AS exclusions,
    n_lines AS staffing_count, n_lines AS deliverables_count, len(exclusions) AS exclusions_count FROM sow"""))
def pj24(spark, sf_dir):
    return B.sow(spark, sf_dir).select(
        "sow_key", F.coalesce(F.col("end_date").cast("string"), F.lit("Not specified")).alias("end_date"),
        S.list_or_default(F.col("deliverables"), "No deliverables listed").alias("deliverables"),
        S.list_or_default(F.col("exclusions"), "No exclusions listed").alias("exclusions"),
        F.size("staffing").alias("staffing_count"), F.size("deliverables").alias("deliverables_count"),
        F.size("exclusions").alias("exclusions_count"))


@query("pj25_validate", B.sql("""
  SELECT sow_key, end_date IS NOT NULL AND end_date > start_date AS end_after_start, n_lines <= 50 AS team_size,
    n_lines >= 1 AS has_deliverable, len(list_filter(deliverables, lambda d: length(d) > 500)) = 0 AS short_items,
    len(list_filter(staffing, lambda s: s.title IS NULL OR s.pct IS NULL)) = 0 AS complete_entries,
    end_date IS NOT NULL AND end_date > start_date AND n_lines BETWEEN 1 AND 50 AS ok FROM sow"""))
def pj25(spark, sf_dir):
    from sowmill.operators.report import validation_flags

    return validation_flags(B.sow(spark, sf_dir)).select(
        "sow_key", "end_after_start", "team_size", "has_deliverable", "short_items", "complete_entries", "ok")


def records(df):
    """Extraction records built from SOW rows."""
    key = F.col("sow_key")
    return df.withColumn("rec", F.struct(
        F.col("client_name").alias("company"), key.cast("string").alias("sow_id"),
        F.array("theme").alias("scope_bullets"), F.col("deliverables"),
        F.transform("staffing", lambda s: s["title"]).alias("roles"),
        F.col("exclusions").alias("assumptions"),
        F.col("start_date").cast("string").alias("term_start"), F.col("end_date").cast("string").alias("term_end"),
        (key % 13).cast("int").alias("term_months"),
        F.array().cast("array<string>").alias("rates")))


@query("pj26_embedding_text", B.sql("""
  SELECT sow_key, 'Company: ' || client_name || ' | SOW ID: ' || sow_key || ' | Scope: ' || theme ||
      CASE WHEN n_lines > 0 THEN ' | Deliverables: ' || array_to_string(deliverables, '; ') || ' | Roles: ' ||
        array_to_string(list_transform(staffing, lambda s: s.title), ', ') ELSE '' END ||
      CASE WHEN sow_key % 13 > 0 THEN ' | Duration: ' || (sow_key % 13) || ' months' ELSE '' END AS compact,
    'Document Content:' || chr(10) || scope_summary || chr(10) || chr(10) || 'Scope of Work:' || chr(10) || '• ' || theme ||
      CASE WHEN n_lines > 0 THEN chr(10) || chr(10) || 'Deliverables:' || chr(10) || array_to_string(list_transform(deliverables,
        lambda d: '• ' || d), chr(10)) || chr(10) || chr(10) || 'Required Roles:' || chr(10) ||
        array_to_string(list_transform(staffing, lambda s: s.title), ', ') ELSE '' END ||
      CASE WHEN len(exclusions) > 0 THEN chr(10) || chr(10) || 'Assumptions:' || chr(10) || '• ' || exclusions[1] ELSE '' END ||
      chr(10) || chr(10) || 'Project Term:' || chr(10) || 'Start: ' || CAST(start_date AS VARCHAR) ||
      CASE WHEN end_date IS NOT NULL THEN chr(10) || 'End: ' || CAST(end_date AS VARCHAR) ELSE '' END ||
      CASE WHEN sow_key % 13 > 0 THEN chr(10) || 'Duration: ' || (sow_key % 13) || ' months' ELSE '' END AS labelled,
    client_name || ' ' || project_title || ' ' || trim(scope_summary) AS plain
  FROM sow"""))
def pj26(spark, sf_dir):
    df = records(B.sow(spark, sf_dir))
    return df.select("sow_key", S.compact_text(F.col("rec")).alias("compact"),
                     S.labelled_text(F.col("scope_summary"), F.col("rec")).alias("labelled"),
                     S.plain_text(F.col("client_name"), F.col("project_title"),
                                  F.trim("scope_summary")).alias("plain"))


@query("pj27_min_chars", "SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) >= 100")
def pj27(spark, sf_dir):
    return (B.table(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= 100).select("doc_id", "n_chars"))


@query("pj28_truncate", "SELECT doc_id, text[1:500] AS t500, length(text[1:5000]) AS n5000 FROM documents")
def pj28(spark, sf_dir):
    t = F.col("text")
    return B.table(spark, sf_dir, "documents").select("doc_id", S.truncate(t, 500).alias("t500"),
                                                      F.length(S.truncate(t, 5000)).alias("n5000"))


@query("pj29_project_info", B.sql("""
  SELECT coalesce(nullif(project_title, ''), 'Unknown Project') AS project_name, client_name, CAST(sow_key AS VARCHAR) AS project_id,
    CASE WHEN sow_key % 13 > 0 THEN sow_key % 13 * 4 END AS duration_weeks FROM sow_base"""))
def pj29(spark, sf_dir):
    from sowmill.functions.classify import project_info

    rec = F.struct(F.col("client_name").alias("company"), F.col("sow_key").cast("string").alias("sow_id"),
                   F.col("project_title"), (F.col("sow_key") % 13).cast("int").alias("term_months"))
    return (B.sow_base(spark, sf_dir).select(project_info(rec).alias("p"))
            .select("p.project_name", "p.client_name", "p.project_id", "p.duration_weeks"))
