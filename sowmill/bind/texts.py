"""Field extraction over SOW texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.bind import base as B
from sowmill.bind.classes import any_sql, q
from sowmill.bind.registry import query
from sowmill.functions import text as X


def rich(spark, sf_dir):
    """SOW texts with a contract line, an end date, exclusions and fee wording."""
    key = F.col("sow_key")
    end = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (key % 400).cast("int")), "MMMM dd, yyyy")
    body = F.concat(
        F.when(key % 2 == 0, F.concat(F.lit("Agreement between "), "client_name", F.lit(" and the other side\n"))).otherwise(""),
        F.col("text"), F.lit("\n\nCompletion Date: "), end,
        F.lit("\n\nExclusions:\n• Travel costs are not included\n- Printing of materials\n\nMonthly fee billed hourly for 2 FTE"))
    return B.sow_text(spark, sf_dir).withColumn("text", body)


RICH = """rich AS (SELECT sow_key, client_name, project_title, CASE WHEN sow_key % 2 = 0 THEN 'Agreement between ' || client_name ||
    ' and the other side' || chr(10) ELSE '' END || text || chr(10) || chr(10) || 'Completion Date: ' ||
    strftime(DATE '2025-01-01' + CAST(sow_key % 400 AS INTEGER), '%B %d, %Y') || chr(10) || chr(10) || 'Exclusions:' || chr(10) ||
    '• Travel costs are not included' || chr(10) || '- Printing of materials' || chr(10) || chr(10) ||
    'Monthly fee billed hourly for 2 FTE' AS text FROM sow_text)"""


def ex(pattern: str, group: int = 1, col: str = "text") -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, {group}), '')"


def every(pattern: str, group: int = 1, col: str = "text") -> str:
    return f"regexp_extract_all({col}, {q(pattern)}, {group})"


def joined(lst: str, sep: str = "; ") -> str:
    return f"array_to_string({lst}, {q(sep)})"


def after(lead: str, patterns) -> str:
    rest = ex(rf"(?i){lead}\s*([^\n\r]+)")
    return "coalesce(" + ", ".join(ex("(?i)" + p, 0, f"({rest})") for p in patterns) + ")"


def date_sql(field: str) -> str:
    w = K.FIELD_WORDING[field]
    leads = w["context_patterns"] + [x + r"\s*:?" for x in w["primary_indicators"]]
    return "coalesce(" + ", ".join(after(lead, w["date_formats"]) for lead in leads) + ")"


def guarded(expr: str, banned) -> str:
    return f"CASE WHEN NOT {any_sql(f'lower({expr})', banned)} THEN trim({expr}) END"


def section(header: str, end: str = X.SECTION_END) -> str:
    rest = rf"regexp_extract(text, {q(rf'(?is){header}[:\s]*(.*)')}, 1)"
    return f"nullif(string_split_regex({rest}, {q(end)})[1], '')"


def sections(field: str) -> str:
    return "[" + ", ".join(section(h) for h in K.FIELD_WORDING[field]["section_headers"]) + "]"


def items(field: str) -> str:
    """Ordered list items as SQL: all headers, all marks."""
    marks = K.FIELD_WORDING[field]["list_indicators"]
    per = "list_concat(" + ", ".join(every(re.escape(m) + r"\s*([^\n\r]+)", 1, "s") for m in marks) + ")"
    return (f"list_filter(list_transform(flatten(list_transform(list_filter({sections(field)}, lambda s: s IS NOT NULL), "
            f"lambda s: {per})), lambda x: trim(x)), lambda x: length(x) > 10)")


FLAT = r"(SELECT sow_key, regexp_replace(text, '\s+', ' ', 'g') AS text FROM rich)"


@query("tx01_parse_fields", B.sql(rf"""
  SELECT sow_key, {ex(r'(?i)(?:Scope of Work|Scope|Services)[:\-]\s*(.+?)(?:Deliverables|Term|Timeline|$)')} AS scope,
    {ex(r'(?i)(?:Deliverables?)[:\-]\s*(.+?)(?:Term|Timeline|$)')} AS deliverable,
    {joined(every('(?i)' + K.LOOSE_DATES[0], 0))} AS dates,
    {joined(f"list_sort(list_distinct({every(rf'(?i){chr(92)}b({K.FIRST_PASS_ROLES}){chr(92)}b')}))")} AS roles,
    {joined(every(r'(?i)\b(\d{1,3})\s*%?\s*FTE\b'))} AS fte,
    {joined(every(r'(?i)\b(\d{1,4})\s*(?:hours|hrs)\b'))} AS hours,
    {joined(f"list_transform(list_zip({every(r'(?i)\b(rate|fee)s?\b.*?\b(hour|daily|monthly)\b')}, "
            f"{every(r'(?i)\b(rate|fee)s?\b.*?\b(hour|daily|monthly)\b', 2)}), lambda z: z[1] || ' ' || z[2])")} AS rates
  FROM {FLAT}""", RICH))
def tx01(spark, sf_dir):
    flat = F.regexp_replace("text", r"\s+", " ")
    f = rich(spark, sf_dir).withColumn("text", flat).select("sow_key", X.parse_fields(F.col("text")).alias("f"))
    text = lambda c: F.array_join(F.transform(f"f.{c}", lambda x: x.cast("string")), "; ").alias(c)
    return f.select("sow_key", "f.scope", "f.deliverable", *[text(c) for c in ("dates", "roles", "fte", "hours", "rates")])


@query("tx02_project_info", B.sql(rf"""
  SELECT sow_key, trim({ex(r'(?i)(?:Project Title|Project Name)[:\-]\s*(.+?)(?:\n|$)')}) AS project_name,
    trim({ex(r'(?i)(?:Client|Company)[:\-]\s*(.+?)(?:\n|$)')}) AS client_name,
    trim({ex(r'(?i)(?:Contract Number|Contract #)[:\-]\s*(.+?)(?:\n|$)')}) AS contract_number,
    {joined('list_concat(' + ', '.join(every('(?i)' + p, 0) for p in K.LOOSE_DATES) + ')')} AS dates FROM rich""", RICH))
def tx02(spark, sf_dir):
    return (rich(spark, sf_dir).select("sow_key", X.project_info_heuristic(F.col("text")).alias("p"))
            .select("sow_key", "p.project_name", "p.client_name", "p.contract_number",
                    F.array_join("p.dates", "; ").alias("dates")))


@query("tx03_role_lines", B.sql("""
  SELECT sow_key, title, CAST(hours AS DOUBLE) AS hours, CAST(NULL AS DOUBLE) AS fte_percentage FROM ln WHERE title <> 'VP'"""))
def tx03(spark, sf_dir):
    marked = F.regexp_replace("text", r"\n([A-Za-z ]+ - \d+ hours)", "\n* $1")  # list marks keep the section together
    marked = F.regexp_replace(marked, r"\nBudget", "\n\nBudget")
    return (B.sow_text(spark, sf_dir).select("sow_key", F.explode(X.roles_heuristic(
        F.regexp_replace(marked, "Project Staffing Plan", "Resource Table"))).alias("r"))
        .select("sow_key", "r.title", "r.hours", "r.fte_percentage"))


_W = K.FIELD_WORDING
_CLIENT = "coalesce(" + ", ".join(
    [guarded(ex(rf"(?i){w}\s+([^,]+?)(?:\s+and\s+|\s+vs\.?\s+|\s+versus\s+|\s+\(|\s*$)"), _W["client_name"]["exclusion_patterns"])
     for w in _W["client_name"]["contract_indicators"]] +
    [guarded(ex(rf"(?i){w}\s*:?\s*([^\n\r]+)"), _W["client_name"]["exclusion_patterns"])
     for w in _W["client_name"]["label_indicators"]]) + ")"
_PTITLE = "coalesce(" + ", ".join(guarded(ex(rf"(?i){w}\s*:?\s*([^\n\r]+)"), _W["project_title"]["exclusion_patterns"])
                                  for w in _W["project_title"]["title_indicators"]) + ")"
_LENGTH = "coalesce(" + ", ".join(after(w + r"\s*:?", _W["project_length"]["duration_patterns"])
                                  for w in _W["project_length"]["duration_indicators"]) + ")"
_SCOPE = "coalesce(" + ", ".join(
    f"(SELECT CASE WHEN length(s) > 50 THEN s END FROM (SELECT trim({section(h, X.SECTION_END + chr(124) + chr(92) + 'n' + chr(92) + 'd+' + chr(92) + '.')}) AS s))"
    for h in _W["scope_summary"]["section_headers"]) + ")"
_LINES = (f"list_filter(list_transform(flatten(list_transform(list_filter({sections('staffing_plan')}, lambda s: s IS NOT NULL), "
          "lambda s: string_split(s, chr(10)))), lambda x: trim(x)), lambda x: "
          f"{any_sql('lower(x)', _W['staffing_plan']['table_indicators'])})")


def one_field(name, field, fn, expr):
    is_list = field in ("deliverables", "exclusions", "staffing_plan")
    shown = joined(expr, " | ") if is_list else expr

    @query(name, B.sql(f"SELECT sow_key, {shown} AS {field} FROM rich", RICH))
    def run(spark, sf_dir):
        value = fn(F.col("text"))
        return rich(spark, sf_dir).select("sow_key", (F.array_join(value, " | ") if is_list else value).alias(field))


one_field("tx04_client_name", "client_name", X.client_name, _CLIENT)
one_field("tx05_project_title", "project_title", X.project_title, _PTITLE)
one_field("tx06_start_date", "start_date", X.start_date, date_sql("start_date"))
one_field("tx07_end_date", "end_date", X.end_date, date_sql("end_date"))
one_field("tx08_project_length", "project_length", X.project_length_text, _LENGTH)
one_field("tx09_scope_summary", "scope_summary", X.scope_summary, _SCOPE)
one_field("tx10_deliverables", "deliverables", X.deliverables, items("deliverables"))
one_field("tx11_exclusions", "exclusions", X.exclusions, items("exclusions"))
one_field("tx12_staffing_lines", "staffing_plan", X.staffing_lines, _LINES)


@query("tx13_taxonomy_extract", B.sql(f"""
  SELECT sow_key, {_CLIENT} AS client_name, {_PTITLE} AS project_title, {date_sql('start_date')} AS start_date,
    {date_sql('end_date')} AS end_date, {_LENGTH} AS project_length, {_SCOPE} AS scope_summary,
    len({items('deliverables')}) AS deliverables, len({items('exclusions')}) AS exclusions, len({_LINES}) AS staffing_plan
  FROM rich""", RICH))
def tx13(spark, sf_dir):
    out = X.taxonomy_extract(rich(spark, sf_dir), "text", ["sow_key"])
    return out.select("sow_key", *[F.size(c).alias(c) if c in ("deliverables", "exclusions", "staffing_plan") else F.col(c)
                                   for c in K.COMPARED_FIELDS])


def distinct_sorted(parts) -> str:
    return f"list_sort(list_distinct(list_concat({', '.join(parts)})))"


PROFILE = {
    "sections": distinct_sorted(every(rf"(?im)^(?:\d+\.?\s*)?({p})") for p in K.SECTION_TERMS),
    "roles": distinct_sorted(every(rf"(?i)\b({p})\b") for p in K.ROLE_TERMS),
    "deliverables": "list_concat(" + ", ".join(f"list_transform({every('(?i)' + p)}, lambda x: trim(x))"
                                               for p in K.DELIVERABLE_TERMS) + ")",
    "timeline": distinct_sorted(every("(?i)" + p, 1 if i == 0 else 0) for i, p in enumerate(K.TIMELINE_TERMS)),
    "budget": distinct_sorted(every("(?i)" + p, 0) for p in K.BUDGET_TERMS),
    "key_phrases": ("list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: "
                    r"regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), lambda s: length(s) > 20 AND "
                    + any_sql("lower(s)", K.KEY_PHRASE_WORDS) + ")"),
}


@query("tx14_term_profile", B.sql(f"""
  SELECT sow_key, length(text) AS text_length, {', '.join(f"{joined(v)} AS {k}" for k, v in PROFILE.items())},
    text AS sample FROM rich""", RICH))
def tx14(spark, sf_dir):
    p = rich(spark, sf_dir).select("sow_key", X.term_profile(F.col("text")).alias("p"))
    return p.select("sow_key", "p.text_length", *[F.array_join(f"p.{c}", "; ").alias(c) for c in PROFILE], "p.sample")


_HIT = any_sql("lower(lines[i])", K.WINDOW_WORDS)


@query("tx15_staffing_window", B.sql(f"""
  SELECT sow_key, len(w) AS windows, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS best
  FROM (SELECT sow_key, list_transform(list_filter(range(1, len(lines) + 1), lambda i: {_HIT}), lambda i:
      array_to_string(lines[greatest(i - 3, 1):i + 14], chr(10))) AS w
    FROM (SELECT sow_key, string_split(text, chr(10)) AS lines FROM sow_text))"""))
def tx15(spark, sf_dir):
    t = F.col("text")
    return B.sow_text(spark, sf_dir).select("sow_key", F.size(X.staffing_windows(t)).alias("windows"),
                                            X.best_staffing_window(t).alias("best"))


_STOPPED = r"(?is)^(.*?)(?:\n\n|\n[A-Z][a-z]+\s+[A-Z]|\z)"
#: The texts hold one heading, which two of the patterns find: at its first and at its second word.
_HEADED = (f"hd AS (SELECT sow_key, text, strpos(text, 'Project Staffing Plan') AS pos, length(regexp_extract(substr(text, strpos(text, 'Project Staffing Plan')), {q(_STOPPED)}, 1)) AS n "
           "FROM sow_text)")


_WIDE_HIT = any_sql("lower(lines[i])", K.WIDE_WINDOW_WORDS)


@query("tx15_wide_window", B.sql(f"""
  SELECT sow_key, len(w) AS windows, array_to_string(w, chr(10) || '--' || chr(10)) AS every
  FROM (SELECT sow_key, list_transform(list_filter(range(1, len(lines) + 1), lambda i: {_WIDE_HIT}), lambda i:
      array_to_string(lines[greatest(i - 5, 1):i + 19], chr(10))) AS w
    FROM (SELECT sow_key, string_split(text, chr(10)) AS lines FROM sow_text))"""))
def tx15_wide(spark, sf_dir):
    windows = X.staffing_windows(F.col("text"), K.WIDE_WINDOW_WORDS, 5, 20)
    return (B.sow_text(spark, sf_dir).select("sow_key", windows.alias("w"))
            .select("sow_key", F.size("w").alias("windows"), F.array_join("w", "\n--\n").alias("every")))


@query("tx16_staffing_sections", B.sql("SELECT sow_key, 2 AS sections, text || chr(10) || chr(10) || text AS raw FROM hd", _HEADED))
def tx16(spark, sf_dir):
    s = X.staffing_sections(F.col("text"))
    return (B.sow_text(spark, sf_dir).select("sow_key", s.alias("s"))
            .select("sow_key", F.size("s").alias("sections"), F.array_join("s", "\n\n").alias("raw")))


@query("tx16_staffing_context", B.sql("""
  SELECT sow_key, 2 AS sections, substr(text, greatest(pos - 50, 1), pos + n + 200 - greatest(pos - 50, 1)) || chr(10) || chr(10) ||
    substr(text, greatest(pos - 42, 1), pos + n + 200 - greatest(pos - 42, 1)) AS raw FROM hd""", _HEADED))
def tx16_context(spark, sf_dir):
    s = X.staffing_sections(F.col("text"), before=50, after=200, loose_after=500)
    return (B.sow_text(spark, sf_dir).select("sow_key", s.alias("s"))
            .select("sow_key", F.size("s").alias("sections"), F.array_join("s", "\n\n").alias("raw")))


@query("tx17_staffing_rows", B.sql("""
  SELECT sow_key, 'Person ' || chr(CAST(65 + (sow_key + i) % 26 AS INTEGER)) || 'x' AS name, 'PM' AS role, staffing[i].title AS primary_role,
    CAST(staffing[i].pct AS BIGINT) || '%' AS percentage
  FROM (SELECT sow_key, staffing, unnest(generate_series(1, least(n_lines, 26))) AS i FROM sow)"""))
def tx17(spark, sf_dir):
    key = F.col("sow_key")
    row = lambda s, i: F.concat(F.lit("Person "), F.char(F.lit(65) + (key + i + 1) % 26), F.lit("x PM "), s["title"],
                                F.lit(" "), s["pct"].cast("long").cast("string"), F.lit("% Austin, TX 78701"))
    text = F.concat(F.lit("Project Staffing Plan Name Role Primary Role % Primary Location (2024)\n"),
                    F.array_join(F.transform("staffing", row), "\n"))
    return (B.sow(spark, sf_dir).select("sow_key", F.explode(X.staffing_rows(text)).alias("r"))
            .select("sow_key", "r.name", "r.role", "r.primary_role", "r.percentage"))


def keep_order(parts) -> str:
    """Ordered distinct list: keep the first position of each value."""
    lst = f"list_concat({', '.join(parts)})"
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {lst} AS l))"


@query("tx18_roles_hours_fte", B.sql(f"""
  SELECT sow_key, {joined(f"list_filter({keep_order(every(f'(?i)({p})') for p in K.ROLE_LIST_TERMS)}, lambda r: length(r) > 3)")} AS roles,
    {joined(keep_order(every('(?i)' + p) for p in K.HOUR_TERMS))} AS hours,
    {joined(keep_order(every('(?i)' + p) for p in K.FTE_TERMS))} AS fte FROM rich""", RICH))
def tx18(spark, sf_dir):
    r = rich(spark, sf_dir).select("sow_key", X.roles_hours_fte(F.col("text")).alias("r"))
    nums = lambda c: F.array_join(F.transform(f"r.{c}", lambda x: x.cast("long").cast("string")), "; ").alias(c)
    return r.select("sow_key", F.array_join("r.roles", "; ").alias("roles"), nums("hours"), nums("fte"))


_PAIRS = "list_concat(" + ", ".join(
    f"list_transform(list_zip({every('(?i)' + p, 1)}, {every('(?i)' + p, 2)}, {every('(?i)' + p, 0)}), lambda z: "
    r"regexp_replace(regexp_replace(z[1], '^\s+', ''), '\s+$', '') || '=' || z[2] || CASE WHEN contains(lower(z[3]), 'fte') OR "
    "contains(z[3], '%') THEN ' fte' ELSE ' hours' END)" for p in K.ROLE_VALUE_TERMS) + ")"


@query("tx19_role_values", B.sql(f"SELECT sow_key, {joined(_PAIRS)} AS pairs FROM rich", RICH))
def tx19(spark, sf_dir):
    pair = lambda z: F.concat(z["role"], F.lit("="), z["value"].cast("long").cast("string"), F.lit(" "), z["type"])
    return rich(spark, sf_dir).select("sow_key", F.array_join(F.transform(X.role_values(F.col("text")), pair), "; ").alias("pairs"))


@query("tx20_summary", B.sql("""
  SELECT sow_key, '**Term:** Start Date: ' || strftime(start_date, '%Y-%m-%d') || chr(10) || chr(10) || '**Description:** Scope of Work: ' ||
    theme || ' ' || o_orderpriority || ' Deliverables:' || array_to_string(list_transform(list_filter(nxt, lambda x: length(x) > 10), lambda x: ' ' || x), '') ||
    chr(10) || chr(10) || '**Key Deliverables:**' || array_to_string(list_transform(nxt, lambda x: chr(10) || chr(10) || '• ' || x), '') AS summary
  FROM (SELECT *, list_concat(list_transform(deliverables, lambda d: '- ' || d),
      [CASE WHEN sow_key % 2 = 0 THEN 'Events:' ELSE 'Activations:' END, 'Project Staffing Plan'],
      list_transform(staffing, lambda s: s.title || ' - ' || CAST(s.hours AS BIGINT) || ' hours'),
      ['Budget: $' || CAST(round(o_totalprice) AS BIGINT)]) AS nxt FROM sow)"""))
def tx20(spark, sf_dir):
    return B.sow_text(spark, sf_dir).select("sow_key", X.extractive_summary(F.col("text")).alias("summary"))


@query("tx20_summary_limited", B.sql("""
  SELECT sow_key, '**Term:** Start Date: ' || strftime(start_date, '%Y-%m-%d') || chr(10) || chr(10) || '**Description:** Scope of Work: ' ||
    theme || ' ' || o_orderpriority || ' Deliverables:' ||
    CASE WHEN n_lines = 0 THEN CASE WHEN sow_key % 2 = 0 THEN '' ELSE ' Activations:' END || ' Project Staffing Plan' ||
      CASE WHEN length(bud) > 10 THEN ' ' || bud ELSE '' END
    ELSE array_to_string(list_transform(list_filter(nxt[1:3], lambda x: length(x) > 10), lambda x: ' ' || x), '') END ||
    chr(10) || chr(10) || '**Key Deliverables:**' ||
    array_to_string(list_transform(nxt[1:5], lambda x: chr(10) || chr(10) || '• ' || x), '') AS summary
  FROM (SELECT *, 'Budget: $' || CAST(round(o_totalprice) AS BIGINT) AS bud, list_concat(list_transform(deliverables, lambda d: '- ' || d),
      [CASE WHEN sow_key % 2 = 0 THEN 'Events:' ELSE 'Activations:' END, 'Project Staffing Plan'],
      list_transform(staffing, lambda s: s.title || ' - ' || CAST(s.hours AS BIGINT) || ' hours'),
      ['Budget: $' || CAST(round(o_totalprice) AS BIGINT)]) AS nxt FROM sow)"""))
def tx20_limited(spark, sf_dir):
    return B.sow_text(spark, sf_dir).select("sow_key", X.extractive_summary(F.col("text"), project_lines=2, description_lines=4, description_chars=300, item_lines=9, items=5, sentences=3, opening_chars=200).alias("summary"))


_ENTRIES = [(f, k, p, not set("\\[(") & set(p)) for f, k, p in X.wordings()]


@query("tx30_wording_hits", B.sql(f"""
  SELECT field, kind, word, count(*) AS documents FROM rich JOIN (VALUES
    {', '.join(f"({q(f)}, {q(k)}, {q(p)}, {plain})" for f, k, p, plain in _ENTRIES)}) AS w(field, kind, word, plain)
    ON CASE WHEN plain THEN contains(lower(text), word) ELSE regexp_matches(text, word, 'i') END
  GROUP BY field, kind, word""", RICH))
def tx30(spark, sf_dir):
    return X.wording_hits(rich(spark, sf_dir), "text")
