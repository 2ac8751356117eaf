"""Classification and role mapping over SOW rows and texts."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.bind import base as B
from sowmill.bind.registry import query
from sowmill.functions import classify as C


# --- SQL builders from the fixed values ----------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def group_sql(col: str, groups, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(col, w)} THEN {q(label)}" for label, w in groups) + f" ELSE {q(default)} END"


def count_sql(col: str, words, marked=True) -> str:
    end = r"[:\-]" if marked else ""
    return "(" + " + ".join(f"len(regexp_extract_all({col}, '(?i){w}s?{end}'))" for w in words) + ")"


def points_sql(col: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(col, w)} THEN {p}" for p, w in steps) + " ELSE 1 END"


EVENTS = count_sql("text", K.EVENT_MENTIONS)
DELIVERABLES = f"greatest({count_sql('text', K.DELIVERABLE_MENTIONS)}, 1)"
STAKEHOLDERS = f"greatest({count_sql('text', K.STAKEHOLDER_MENTIONS, False)}, 1)"
TYPE = group_sql("low", K.PROJECT_TYPE_WORDS, K.DEFAULT_PROJECT_TYPE)


def complexity_sql(weeks: str) -> str:
    points = (f"(CASE WHEN {weeks} >= 52 THEN 3 WHEN {weeks} >= 26 THEN 2 ELSE 1 END + "
              f"{points_sql('low', K.BUDGET_POINT_WORDS)} + {points_sql('low', K.GEO_POINT_WORDS)} + "
              f"CASE WHEN {any_sql('low', K.STAKEHOLDER_POINT_WORDS)} THEN 2 ELSE 0 END + "
              f"CASE WHEN ev >= 5 THEN 3 WHEN ev >= 3 THEN 2 WHEN ev >= 1 THEN 1 ELSE 0 END)")
    return points


STEPS = "CASE " + " ".join(f"WHEN points >= {f} THEN {q(l)}" for l, f in K.COMPLEXITY_STEPS) + " ELSE 'simple' END"
DURATION = ("(SELECT CASE WHEN u = 'month' THEN n * 4 ELSE n END FROM (SELECT "
            r"TRY_CAST(nullif(regexp_extract(text, '(?i)(\d+)\s*(week|month)s?', 1), '') AS INTEGER) AS n, "
            r"lower(regexp_extract(text, '(?i)(\d+)\s*(week|month)s?', 2)) AS u))")
BUDGET = group_sql("low", K.BUDGET_RANGE_WORDS, "low")
GEO = group_sql("low", K.GEO_SCOPE_WORDS, "local")
SIZE = (f"CASE WHEN {any_sql('low', K.LARGE_CLIENT_WORDS)} OR {any_sql('lower(client_name)', K.LARGE_CLIENTS)} "
        f"THEN 'enterprise' WHEN {any_sql('low', K.MID_CLIENT_WORDS)} THEN 'mid-market' ELSE 'startup' END")
SPECIAL = ("concat_ws(', ', " + ", ".join(f"CASE WHEN contains(low, {q(w)}) THEN {q(w.title())} END"
                                          for w in K.SPECIAL_WORDS) + ")")
TXT = f"txt AS (SELECT *, lower(text) AS low, {EVENTS} AS ev FROM sow_text)"
# requirement rows: weeks from the text, complexity without given weeks
REQ = (TXT + f", req AS (SELECT sow_key, client_name, project_type, {STEPS} AS complexity, duration_weeks, budget_range, "
       "client_size, geographic_scope, deliverables_count, events_count, stakeholders_count, special_requirements "
       f"FROM (SELECT sow_key, client_name, {TYPE} AS project_type, {complexity_sql('26')} AS points, "
       f"coalesce(nullif({DURATION}, 0), 26) AS duration_weeks, {BUDGET} AS budget_range, {SIZE} AS client_size, "
       f"{GEO} AS geographic_scope, {DELIVERABLES} AS deliverables_count, ev AS events_count, "
       f"{STAKEHOLDERS} AS stakeholders_count, {SPECIAL} AS special_requirements FROM txt))")


def role_sql(col: str, field: int) -> str:
    """CASE giving role (1), department (2) or level (3) of a lower-cased title."""
    val = lambda e: str(e[field]) if field == 3 else q(e[field])
    arms = [f"WHEN {col} IS NULL OR {col} = '' THEN NULL"]
    arms += [f"WHEN {col} = {q(e[0])} THEN {val(e)}" for e in K.ROLE_MAP]
    arms += [f"WHEN contains({col}, {q(e[0])}) OR contains({q(e[0])}, {col}) THEN {val(e)}" for e in K.ROLE_MAP]
    arms += ["WHEN " + " AND ".join(f"contains({col}, {q(w)})" for w in e[0]) + f" THEN {val(e)}" for e in K.ROLE_KEYWORDS]
    return "CASE " + " ".join(arms) + " ELSE NULL END"


ORG_SQL = ("org AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(t)}, {lv}, {q(d)}, [{', '.join(q(a) for a in al)}])" for i, (t, lv, d, al) in enumerate(K.ORG_ROLES)) +
    ") AS o(ord, title, level, department, aliases))")


# --- texts ------------------------------------------------------------------------------------


@query("cl01_project_type", B.sql(f"SELECT sow_key, {TYPE} AS project_type FROM txt", TXT))
def cl01(spark, sf_dir):
    return B.sow_text(spark, sf_dir).select("sow_key", C.project_type(F.col("text")).alias("project_type"))


@query("cl02_complexity", B.sql(f"""SELECT sow_key, points, {STEPS} AS complexity FROM (
  SELECT sow_key, {complexity_sql('coalesce(nullif(sow_key % 70, 0), 26)')} AS points FROM txt)""", TXT))
def cl02(spark, sf_dir):
    points = C.complexity_points(F.col("text"), F.col("sow_key") % 70)
    return (B.sow_text(spark, sf_dir).select("sow_key", points.alias("points"))
            .select("sow_key", "points", C.complexity_of(F.col("points")).alias("complexity")))


@query("cl03_duration_weeks", B.sql(f"SELECT sow_key, {DURATION} AS weeks FROM sow_text"))
def cl03(spark, sf_dir):
    return B.sow_text(spark, sf_dir).select("sow_key", C.duration_weeks(F.col("text")).alias("weeks"))


@query("cl04_budget_range", B.sql(f"""SELECT sow_key, {BUDGET} AS budget_range FROM (
  SELECT sow_key, lower(text || CASE sow_key % 4 WHEN 0 THEN ' two Million' WHEN 1 THEN ' substantial' WHEN 2 THEN ' standard'
    ELSE '' END) AS low FROM sow_text)"""))
def cl04(spark, sf_dir):
    k = F.col("sow_key") % 4
    extra = F.when(k == 0, " two Million").when(k == 1, " substantial").when(k == 2, " standard").otherwise("")
    return B.sow_text(spark, sf_dir).select("sow_key", C.budget_range(F.concat("text", extra)).alias("budget_range"))


@query("cl05_client_size", B.sql(f"""SELECT sow_key, {SIZE} AS client_size FROM (
  SELECT sow_key, low || CASE WHEN sow_key % 7 = 1 THEN ' regional' ELSE '' END AS low,
    CASE WHEN sow_key % 7 = 2 THEN 'Company 3 Ltd' ELSE client_name END AS client_name FROM txt)""", TXT))
def cl05(spark, sf_dir):
    k = F.col("sow_key") % 7
    text = F.concat("text", F.when(k == 1, " regional").otherwise(""))
    client = F.when(k == 2, "Company 3 Ltd").otherwise(F.col("client_name"))
    return B.sow_text(spark, sf_dir).select("sow_key", C.client_size(text, client).alias("client_size"))


@query("cl06_geo_scope", B.sql(f"SELECT sow_key, {GEO} AS geographic_scope FROM txt", TXT))
def cl06(spark, sf_dir):
    return B.sow_text(spark, sf_dir).select("sow_key", C.geo_scope(F.col("text")).alias("geographic_scope"))


@query("cl07_mention_counts", B.sql(f"""
  SELECT sow_key, {DELIVERABLES} AS deliverables_count, ev AS events_count, {STAKEHOLDERS} AS stakeholders_count
  FROM txt""", TXT))
def cl07(spark, sf_dir):
    t = F.col("text")
    return B.sow_text(spark, sf_dir).select(
        "sow_key", C.deliverable_mentions(t).alias("deliverables_count"), C.event_mentions(t).alias("events_count"),
        C.stakeholder_mentions(t).alias("stakeholders_count"))


@query("cl08_special_requirements", B.sql(f"""SELECT sow_key, {SPECIAL} AS special_requirements FROM (
  SELECT sow_key, low || CASE sow_key % 3 WHEN 0 THEN ' Legal and crisis management' WHEN 1 THEN ' multi-language' ELSE '' END
    AS low FROM (SELECT sow_key, low FROM txt))""".replace("' Legal", "' legal"), TXT))
def cl08(spark, sf_dir):
    k = F.col("sow_key") % 3
    text = F.concat("text", F.when(k == 0, " Legal and crisis management").when(k == 1, " multi-language").otherwise(""))
    return B.sow_text(spark, sf_dir).select(
        "sow_key", F.array_join(C.special_requirements(text), ", ").alias("special_requirements"))


REQ_COLS = ["sow_key", "project_type", "complexity", "duration_weeks", "budget_range", "client_size", "geographic_scope",
            "deliverables_count", "events_count", "stakeholders_count", "special_requirements"]


@query("cl09_requirements", B.sql(f"SELECT {', '.join(REQ_COLS)} FROM req", REQ))
def cl09(spark, sf_dir):
    return (C.with_requirements(B.sow_text(spark, sf_dir), "text", "client_name")
            .withColumn("special_requirements", F.array_join("special_requirements", ", ")).select(*REQ_COLS))


@query("cl10_project_category", B.sql(f"""
  SELECT sow_key, {group_sql('both_low', K.PROJECT_CATEGORY_WORDS, 'General/Other')} AS category,
    {group_sql('title_low', K.TITLE_CATEGORY_WORDS, 'Other')} AS title_category
  FROM (SELECT sow_key, lower(array_to_string(deliverables, ' ') || ' ' || project_title) AS both_low,
    lower(project_title) AS title_low FROM sow)"""))
def cl10(spark, sf_dir):
    return B.sow(spark, sf_dir).select(
        "sow_key", C.project_category(F.col("deliverables"), F.col("project_title")).alias("category"),
        C.title_category(F.col("project_title")).alias("title_category"))


@query("cl11_service_type_and_score", B.sql(f"""
  SELECT sow_key, {group_sql('lower(theme)', K.SERVICE_TYPE_WORDS, 'General Project')} AS service_type,
    least(5.0 + CASE WHEN m >= 12 THEN 2 WHEN m >= 6 THEN 1 ELSE 0 END + CASE WHEN n_lines >= 6 THEN 2 WHEN n_lines >= 4
      THEN 1 ELSE 0 END + CASE WHEN n_lines >= 5 THEN 1.5 WHEN n_lines >= 3 THEN 0.5 ELSE 0 END, 10.0) * 10 AS score10
  FROM (SELECT *, sow_key % 13 AS m FROM sow)"""))
def cl11(spark, sf_dir):
    df = B.with_counts(spark, sf_dir, B.sow_base(spark, sf_dir))
    n = F.col("n_lines")
    return df.select("sow_key", C.service_project_type(F.col("theme"), F.col("client_name")).alias("service_type"),
                     (C.complexity10(F.col("sow_key") % 13, n, n, F.lit(1)) * 10).alias("score10"))


@query("cl12_categories", f"""
  SELECT kind, category, count(*) AS items, min(item) AS first_item FROM (
    SELECT 'role' AS kind, p_type AS item, {group_sql('lower(p_type)', K.ROLE_CATEGORY_WORDS, 'Other')} AS category FROM part
    UNION ALL SELECT 'deliverable', p_name, {group_sql('lower(p_name)', K.DELIVERABLE_CATEGORY_WORDS, 'Other')} FROM part
    UNION ALL SELECT 'role', role, {group_sql('lower(role)', K.ROLE_CATEGORY_WORDS, 'Other')} FROM (
      SELECT CASE p_size % 8 {' '.join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(B.TITLES))} END AS role FROM part))
  GROUP BY kind, category""")
def cl12(spark, sf_dir):
    from sowmill.operators.report import categorize

    part = B.table(spark, sf_dir, "part")
    title = B.pick(B.TITLES, F.col("p_size") % 8)
    items = (part.select(F.lit("role").alias("kind"), F.col("p_type").alias("item"))
             .unionByName(part.select(F.lit("deliverable").alias("kind"), F.col("p_name").alias("item")))
             .unionByName(part.select(F.lit("role").alias("kind"), title.alias("item"))))
    return categorize(items)


@query("cl13_map_role", B.sql(f"""
  SELECT sow_key, l_linenumber, title, {role_sql('lower(title)', 1)} AS role, {role_sql('lower(title)', 2)} AS department,
    {role_sql('lower(title)', 3)} AS level
  FROM (SELECT sow_key, l_linenumber, title || CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Lead' ELSE ' II' END AS title
    FROM ln)"""))
def cl13(spark, sf_dir):
    k = F.col("l_partkey") % 3
    title = F.concat("title", F.when(k == 0, "").when(k == 1, " Lead").otherwise(" II"))
    return (B.lines(spark, sf_dir, supplier=False)
            .select("sow_key", "l_linenumber", title.alias("title")).withColumn("m", C.map_role(F.col("title")))
            .select("sow_key", "l_linenumber", "title", "m.role", "m.department", "m.level"))


def closest_by_search(title: str) -> int | None:
    """Position of an organisation role by comparing a title with every name: equal, else the first of the most alike over the ratio."""
    names = [(n.lower(), i) for i, (t, _, _, al) in enumerate(K.ORG_ROLES) for n in (t, *al)]
    low = title.lower().strip()
    best = max([(2.0 if n == low else difflib.SequenceMatcher(None, low, n).ratio(), -at) for at, (n, _) in enumerate(names)])
    return names[-best[1]][1] if best[0] > K.FUZZY_RATIO else None


#: The titles of the data, as they are and misspelt.
SPELLINGS = [t + end for t in B.TITLES for end in ("", "s", " xyz")]
_KNOWN = "known AS (SELECT * FROM (VALUES " + ", ".join(f"({q(t)}, {'NULL' if closest_by_search(t) is None else closest_by_search(t)})" for t in SPELLINGS) + ") AS k(spelt, ord))"


@query("cl14_org_role", B.sql("""
  SELECT sow_key, l_linenumber, spelt AS title, o.title AS org_title, o.department AS org_department, o.level AS org_level
  FROM (SELECT sow_key, l_linenumber, title || CASE l_partkey % 3 WHEN 1 THEN 's' WHEN 2 THEN ' xyz' ELSE '' END AS spelt FROM ln)
  LEFT JOIN known USING (spelt) LEFT JOIN org o ON o.ord = known.ord""", ORG_SQL + ", " + _KNOWN))
def cl14(spark, sf_dir):
    k = F.col("l_partkey") % 3
    title = F.concat("title", F.when(k == 1, "s").when(k == 2, " xyz").otherwise(""))
    rows = B.lines(spark, sf_dir, supplier=False).select("sow_key", "l_linenumber", title.alias("title"))
    return C.map_org_roles(rows, "title")


def options_by_search(text: str) -> list[int]:
    """Roles of the wording patterns that a text has, in order, and its own role."""
    lookup = {n.lower(): i for i, (t, _, _, al) in reversed(list(enumerate(K.ORG_ROLES))) for n in reversed((t, *al))}
    own = closest_by_search(text)
    return [lookup[target.lower()] for wording, target in K.ROLE_WORDING if re.search(wording, text, re.IGNORECASE)] + ([] if own is None else [own])


_ROLE_TITLES = "[" + ", ".join(q(t) for t, _, _, _ in K.ORG_ROLES) + "]"
_OPTIONS = "MAP {" + ", ".join(f"{q(t)}: CAST({options_by_search(t)} AS INTEGER[])" for t in SPELLINGS) + "}"


@query("cl15_map_sow_roles", B.sql(f"""
  SELECT sow_key, array_to_string(detected, '; ') AS detected, coalesce(array_to_string(list_transform(
      list_reduce(list_transform(detected, lambda t: {_OPTIONS}[t]), lambda taken, o: list_concat(taken, list_filter(o, lambda x: NOT list_contains(taken, x))[1:1]), CAST([] AS INTEGER[])),
      lambda i: {_ROLE_TITLES}[i + 1]), '; '), '') AS mapped
  FROM (SELECT sow_key, list_transform(staffing, lambda s: s.title || CASE s.level % 3 WHEN 1 THEN 's' WHEN 2 THEN ' xyz' ELSE '' END) AS detected FROM sow)""", ORG_SQL))
def cl15(spark, sf_dir):
    end = lambda s: F.when(s["level"] % 3 == 1, "s").when(s["level"] % 3 == 2, " xyz").otherwise("")
    roles = B.sow(spark, sf_dir).select("sow_key", F.transform("staffing", lambda s: F.concat(s["title"], end(s))).alias("detected"))
    return (C.map_sow_roles(roles, "sow_key", "detected", "found")
            .select("sow_key", F.array_join("detected", "; ").alias("detected"),
                    F.array_join(F.transform("found", lambda i: C.org_row(i)["title"]), "; ").alias("mapped")))


_abbr = "CASE lower(title) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.TITLE_ABBREVIATIONS.items()) + " END"
_lvl = "CASE lower(x) " + " ".join(f"WHEN {q(k)} THEN {q(str(v))}" for k, v in K.TITLE_LEVELS.items()) + " END"


@query("cl16_normalize_titles", B.sql(f"""
  SELECT sow_key, l_linenumber, coalesce(t1, t2, ab, title) AS title,
    coalesce(CAST(coalesce(l1, l2) AS VARCHAR), {_lvl.replace('lower(x)', 'lower(coalesce(t1, t2, ab, title))')}, level) AS level
  FROM (SELECT r.*, c1.title AS t1, c1.level AS l1, c2.title AS t2, c2.level AS l2 FROM
    (SELECT r0.*, CASE WHEN c0.title IS NULL THEN {_abbr.replace('title', 'r0.title')} END AS ab FROM
      (SELECT sow_key, l_linenumber, l_partkey, title, CASE WHEN l_partkey % 2 = 0 THEN 'n/k' END AS level FROM ln) r0
      LEFT JOIN chart c0 ON c0.key = lower(r0.title)) r
    LEFT JOIN chart c1 ON c1.key = lower(r.title) LEFT JOIN chart c2 ON c2.key = lower(r.ab))""",
                                      ORG_SQL + ", chart AS (SELECT lower(title) AS key, arg_min(title, ord) AS title, "
                                      "arg_min(level, ord) AS level FROM org GROUP BY 1)"))
def cl16(spark, sf_dir):
    rows = B.lines(spark, sf_dir, supplier=False).select(
        "sow_key", "l_linenumber", "title", F.when(F.col("l_partkey") % 2 == 0, "n/k").alias("level"),
        F.lit(None).cast("string").alias("primary_role"))
    return C.normalize_titles(rows, C.org_chart(spark)).select("sow_key", "l_linenumber", "title", "level")


@query("cl17_org_roles_by_department_and_level", B.sql("""
  SELECT o.title, o.level, o.department, count(*) AS lines FROM ln JOIN org o ON o.level = ln.level
  WHERE o.department = 'strategy' AND o.level BETWEEN 3 AND 8 GROUP BY o.title, o.level, o.department, o.ord""", ORG_SQL))
def cl17(spark, sf_dir):
    by_level = B.lines(spark, sf_dir, supplier=False).groupBy("level").agg(F.count(F.lit(1)).alias("lines"))
    wanted = C.org_roles(spark).where((F.col("department") == K.STRATEGY) & F.col("level").between(3, 8))
    return wanted.join(by_level, "level").select("title", "level", "department", "lines")


@query("cl18_unmapped_roles", B.sql(f"""
  SELECT DISTINCT l.sow_key, l.title AS role FROM ln l WHERE NOT EXISTS (
    SELECT 1 FROM mapped m WHERE m.sow_key = l.sow_key AND (contains(lower(l.title), m.title) OR contains(m.title, lower(l.title))))
  """, ORG_SQL + """, mapped AS (SELECT DISTINCT ln.sow_key, lower(o.title) AS title FROM ln JOIN
    (SELECT lower(x) AS key, arg_min(title, ord) AS title FROM
      (SELECT ord, title, unnest(list_concat([title], aliases)) AS x FROM org) GROUP BY 1) o ON o.key = lower(ln.title))"""))
def cl18(spark, sf_dir):
    rows = B.lines(spark, sf_dir, supplier=False).select("sow_key", F.col("title").alias("role")).distinct()
    mapped = (rows.select("sow_key", C.org_row(C.org_exact(F.col("role")))["title"].alias("title"))
              .where(F.col("title").isNotNull()))
    return C.unmapped_roles(rows, mapped, "sow_key")


@query("cl19_describe_department", B.sql(f"""
  SELECT d.label AS department, count(*) AS lines FROM (SELECT {role_sql('lower(title)', 2)} AS code FROM ln) l
  JOIN (VALUES {', '.join(f"({q(k)}, {q(v)})" for k, v in K.DEPARTMENT_LABELS.items())}) AS d(code, label) ON d.code = l.code
  GROUP BY d.label"""))
def cl19(spark, sf_dir):
    code = C.map_role(F.col("title"))["department"]
    return (B.lines(spark, sf_dir, supplier=False).groupBy("title").agg(F.count(F.lit(1)).alias("n"))
            .groupBy(C.describe_department(code).alias("department")).agg(F.sum("n").alias("lines")))
