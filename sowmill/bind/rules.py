"""Staffing rules and plans over SOW rows and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.bind import base as B
from sowmill.bind.classes import ORG_SQL, REQ, TYPE, any_sql, q, role_sql
from sowmill.bind.registry import query
from sowmill.functions import classify as C
from sowmill.plans import build as P
from sowmill.plans import rules as U

# --- inputs: plans whose roles are the staffing lines of a SOW ------------------------------------------


def plans(spark, sf_dir):
    s = B.sow(spark, sf_dir)
    entries = F.transform("staffing", lambda x: F.struct(x["title"].alias("title"), x["pct"].alias("pct")))
    return s.select("sow_key", C.project_type(F.col("theme")).alias("project_type"),
                    B.pick(K.COMPLEXITIES, F.col("sow_key") % 4).alias("complexity"), U.roles_of(entries).alias("roles"))


def spread(df):
    """Roles as rows; shares in ten-thousandths. The outer form keeps Spark from testing the roles twice."""
    return (df.select("sow_key", F.explode_outer("roles").alias("r")).where(F.col("r").isNotNull())
            .select("sow_key", "r.title", "r.level", F.floor(F.col("r.pct") * 1e4 + 0.500001).cast("long").alias("pct_e4"),
                    F.size("r.audit").alias("audits")))


_CX = "CASE sow_key % 4 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(K.COMPLEXITIES)) + " END"
PLANS = (f"pq AS MATERIALIZED (SELECT sow_key, {TYPE.replace('low', 'lower(theme)')} AS ptype, {_CX} AS cx FROM sow_base), "
         f"p0 AS MATERIALIZED (SELECT l.sow_key, 99 + seq AS ord, title, {role_sql('lower(title)', 2)} AS department, {role_sql('lower(title)', 1)} AS role, "
         f"{role_sql('lower(title)', 3)} AS level, pct, true AS original, 0 AS audits, ptype, cx FROM ln l JOIN pq USING (sow_key))")
COLS = "sow_key, ord, title, department, role, level, pct, original, audits, ptype, cx"
OUT = "SELECT sow_key, title, level, CAST(floor(pct * 1e4 + 0.500001) AS BIGINT) AS pct_e4, audits FROM "


def move_sql(prev: str, match: str, to: int, added: str, when: str = "true") -> str:
    """First matching original role to the front at five percent, else the added role."""
    return (f"SELECT sow_key, CASE WHEN {when} AND ord = f THEN {to} ELSE ord END AS ord, title, department, role, level, "
            f"CASE WHEN {when} AND ord = f THEN 5.0 ELSE pct END AS pct, original, audits, ptype, cx FROM "
            f"(SELECT *, min(ord) FILTER (original AND {match}) OVER (PARTITION BY sow_key) AS f FROM {prev}) UNION ALL "
            f"SELECT sow_key, {to}, {added}, 5.0, false, 1, ptype, cx FROM pq WHERE {when} AND sow_key NOT IN "
            f"(SELECT sow_key FROM {prev} WHERE original AND {match})")


def scale_sql(prev: str, member: str, factor: str, cap: str | None = None) -> str:
    new = f"pct * ({factor})"
    new = f"least({new}, {cap})" if cap else new
    return (f"SELECT sow_key, ord, title, department, role, level, CASE WHEN hit THEN {new} ELSE pct END AS pct, original, "
            f"audits + CASE WHEN hit THEN 1 ELSE 0 END AS audits, ptype, cx FROM (SELECT *, coalesce({member}, false) AND coalesce(pct, 0) <> 0 "
            f"AND ({factor}) IS NOT NULL AS hit FROM (SELECT *, coalesce(sum(pct) FILTER ({member}) OVER (PARTITION BY sow_key), 0) AS t FROM {prev}))")


def dept(code: str) -> str:
    return f"(original AND department = '{code}')"


CD_MATCH = "(role = 'vp_creative_director' OR contains(lower(title), 'creative director'))"
CD_NEW = "'Creative Director', 'planning_creative', 'vp_creative_director', 6"
EX_MATCH = "(level IN (7, 8) AND role IN ('vice_president', 'sr_vice_president'))"
EX_NEW = "'Vice President - Executive Oversight', 'client_services', 'vice_president', 7"
EX_WHEN = "cx IN ('complex', 'enterprise')"
SPONSOR = ("(original AND department = 'strategy' AND (contains(lower(title), 'sponsorship') OR role IN ('director_sponsorship_strategy', "
           "'manager_sponsorship_strategy')))")
SP_F = "CASE WHEN ptype = 'sponsorship_activation' AND t > 25 THEN 25 / t END"
SP_F2 = "CASE WHEN ptype = 'sponsorship_activation' AND t > 0 AND pct > 50 THEN 1.0 END"
CS_F = "CASE WHEN t < 75 THEN CASE WHEN t > 0 THEN 75 / t ELSE 1.0 END WHEN t > 100 THEN 100 / t END"
EXP_F = "CASE WHEN ptype IN ('event_management', 'hospitality_program') AND t < 80 THEN CASE WHEN t > 0 THEN 100 / t ELSE 1.0 END END"
CR_F = "CASE WHEN t < 5 THEN CASE WHEN t > 0 THEN 5 / t ELSE 1.0 END WHEN t > 25 THEN 25 / t END"
CAP_F = "CASE WHEN round(t, 6) > 100 THEN 100 / t END"


def pod_sql(prev: str, scope: str = "true") -> str:
    count = (f"SELECT pq.*, coalesce(n, 0) AS n, coalesce(am, false) AS am, coalesce(sae, false) AS sae FROM pq LEFT JOIN (SELECT sow_key, count(*) AS n, "
             f"bool_or(coalesce(role = 'account_manager', false)) AS am, bool_or(coalesce(role = 'sr_account_executive', false)) AS sae FROM {prev} WHERE {scope} GROUP BY 1) USING (sow_key)")
    steps = (f"SELECT *, CASE WHEN need > 0 AND NOT am THEN 1 ELSE 0 END AS a FROM (SELECT *, 4 - n AS need FROM ({count}))")
    steps = f"SELECT *, CASE WHEN need - a > 0 AND NOT sae THEN 1 ELSE 0 END AS b FROM ({steps})"
    new = lambda o, t, r, lv, p, cond: (f" UNION ALL SELECT sow_key, {o}, '{t}', 'client_services', '{r}', {lv}, {p}, false, 1, ptype, cx "  # noqa: E731
                                        f"FROM ({steps}) WHERE {cond}")
    return (f"SELECT {COLS} FROM {prev}" + new(3, "Account Manager", "account_manager", 3, 25.0, "a = 1")
            + new(4, "Senior Account Executive", "sr_account_executive", 2, 20.0, "b = 1")
            + new(5, "Account Executive", "account_executive", 1, 15.0, "need - a - b > 0"))


def chain_sql(first: str = "p0", strict: bool = True) -> str:
    scope = "true" if strict else "ord < 100"
    steps = [
        move_sql(first, CD_MATCH, 1, CD_NEW), move_sql("r1", EX_MATCH, 2, EX_NEW, EX_WHEN), scale_sql("r2", SPONSOR, SP_F),
        scale_sql("r3", SPONSOR, SP_F2, "50.0"), scale_sql("r4", dept("client_services"), CS_F, "100.0"),
        scale_sql("r5", dept("integrated_production_experiences"), EXP_F), scale_sql("r6", dept("planning_creative"), CR_F, "25.0"),
        pod_sql("r7", scope), scale_sql("r8", f"({scope} AND department = 'client_services')", CAP_F)]
    return ", ".join(f"r{i + 1} AS MATERIALIZED ({s})" for i, s in enumerate(steps))


# --- rule tables over the requirements of each text --------------------------------------------------------


def requirements(spark, sf_dir):
    return C.with_requirements(B.sow_text(spark, sf_dir), "text", "client_name")


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


SPLIT = values([(t, c, d, float(v)) for t, rows in K.DEPARTMENT_SPLIT.items() for c, shares in zip(K.COMPLEXITIES, rows)
                for d, v in zip(K.DEPARTMENTS, shares)])
KNOWN = f"CASE WHEN project_type IN ({', '.join(q(t) for t in K.DEPARTMENT_SPLIT)}) THEN project_type ELSE 'sponsorship_activation' END"
RECS = values([(t, "", *r[:4]) for t, rows in K.TYPE_ROLES.items() for r in rows] + [("", "complex", *K.COMPLEX_ROLE[:4])])


@query("ru01_department_split", B.sql(f"""
  SELECT sow_key, d.department, CAST(d.share AS DOUBLE) AS share FROM req JOIN {SPLIT} AS d(kind, cx, department, share)
  ON d.kind = {KNOWN} AND d.cx = complexity""", REQ))
def ru01(spark, sf_dir):
    split = U.department_split(F.col("project_type"), F.col("complexity"))
    return requirements(spark, sf_dir).select("sow_key", F.explode(split).alias("department", "share"))


@query("ru02_level_split", B.sql(f"""
  SELECT sow_key, l.level, CAST(l.share AS DOUBLE) AS share FROM req JOIN
    {values([(c, lv, float(v)) for c, row in K.LEVEL_SPLIT.items() for lv, v in zip(range(9, 0, -1), row)])} AS l(cx, level, share)
  ON l.cx = complexity""", REQ))
def ru02(spark, sf_dir):
    return requirements(spark, sf_dir).select("sow_key", F.explode(U.level_split(F.col("complexity"))).alias("level", "share"))


@query("ru03_recommended_roles", B.sql(f"""
  SELECT sow_key, r.title, r.level, CAST(r.low AS DOUBLE) AS low, CAST(r.high AS DOUBLE) AS high FROM req JOIN {RECS} AS r(kind, cx, title, level, low, high)
  ON r.kind = project_type OR r.cx = complexity""", REQ))
def ru03(spark, sf_dir):
    recs = U.recommended_roles(F.col("project_type"), F.col("complexity"))
    return (requirements(spark, sf_dir).select("sow_key", F.explode(recs).alias("r"))
            .select("sow_key", "r.title", "r.level", "r.low", "r.high"))


def case(col: str, table: dict, default) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


FTE = (f"CAST(round(CAST({case('complexity', K.BASE_FTE, 2)} AS DECIMAL(4,1)) * CAST({case('project_type', K.TYPE_FACTOR, 1)} AS DECIMAL(4,1)) * "
       "CAST(CASE WHEN events_count > 3 THEN 1.2 ELSE 1 END AS DECIMAL(4,1)), 1) AS DOUBLE)")


@query("ru04_total_fte", B.sql(f"SELECT sow_key, {FTE} AS total_fte FROM req", REQ))
def ru04(spark, sf_dir):
    fte = U.total_fte(F.col("project_type"), F.col("complexity"), F.col("events_count"))
    return requirements(spark, sf_dir).select("sow_key", fte.alias("total_fte"))


@query("ru05_timeline_phases", B.sql("""
  SELECT sow_key, p.phase, CASE p.phase WHEN 'Execution' THEN duration_weeks - 2 * e ELSE e END AS weeks,
    CAST(CASE WHEN p.phase = 'Execution' THEN 1.0 WHEN e = 4 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS fte
  FROM (SELECT *, CASE WHEN duration_weeks >= 26 THEN 4 ELSE 2 END AS e FROM req), (VALUES ('Planning'), ('Execution'), ('Wrap-up')) AS p(phase)""", REQ))
def ru05(spark, sf_dir):
    return (requirements(spark, sf_dir).select("sow_key", F.explode(U.timeline_phases(F.col("duration_weeks"))).alias("p"))
            .select("sow_key", "p.*"))


@query("ru06_assessment", B.sql("""
  SELECT sow_key, concat_ws('; ', CASE WHEN hard THEN 'High complexity requires experienced team' END,
      CASE WHEN duration_weeks > 52 THEN 'Long duration may require team continuity planning' END,
      CASE WHEN geographic_scope = 'global' THEN 'Global scope requires time zone coordination' END,
      CASE WHEN events_count > 5 THEN 'Multiple events require strong project management' END) AS risks,
    concat_ws('; ', 'Clear ' || replace(project_type, '_', ' ') || ' focus', 'Appropriate team size for ' || complexity || ' complexity',
      CASE WHEN special_requirements <> '' THEN 'Specialized expertise for: ' || special_requirements END) AS success_factors,
    concat_ws('; ', CASE WHEN events_count > 3 THEN 'Coordinating multiple events' END, CASE WHEN geographic_scope IN ('national', 'global')
      THEN 'Multi-location coordination' END, CASE WHEN deliverables_count > 10 THEN 'Managing multiple deliverables' END) AS challenges,
    CASE complexity WHEN 'simple' THEN 'Small' WHEN 'moderate' THEN 'Medium' ELSE 'Large' END AS team_size,
    CASE WHEN hard THEN 'Senior' ELSE 'Mid-level' END AS expertise_level,
    CASE WHEN events_count > 3 THEN 'High' WHEN events_count > 1 THEN 'Medium' ELSE 'Low' END AS coordination_needs,
    concat_ws('; ', CASE WHEN duration_weeks < 13 THEN 'Short timeline requires immediate mobilization' WHEN duration_weeks > 52
      THEN 'Long timeline allows for phased approach' END, CASE WHEN events_count > 1 THEN 'Multiple events require staggered execution' END) AS timeline_notes,
    'Project classified as ' || complexity || ' based on ' || duration_weeks || '-week duration, ' || budget_range || ' budget, and ' ||
      geographic_scope || ' scope' AS justification
  FROM (SELECT *, complexity IN ('complex', 'enterprise') AS hard FROM req)""", REQ))
def ru06(spark, sf_dir):
    a = U.assessment(requirements(spark, sf_dir))
    lists = ["risks", "success_factors", "challenges", "timeline_notes"]
    return a.select("sow_key", *[F.array_join(c, "; ").alias(c) for c in lists], "team_size", "expertise_level",
                    "coordination_needs", "justification")


SYNTH = (f"rec AS (SELECT sow_key, r.title, r.ord, (r.low + r.high) / 2.0 AS mid, project_type, complexity FROM req JOIN "
         + values([(t, "", *r[:1], i, r[2], r[3]) for t, rows in K.TYPE_ROLES.items() for i, r in enumerate(rows)]
                  + [("", "complex", K.COMPLEX_ROLE[0], 2, K.COMPLEX_ROLE[2], K.COMPLEX_ROLE[3])])
         + " AS r(kind, cx, title, ord, low, high) ON r.kind = project_type OR r.cx = complexity), "
         f"syn AS (SELECT sow_key, title, ord, {role_sql('lower(title)', 2)} AS department, {role_sql('lower(title)', 1)} AS role, "
         f"{role_sql('lower(title)', 3)} AS level, least(mid, round(CAST(d.share AS DOUBLE) * 100, 6)) AS pct, project_type, complexity FROM rec JOIN {SPLIT} AS d(kind, cx, dep, share) "
         f"ON d.kind = {KNOWN} AND d.cx = complexity AND d.dep = {role_sql('lower(title)', 2)})")


@query("ru07_synthesize_roles", B.sql("SELECT sow_key, title, level, CAST(floor(pct * 1e4 + 0.500001) AS BIGINT) AS pct_e4, 1 AS audits FROM syn",
                                      REQ + ", " + SYNTH))
def ru07(spark, sf_dir):
    roles = U.synthesize_roles(F.col("project_type"), F.col("complexity"))
    return spread(requirements(spark, sf_dir).select("sow_key", roles.alias("roles")))


# --- single rules over plans of staffing lines -----------------------------------------------------------------


def single(name, rule, body):
    @query(name, B.sql(OUT + f"({body})", PLANS))
    def run(spark, sf_dir):
        return spread(rule(plans(spark, sf_dir)))


single("ru08_rule_creative_director", U.rule_creative_director, move_sql("p0", CD_MATCH, 1, CD_NEW))
single("ru09_rule_executive", U.rule_executive, move_sql("p0", EX_MATCH, 2, EX_NEW, EX_WHEN))
single("ru10_rule_sponsorship", U.rule_sponsorship, scale_sql(f"({scale_sql('p0', SPONSOR, SP_F)})", SPONSOR, SP_F2, "50.0"))
single("ru11_rule_client_services", U.rule_client_services, scale_sql("p0", dept("client_services"), CS_F, "100.0"))
single("ru12_rule_experiences", U.rule_experiences, scale_sql("p0", dept("integrated_production_experiences"), EXP_F))
single("ru13_rule_creative", U.rule_creative, scale_sql("p0", dept("planning_creative"), CR_F, "25.0"))
single("ru14_rule_min_pod", U.rule_min_pod, pod_sql("p0"))
single("ru15_rule_final_cap", U.rule_final_cap, scale_sql("p0", "(department = 'client_services')", CAP_F))


@query("ru16_apply_rules", B.sql(OUT + "r9", PLANS + ", " + chain_sql()))
def ru16(spark, sf_dir):
    return spread(U.apply_rules(plans(spark, sf_dir)))


@query("ru16_apply_rules_loose_order", B.sql(OUT + "r9", PLANS + ", " + chain_sql(strict=False)))
def ru16_loose(spark, sf_dir):
    return spread(U.apply_rules(plans(spark, sf_dir), strict_order=False))


MONEY = f"{FTE} * 40 * duration_weeks * {case('complexity', K.HOURLY_RATE, 200)}"


@query("ru17_financials", B.sql(f"""SELECT sow_key, CAST(floor(b * 100 + 0.5) AS BIGINT) AS budget_cents, CAST(floor(b * 0.8 * 100 + 0.5) AS BIGINT) AS labor_cents
  FROM (SELECT sow_key, {MONEY} AS b FROM req)""", REQ))
def ru17(spark, sf_dir):
    fte = U.total_fte(F.col("project_type"), F.col("complexity"), F.col("events_count"))
    f = U.with_financials(requirements(spark, sf_dir).withColumn("total_fte", fte))
    cents = lambda c: F.floor(F.col(f"financial.{c}") * 100 + 0.5).cast("long")
    return f.select("sow_key", cents("total_budget").alias("budget_cents"), cents("labor_costs").alias("labor_cents"))


# requirement rows as plans for the same chain
TEXT_PLANS = REQ + ", " + SYNTH + (", pq AS MATERIALIZED (SELECT sow_key, project_type AS ptype, complexity AS cx FROM req), p0 AS MATERIALIZED (SELECT sow_key, 100 + ord AS ord, title, "
                                   "department, role, level, pct, true AS original, 1 AS audits, project_type AS ptype, complexity AS cx FROM syn)")


@query("ru18_recommend_plan", B.sql(OUT + "r9", TEXT_PLANS + ", " + chain_sql()))
def ru18(spark, sf_dir):
    return spread(P.recommend_plan(B.sow_text(spark, sf_dir), "text", "client_name"))


# --- baseline ---------------------------------------------------------------------------------------------------


def detected(spark, sf_dir):
    """SOWs with the organisation roles of their titles (exact look-up, distinct, in order)."""
    found = F.array_distinct(F.array_compact(F.transform("staffing", lambda s: C.org_exact(s["title"]))))
    return B.sow(spark, sf_dir).select("sow_key", "client_name", found.alias("found"))


FOUND = ORG_SQL + """, names AS (SELECT lower(x) AS key, min(ord) AS ord FROM (SELECT ord, unnest(list_concat([title], aliases)) AS x FROM org) GROUP BY 1),
  fd AS (SELECT DISTINCT ln.sow_key, o.ord, o.title, o.level, o.department FROM ln JOIN names n ON n.key = lower(ln.title) JOIN org o ON o.ord = n.ord),
  base(department, lo, hi) AS (VALUES """ + ", ".join(f"({q(d)}, {lo}, {hi})" for d, (lo, hi) in K.BASELINE_FTE.items()) + ")"


@query("ru19_baseline_allocations", B.sql("""
  SELECT sow_key, fd.department, CAST(lo AS DOUBLE) AS min_fte, CAST(hi AS DOUBLE) AS max_fte, CAST((lo + hi) / 2 AS DOUBLE) AS suggested_fte, count(*) AS titles,
    CAST(floor((sum(any_value((lo + hi) / 2)) OVER (PARTITION BY sow_key) + 0.4) * 1e4 + 0.5) AS BIGINT) AS total_e4
  FROM fd JOIN base USING (department) GROUP BY sow_key, fd.department, lo, hi""", FOUND))
def ru19(spark, sf_dir):
    a = detected(spark, sf_dir).select("sow_key", P.baseline_allocations(F.col("found")).alias("a"))
    total = F.floor(P.baseline_total(F.col("a")) * 1e4 + 0.5).cast("long")
    return (a.select("sow_key", total.alias("total_e4"), F.explode("a").alias("x"))
            .select("sow_key", "x.department", "x.min_fte", "x.max_fte", "x.suggested_fte", F.size("x.titles").alias("titles"), "total_e4"))


@query("ru20_oversight_rows", B.sql("SELECT sow_key, title AS role, department, level, CAST(0.05 AS DOUBLE) AS fte FROM sow_base, org WHERE level BETWEEN 7 AND 8", ORG_SQL))
def ru20(spark, sf_dir):
    return P.oversight_rows(B.sow_base(spark, sf_dir).select("sow_key"))


_CASED = "list_aggregate(list_transform(string_split({}, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"


@query("ru21_baseline_to_plan", B.sql(f"""
  SELECT sow_key, title AS role, {_CASED.format('department')} AS department, level, CAST(floor((lo + hi) * 50) AS INTEGER) AS allocation_percent,
    'AI DRAFT - ' || {_CASED.format('department')} || ' allocation' AS notes FROM fd JOIN base USING (department)
  UNION ALL SELECT sow_key, o.title, {_CASED.format('f.department')}, f.level, 5, 'AI DRAFT - l7_l8_oversight rule'
  FROM sow_base, org o JOIN names n ON n.key = lower(o.title) JOIN org f ON f.ord = n.ord WHERE o.level BETWEEN 7 AND 8""", FOUND))
def ru21(spark, sf_dir):
    d = detected(spark, sf_dir).withColumn("months", (F.col("sow_key") % 13).cast("int"))
    plan = P.baseline_to_plan(d, "found", "client_name", "sow_key", "months")
    return (plan.select("sow_key", F.explode("roles").alias("r"))
            .select("sow_key", "r.role", "r.department", "r.level", "r.allocation_percent", "r.notes"))


@query("ru21_baseline_summary", B.sql(f"""
  SELECT b.sow_key, concat_ws(chr(10), 'AI DRAFT Staffing Plan for ' || client_name || ' - ' || b.sow_key, 'Project Duration: ' || (b.sow_key % 13) || ' months',
    'Departments: ' || coalesce(d.names, ''), 'Total Allocation: ' || CAST(CAST((coalesce(d.mids, 0) + 0.4) * 100 AS DECIMAL(10,1)) AS VARCHAR) || '% FTE',
    'Roles Identified: ' || (coalesce(d.n, 0) + 8) || ' positions') AS summary
  FROM sow_base b LEFT JOIN (SELECT sow_key, string_agg(nm, ', ' ORDER BY o) AS names, sum(mid) AS mids, sum(c) AS n FROM (
    SELECT sow_key, {_CASED.format('department')} AS nm, min(ord) AS o, any_value((lo + hi) / 2) AS mid, count(*) AS c FROM fd JOIN base USING (department)
    GROUP BY sow_key, department) GROUP BY sow_key) d USING (sow_key)""", FOUND))
def ru21_summary(spark, sf_dir):
    d = detected(spark, sf_dir).withColumn("months", (F.col("sow_key") % 13).cast("int"))
    return P.baseline_to_plan(d, "found", "client_name", "sow_key", "months").select("sow_key", "summary")


# --- API form, combination, assessment ------------------------------------------------------------------------------


def recommended(spark, sf_dir):
    return P.recommend_plan(B.sow_text(spark, sf_dir), "text", "client_name")


@query("ru22_plan_to_api", B.sql(f"""
  SELECT sow_key, ord, title AS role, {_CASED.format('department')} AS department, level, CAST(floor(round(pct, 6)) AS INTEGER) AS allocation_percent,
    'AI Generated - Confidence: ' || CASE WHEN ord >= 100 THEN '0.90' WHEN ord <= 2 THEN '1.00' ELSE '0.80' END AS notes FROM (SELECT *, row_number()
    OVER (PARTITION BY sow_key ORDER BY ord) AS rn FROM r9)""".replace("sow_key, ord, title", "sow_key, rn AS seq, title"), TEXT_PLANS + ", " + chain_sql()))
def ru22(spark, sf_dir):
    api = P.plan_to_api(recommended(spark, sf_dir), "sow_key", "project_title", "client_name")
    return (api.select("sow_key", F.posexplode_outer("roles").alias("i", "r"))
            .select("sow_key", (F.col("i") + 1).alias("seq"), "r.role", "r.department", "r.level", "r.allocation_percent", "r.notes"))


def extracted(spark, sf_dir):
    s = B.sow(spark, sf_dir)
    return P.build_plan(s.select(
        "sow_key", F.col("project_title").alias("project_name"), "client_name",
        F.when(F.col("sow_key") % 3 == 0, F.concat(F.lit("C-"), F.col("sow_key").cast("string"))).alias("contract_number"),
        (F.col("sow_key") % 4).alias("duration_weeks"), F.when(F.col("sow_key") % 5 > 0, F.col("o_totalprice")).alias("budget"),
        F.transform("staffing", lambda x: F.struct(x["title"].alias("title"), x["pct"].alias("pct"))).alias("entries")), "entries", "budget")


_EXTRA = f"""ex AS (SELECT sow_key, seq, title, pct, {role_sql('lower(title)', 2)} AS department, {role_sql('lower(title)', 3)} AS level FROM ln),
  es AS (SELECT b.sow_key, (0.3 + 0.3 + CASE WHEN b.sow_key % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN b.sow_key % 4 = 0 THEN 0 ELSE 0.2 END) * 0.4 +
    (least(coalesce(n, 0) / 3.0, 1.0) * 0.6 + coalesce(m / n, 0) * 0.4) * 0.4 + CASE WHEN b.sow_key % 5 > 0 AND o_totalprice <> 0 THEN 0.2 ELSE 0 END AS score,
    coalesce(fte, 0) AS fte FROM sow_base b LEFT JOIN (SELECT sow_key, count(*) AS n, count(department) AS m, sum(pct) AS fte FROM ex GROUP BY 1) USING (sow_key))"""


@query("ru25_build_plan", B.sql("SELECT sow_key, fte AS total_fte_percentage, CAST(floor(score * 1e4 + 0.5) AS BIGINT) AS completeness_e4 FROM es", _EXTRA))
def ru25(spark, sf_dir):
    return extracted(spark, sf_dir).select("sow_key", "total_fte_percentage",
                                           F.floor(F.col("completeness_score") * 1e4 + 0.5).cast("long").alias("completeness_e4"))


_COMBINED = TEXT_PLANS + ", " + chain_sql() + ", " + _EXTRA + """, cb AS (
  SELECT sow_key, title, department, level, pct FROM r9 UNION ALL SELECT e.sow_key, e.title, e.department, e.level, e.pct FROM ex e WHERE NOT EXISTS (
    SELECT 1 FROM r9 r WHERE r.sow_key = e.sow_key AND lower(r.title) = lower(e.title)))"""


@query("ru23_combine_plans", B.sql("SELECT sow_key, title, level, CAST(floor(pct * 1e4 + 0.500001) AS BIGINT) AS pct_e4 FROM cb", _COMBINED))
def ru23(spark, sf_dir):
    return spread(P.combine_plans(extracted(spark, sf_dir), recommended(spark, sf_dir), "sow_key")).drop("audits")


@query("ru24_assess_quality", B.sql("""
  SELECT sow_key, CAST(floor((0.8 * 0.3 + 0.85 * 0.7) * 1000 + 0.5) AS BIGINT) AS confidence, CAST(floor((score * 0.4 + 0.95 * 0.6) * 100 + 0.5) AS BIGINT) AS completeness,
    CAST(floor(count(department) * 100.0 / count(*) + 0.5) AS BIGINT) AS mapping, count(DISTINCT department) * 25 AS coverage,
    coalesce(sum(pct) FILTER (level BETWEEN 7 AND 9), 0) > 0 AS executive, count(*) AS total_roles,
    concat_ws('; ', CASE WHEN round(score * 0.4 + 0.95 * 0.6, 6) < 0.8 THEN 'Low completeness score - may be missing key roles' END,
      CASE WHEN NOT bool_or(coalesce(level BETWEEN 7 AND 9, false)) AND sum(pct) > 200 THEN 'Large project without executive oversight' END,
      CASE WHEN count(*) > count(department) THEN (count(*) - count(department)) || ' roles not mapped to departments' END,
      CASE WHEN count(DISTINCT department) = 1 THEN 'All roles in single department - may need cross-functional input' END) AS flags
  FROM cb JOIN es USING (sow_key) GROUP BY sow_key, score""", _COMBINED))
def ru24(spark, sf_dir):
    a = P.assess_quality(P.combine_plans(extracted(spark, sf_dir), recommended(spark, sf_dir), "sow_key"))
    whole = lambda c, n: F.floor(F.col(c) * n + 0.5).cast("long")
    return a.select("sow_key", whole("overall_confidence", 1000).alias("confidence"),
                    F.floor((F.col("_es") * 0.4 + F.col("completeness_score") * 0.6) * 100 + 0.5).cast("long").alias("completeness"),
                    whole("role_mapping_quality", 100).alias("mapping"), whole("department_coverage", 100).alias("coverage"),
                    F.col("has_executive_oversight").alias("executive"), "total_roles", F.array_join("quality_flags", "; ").alias("flags"))


@query("ru26_compliance", B.sql("""
  SELECT sow_key, coalesce(bool_or(contains(lower(title), 'creative director') AND pct = 5), false) AS creative_director,
    coalesce(bool_or(level IN (7, 8)), false) AS executive, count(*) >= 4 AS min_pod,
    coalesce(round(sum(pct) FILTER (department = 'client_services'), 6) BETWEEN 75 AND 100, false) AS client_services FROM r9 GROUP BY sow_key""",
                               TEXT_PLANS + ", " + chain_sql()))
def ru26(spark, sf_dir):
    c = recommended(spark, sf_dir).select("sow_key", U.compliance(F.col("roles")).alias("c"))
    return c.select("sow_key", "c.creative_director", "c.executive", "c.min_pod", "c.client_services")
