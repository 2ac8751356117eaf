"""Reports over SOW rows, texts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.bind import base as B
from sowmill.bind.classes import group_sql, q, role_sql
from sowmill.bind.joins import CMP_SQL, comparison
from sowmill.bind.registry import query
from sowmill.bind.texts import PROFILE, RICH, rich
from sowmill.functions import classify as C
from sowmill.functions import text as X
from sowmill.operators import report as R

DISPLAY = "name || ' (' || title || '): ' || CAST(pct AS BIGINT) || '%'"


def displays(spark, sf_dir):
    """Display strings, one row per staffing line."""
    text = F.concat("name", F.lit(" ("), "title", F.lit("): "), F.col("pct").cast("long").cast("string"), F.lit("%"))
    return B.lines(spark, sf_dir).select("sow_key", text.alias("display"))


def counted(spark, sf_dir):
    return (B.with_counts(spark, sf_dir, B.sow_base(spark, sf_dir))
            .withColumn("n_staffing", F.col("n_lines")).withColumn("n_deliverables", F.col("n_lines"))
            .withColumn("kind", C.title_category(F.col("project_title"))))


KIND = group_sql("lower(project_title)", K.TITLE_CATEGORY_WORDS, "Other")


@query("ag01_corpus_stats", B.sql("""
  SELECT count(*) AS documents, count(DISTINCT nullif(trim(client_name), '')) AS clients, CAST(min(start_date) AS VARCHAR) AS first_start,
    CAST(max(start_date) AS VARCHAR) AS last_start FROM sow_base"""))
def ag01(spark, sf_dir):
    s = R.corpus_stats(B.sow_base(spark, sf_dir))
    return s.select("documents", "clients", F.col("first_start").cast("string").alias("first_start"),
                    F.col("last_start").cast("string").alias("last_start"))


@query("ag02_distinct_values", B.sql("SELECT DISTINCT trim(client_name) AS value FROM sow_base WHERE trim(client_name) <> ''"))
def ag02(spark, sf_dir):
    return R.distinct_values(B.sow_base(spark, sf_dir), "client_name")


@query("ag03_role_frequency", B.sql("SELECT title AS role, count(*) AS n FROM ln GROUP BY title ORDER BY n DESC, role LIMIT 10"))
def ag03(spark, sf_dir):
    return R.top_roles(displays(spark, sf_dir), "display")


@query("ag04_type_counts", B.sql(f"""
  SELECT t.kind, t.projects, m.most_common_type FROM (SELECT {KIND} AS kind, count(*) AS projects FROM sow_base GROUP BY 1) t,
    (SELECT arg_max(kind, {{'n': n, 'f': -f}}) AS most_common_type FROM (SELECT {KIND} AS kind, count(*) AS n, min(sow_key) AS f
      FROM sow_base GROUP BY 1)) m"""))
def ag04(spark, sf_dir):
    s = B.sow_base(spark, sf_dir).select("sow_key", C.title_category(F.col("project_title")).alias("kind"))
    best = R.mode_type(s, "kind", "sow_key").select("most_common_type")
    return R.type_counts(s, "kind").withColumn("most_common_type", best.scalar())


@query("ag05_team_size", B.sql("""
  SELECT sum(n_lines) / count(*) AS per_project, sum(n_lines) / count(*) FILTER (n_lines > 0) AS per_staffed_project,
    count(*) FILTER (n_lines > 0) AS staffed_projects FROM sow"""))
def ag05(spark, sf_dir):
    return R.avg_team_size(B.with_counts(spark, sf_dir, B.sow_base(spark, sf_dir)), "n_lines")


@query("ag06_role_usage", B.sql("""
  SELECT title AS role, count(*) AS n, CAST(floor(count(*) * 1000.0 / (SELECT count(*) FROM sow_base) + 0.5) AS BIGINT) AS share_permille
  FROM ln GROUP BY title ORDER BY n DESC, role LIMIT 3"""))
def ag06(spark, sf_dir):
    return R.role_usage(displays(spark, sf_dir), "display", B.sow_base(spark, sf_dir))


@query("ag07_client_summary", B.sql("""
  SELECT client_name, count(*) AS projects, CAST(sum(n_lines) AS BIGINT) AS staffing, CAST(sum(n_lines) AS BIGINT) AS deliverables
  FROM sow GROUP BY client_name"""))
def ag07(spark, sf_dir):
    return R.client_summary(counted(spark, sf_dir))


@query("ag08_category_counts", B.sql(f"SELECT {KIND} AS kind, count(*) AS projects FROM sow_base GROUP BY 1"))
def ag08(spark, sf_dir):
    s = B.sow_base(spark, sf_dir).select(C.title_category(F.col("project_title")).alias("kind"))
    return R.type_counts(s, "kind")


@query("ag09_summary_metrics", B.sql(f"""
  SELECT 'Overall' AS category, 'Total SOWs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM sow
  UNION ALL SELECT 'Overall', 'Total Staffing Entries', sum(n_lines) FROM sow
  UNION ALL SELECT 'Overall', 'Total Deliverables', sum(n_lines) FROM sow
  UNION ALL SELECT 'Overall', 'Average Staffing per SOW', floor(sum(n_lines) * 10.0 / count(*) + 0.5) / 10 FROM sow
  UNION ALL SELECT 'By Client', client_name || ' - Projects', count(*) FROM sow GROUP BY client_name
  UNION ALL SELECT 'By Client', client_name || ' - Staffing', sum(n_lines) FROM sow GROUP BY client_name
  UNION ALL SELECT 'By Type', {KIND} || ' Projects', count(*) FROM sow GROUP BY {KIND}"""))
def ag09(spark, sf_dir):
    return R.summary_metrics(counted(spark, sf_dir), "kind")


@query("ag10_client_counts", B.sql("SELECT client_name, count(*) AS projects FROM sow_base GROUP BY client_name"))
def ag10(spark, sf_dir):
    return R.client_counts(B.sow_base(spark, sf_dir))


def results(spark, sf_dir):
    """Analysis results: one per SOW, with weeks and confidence from its key; a few failed."""
    k = F.col("sow_key")
    return B.sow_base(spark, sf_dir).select(
        "sow_key", "file_name", F.when(k % 50 == 0, "ERROR").otherwise(F.col("client_name")).alias("company"), "project_title",
        (k % 60).alias("duration_weeks"), F.when(k % 50 == 0, 0.0).otherwise((k % 16) / 16).alias("confidence"))


RES = ("res AS (SELECT sow_key, file_name, CASE WHEN sow_key % 50 = 0 THEN 'ERROR' ELSE client_name END AS company, project_title, "
       "sow_key % 60 AS duration_weeks, CASE WHEN sow_key % 50 = 0 THEN 0.0 ELSE (sow_key % 16) / 16 END AS confidence FROM sow_base)")


@query("ag11_company_summary", B.sql("""
  SELECT r.company, r.project_title, s.sow_count, s.total_weeks, s.avg_weeks FROM res r JOIN (SELECT company, count(*) AS sow_count,
    CAST(sum(duration_weeks) AS BIGINT) AS total_weeks, sum(duration_weeks) / count(*) AS avg_weeks FROM res GROUP BY company) s
  ON s.company = r.company WHERE r.company <> 'ERROR'""", RES))
def ag11(spark, sf_dir):
    return R.company_projects(results(spark, sf_dir))


@query("ag12_department_usage", B.sql(f"""
  SELECT department, count(DISTINCT sow_key) AS sows, CAST(floor(count(DISTINCT sow_key) * 1000.0 /
    (SELECT count(*) FROM res WHERE confidence > 0.5) + 0.5) AS BIGINT) AS permille
  FROM (SELECT sow_key, {role_sql('lower(title)', 2)} AS department FROM ln) WHERE department IS NOT NULL GROUP BY department""", RES))
def ag12(spark, sf_dir):
    d = B.lines(spark, sf_dir, supplier=False).select("sow_key", C.map_role(F.col("title"))["department"].alias("department"))
    return R.department_usage(d, results(spark, sf_dir))


@query("ag13_item_frequency", "SELECT p_name AS item, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def ag13(spark, sf_dir):
    return R.item_frequency(B.lines(spark, sf_dir, supplier=False).select(F.col("deliverable").alias("item")), "item")


@query("ag14_duration_stats", B.sql("""
  SELECT min(w) AS min_weeks, max(w) AS max_weeks, sum(w) / count(*) AS avg_weeks, list_sort(list(w))[count(*) // 2 + 1] AS median_weeks
  FROM (SELECT duration_weeks AS w FROM res WHERE duration_weeks > 0)""", RES))
def ag14(spark, sf_dir):
    return R.duration_stats(results(spark, sf_dir))


@query("ag15_run_summary", """
  SELECT count(*) AS total, count(*) FILTER (quality > 0.5) AS successful, avg(CAST(quality AS DOUBLE)) AS mean_confidence,
    count(*) FILTER (quality > 0.5) / count(*) AS success_rate FROM labels""")
def ag15(spark, sf_dir):
    return R.run_summary(B.table(spark, sf_dir, "labels").select(F.col("quality").cast("double").alias("confidence")))


_TERMS = ("tc AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest({PROFILE[k]}) AS term FROM rich"
                                         for k in ("sections", "roles", "deliverables", "timeline", "budget")) +
          "), tn AS (SELECT kind, term, count(*) AS n FROM tc GROUP BY kind, term), "
          "tr AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS r FROM tn)")


@query("ag16_term_taxonomy", B.sql("""
  SELECT kind, term, n, CASE WHEN kind IN ('sections', 'deliverables') THEN r <= 10 AND n >= 2 WHEN kind = 'roles' THEN r <= 15 ELSE r <= 20 END AS common FROM tr""",
                                   RICH + ", " + _TERMS))
def ag16(spark, sf_dir):
    p = rich(spark, sf_dir).select(X.term_profile(F.col("text")).alias("p")).select("p.*")
    return R.term_taxonomy(p)


@query("ag17_word_frequency", r"""
  SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\s+')) AS word FROM (SELECT DISTINCT text FROM documents))
  WHERE length(word) > 3 GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def ag17(spark, sf_dir):
    return R.word_frequency(B.table(spark, sf_dir, "documents"), "text")


_STATS = ("count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower().replace(' ', '_')}" for s in R.STATUSES) +
          ", CAST(floor(count(*) FILTER (status = 'Match') * 10000.0 / count(*) + 0.5) AS BIGINT) AS match_rate")


@query("ag18_comparison_stats", B.sql(f"""
  SELECT 'field' AS scope, field AS name, {_STATS} FROM st GROUP BY field UNION ALL SELECT 'overall', 'all', {_STATS} FROM st""", CMP_SQL))
def ag18(spark, sf_dir):
    # the overall row adds up the nine field rows
    fields = R.comparison_stats(comparison(spark, sf_dir), ["field"])
    sums = [F.sum(c).alias(c) for c in fields.columns if c not in ("field", "match_rate")]
    overall = fields.agg(*sums).withColumn("match_rate", F.floor(F.col("match") * 10000 / F.col("total") + 0.5).cast("long"))
    named = fields.withColumnRenamed("field", "name").withColumn("scope", F.lit("field"))
    return named.unionByName(overall.withColumn("name", F.lit("all")).withColumn("scope", F.lit("overall")))


@query("ag19_status_crosstab", B.sql(f"""
  SELECT field, {', '.join(f"count(*) FILTER (status = '{s}') AS " + chr(34) + s + chr(34) for s in R.STATUSES)},
    CAST(floor(count(*) FILTER (status = 'Match') * 10000.0 / count(*) + 0.5) AS BIGINT) AS match_rate FROM st GROUP BY field""", CMP_SQL))
def ag19(spark, sf_dir):
    return R.status_crosstab(comparison(spark, sf_dir), "field")


def mapped_roles(spark, sf_dir):
    m = C.map_role(F.col("title"))
    return (B.lines(spark, sf_dir, supplier=False).withColumn("m", m)
            .select("sow_key", "title", "pct", F.when(F.col("l_partkey") % 7 != 0, F.col("m.department")).alias("department"),
                    F.col("m.role").alias("role"), F.col("m.level").alias("level")))


ROLES = (f"mr AS (SELECT sow_key, title, pct, CASE WHEN l_partkey % 7 <> 0 THEN {role_sql('lower(title)', 2)} END AS department, "
         f"{role_sql('lower(title)', 1)} AS role, {role_sql('lower(title)', 3)} AS level FROM ln)")


@query("ag20_fte_by_department", B.sql("""
  SELECT sow_key, department, sum(pct) AS fte FROM mr WHERE department IS NOT NULL AND pct <> 0 GROUP BY 1, 2""", ROLES))
def ag20(spark, sf_dir):
    return R.fte_by_department(mapped_roles(spark, sf_dir), "sow_key")


@query("ag21_level_distribution", B.sql("""
  SELECT a.sow_key, a.level, a.fte, b.executive FROM (SELECT sow_key, level, sum(pct) AS fte FROM mr WHERE level IS NOT NULL GROUP BY 1, 2) a
  JOIN (SELECT sow_key, bool_or(level BETWEEN 7 AND 9 AND pct > 0) AS executive FROM mr WHERE level IS NOT NULL GROUP BY 1) b
  ON b.sow_key = a.sow_key""", ROLES))
def ag21(spark, sf_dir):
    return R.level_distribution(mapped_roles(spark, sf_dir), "sow_key")


@query("ag22_mapping_quality", B.sql("""
  SELECT sow_key, count(department) AS mapped, count(*) AS roles, count(department) / count(*) AS role_mapping_quality,
    count(DISTINCT department) / 4 AS department_coverage FROM mr GROUP BY 1""", ROLES))
def ag22(spark, sf_dir):
    return R.mapping_quality(mapped_roles(spark, sf_dir), "sow_key")


_PLAN = """pl AS (SELECT b.sow_key, b.project_title, b.client_name, CASE WHEN b.sow_key % 3 = 0 THEN 'C-' || b.sow_key END AS contract,
    b.sow_key % 4 AS weeks, coalesce(r.n, 0) AS n_roles, coalesce(r.m, 0) AS n_mapped, coalesce(r.fte, 0) AS fte, coalesce(r.d, 0) AS depts,
    coalesce(r.ex, false) AS executive, CASE WHEN b.sow_key % 5 > 0 THEN o_totalprice END AS budget
  FROM sow_base b LEFT JOIN (SELECT sow_key, count(*) AS n, count(department) AS m, sum(pct) AS fte, count(DISTINCT department) AS d,
    bool_or(coalesce(level BETWEEN 7 AND 9, false)) AS ex FROM mr GROUP BY 1) r ON r.sow_key = b.sow_key),
  ps AS (SELECT *, (CASE WHEN project_title = '' THEN 0 ELSE 0.3 END + 0.3 + CASE WHEN contract IS NULL THEN 0 ELSE 0.2 END +
    CASE WHEN weeks = 0 THEN 0 ELSE 0.2 END) * 0.4 + (least(n_roles / 3.0, 1.0) * 0.6 + CASE WHEN n_roles > 0 THEN n_mapped / n_roles ELSE 0 END * 0.4) * 0.4
    + CASE WHEN budget IS NOT NULL THEN 0.2 ELSE 0 END AS score FROM pl)"""


def plan_facts(spark, sf_dir):
    r = mapped_roles(spark, sf_dir).groupBy("sow_key").agg(
        F.count(F.lit(1)).alias("n_roles"), F.count("department").alias("n_mapped"), F.sum("pct").alias("fte"),
        F.countDistinct("department").alias("depts"), F.max(F.coalesce(F.col("level").between(7, 9), F.lit(False))).alias("executive"))
    k = F.col("sow_key")
    out = B.sow_base(spark, sf_dir).join(r, "sow_key", "left").na.fill(0, ["n_roles", "n_mapped", "fte", "depts"])
    return (out.withColumn("executive", F.coalesce("executive", F.lit(False)))
            .withColumn("contract", F.when(k % 3 == 0, F.concat(F.lit("C-"), k.cast("string")))).withColumn("weeks", k % 4)
            .withColumn("budget", F.when(k % 5 > 0, F.col("o_totalprice")))
            .withColumn("score", R.completeness(F.col("project_title"), F.col("client_name"), F.col("contract"), F.col("weeks"),
                                                F.col("n_roles"), F.col("n_mapped"), F.col("budget"))))


@query("ag23_completeness", B.sql("SELECT sow_key, CAST(floor(score * 1e4 + 0.5) AS BIGINT) AS score_e4 FROM ps", ROLES + ", " + _PLAN))
def ag23(spark, sf_dir):
    return plan_facts(spark, sf_dir).select("sow_key", F.floor(F.col("score") * 1e4 + 0.5).cast("long").alias("score_e4"))


@query("ag24_quality_flags", B.sql("""
  SELECT sow_key, concat_ws('; ', CASE WHEN sow_key % 10 < 7 THEN 'Low overall confidence - manual review recommended' END,
    CASE WHEN floor(score * 1e6 + 0.5) / 1e6 < 0.8 THEN 'Low completeness score - may be missing key roles' END,
    CASE WHEN NOT executive AND fte > 200 THEN 'Large project without executive oversight' END,
    CASE WHEN n_roles > n_mapped THEN (n_roles - n_mapped) || ' roles not mapped to departments' END,
    CASE WHEN depts = 1 THEN 'All roles in single department - may need cross-functional input' END) AS flags FROM ps""", ROLES + ", " + _PLAN))
def ag24(spark, sf_dir):
    f = plan_facts(spark, sf_dir)
    flags = R.quality_flags((F.col("sow_key") % 10) / 10, F.floor(F.col("score") * 1e6 + 0.5) / 1e6, F.col("executive"), F.col("fte"),
                            F.col("n_roles") - F.col("n_mapped"), F.col("depts"))
    return f.select("sow_key", F.array_join(flags, "; ").alias("flags"))


def event_json(spark, sf_dir):
    """Event rows as nested JSON text."""
    num = lambda c: F.col(c).cast("string")
    body = F.concat(F.lit('{"id":'), num("event_id"), F.lit(',"kind":"'), "event_type", F.lit('","props":'), "props",
                    F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(',"user":'), num("user_id"))).otherwise(
                        F.concat(F.lit(',"user":"u'), num("user_id"), F.lit('"'))),
                    F.lit(',"tags":["a","'), "event_type", F.lit('"],"live":true}'))
    return B.table(spark, sf_dir, "events").select("event_type", body.alias("body"))


EV_JSON = """ej AS (SELECT event_type, '{"id":' || event_id || ',"kind":"' || event_type || '","props":' || props || CASE WHEN user_id % 2 = 0
    THEN ',"user":' || user_id ELSE ',"user":"u' || user_id || '"' END || ',"tags":["a","' || event_type || '"],"live":true}' AS body FROM events),
  ef AS (SELECT event_type, k AS field, body, json_extract(body, '$.' || k) AS v FROM (SELECT event_type, body, unnest(json_keys(body)) AS k FROM ej)),
  prof AS (SELECT field, CASE WHEN json_type(v) = 'VARCHAR' THEN 'str' WHEN json_type(v) IN ('UBIGINT', 'BIGINT') THEN 'int'
      WHEN json_type(v) = 'DOUBLE' THEN 'float' WHEN json_type(v) = 'BOOLEAN' THEN 'bool' WHEN json_type(v) = 'ARRAY' THEN 'list'
      WHEN json_type(v) = 'OBJECT' THEN 'dict' ELSE 'NoneType' END AS type, count(*) AS n,
    max(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) END) AS max_items,
    max(CASE WHEN json_type(v) = 'ARRAY' THEN 'str' END) AS item_type,
    max(CASE WHEN json_type(v) = 'OBJECT' THEN array_to_string(list_sort(json_keys(v)), ',') END) AS nested_keys FROM ef GROUP BY 1, 2)"""


@query("ag25_profile_json", f"WITH {EV_JSON} SELECT * FROM prof")
def ag25(spark, sf_dir):
    return R.profile_json(event_json(spark, sf_dir), "body")


@query("ag26_recommend_schema", f"""WITH {EV_JSON} SELECT field, CASE WHEN il THEN 'array<string>' WHEN t = 'int' THEN 'int' WHEN t = 'float'
    THEN 'double' WHEN t = 'bool' THEN 'boolean' ELSE 'string' END AS column_type, t = 'str' AS searchable,
    t IN ('str', 'int', 'float', 'bool') AS filterable, t IN ('str', 'int', 'float', 'bool') AS sortable, false AS facetable
  FROM (SELECT field, arg_max(type, {{'n': n, 't': type}}) AS t, bool_or(type = 'list') AS il FROM prof GROUP BY field)""")
def ag26(spark, sf_dir):
    return R.recommend_schema(R.profile_json(event_json(spark, sf_dir), "body"))


@query("ag27_schema_stats", f"""WITH {EV_JSON} SELECT avg(n) AS avg_fields, max(n) AS max_fields, min(n) AS min_fields FROM (
    SELECT event_type, count(DISTINCT field) AS n FROM ef GROUP BY 1)""")
def ag27(spark, sf_dir):
    fields = event_json(spark, sf_dir).select("event_type", F.explode(F.json_object_keys("body")).alias("field"))
    return R.schema_stats(fields, "event_type", "field")


@query("ag28_outcome_summary", """
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'skipped' ELSE 'success' END AS status,
    CASE WHEN event_type = 'error' THEN 'bad value ' || CAST(floor(value / 10) AS BIGINT) END AS error, count(*) AS n FROM events GROUP BY ALL""")
def ag28(spark, sf_dir):
    t = F.col("event_type")
    rows = B.table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("run"), F.when(t == "error", "failed").when(t == "click", "skipped").otherwise("success").alias("status"),
        F.when(t == "error", F.concat(F.lit("bad value "), F.floor(F.col("value") / 10).cast("string"))).alias("error"))
    return R.outcome_summary(rows, ["run"])


@query("ag29_count_docs", "SELECT count(*) AS documents FROM documents")
def ag29(spark, sf_dir):
    return R.count_docs(B.table(spark, sf_dir, "documents"))


@query("ag30_plan_rollup", B.sql(f"""
  SELECT b.sow_key, count(l.sow_key) AS role_count, CAST(coalesce(sum(l.pct), 0) AS BIGINT) AS total_percent, coalesce(sum(l.pct), 0) / 100.0 AS total_fte,
    coalesce(string_agg(DISTINCT l.department, ',' ORDER BY l.department), '') AS departments
  FROM sow_base b LEFT JOIN (SELECT sow_key, pct, {role_sql('lower(title)', 2)} AS department FROM ln) l ON l.sow_key = b.sow_key GROUP BY 1"""))
def ag30(spark, sf_dir):
    roles = F.transform("staffing", lambda s: F.struct(C.map_role(s["title"])["department"].alias("department"),
                                                       s["pct"].cast("int").alias("allocation_percent")))
    r = B.sow(spark, sf_dir).select("sow_key", R.plan_rollup(roles).alias("r"))
    return r.select("sow_key", "r.role_count", "r.total_percent", "r.total_fte", F.array_join("r.departments", ",").alias("departments"))


@query("ag31_plan_confidence", B.sql("""
  SELECT sow_key, CASE WHEN d = 0 THEN 0.5 ELSE floor(least(CAST(n_lines AS DOUBLE) / d, 1.0) * greatest(0.7, 1 - 0.05 * n_lines) * 100 + 0.5000001) / 100 END
    AS confidence FROM (SELECT sow_key, n_lines, sow_key % 9 AS d FROM sow)"""))
def ag31(spark, sf_dir):
    s = B.with_counts(spark, sf_dir, B.sow_base(spark, sf_dir))
    return s.select("sow_key", R.plan_confidence(F.col("sow_key") % 9, F.col("n_lines")).alias("confidence"))
