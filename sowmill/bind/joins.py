"""Joins and set operations over SOW rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.bind import base as B
from sowmill.bind.classes import q
from sowmill.bind.registry import query
from sowmill.bind.texts import _CLIENT, _LENGTH, _LINES, _PTITLE, _SCOPE, date_sql, items
from sowmill.functions import scalars as S
from sowmill.functions import text as X
from sowmill.operators import relate as R


@query("jn01_pair_parsed_and_text", """
  SELECT d.doc_id AS base, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def jn01(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("base"))
    labels = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("base"), "quality")
    both, alone = R.pair_by_base(docs, labels)
    return (both.withColumn("missing", F.lit(False))
            .unionByName(alone.withColumn("quality", F.lit(None).cast("int")).withColumn("missing", F.lit(True))))


@query("jn02_attach_staffing", B.sql("""
  SELECT b.sow_key, coalesce(CASE WHEN l.sow_key % 2 = 0 THEN 'structured ' || l.n_lines END, 'display only') AS staffing
  FROM sow_base b LEFT JOIN ln_list l ON l.sow_key = b.sow_key"""))
def jn02(spark, sf_dir):
    hits = B.sow_base(spark, sf_dir).select("sow_key", F.lit("display only").alias("staffing_plan"))
    rows = (B.table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("sow_key"))
            .agg(F.concat(F.lit("structured "), F.count(F.lit(1)).cast("string")).alias("staffing_structured")))
    return R.attach_staffing(hits, rows, "sow_key").select("sow_key", "staffing")


@query("jn03_title_lookup", B.sql("""
  SELECT ln.sow_key, l_linenumber, ln.title, c.level AS chart_level FROM ln LEFT JOIN chart c ON c.key = lower(ln.title)""",
                                  "chart AS (SELECT lower(t) AS key, level FROM (VALUES ('Account Director', 5), ('Account Manager', 3), "
                                  "('VP', 7)) v(t, level))"))
def jn03(spark, sf_dir):
    chart = spark.createDataFrame([("account director", 5), ("account manager", 3), ("vp", 7)], "key string, chart_level int")
    rows = B.lines(spark, sf_dir, supplier=False).select("sow_key", "l_linenumber", "title")
    return rows.join(chart, F.lower("title") == F.col("key"), "left").drop("key")


@query("jn04_first_correction", B.sql("""
  SELECT file_name, arg_min(key, ord) AS key, arg_min(value, ord) AS value FROM sow_base JOIN fix ON contains(lower(file_name), lower(key))
  GROUP BY file_name""", """fix AS (SELECT c_custkey AS ord, 'company_' || c_custkey || '_' AS key, c_mktsegment AS value FROM customer
    UNION ALL SELECT -1, '_SOW_77', 'special')"""))
def jn04(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("company_"), F.col("c_custkey").cast("string"), F.lit("_")).alias("key"),
        F.col("c_mktsegment").alias("value"))
    fix = c.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("ord"), F.lit("_SOW_77").alias("key"),
                                              F.lit("special").alias("value")))
    return R.first_correction(B.sow_base(spark, sf_dir), fix)


# the item set holds plain names, their last words and longer names, so that containment is not just equality
_ITEMS = """it AS (SELECT sow_key, file_name, CASE (sow_key + l_linenumber) % 3 WHEN 0 THEN upper(split_part(deliverable, ' ', 2))
    WHEN 1 THEN deliverable ELSE deliverable || ' kit' END AS item FROM ln JOIN sow_base USING (sow_key))"""


def item_rows(spark, sf_dir):
    k = (F.col("sow_key") + F.col("l_linenumber")) % 3
    item = (F.when(k == 0, F.upper(F.get(F.split("deliverable", " "), F.lit(1)))).when(k == 1, F.col("deliverable"))
            .otherwise(F.concat("deliverable", F.lit(" kit"))))
    return (B.lines(spark, sf_dir, supplier=False).select("sow_key", item.alias("item"))
            .join(B.sow_base(spark, sf_dir).select("sow_key", "file_name"), "sow_key"))


@query("jn05_item_mentions", B.sql("""
  SELECT i.item, count(*) AS sows, array_to_string((list(f.file_name ORDER BY f.sow_key))[1:3], ', ') ||
    CASE WHEN count(*) > 3 THEN '...' ELSE '' END AS sow_list
  FROM (SELECT DISTINCT item FROM it) i JOIN LATERAL (SELECT DISTINCT sow_key, file_name FROM it
    WHERE contains(lower(it.item), lower(i.item))) f ON true GROUP BY i.item""", _ITEMS))
def jn05(spark, sf_dir):
    rows = item_rows(spark, sf_dir).withColumnRenamed("sow_key", "ord")
    return R.mentions_report(rows)


@query("jn06_contained_either_way", B.sql("""
  SELECT DISTINCT a.item AS "left", b.title AS "right" FROM (SELECT DISTINCT item FROM it) a, (SELECT DISTINCT p_name AS title FROM part) b
  WHERE contains(lower(a.item), lower(b.title)) OR contains(lower(b.title), lower(a.item))""", _ITEMS))
def jn06(spark, sf_dir):
    return R.contained_either_way(item_rows(spark, sf_dir).select("item"), B.table(spark, sf_dir, "part").select("p_name"))


@query("jn08_not_covered", B.sql("""
  SELECT e.sow_key, e.title FROM ln e WHERE NOT EXISTS (SELECT 1 FROM ln r WHERE r.sow_key = e.sow_key AND r.level >= 5
    AND lower(r.title) = lower(e.title))"""))
def jn08(spark, sf_dir):
    rows = B.lines(spark, sf_dir, supplier=False).select("sow_key", "title", "level")
    return R.not_covered(rows, rows.where("level >= 5"), "sow_key", "title").select("sow_key", "title")


def records(spark, sf_dir):
    """Two extractions of each SOW in one row: the stored record, under ``stored_`` names, and the reading of its text."""
    s = B.with_text(B.sow(spark, sf_dir))
    stored = s.select(
        "sow_key", "client_name", "project_title", F.col("start_date").cast("string").alias("start_date"),
        F.col("end_date").cast("string").alias("end_date"),
        S.project_length(F.col("start_date"), F.col("end_date")).alias("project_length"),
        F.col("scope_summary"), "deliverables", "exclusions",
        F.transform("staffing", lambda x: x["title"]).alias("staffing_plan"), "text")
    return X.taxonomy_extract(stored.withColumnsRenamed({f: f"stored_{f}" for f in K.COMPARED_FIELDS}), "text", ["sow_key", *[f"stored_{f}" for f in K.COMPARED_FIELDS]])


_STORED = """stored AS (SELECT sow_key, client_name, project_title, CAST(start_date AS VARCHAR) AS start_date,
    CAST(end_date AS VARCHAR) AS end_date, CASE WHEN d >= 365 THEN CAST(round(d / 30.44) AS BIGINT) || ' months'
    WHEN d >= 30 THEN CAST(round(d / 7.0) AS BIGINT) || ' weeks' WHEN d IS NOT NULL THEN d || ' days' END AS project_length,
    scope_summary, CAST(n_lines AS VARCHAR) AS deliverables, CAST(len(exclusions) AS VARCHAR) AS exclusions,
    CAST(n_lines AS VARCHAR) AS staffing_plan FROM (SELECT *, date_diff('day', start_date, end_date) AS d FROM sow))"""
_READ = f""", rd AS (SELECT sow_key, {_CLIENT} AS client_name, {_PTITLE} AS project_title, {date_sql('start_date')} AS start_date,
    {date_sql('end_date')} AS end_date, {_LENGTH} AS project_length, {_SCOPE} AS scope_summary,
    CAST(len({items('deliverables')}) AS VARCHAR) AS deliverables, CAST(len({items('exclusions')}) AS VARCHAR) AS exclusions,
    CAST(len({_LINES}) AS VARCHAR) AS staffing_plan FROM sow_text)"""
_CMP = _STORED + _READ + ", cmp AS (" + " UNION ALL ".join(
    f"SELECT sow_key, '{f}' AS field, a.{f} AS llm_value, b.{f} AS taxonomy_value FROM stored a JOIN rd b USING (sow_key)"
    for f in K.COMPARED_FIELDS) + """), st AS (SELECT *, CASE WHEN llm_value IS NOT DISTINCT FROM taxonomy_value THEN 'Match'
    WHEN ha AND NOT hb THEN 'LLM Only' WHEN hb AND NOT ha THEN 'Taxonomy Only' WHEN NOT ha AND NOT hb THEN 'Match' ELSE 'Different' END AS status
    FROM (SELECT *, llm_value IS NOT NULL AND llm_value NOT IN ('', '0') AS ha,
      taxonomy_value IS NOT NULL AND taxonomy_value NOT IN ('', '0') AS hb FROM cmp))"""
CMP_SQL = _CMP


def comparison(spark, sf_dir):
    return R.compare_columns(records(spark, sf_dir), "sow_key", {f: f"stored_{f}" for f in K.COMPARED_FIELDS}, {f: f for f in K.COMPARED_FIELDS})


@query("jn09_compare_extractions", B.sql("SELECT sow_key, field, llm_value, taxonomy_value, status FROM st", _CMP))
def jn09(spark, sf_dir):
    return comparison(spark, sf_dir)


@query("jn10_field_precedence", """
  SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'model' END, nullif(CASE WHEN d2.n_chars > 500 THEN source ELSE '' END, '')) AS origin
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN documents d2 ON d2.doc_id = d.doc_id""".replace("source ELSE", "d2.source ELSE"))
def jn10(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    model = (B.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("model").alias("origin")))
    meta = docs.select("doc_id", F.when(F.col("n_chars") > 500, F.col("source")).otherwise("").alias("origin"))
    return R.by_precedence(docs.select("doc_id"), [model, meta], "doc_id", "origin")


@query("jn12_other_clients", B.sql("SELECT sow_key, client_name FROM sow_base WHERE client_name <> 'Customer#000000002'"))
def jn12(spark, sf_dir):
    return R.other_clients(B.sow_base(spark, sf_dir), "Customer#000000002").select("sow_key", "client_name")


# --- sets ----------------------------------------------------------------------------------------


@query("so01_union_results", """
  SELECT 'title' AS strategy, doc_id FROM documents WHERE n_chars > 2000 UNION ALL SELECT 'label', doc_id FROM labels WHERE quality = 1""")
def so01(spark, sf_dir):
    a = B.table(spark, sf_dir, "documents").where("n_chars > 2000").select(F.lit("title").alias("strategy"), "doc_id")
    b = B.table(spark, sf_dir, "labels").where("quality = 1").select(F.lit("label").alias("strategy"), "doc_id")
    return R.union_results(a, b)


@query("so02_union_role_sets", B.sql("""
  SELECT sow_key, title, 'department' AS origin FROM ln UNION ALL SELECT sow_key, 'Vice President', 'special rule' FROM sow_base"""))
def so02(spark, sf_dir):
    a = B.lines(spark, sf_dir, supplier=False).select("sow_key", "title", F.lit("department").alias("origin"))
    b = B.sow_base(spark, sf_dir).select("sow_key", F.lit("Vice President").alias("title"), F.lit("special rule").alias("origin"))
    return R.union_results(a, b)


@query("so03_ordered_distinct", """
  SELECT doc_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS terms FROM (
    SELECT doc_id, string_split(lower(text[1:400]), ' ') AS t FROM documents)""".replace("text[1:400]", "text"))
def so03(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(R.distinct_terms(F.split(F.lower("text"), " ")), " ").alias("terms"))


@query("so04_unordered_distinct", B.sql("""
  SELECT sow_key, array_to_string(list_sort(list_distinct(list_transform(staffing, lambda s: s.title))), '; ') AS titles FROM sow"""))
def so04(spark, sf_dir):
    titles = F.transform("staffing", lambda s: s["title"])
    return B.sow(spark, sf_dir).select("sow_key", F.array_join(F.array_sort(F.array_distinct(titles)), "; ").alias("titles"))


@query("so05_in_both", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def so05(spark, sf_dir):
    return R.in_both(B.table(spark, sf_dir, "documents").select("doc_id"), B.table(spark, sf_dir, "labels").select("doc_id"))


@query("so06_only_first", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def so06(spark, sf_dir):
    return R.only_first(B.table(spark, sf_dir, "documents").select("doc_id"), B.table(spark, sf_dir, "labels").select("doc_id"))
