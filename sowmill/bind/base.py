"""SOW-shaped rows and texts derived from the given tables, for Spark and as SQL.

``lines`` is one row per staffing line (no grouping), ``sow_base`` one row per
SOW without lists, ``sow`` one row per SOW with its lists. A list belongs to one
document, so its size is a property of that document; every operator that does
not need the list as a value works on ``lines`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THEMES = [
    "Sponsorship activation program: global partnership",
    "Event hospitality guest venue: national",
    "Creative campaign brand design",
    "Measurement analytics reporting dashboard",
    "Research analysis",
]
TITLES = ["Account Director", "Strategy Director", "Creative Director", "Event Manager",
          "Account Manager", "SAE", "VP", "Analyst"]
EXCLUSION = "Travel costs are not included"
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str, supplier: bool = True) -> DataFrame:
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    out = item.join(part, item.l_partkey == part.p_partkey)
    if supplier:
        sup = table(spark, sf_dir, "supplier")
        out = out.join(sup, out.l_suppkey == sup.s_suppkey).withColumn("name", F.col("s_name"))
    return (out.withColumn("sow_key", F.col("l_orderkey"))
            .withColumn("title", pick(TITLES, F.col("p_size") % 8))
            .withColumn("level", (F.col("p_size") % 10).cast("int"))
            .withColumn("pct", F.col("l_quantity") * 2)
            .withColumn("hours", F.col("l_quantity") * 36)
            .withColumn("deliverable", F.col("p_name"))
            .select("sow_key", *LINE_ORDER, *(["name"] if supplier else []), "title", "level", "pct", "hours",
                    "deliverable", "l_shipdate"))


def sow_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    theme = pick(THEMES, key % 5)
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .select(
                key.alias("sow_key"),
                F.concat(F.lit("company_"), F.col("o_custkey").cast("string"), F.lit("_sow_"), key.cast("string"),
                         F.when(key % 2 == 0, F.lit(".pdf")).otherwise(F.lit(".docx"))).alias("file_name"),
                F.col("c_name").alias("client_name"),
                F.to_date("o_orderdate").alias("start_date"),
                theme.alias("theme"),
                F.concat_ws(" ", theme, F.col("c_mktsegment"), key.cast("string")).alias("project_title"),
                F.expr(f"repeat(concat_ws(' ', {_theme_sql()}, o_orderpriority, cast(o_orderkey as string), ''), "
                       "cast(o_orderkey % 6 + 1 as int))").alias("scope_summary"),
                F.when(key % 2 == 0, F.array().cast("array<string>"))
                .otherwise(F.array(F.lit(EXCLUSION))).alias("exclusions"),
                F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_custkey"),
                F.col("c_mktsegment").alias("segment"),
            ))


def _theme_sql() -> str:
    listed = ", ".join(f"'{t}'" for t in THEMES)
    return f"element_at(array({listed}), cast(o_orderkey % 5 + 1 as int))"


def with_end_date(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    last = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sow_key"))
            .agg(F.to_date(F.max("l_shipdate")).alias("end_date")))
    return base.join(last, "sow_key", "left")


def with_counts(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    """Staffing and deliverable counts per SOW; partial sums shrink the data before the shuffle."""
    n = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sow_key"))
         .agg(F.count(F.lit(1)).alias("n_lines")))
    return base.join(n, "sow_key", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sow_key with the ordered staffing list of the SOW and its last ship date."""
    entry = F.struct(*LINE_ORDER, "name", "title", "level", "pct", "hours", "deliverable")
    return (lines(spark, sf_dir).groupBy("sow_key")
            .agg(F.sort_array(F.collect_list(entry)).alias("plan"),
                 F.to_date(F.max("l_shipdate")).alias("end_date")))


def sow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per SOW with its lists."""
    empty = F.array().cast("array<struct<name:string,title:string,level:int,pct:double,hours:double>>")
    keep = lambda x: F.struct(x["name"].alias("name"), x["title"].alias("title"),
                              x["level"].alias("level"), x["pct"].alias("pct"), x["hours"].alias("hours"))
    return (sow_base(spark, sf_dir).join(plans(spark, sf_dir), "sow_key", "left")
            .withColumn("staffing", F.coalesce(F.transform("plan", keep), empty))
            .withColumn("deliverables", F.coalesce(F.transform("plan", lambda x: x["deliverable"]),
                                                   F.array().cast("array<string>")))
            .drop("plan"))


def with_text(rows: DataFrame) -> DataFrame:
    """Adds the text of each SOW."""
    key = F.col("sow_key")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Project Title: "), F.col("project_title")),
        F.concat(F.lit("Client: "), F.col("client_name")),
        F.concat(F.lit("Duration: "), (key % 60 + 4).cast("string"),
                 F.when(key % 3 == 0, F.lit(" months")).otherwise(F.lit(" weeks"))),
        F.concat(F.lit("Start Date: "), F.col("start_date").cast("string")),
        F.concat(F.lit("Scope of Work: "), F.col("theme"), F.lit(" "), F.col("o_orderpriority")),
        F.lit("Deliverables:"),
        F.transform("deliverables", lambda d: F.concat(F.lit("- "), d)),
        F.when(key % 2 == 0, F.lit("Events:")).otherwise(F.lit("Activations:")),
        F.lit("Project Staffing Plan"),
        F.transform("staffing", lambda s: F.concat(s["title"], F.lit(" - "), s["hours"].cast("long").cast("string"),
                                                   F.lit(" hours"))),
        F.concat(F.lit("Budget: $"), F.round("o_totalprice").cast("long").cast("string")),
    )
    return rows.withColumn("text", body)


def sow_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per SOW."""
    return with_text(sow(spark, sf_dir)).select("sow_key", "file_name", "client_name", "project_title", "text")


# --- the same in SQL -------------------------------------------------------------------------

_theme = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(THEMES)) + " END"
_title = "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END"

CTES = f"""
ln AS (
  SELECT l_orderkey AS sow_key, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
    s_name AS name, {_title} AS title, CAST(p_size % 10 AS INTEGER) AS level,
    l_quantity * 2 AS pct, l_quantity * 36 AS hours, p_name AS deliverable, l_shipdate
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
ln_list AS (
  SELECT sow_key, count(*) AS n_lines, CAST(max(l_shipdate) AS DATE) AS end_date,
    list(deliverable ORDER BY seq) AS deliverables,
    list({{'name': name, 'title': title, 'level': level, 'pct': pct, 'hours': hours}} ORDER BY seq) AS staffing
  FROM ln GROUP BY sow_key),
sow_base AS (
  SELECT o_orderkey AS sow_key,
    'company_' || o_custkey || '_sow_' || o_orderkey ||
      CASE WHEN o_orderkey % 2 = 0 THEN '.pdf' ELSE '.docx' END AS file_name,
    c_name AS client_name, CAST(o_orderdate AS DATE) AS start_date, {_theme} AS theme,
    {_theme} || ' ' || c_mktsegment || ' ' || o_orderkey AS project_title,
    repeat({_theme} || ' ' || o_orderpriority || ' ' || o_orderkey || ' ', CAST(o_orderkey % 6 + 1 AS INTEGER))
      AS scope_summary,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['{EXCLUSION}'] END AS exclusions,
    o_orderpriority, o_totalprice, o_orderstatus, o_custkey, c_mktsegment AS segment
  FROM orders JOIN customer ON c_custkey = o_custkey),
sow AS (
  SELECT b.*, l.end_date, coalesce(l.n_lines, 0) AS n_lines,
    coalesce(l.deliverables, CAST([] AS VARCHAR[])) AS deliverables,
    coalesce(l.staffing, []) AS staffing
  FROM sow_base b LEFT JOIN ln_list l ON l.sow_key = b.sow_key),
sow_text AS (
  SELECT sow_key, file_name, client_name, project_title, array_to_string(list_concat(
    ['Project Title: ' || project_title, 'Client: ' || client_name,
     'Duration: ' || (sow_key % 60 + 4) || CASE WHEN sow_key % 3 = 0 THEN ' months' ELSE ' weeks' END,
     'Start Date: ' || strftime(start_date, '%Y-%m-%d'),
     'Scope of Work: ' || theme || ' ' || o_orderpriority, 'Deliverables:'],
    list_transform(deliverables, lambda d: '- ' || d),
    [CASE WHEN sow_key % 2 = 0 THEN 'Events:' ELSE 'Activations:' END, 'Project Staffing Plan'],
    list_transform(staffing, lambda s: s.title || ' - ' || CAST(s.hours AS BIGINT) || ' hours'),
    ['Budget: $' || CAST(round(o_totalprice) AS BIGINT)]), chr(10)) AS text
  FROM sow)
"""


def sql(body: str, extra: str = "") -> str:
    """A query over the derived tables; ``extra`` adds more named subqueries."""
    return f"WITH {CTES}{', ' + extra if extra else ''} {body}"
