"""Ranking, paging and numbering over SOW rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowmill.bind import base as B
from sowmill.bind.registry import query
from sowmill.functions import scalars as S
from sowmill.operators import ranking as N
from sowmill.sources.files import latest_run


@query("wn01_rank_score", """
  SELECT o_custkey, o_orderkey, rank, CAST(1 - 0.1 * (rank - 1) AS DOUBLE) AS rank_score FROM (
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
  WHERE rank <= 50""")
def wn01(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return N.rank_score(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).drop("o_totalprice")


@query("wn02_page", """
  SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total_count FROM orders WHERE o_orderstatus = 'F'
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def wn02(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return N.page(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 40).select("o_orderkey", "total_count")


@query("wn03_order_by", B.sql("SELECT sow_key, client_name FROM sow_base ORDER BY client_name DESC, sow_key"))
def wn03(spark, sf_dir):
    return N.order_by(B.sow_base(spark, sf_dir).select("sow_key", "client_name"), "client_name", "sow_key", descending=True)


@query("wn04_merge_strategies", """
  SELECT doc_id, CAST(min(p) AS INTEGER) AS priority, arg_min(s, p) AS search_strategy, CAST(arg_min(w, p) AS DOUBLE) AS strategy_score FROM (
    SELECT doc_id, 0 AS p, 'exact_match' AS s, 1.0 AS w FROM documents WHERE n_chars > 3000
    UNION ALL SELECT doc_id, 1, 'fuzzy_match', 0.8 FROM documents WHERE n_chars > 1500
    UNION ALL SELECT doc_id, 2, 'synonym_match', 0.7 FROM documents WHERE lang = 'fr') GROUP BY doc_id
  ORDER BY strategy_score DESC, priority, doc_id LIMIT 200""")
def wn04(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return N.merge_strategies([("exact_match", 1.0, d.where("n_chars > 3000")), ("fuzzy_match", 0.8, d.where("n_chars > 1500")),
                               ("synonym_match", 0.7, d.where("lang = 'fr'"))], "doc_id", 200)


@query("wn05_dedup_best", """
  SELECT source, max(n_chars) AS n_chars, arg_min(doc_id, {'s': -n_chars, 'k': doc_id}) AS doc_id FROM documents GROUP BY source""")
def wn05(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return N.dedup_best(d, "source", "doc_id", "n_chars")


@query("wn06_sorted_overview", B.sql("SELECT client_name, project_title, file_name FROM sow_base ORDER BY client_name, project_title, file_name"))
def wn06(spark, sf_dir):
    return (B.sow_base(spark, sf_dir).select("client_name", "project_title", "file_name")
            .orderBy("client_name", "project_title", "file_name"))


@query("wn07_numbered_items", B.sql("""
  SELECT b.sow_key, coalesce(l.deliverable, 'No deliverables listed') AS item, l.seq AS item_number
  FROM sow_base b LEFT JOIN ln l ON l.sow_key = b.sow_key"""))
def wn07(spark, sf_dir):
    return N.numbered_items(B.sow(spark, sf_dir), ["sow_key"], "deliverables", "No deliverables listed")


@query("wn08_top_terms", """
  SELECT kind, term, n, rank FROM (SELECT kind, term, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS rank FROM (
    SELECT p_type AS kind, p_name AS term, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2)) WHERE rank <= 10""")
def wn08(spark, sf_dir):
    counts = (B.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_name").alias("term"))
              .agg(F.count(F.lit(1)).alias("n")))
    return N.top_terms(counts, 10, 2)


@query("wn09_preview", B.sql("""
  SELECT sow_key, array_to_string(deliverables[1:3], '; ') AS preview, greatest(n_lines - 3, 0) AS more FROM sow"""))
def wn09(spark, sf_dir):
    return B.sow(spark, sf_dir).select("sow_key", F.array_join(S.preview(F.col("deliverables"), 3), "; ").alias("preview"),
                                       F.greatest(F.size("deliverables") - 3, F.lit(0)).alias("more"))


@query("wn10_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def wn10(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return N.top_n(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)


@query("wn11_latest_run", """
  SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def wn11(spark, sf_dir):
    runs = B.table(spark, sf_dir, "events").withColumn(
        "source_file", F.concat(F.lit("comparison_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv")))
    return latest_run(runs).select("event_id", "event_type")


@query("wn12_staffing_detail", B.sql("""
  SELECT b.sow_key, b.client_name, CASE WHEN l.sow_key IS NULL THEN 'No staffing data available' ELSE l.name END AS person_name,
    coalesce(l.title, '') AS role, coalesce(CAST(l.hours AS BIGINT) || ' hrs (' || CAST(l.pct AS BIGINT) || '%)', '') AS allocation,
    coalesce(CAST(CAST(l.hours AS BIGINT) AS VARCHAR), '') AS hours, coalesce(CAST(l.pct AS BIGINT) || '%', '') AS percentage
  FROM sow_base b LEFT JOIN ln l ON l.sow_key = b.sow_key"""))
def wn12(spark, sf_dir):
    whole = lambda c: F.col(c).cast("long").cast("string")
    rows = B.lines(spark, sf_dir).select("sow_key", "name", F.col("title").alias("role"),
                                         F.concat(whole("hours"), F.lit(" hrs ("), whole("pct"), F.lit("%)")).alias("allocation"))
    return N.staffing_detail(B.sow_base(spark, sf_dir).select("sow_key", "client_name"), rows, "sow_key")
