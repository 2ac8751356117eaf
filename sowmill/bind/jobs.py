"""Batch forms of the streaming jobs, and the user-function surface, over the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from sowmill.bind import base as B
from sowmill.bind.registry import query
from sowmill.functions import classify as C
from sowmill.functions import extract as X
from sowmill.sources.merge import upsert
from sowmill.sources.work import work_folder
from sowmill.streaming import jobs as J

STATUS = {"view": "queued", "click": "processing", "purchase": "completed", "error": "error"}


def status_events(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    status = None
    for kind, s in STATUS.items():
        status = F.when(F.col("event_type") == kind, s) if status is None else status.when(F.col("event_type") == kind, s)
    return e.select(F.col("user_id").alias("job_id"), status.otherwise(F.col("event_type")).alias("status"), "ts", "event_id")


STATUS_SQL = ("stt AS (SELECT user_id AS job_id, arg_max(s, {'t': ts, 'e': event_id}) AS status FROM (SELECT *, CASE event_type "
              + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE event_type END AS s FROM events) GROUP BY 1)")


@query("st01_upsert_batches", """
  SELECT o_custkey AS id, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS status, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS version
  FROM orders GROUP BY 1""")
def st01(spark, sf_dir):
    """Three batches that are not in the order of time, so that rows of each lose to rows of the others."""
    o = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"),
                                                F.col("o_orderkey").alias("version"), "o_orderdate")
    order = F.struct("o_orderdate", "version")
    table = o.limit(0)
    for part in (2, 0, 1):
        table = upsert(table, o.where(F.col("version") % 3 == part), "id", order)
    return table.drop("o_orderdate")


@query("st02_latest_status", f"WITH {STATUS_SQL} SELECT job_id, status FROM stt")
def st02(spark, sf_dir):
    return J.latest_status(status_events(spark, sf_dir)).select("job_id", "status")


@query("st02_job_states", """
  WITH ev AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
      ELSE event_type END AS s FROM events),
  p AS (SELECT job_id, min(CASE WHEN s = 'processing' THEN {'t': ts, 'e': event_id} END) AS at FROM ev GROUP BY 1),
  e AS (SELECT job_id, arg_min(s, {'t': ts, 'e': event_id}) AS s, min(ts) AS ts FROM ev JOIN p USING (job_id)
    WHERE s IN ('completed', 'error') AND {'t': ts, 'e': event_id} > p.at GROUP BY 1),
  j AS (SELECT job_id, p.at.t AS p, e.ts AS e, e.s, coalesce(e.ts, (SELECT max(ts) FROM events)) >= p.at.t + INTERVAL 2 DAY AS stuck FROM p LEFT JOIN e USING (job_id))
  SELECT job_id, CASE WHEN p IS NULL THEN 'queued' WHEN stuck THEN 'error' WHEN e IS NOT NULL THEN s ELSE 'processing' END AS status,
    CASE WHEN stuck THEN 'stuck' END AS reason, epoch_us(CASE WHEN stuck THEN p + INTERVAL 2 DAY ELSE coalesce(e, p) END) AS since FROM j""")
def st02_states(spark, sf_dir):
    """Moves that are allowed alone; two days of processing are too many."""
    events = status_events(spark, sf_dir)
    return J.job_states(events, 2 * 86400, events.agg(F.max("ts")).scalar()).withColumn("since", F.unix_micros(F.col("since").cast("timestamp")))


@query("st03_route", """
  SELECT o_orderkey AS job_id, 'historical' AS branch, 1.0 AS confidence FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'planned', NULL FROM orders WHERE o_orderstatus <> 'F'""")
def st03(spark, sf_dir):
    jobs = job_rows(spark, sf_dir)
    old, new = J.route(jobs)
    return (old.select("job_id", F.lit("historical").alias("branch"), "confidence")
            .unionByName(new.select("job_id", F.lit("planned").alias("branch"), F.lit(None).cast("double").alias("confidence"))))


def job_rows(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "historical").otherwise("new_staffing").alias("processing_type"))


@query("st04_list_jobs", f"""WITH {STATUS_SQL} SELECT o_orderkey AS job_id, coalesce(status, 'queued') AS status FROM orders
  LEFT JOIN stt ON job_id = o_orderkey WHERE o_orderstatus <> 'F'""")
def st04(spark, sf_dir):
    status = J.latest_status(status_events(spark, sf_dir)).select("job_id", "status")
    return J.list_jobs(job_rows(spark, sf_dir), status, "new_staffing").select("job_id", "status")


def answers(spark, sf_dir):
    """JSON answers per event: good, cut off, or with a missing field."""
    k = F.col("event_id") % 10
    text = (F.when(k == 0, F.concat(F.lit("{broken"), "props")).when(k == 1, F.lit('{"other": 1}')).otherwise(F.col("props")))
    return B.table(spark, sf_dir, "events").select("event_id", text.alias("record"))


@query("ud01_check_json", """
  SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'not valid JSON' WHEN 1 THEN 'missing: k' END AS reason,
    CASE WHEN event_id % 10 > 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def ud01(spark, sf_dir):
    good, bad = X.check_json(answers(spark, sf_dir), "record", "k bigint", ["k"])
    return (good.select("event_id", F.lit(None).cast("string").alias("reason"), "parsed.k")
            .unionByName(bad.select("event_id", "reason", F.lit(None).cast("bigint").alias("k"))))


def first_word(text: str) -> dict:
    """Sample user extractor: the first word and the number of words; short texts are refused."""
    words = text.split()
    if len(words) < 5:
        raise ValueError("text too short")
    return {"first": words[0], "words": len(words)}


def forgetful(text: str, reason: str | None) -> dict | str:
    """Sample user extractor that leaves out the word count of long texts, breaks off in the middle of others, and does better when told."""
    words = text.split()
    if len(words) < 5:
        raise ValueError("text too short")
    if len(words) % 3 == 0 and reason is None:
        return {"first": words[0]}
    if len(words) % 3 == 1 and (reason is None or reason == "not valid JSON" and len(words) % 2):
        return '{"first": "' + "broken"
    return {"first": words[0], "words": len(words)}


_WORDS = r"len(list_filter(string_split_regex(text, '[\s\x{1c}-\x{1f}\x{85}]+'), lambda x: x <> ''))"


@query("ud02_checked_extractor", f"""
  SELECT doc_id, CASE WHEN n >= 5 AND NOT (n % 3 = 1 AND n % 2 = 1) THEN n END AS words,
    CASE WHEN n < 5 THEN 'ValueError: text too short' WHEN n % 3 = 1 AND n % 2 = 1 THEN 'not valid JSON' END AS reason,
    CASE WHEN n < 5 OR (n % 3 = 1 AND n % 2 = 1) THEN 3 WHEN n % 3 = 2 THEN 1 ELSE 2 END AS attempts
  FROM (SELECT doc_id, {_WORDS} AS n FROM documents)""")
def ud02_checked(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = X.extract_checked(docs, forgetful, "doc_id", "text", "first string, words bigint", ["first", "words"], work_folder(spark, "answers"))
    words = F.when(F.col("reason").isNull(), F.get_json_object("record", "$.words").cast("long"))
    return out.select("doc_id", words.alias("words"), "reason", "attempts")


@query("ud02_user_extractor", f"SELECT doc_id, CASE WHEN n >= 5 THEN n END AS words, CASE WHEN n < 5 THEN 'ValueError: text too short' END AS error "
       f"FROM (SELECT doc_id, {_WORDS} AS n FROM documents)")
def ud02(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = X.run_extractor(docs, first_word, "doc_id", "text")
    return out.select("doc_id", F.get_json_object("record", "$.words").cast("long").alias("words"), "error")


@query("ud03_error_rows", r"""
  SELECT CASE WHEN n < 5 THEN 'ValueError: text too short' END AS error, count(*) AS documents FROM (
    SELECT len(list_filter(string_split_regex(text, '[\s\x{1c}-\x{1f}\x{85}]+'), lambda x: x <> '')) AS n FROM documents) GROUP BY 1""")
def ud03(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.run_extractor(docs, first_word, "doc_id", "text").groupBy("error").agg(F.count(F.lit(1)).alias("documents"))


@query("ud04_known_misspellings", """
  SELECT DISTINCT lower(p_name) AS name, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) || 's' WHEN 1 THEN 'x' || lower(p_name)
      WHEN 2 THEN left(lower(p_name), length(p_name) - 1) ELSE lower(p_name) || ' (misspelt)' END AS spelt,
    round(2.0 * CASE p_partkey % 4 WHEN 2 THEN length(p_name) - 1 ELSE length(p_name) END
      / (2 * length(p_name) + CASE p_partkey % 4 WHEN 2 THEN -1 ELSE 1 END), 6) AS ratio
  FROM part WHERE p_partkey % 4 <> 3 AND 2.0 * CASE p_partkey % 4 WHEN 2 THEN length(p_name) - 1 ELSE length(p_name) END
      / (2 * length(p_name) + CASE p_partkey % 4 WHEN 2 THEN -1 ELSE 1 END) > 0.95""")
def ud04_known(spark, sf_dir):
    """Names against themselves with a letter more, a letter less, or much more, which is not alike enough."""
    name, k = F.lower("p_name"), F.col("p_partkey") % 4
    spelt = (F.when(k == 0, F.concat(name, F.lit("s"))).when(k == 1, F.concat(F.lit("x"), name))
             .when(k == 2, F.left(name, F.length(name) - 1)).otherwise(F.concat(name, F.lit(" (misspelt)"))))
    pairs = B.table(spark, sf_dir, "part").select(name.alias("name"), spelt.alias("spelt"))
    return C.similar_pairs(pairs, "name", "spelt", 0.95).withColumn("ratio", F.round("ratio", 6))


@query("ud04_similarity_ratio")
def ud04(spark, sf_dir):
    part = B.table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), F.lower("p_type").alias("type")).distinct()
    return part.select("name", "type", F.round(C.similarity_ratio("name", "type"), 6).alias("ratio"))


