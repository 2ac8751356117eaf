"""Searches over documents, SOW rows and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.bind import base as B
from sowmill.bind.classes import any_sql, group_sql, q
from sowmill.bind.registry import query
from sowmill.functions import vectors as V
from sowmill.operators import postings as P
from sowmill.operators import relate as R
from sowmill.operators import search as E
from sowmill.sources.work import work_folder

QUERY = "ther than"
SYN = {"ther": ["thor", "thin"], "than": ["thnd", "ble sh"]}
BREAK = E.WORD_BREAK


def toks(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), {q(BREAK)}), lambda x: x <> '')"


def docs(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")


DOC = f"dt AS (SELECT doc_id, lang, n_chars, {toks('text')} AS t FROM documents)"


def bm25(src: str, key: str, weights: dict[str, float], terms: list[str], where: str = "true") -> str:
    """CTEs sc(key, score) with the BM25 of token-list columns."""
    w = lambda t: " + ".join(f"len(list_filter({c}, lambda x: x = {q(t)})) * {float(v)}" for c, v in weights.items())
    length = " + ".join(f"len({c})" for c in weights)
    cols = ", ".join(f"{w(t)} AS w{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (w{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN w{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * w{i} * {E.K1 + 1} / "
                       f"(w{i} + {E.K1} * (1 - {E.B_LEN} + {E.B_LEN} * len / avg_len)) ELSE 0 END" for i in range(len(terms)))
    return (f"cn AS (SELECT *, {cols}, {length} AS len FROM {src} WHERE {where}), "
            f"ss AS (SELECT count(*) AS n, avg(len) AS avg_len, {stats} FROM cn), "
            f"sc AS (SELECT cn.*, floor(({score}) * 1e4 + 0.5) AS s4, round({score}, 6) AS score FROM cn, ss)")


def has(t: str, col: str = "t") -> str:
    return f"list_contains({col}, {q(t)})"


def all_of(terms, fn, word=" AND ") -> str:
    return "(" + word.join(fn(t) for t in terms) + ")"


def edits(t: str) -> str:
    """Edit distance by character: the SQL engine counts bytes, so other letters become one byte first."""
    return f"levenshtein(regexp_replace(x, '[^\\x00-\\x7F]', '#', 'g'), {q(t)})"


def fuzzy(t: str) -> str:
    return f"len(list_filter(t, lambda x: starts_with(x, {q(t)}) OR {edits(t)} <= 1)) > 0"


def phonetic(t: str) -> str:
    return f"len(list_filter(t, lambda x: {edits(t)} <= 2)) > 0"


def synonym(t: str) -> str:
    return "(" + " OR ".join([has(t)] + [all_of(s.split(), has) for s in SYN.get(t, [])]) + ")"


TERMS = QUERY.split()


def rounded(df):
    """Scores as whole ten-thousandths, so that both engines agree on the last digit."""
    return df.withColumn("score", F.floor(F.col("score") * 1e4 + 0.5).cast("long"))


S4 = "CAST(floor(score * 1e4 + 0.5) AS BIGINT) AS score"


@query("se01_keyword_search", f"WITH {DOC}, {bm25('dt', 'doc_id', {'t': 1}, TERMS)} SELECT doc_id, {S4} FROM sc WHERE "
       f"{all_of(TERMS, has)} ORDER BY score DESC, doc_id LIMIT 50")
def se01(spark, sf_dir):
    return rounded(E.keyword_search(docs(spark, sf_dir), QUERY, ["text"], "doc_id").select("doc_id", "score"))


@query("se02_search_by_field", B.sql(
    f"SELECT sow_key, {S4} FROM sc WHERE {all_of(['sponsorship', 'machinery'], has)} ORDER BY score DESC, sow_key LIMIT 50",
    f"st AS (SELECT sow_key, {toks('project_title')} AS t FROM sow_base), " + bm25("st", "sow_key", {"t": 1}, ["sponsorship", "machinery"])))
def se02(spark, sf_dir):
    s = B.sow_base(spark, sf_dir).select("sow_key", "project_title")
    return rounded(E.search_by_field(s, "project_title", "Sponsorship MACHINERY", "sow_key").select("sow_key", "score"))


@query("se03_date_range", B.sql("""SELECT sow_key, CAST(start_date AS VARCHAR) AS start_date FROM sow
  WHERE start_date >= DATE '1996-06-01' AND end_date <= DATE '1999-12-31'"""))
def se03(spark, sf_dir):
    s = B.with_end_date(spark, sf_dir, B.sow_base(spark, sf_dir))
    return (E.search_by_date_range(s, "1996-06-01", "1999-12-31")
            .select("sow_key", F.col("start_date").cast("string").alias("start_date")))


_MAP = "MAP {" + ", ".join(f"{q(k)}: [{', '.join(q(x) for x in v)}]" for k, v in K.SYNONYMS_LONG.items()) + "}"


@query("se04_expand_synonyms", B.sql(f"""
  SELECT sow_key, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS expanded FROM (
    SELECT sow_key, flatten(list_transform(string_split(lower(theme), ' '), lambda t: list_concat([t], coalesce({_MAP}[t], [])))) AS l
    FROM sow_base)"""))
def se04(spark, sf_dir):
    return B.sow_base(spark, sf_dir).select("sow_key", E.expand_synonyms(F.col("theme"), K.SYNONYMS_LONG).alias("expanded"))


_SHORT = "MAP {" + ", ".join(f"{q(k)}: [{', '.join(q(x) for x in v)}]" for k, v in K.SYNONYMS_SHORT.items()) + "}"
_WORDED = "lower(split_part(theme, ' ', 1)) || ' golf ' || lower(segment)"


@query("se04_short_synonyms", B.sql(f"""
  SELECT sow_key, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS expanded FROM (
    SELECT sow_key, flatten(list_transform(string_split({_WORDED}, ' '), lambda t: list_concat([t], coalesce({_SHORT}[t], [])))) AS l FROM sow_base)"""))
def se04_short(spark, sf_dir):
    query_of = F.concat(F.lower(F.split("theme", " ")[0]), F.lit(" golf "), F.lower("segment"))
    return B.sow_base(spark, sf_dir).select("sow_key", E.expand_synonyms(query_of, K.SYNONYMS_SHORT).alias("expanded"))


@query("se05_fuzzy_match", f"WITH {DOC} SELECT doc_id, {all_of(TERMS, fuzzy)} AS every FROM dt WHERE {all_of(TERMS, fuzzy, ' OR ')}")
def se05(spark, sf_dir):
    found = E.near_search(docs(spark, sf_dir), QUERY, ["text"], mode="any", every="every")
    return found.select("doc_id", "every")


@query("se06_phonetic_edit_distance", f"WITH {DOC} SELECT doc_id FROM dt WHERE {all_of(TERMS, phonetic)}")
def se06(spark, sf_dir):
    hit = lambda x, t: E.phonetic_hit(x, t, sound=False)
    return E.near_search(docs(spark, sf_dir), QUERY, ["text"], hit=hit).select("doc_id")


def sound_sql(x: str) -> str:
    """Sound code of a word: its first letter and the next three digits, letters of one digit in a row counting once and h and w not at all."""
    digits = f"translate(upper({x}), 'ABCDEFGIJKLMNOPQRSTUVXYZ', '012301202245501262301202')"
    rest = f"regexp_replace(regexp_replace(substr({digits}, 2), '[HW]', '', 'g'), '[^0-6]', '0', 'g')"
    runs = f"(CASE WHEN left({digits}, 1) IN ('H', 'W') THEN '0' ELSE left({digits}, 1) END) || {rest}"
    for d in "123456":
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN regexp_matches({x}, '^[A-Za-z]') THEN upper(left({x}, 1)) || rpad(left(replace(substr({runs}, 2), '0', ''), 3), 3, '0') ELSE {x} END"


def phonetic_sound(t: str) -> str:
    return f"len(list_filter(t, lambda x: {edits(t)} <= 2 OR {sound_sql('x')} = {sound_sql(q(t))})) > 0"


@query("se06_phonetic_sound", f"WITH {DOC} SELECT doc_id FROM dt WHERE {all_of(TERMS, phonetic_sound)}")
def se06_sound(spark, sf_dir):
    return E.near_search(docs(spark, sf_dir), QUERY, ["text"], hit=E.phonetic_hit).select("doc_id")


@query("se06_sound_codes", f"WITH w AS (SELECT DISTINCT unnest({toks('text')}) AS word FROM documents) SELECT word, {sound_sql('word')} AS code FROM w WHERE regexp_matches(word, '^[a-z]+$')")
def se06_codes(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(E.tokens(F.col("text"))).alias("word")).distinct()
    return words.where(F.col("word").rlike("^[a-z]+$")).select("word", F.soundex("word").alias("code"))


@query("se07_term_search", f"""WITH {DOC}, {bm25('dt', 'doc_id', {'t': 1}, TERMS)}
  SELECT term, doc_id, rank FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY score DESC, doc_id) AS rank FROM (
    {' UNION ALL '.join(f"SELECT {q(t)} AS term, doc_id, score FROM sc WHERE {has(t)}" for t in TERMS)}))""")
def se07(spark, sf_dir):
    return E.term_search(docs(spark, sf_dir), QUERY, ["text"], "doc_id").select("term", "doc_id", "rank")


RANKED = "sponsorship dashboard anvil"
_SOWT = (f"st AS (SELECT sow_key, {toks('project_title')} AS a, {toks('scope_summary')} AS b, "
         f"{toks(chr(39) + chr(39) + ' || array_to_string(deliverables, chr(32))')} AS c, {toks('client_name')} AS d FROM sow)")
_W = {"a": 3.0, "b": 2.0, "c": 2.0, "d": 1.0}


@query("se08_ranked_search", B.sql(f"SELECT sow_key, {S4} FROM sc WHERE {' OR '.join(f'w{i} > 0' for i in range(3))} "
                                   "ORDER BY score DESC, sow_key LIMIT 25", _SOWT + ", " + bm25("st", "sow_key", _W, RANKED.split())))
def se08(spark, sf_dir):
    return rounded(E.ranked_search(B.sow(spark, sf_dir), RANKED, "sow_key", top=25).select("sow_key", "score"))


# --- the same searches over stored postings --------------------------------------------------------------


def stored(spark, df, key: str, fields: dict[str, float]):
    """An index of the rows, written anew."""
    path = work_folder(spark, "postings")
    P.write_index(df, key, fields, path)
    return P.Index(spark, path)


@query("se01_postings", f"WITH {DOC}, {bm25('dt', 'doc_id', {'t': 1}, TERMS)} SELECT doc_id, {S4} FROM sc WHERE "
       f"{all_of(TERMS, has)} ORDER BY score DESC, doc_id LIMIT 50")
def se01_postings(spark, sf_dir):
    hits = stored(spark, docs(spark, sf_dir), "doc_id", {"text": 1.0}).keyword_search(QUERY)
    return rounded(hits.withColumnRenamed("key", "doc_id"))


@query("se05_vocabulary", f"WITH {DOC} SELECT doc_id, {all_of(TERMS, fuzzy)} AS every FROM dt WHERE {all_of(TERMS, fuzzy, ' OR ')}")
def se05_vocabulary(spark, sf_dir):
    index = stored(spark, docs(spark, sf_dir), "doc_id", {"text": 1.0})
    return index.near_rows(QUERY, index.fuzzy_words, mode="any").withColumnRenamed("key", "doc_id")


@query("se06_vocabulary", f"WITH {DOC} SELECT doc_id FROM dt WHERE {all_of(TERMS, phonetic)}")
def se06_vocabulary(spark, sf_dir):
    index = stored(spark, docs(spark, sf_dir), "doc_id", {"text": 1.0})
    return index.near_rows(QUERY, lambda w: index.phonetic_words(w, sound=False)).select(F.col("key").alias("doc_id"))


@query("se08_postings", B.sql(f"SELECT sow_key, {S4} FROM sc WHERE {' OR '.join(f'w{i} > 0' for i in range(3))} "
                              "ORDER BY score DESC, sow_key LIMIT 25", _SOWT + ", " + bm25("st", "sow_key", _W, RANKED.split())))
def se08_postings(spark, sf_dir):
    index = stored(spark, B.sow(spark, sf_dir).select("sow_key", *K.SEARCH_FIELD_WEIGHTS), "sow_key", K.SEARCH_FIELD_WEIGHTS)
    return rounded(index.ranked_search(RANKED, top=25).withColumnRenamed("key", "sow_key"))


# --- vectors -------------------------------------------------------------------------------------------


def vectors(spark, sf_dir):
    return B.table(spark, sf_dir, "embeddings").withColumn("reversed", F.reverse("embedding"))


def queries_of(spark, sf_dir):
    return (B.table(spark, sf_dir, "embeddings").where("vec_id < 5")
            .select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")))


def cos(a: str, b: str) -> str:
    return f"round(greatest(0, least(1, list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])))), 9)"


KNN = (f"kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ("
       f"SELECT q.vec_id AS query_id, e.vec_id, e.label, {cos('e.embedding', 'q.embedding')} AS score "
       "FROM embeddings e, embeddings q WHERE q.vec_id < 5)) WHERE rank <= 10)")


@query("se09_knn", f"WITH {KNN} SELECT query_id, vec_id, rank, {S4} FROM kn")
def se09(spark, sf_dir):
    return rounded(V.knn(vectors(spark, sf_dir), queries_of(spark, sf_dir), 10)).select("query_id", "vec_id", "rank", "score")


@query("se10_cosine", f"SELECT vec_id, CAST(floor({cos('embedding', 'list_reverse(embedding)')} * 1e4 + 0.5) AS BIGINT) AS score FROM embeddings")
def se10(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return rounded(e.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("reversed")), 9).alias("score")))


@query("pj21_min_score", f"WITH {KNN} SELECT query_id, vec_id FROM kn WHERE score >= 0.3")
def pj21(spark, sf_dir):
    hits = V.knn(vectors(spark, sf_dir), queries_of(spark, sf_dir), 10)
    return E.min_score(hits, K.MIN_VECTOR_SCORE).select("query_id", "vec_id")


@query("pj21_min_blended_score", f"WITH {KNN} SELECT query_id, vec_id FROM kn WHERE score * 0.02 >= 0.01")
def pj21_blended(spark, sf_dir):
    hits = V.knn(vectors(spark, sf_dir), queries_of(spark, sf_dir), 10)
    return E.min_score(hits.withColumn("score", F.col("score") * 0.02), K.MIN_BLENDED_SCORE).select("query_id", "vec_id")


@query("jn11_queries_against_documents", f"""SELECT query_id, label, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, {cos('e.embedding', 'list_reverse(q.embedding)')} AS score
    FROM embeddings e, embeddings q)) WHERE rank <= 5 GROUP BY 1, 2""")
def jn11(spark, sf_dir):
    """Every vector, reversed, asks among all vectors."""
    e = vectors(spark, sf_dir)
    qs = e.select(F.col("vec_id").alias("query_id"), F.col("reversed").alias("query_vector"))
    hits = V.knn(e, qs, 5)
    return (hits.join(e.select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("hits")))


def two_vectors(spark, sf_dir):
    """Vectors with a second one, which some rows lack."""
    return vectors(spark, sf_dir).withColumn("reversed", F.when(F.col("vec_id") % 7 != 3, F.col("reversed")))


def two_lists(score: str, lacking: str = "e.vec_id % 7 <> 3") -> str:
    one = lambda name, col, where: (f"{name} AS (SELECT e.vec_id, e.label, {cos(col, 'q.embedding')} AS score "  # noqa: E731
                                    f"FROM embeddings e, embeddings q WHERE q.vec_id = 1 AND {where})")
    return (one("fa", "e.embedding", "true") + ", " + one("fb", "list_reverse(e.embedding)", lacking) + ", bl AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, "
            f"coalesce(a.label, b.label) AS label, {score} AS score, "
            "CASE WHEN a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL THEN 'hybrid_combined' WHEN a.vec_id IS NOT NULL THEN 'hybrid_full_text' "
            "ELSE 'hybrid_parsed' END AS strategy FROM fa a FULL JOIN fb b ON a.vec_id = b.vec_id)")


SUM_OF_TWO = "coalesce(a.score, 0) * 0.6 + coalesce(b.score, 0) * 0.4"


def both_lists(spark, sf_dir):
    """Scores of all rows by either vector."""
    e = two_vectors(spark, sf_dir)
    e = e.withColumn("_one", e.where("vec_id = 1").select(F.col("embedding").alias("v")).limit(1).scalar())
    score = lambda c: F.round(V.cosine(F.col(c), F.col("_one")), 9).alias("score")
    return [e.where(F.col(c).isNotNull()).select("vec_id", score(c)) for c in ("embedding", "reversed")]


LABELS = ("hybrid_full_text", "hybrid_parsed", "hybrid_combined")


@query("jn07_blend", f"WITH {two_lists(SUM_OF_TWO)} SELECT vec_id, strategy, {S4} FROM bl")
def jn07(spark, sf_dir):
    return rounded(R.blend(*both_lists(spark, sf_dir), "vec_id", K.FULL_TEXT_WEIGHT, K.PARSED_WEIGHT, LABELS)).select("vec_id", "strategy", "score")


@query("jn07_blend_top", f"WITH {two_lists(SUM_OF_TWO)} SELECT vec_id, strategy, {S4} FROM (SELECT * FROM bl ORDER BY score DESC, vec_id LIMIT 25)")
def jn07_top(spark, sf_dir):
    best = R.blend_top(*both_lists(spark, sf_dir), "vec_id", K.FULL_TEXT_WEIGHT, K.PARSED_WEIGHT, LABELS, 25)
    return rounded(best).select("vec_id", "strategy", "score")


_TEXT_VECTOR = f"""{DOC}, {bm25('dt', 'doc_id', {'t': 1}, TERMS)},
  tx AS (SELECT doc_id, score / max(score) OVER () AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM sc WHERE {all_of(TERMS, has, ' OR ')}),
  vx AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (
    SELECT e.vec_id AS doc_id, {cos('e.embedding', 'q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 2))"""


def text_vector_sql(score: str) -> str:
    return f"""WITH {_TEXT_VECTOR} SELECT doc_id, strategy, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score FROM (
    SELECT coalesce(tx.doc_id, vx.doc_id) AS doc_id, {score} AS score,
    CASE WHEN tx.doc_id IS NULL THEN 'vector' WHEN vx.doc_id IS NULL THEN 'text' ELSE 'hybrid' END AS strategy
    FROM tx FULL JOIN vx ON tx.doc_id = vx.doc_id) ORDER BY score DESC, doc_id LIMIT 20"""


def text_and_vector(spark, sf_dir):
    """All text hits and the cosines of all vectors."""
    text = E.ranked_search(docs(spark, sf_dir), QUERY, "doc_id", {"text": 1.0}, top=None).select("doc_id", "score")
    e = B.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    e = e.withColumn("_one", e.where("doc_id = 2").select(F.col("embedding").alias("v")).limit(1).scalar())
    return text, e.select("doc_id", F.round(V.cosine(F.col("embedding"), F.col("_one")), 9).alias("score"))


def sixth(df):
    return df.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5).cast("long")).select("doc_id", "strategy", "score")


@query("se11_hybrid_text_vector", text_vector_sql("coalesce(tx.score, 0) * 0.3 + coalesce(vx.score, 0) * 0.7"))
def se11(spark, sf_dir):
    return sixth(E.hybrid_text_vector(*text_and_vector(spark, sf_dir), "doc_id", 20))


@query("se11_reciprocal_ranks", text_vector_sql("coalesce(1.0::DOUBLE / (60 + tx.r), 0) * 0.3::DOUBLE + coalesce(1.0::DOUBLE / (60 + vx.r), 0) * 0.7::DOUBLE"))
def se11_ranks(spark, sf_dir):
    return sixth(E.hybrid_text_vector(*text_and_vector(spark, sf_dir), "doc_id", 20, fusion="rrf"))


@query("se12_hybrid_two_vector", f"""WITH {two_lists(f"round({SUM_OF_TWO}, 9)")} SELECT vec_id, label, strategy, {S4} FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM bl) WHERE r = 1 ORDER BY bl.score DESC, vec_id LIMIT 10""".replace("bl.score", "score"))
def se12(spark, sf_dir):
    e = two_vectors(spark, sf_dir)
    vector = e.where("vec_id = 1").select("embedding").first()[0]
    out = E.hybrid_two_vector(e, vector, 10, "embedding", "reversed", "vec_id", "label")
    return rounded(out).select("vec_id", "label", "strategy", "score")


@query("se13_search_by_name", f"WITH {DOC}, {bm25('dt', 'doc_id', {'t': 1}, TERMS)} SELECT doc_id FROM sc WHERE {all_of(TERMS, has)} "
       "ORDER BY score DESC, doc_id LIMIT 50")
def se13(spark, sf_dir):
    return E.search("keyword", docs(spark, sf_dir), QUERY, ["text"], "doc_id").select("doc_id")


_SIMILAR = f"""one AS (SELECT unnest(list_distinct({toks("client_name || ' ' || project_title || ' ' || scope_summary || ' ' || array_to_string(deliverables, ' ')")})) AS x
    FROM sow WHERE sow_key = 7),
  rest AS (SELECT * FROM sow WHERE sow_key <> 7),
  tk AS (SELECT sow_key, unnest({toks('project_title')}) AS x, 3.0 AS w FROM rest UNION ALL SELECT sow_key, unnest({toks('scope_summary')}), 2.0 FROM rest
    UNION ALL SELECT sow_key, unnest({toks("array_to_string(deliverables, ' ')")}), 2.0 FROM rest UNION ALL SELECT sow_key, unnest({toks('client_name')}), 1.0 FROM rest),
  ln2 AS (SELECT sow_key, count(*) AS len FROM tk GROUP BY 1),
  tf AS (SELECT sow_key, x, sum(w) AS w FROM tk WHERE x IN (SELECT x FROM one) GROUP BY 1, 2),
  df AS (SELECT x, count(*) AS d FROM tf GROUP BY 1), al AS (SELECT count(*) AS n, avg(len) AS avg_len FROM ln2),
  sim AS (SELECT tf.sow_key, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * w * {E.K1 + 1} / (w + {E.K1} * (1 - {E.B_LEN} + {E.B_LEN} * len / avg_len))), 6) AS score
    FROM tf JOIN df USING (x) JOIN ln2 USING (sow_key), al GROUP BY 1)"""


@query("se14_recommend_similar", B.sql(f"SELECT sow_key, file_name, {S4} FROM sim JOIN sow_base USING (sow_key) ORDER BY score DESC, sow_key LIMIT 3", _SIMILAR))
def se14(spark, sf_dir):
    s = B.sow(spark, sf_dir)
    return rounded(E.recommend_similar(s, s.where("sow_key = 7"), "sow_key")).select("sow_key", "file_name", "score")


_SOW_VECTORS = """sv AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 <> 3 THEN list_reverse(embedding) END AS reversed, 'file_' || (vec_id // 3) AS file_name,
    label % 4 AS client, ['plan of ' || vec_id] AS staffing_plan FROM embeddings),
  st AS (SELECT l_orderkey AS vec_id, list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber, l_partkey) AS staffing_structured FROM lineitem GROUP BY 1)"""


@query("se14_similar_sows", f"""WITH {_SOW_VECTORS},
  pairs AS (SELECT q.vec_id AS asked_key, e.vec_id, e.file_name, round({cos('e.embedding', 'q.embedding')} * 0.6::DOUBLE + CASE WHEN e.reversed IS NULL OR q.reversed IS NULL THEN 0 ELSE {cos('e.reversed', 'q.reversed')} END * 0.4::DOUBLE, 9) AS score
    FROM sv e, sv q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND (q.vec_id % 200 = 0 OR e.client = q.client)),
  files AS (SELECT *, row_number() OVER (PARTITION BY asked_key, file_name ORDER BY score DESC, vec_id) AS r FROM pairs)
  SELECT asked_key, vec_id, rank, array_to_string(coalesce(st.staffing_structured, sv.staffing_plan), ',') AS staffing, CAST(floor(score * 1e4 + 0.5) AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY asked_key ORDER BY score DESC, vec_id) AS rank FROM files WHERE r = 1) JOIN sv USING (vec_id) LEFT JOIN st USING (vec_id)
  WHERE rank <= 3""")
def se14_vectors(spark, sf_dir):
    """Every hundredth SOW against all others; half of them ask for their own client."""
    e = (two_vectors(spark, sf_dir).withColumn("file_name", F.concat(F.lit("file_"), F.floor(F.col("vec_id") / 3).cast("string"))).withColumn("client", F.col("label") % 4)
         .withColumn("staffing_plan", F.array(F.concat(F.lit("plan of "), F.col("vec_id").cast("string")))))
    lines = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("vec_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"].cast("string")).alias("staffing_structured"))
    asked = e.where("vec_id % 100 = 0").withColumn("client", F.when(F.col("vec_id") % 200 != 0, F.col("client")))
    hits = E.similar_sows(e, asked, "vec_id", "embedding", "reversed", same=("client",), structured=lines)
    return rounded(hits).select("asked_key", "vec_id", "rank", F.array_join("staffing", ",").alias("staffing"), "score")


@query("se15_similar_ids", f"WITH {DOC}, {bm25('dt', 'doc_id', {'t': 1}, ['thor'])} SELECT doc_id FROM sc WHERE {has('thor')} "
       "ORDER BY score DESC, doc_id LIMIT 15")
def se15(spark, sf_dir):
    return E.find_similar_ids(docs(spark, sf_dir), "thor", ["text"], "doc_id", 15)


COMPANY = "Customer#000000005"


@query("se16_company_projects", B.sql(f"SELECT sow_key, project_title FROM sow_base WHERE client_name = '{COMPANY}'"))
def se16(spark, sf_dir):
    return E.company_projects(B.sow_base(spark, sf_dir), COMPANY, "sow_key").select("sow_key", "project_title")


_ELSE = bm25("sb", "sow_key", {"t": 1}, ["measurement", "analytics", "reporting"])


@query("se17_similar_elsewhere", B.sql("SELECT sow_key, client_name FROM sc WHERE w0 > 0 OR w1 > 0 OR w2 > 0",
                                       f"sb AS (SELECT sow_key, client_name, {toks('project_title')} AS t FROM sow_base WHERE client_name <> '{COMPANY}'), " + _ELSE))
def se17(spark, sf_dir):
    s = B.sow_base(spark, sf_dir).select("sow_key", "client_name", "project_title")
    return E.similar_elsewhere(s, COMPANY, "Analytics/Measurement", ["project_title"], "sow_key").select("sow_key", "client_name")


def with_display(df):
    from sowmill.functions import scalars as S

    return df.withColumn("staffing_plan", F.transform("staffing", lambda x: S.format_entry(
        x["name"], x["title"], S.percent_text(x["pct"]))))


def _elsewhere(category: str | None) -> str:
    """Rows of one main type: its words score; a type without words takes every row."""
    words = sorted({w for ws in K.CATEGORY_SEARCH_TERMS.values() for w in ws})
    if category is None:
        return f"SELECT sow_key, 0.0::DOUBLE AS score FROM cn, mt WHERE main NOT IN ({', '.join(q(c) for c in K.CATEGORY_SEARCH_TERMS)})"
    own = [i for i, w in enumerate(words) if w in K.CATEGORY_SEARCH_TERMS[category]]
    score = " + ".join(f"CASE WHEN w{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * w{i} * {E.K1 + 1} / "
                       f"(w{i} + {E.K1} * (1 - {E.B_LEN} + {E.B_LEN} * len / avg_len)) ELSE 0 END" for i in own)
    return f"SELECT sow_key, round({score}, 6) AS score FROM cn, ss, mt WHERE main = {q(category)} AND ({' OR '.join(f'w{i} > 0' for i in own)})"


@query("se18_company_analysis", B.sql(f"""
  SELECT 'type' AS section, kind AS label, CAST(count(*) AS BIGINT) AS value FROM mine GROUP BY kind
  UNION ALL SELECT * FROM (SELECT 'role', title, count(*) AS n FROM ln WHERE sow_key IN (SELECT sow_key FROM mine) GROUP BY title
    ORDER BY n DESC, title LIMIT 10)
  UNION ALL SELECT 'main type', arg_max(kind, {{'n': n, 'f': -f}}), max(n) FROM (SELECT kind, count(*) AS n, min(sow_key) AS f FROM mine GROUP BY kind)
  UNION ALL SELECT 'team size x100', 'per project', CAST(floor(sum(n_lines) * 100.0 / count(*) + 0.5) AS BIGINT) FROM mine
  UNION ALL SELECT 'elsewhere', CAST(sow_key AS VARCHAR), score FROM (SELECT sow_key, CAST(floor(score * 1e4 + 0.5) AS BIGINT) AS score FROM el ORDER BY el.score DESC, sow_key LIMIT 5)""",
    f"mine AS (SELECT sow_key, n_lines, {group_sql('lower(array_to_string(deliverables, chr(32)) || chr(32) || project_title)', K.PROJECT_CATEGORY_WORDS, 'General/Other')} "
    f"AS kind FROM sow WHERE client_name = '{COMPANY}'), "
    f"sb AS (SELECT sow_key, {toks('project_title')} AS t FROM sow_base WHERE client_name <> '{COMPANY}'), "
    f"mt AS (SELECT arg_max(kind, {{'n': n, 'f': -f}}) AS main FROM (SELECT kind, count(*) AS n, min(sow_key) AS f FROM mine GROUP BY kind)), "
    + bm25("sb", "sow_key", {"t": 1}, sorted({w for ws in K.CATEGORY_SEARCH_TERMS.values() for w in ws})).replace("sc AS", "every_sc AS")
    + ", el AS (" + " UNION ALL ".join(_elsewhere(c) for c in [*K.CATEGORY_SEARCH_TERMS, None]) + ")"))
def se18(spark, sf_dir):
    parts = E.company_analysis(with_display(B.sow(spark, sf_dir)), COMPANY, "sow_key")
    row = lambda df, section, label, value: df.select(F.lit(section).alias("section"), label.alias("label"),
                                                      value.cast("long").alias("value"))
    c = F.col
    return (row(parts["types"], "type", c("kind"), c("projects"))
            .unionByName(row(parts["roles"], "role", c("role"), c("n")))
            .unionByName(row(parts["main_type"], "main type", c("most_common_type"), c("projects")))
            .unionByName(row(parts["team"], "team size x100", F.lit("per project"), F.floor(c("per_project") * 100 + 0.5)))
            .unionByName(row(parts["elsewhere"], "elsewhere", c("sow_key").cast("string"), F.floor(c("score") * 1e4 + 0.5))))


def ladder_sql(name: str, with_vector: bool = False) -> str:
    tests = {"exact_match": all_of(TERMS, has), "semantic_lexical": all_of(TERMS, has), "fuzzy_match": all_of(TERMS, fuzzy),
             "phonetic_match": all_of(TERMS, phonetic), "synonym_match": all_of(TERMS, synonym), "term_match": all_of(TERMS, has, " OR ")}
    parts = []
    for p, (step, score) in enumerate(K.LADDERS[name]):
        if step in tests:
            parts.append(f"SELECT doc_id, {p} AS p, {q(step)} AS s, {score} AS w FROM dt WHERE {tests[step]}")
        elif with_vector:
            parts.append(f"SELECT doc_id, 0 AS p, {q(step)} AS s, {score} AS w FROM (SELECT e.vec_id AS doc_id FROM embeddings e, embeddings q WHERE q.vec_id = 2 "
                         f"ORDER BY {cos('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 5)")
    return (f"WITH {DOC} SELECT doc_id, CAST(min(p) AS INTEGER) AS priority, arg_min(s, p) AS search_strategy, "
            f"CAST(arg_min(w, p) AS DOUBLE) AS strategy_score FROM ({' UNION ALL '.join(parts)}) GROUP BY doc_id "
            "ORDER BY strategy_score DESC, priority, doc_id LIMIT 200")


def ladder(name: str, with_vector: bool = False):
    @query(f"se19_multi_search_{name}", ladder_sql(name, with_vector))
    def run(spark, sf_dir):
        hits = None
        if with_vector:
            e = B.table(spark, sf_dir, "embeddings")
            one = e.where("vec_id = 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
            hits = V.knn(e.withColumnRenamed("vec_id", "doc_id"), one, 5, "doc_id")
        return E.multi_search(docs(spark, sf_dir), QUERY, name, ["text"], "doc_id", SYN, top=200, vector_hits=hits, sound=False)


ladder("semantic_first", True)
ladder("exact_first")
ladder("phonetic_first")


@query("se20_vectorize", f"SELECT doc_id, 10000 AS twice, 10000 AS turned, 10000 AS length FROM documents WHERE trim(text) <> '' AND len({toks('text')}) > 0")
def se20(spark, sf_dir):
    """Cosines of every text with itself said twice and with its words turned around: its words alone decide."""
    d = docs(spark, sf_dir)
    words = E.tokens(F.col("text"))
    forms = F.array(F.col("text"), F.concat_ws(" ", "text", "text"), F.array_join(F.reverse(words), " "))
    each = d.where(F.size(words) > 0).select("doc_id", F.posexplode(forms).alias("form", "said"))
    v = E.vectorize(each, "said").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("form", "vector"))).alias("v"))
    one = lambda i: F.element_at("v", i)
    near = lambda x: F.floor(x * 1e4 + 0.5).cast("long")
    norm = F.aggregate(one(0), F.lit(0.0), lambda s, x: s + x * x)
    return v.select("doc_id", near(V.cosine(one(0), one(1))).alias("twice"), near(V.cosine(one(0), one(2))).alias("turned"), near(norm).alias("length"))
