"""Queries of the numbered operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sowmill.llm import align, decontaminate, html, language, packing, phrases, quality, scoring, secrets, similar, substrings, tokenfiles, toxicity
from sowmill.llm.common import checkpointed, table, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op10_pack_sequences")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.piece_digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with their windows."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    return language.identify_held_out(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality counts and the divergence verdict of every document."""
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


@query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.extract_text(pages, html.learn_weights(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query("op4_repeated_bytes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that occur more than once."""
    return substrings.removal_digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labelled rows that are not held out."""
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_similar_texts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 of 100 four-word shingles."""
    return similar.similar_components(table(spark, sf_dir, "documents"))


@query("op9_language_model")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and interpolated log10 probabilities of every document."""
    return scoring.score_documents(table(spark, sf_dir, "documents"))


@query("op11_token_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of the ids of every document, as read from the ORC files that hold them."""
    path = f"{work_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.token_digest(tokenfiles.read_token_files(spark, path))


@query("op13_align_tokens")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the ids of two tokenizers for every document, with corpus-wide counts of linked pairs."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    blocks = checkpointed(align.alignment_blocks(table(spark, sf_dir, "documents"), *paths))
    return align.alignment_digest(blocks, align.pair_counts(blocks))


@query("op12_phrases", """
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\\x20\\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS part
          FROM documents)),
words AS (SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM pieces),
near AS (SELECT lang, word AS x, lead(word) OVER by_piece AS y, lead(word, 2) OVER by_piece AS z FROM words WINDOW by_piece AS (PARTITION BY piece ORDER BY pos)),
one AS (SELECT lang, x, count(*) AS f FROM near GROUP BY ALL),
two AS (SELECT lang, x, y, count(*) AS f FROM near WHERE y IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, x, y, z, count(*) AS f FROM near WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cuts AS (
    SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r
    FROM two t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN one r ON r.lang = t.lang AND r.x = t.y
    WHERE t.f >= 10 AND NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND h.x = t.x AND h.y = t.y AND 100 * h.f >= 50 * t.f)
      AND NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND h.y = t.x AND h.z = t.y AND 100 * h.f >= 50 * t.f)
    UNION ALL
    SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, l.f, r.f
    FROM three t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
    UNION ALL
    SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f
    FROM three t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.x = t.z),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM worst w JOIN total USING (lang) QUALIFY rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language that stand together most."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("base_secrets", r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', 2, 'i'), lambda x: length(x) >= 6)) AS n_assign,
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""".replace("\\'", "''"))
def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base spans, which SQL can give too."""
    return op6(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


@query("base_quality", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER near || ' ' || lead(word, 2) OVER near AS run FROM w WINDOW near AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS times FROM g WHERE run IS NOT NULL) WHERE times > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r) GROUP BY doc_id),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
""")
def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of the quality rules, which SQL can give too."""
    return op8(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
