"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histograms of character classes and of common words are compared
with those of its language by the Jensen-Shannon distance (base 2, 0 to 1).
A language's histograms are sums over all of its documents that pass the base
rules, so a reference is learned from the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowmill.functions.scalars import let
from sowmill.llm.common import checkpointed, keyed

WORD_GAP = r"[\x20\x09-\x0D]+"

# Character classes, taken off a text one after another; what is left counts as "other".
CHAR_CLASSES = [r"[a-z]+", WORD_GAP, r"[A-Z]+", r"[0-9]+", r"[\p{L}\p{M}&&[^\x00-\x7F]]+", r"[#*$%&|<>]+", r"[.,;:!?'\"()’-]+"]

# The commonest words of English, German, French and Spanish.
COMMON_WORDS = sorted({
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "nicht", "ein",
    "de", "la", "le", "et", "les", "des", "un", "du", "une", "que", "est", "pour",
    "el", "y", "en", "los", "se", "del", "las", "por", "con", "no", "su"})

ALL_LANGUAGES = "*"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text."""
    def covered(sorted_windows: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(sorted_windows, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(sorted_windows, k + 1)["w"] == x["w"], F.lit(False))

        starts = F.array_sort(F.transform(F.filter(sorted_windows, same), lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
                                                 F.lit(0), lambda total, x: total + x))

    def of_windows(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ranked, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, of_windows)).cast("long")


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, ``char_hist`` and ``word_hist`` of every row; a null text counts as empty."""
    df = keyed(docs, id_col, lang_col, text_col).withColumn("body", F.coalesce(F.col(text_col), F.lit(""))).drop(text_col)
    left = ["body"]
    for k, pattern in enumerate(CHAR_CLASSES):
        df = df.withColumn(f"left_{k}", F.regexp_replace(left[-1], pattern, ""))
        left.append(f"left_{k}")
    lengths = [F.length(c) for c in left]
    classes = [a - b for a, b in zip(lengths, lengths[1:], strict=False)] + [lengths[-1]]
    df = df.withColumn("char_hist", F.array(*[c.cast("double") for c in classes]))
    lines = F.filter(F.split("body", "\n"), lambda x: F.regexp_replace(x, WORD_GAP, "") != "")
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    longest = max(map(len, COMMON_WORDS))
    hits = F.transform(F.filter("words", lambda w: F.length(w) <= longest), lambda w: F.array_position(common, F.lower(w)))
    counted = let(F.filter(hits, lambda p: p > 0), lambda found: F.transform(
        F.sequence(F.lit(1), F.lit(len(COMMON_WORDS))), lambda k: F.size(F.filter(found, lambda p: p == k)).cast("double")))
    return (
        df.withColumn("words", _words(F.col("body")))
        .withColumns({
            "n_words": F.size("words").cast("long"),
            "word_chars": (F.length("body") - F.element_at("char_hist", 2)).cast("long"),
            "n_symbols": F.element_at("char_hist", 6).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": let(F.col("words"), _repeat_words),
            "common_hist": counted})
        .withColumn("word_hist", F.concat("common_hist", F.array(
            F.col("n_words") - F.aggregate("common_hist", F.lit(0.0), lambda a, x: a + x))))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .select(id_col, F.col(lang_col).alias("language"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "char_hist", "word_hist"))


def language_references(features: DataFrame) -> DataFrame:
    """Summed histograms of each language, and of all documents under ``*``, over rows that pass the base rules."""
    def summed(name: str, size: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0.0)) for i in range(size)]).alias(f"ref_{name}")

    n_char, n_word = len(CHAR_CLASSES) + 1, len(COMMON_WORDS) + 1
    good = features.where(~F.col("base_failed"))
    sums = [summed("char_hist", n_char), summed("word_hist", n_word), F.sum("n_words").alias("ref_words")]
    own = good.where(F.col("language").isNotNull()).groupBy("language").agg(*sums)
    every = good.agg(*sums).select(F.lit(ALL_LANGUAGES).alias("language"), "ref_char_hist", "ref_word_hist", F.coalesce("ref_words", F.lit(0)).alias("ref_words"))
    return own.unionByName(every)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 where one of them is empty."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def share(x: Column) -> Column:
        return let(total(x), lambda t: F.transform(x, lambda v: v / t))

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def distance(a: Column, b: Column) -> Column:
        parts = F.zip_with(a, b, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
        return F.sqrt(F.greatest(total(parts) / 2, F.lit(0.0)))

    return F.when((total(p) > 0) & (total(q) > 0), let(share(p), lambda a: let(share(q), lambda b: distance(a, b)))).otherwise(0.0)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char_distance: float = 0.28,
                     max_word_distance: float = 0.4, min_words: int = 50, min_reference_words: int = 2000, max_languages: int = 4096) -> DataFrame:
    """Base counts, distances and ``kept`` of every row.

    ``kept`` is false when a base rule fails, or when the text has at least
    ``min_words`` words and one of its distances is over its limit. A row
    without language, or whose language has under ``min_reference_words``
    words, is compared with the reference over all documents; without any
    reference its distances are 0. Null and empty texts have no words and fail
    the base rule. Repeated rows and null ids are judged row by row; other
    columns are ignored; an empty table gives no rows.

    The references are one row per language and go to the tasks as a broadcast
    when they are at most ``max_languages``; beyond that Spark chooses the join.
    """
    features = checkpointed(text_features(docs, id_col, text_col, lang_col))
    found = checkpointed(language_references(features))
    usable = found.where((F.col("ref_words") >= min_reference_words) | (F.col("language") == ALL_LANGUAGES))
    known = usable.select(F.col("language").alias("reference"), "ref_char_hist", "ref_word_hist")
    names = usable.select(F.col("language").alias("named"))
    if found.count() <= max_languages:
        known, names = F.broadcast(known), F.broadcast(names)
    judged = (
        features.join(names, F.col("language") == F.col("named"), "left")
        .withColumn("reference", F.coalesce("named", F.lit(ALL_LANGUAGES))).drop("named")
        .join(known, "reference", "left")
        .withColumns({"char_distance": js_distance(F.col("char_hist"), F.coalesce("ref_char_hist", F.array().cast("array<double>"))),
                      "word_distance": js_distance(F.col("word_hist"), F.coalesce("ref_word_hist", F.array().cast("array<double>")))}))
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "reference")
