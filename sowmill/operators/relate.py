"""Joins and set operations between SOW tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowmill import constants as K

GRAM = 6
#: Buckets in which grams are counted.
BUCKETS = 1 << 20
#: Bits that hold the place of a gram in its phrase.
PLACE_BITS = 20


def pair_by_base(parsed: DataFrame, texts: DataFrame, base: str = "base") -> tuple[DataFrame, DataFrame]:
    """Parsed rows with their text, and parsed rows that have none."""
    return parsed.join(texts, base), parsed.join(texts.select(base), base, "left_anti")


def attach_staffing(hits: DataFrame, structured: DataFrame, key: str) -> DataFrame:
    """Hits with ``staffing``: the structured plan where there is one, else the display strings."""
    return (hits.join(structured.withColumnRenamed("staffing_structured", "_s"), key, "left")
            .withColumn("staffing", F.coalesce("_s", "staffing_plan")).drop("_s"))


def _grams(text: Column, n: Column) -> Column:
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n)))


def contains_pairs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """All pairs (text, phrase) where the lower-cased text contains the lower-cased phrase.

    Both inputs have one column and are made distinct. A text that contains a
    phrase has all character grams of the phrase, so each phrase is looked up by
    the one of its grams that fewest texts have; a phrase with a gram that no
    text has is in none. Common beginnings such as file name prefixes thus bring
    no candidates. Phrases under ``GRAM`` characters are grams themselves, and
    texts are cut into grams of the lengths that the phrases have.

    Grams are counted by bucket of their hash, in a table that does not grow
    with the texts; a bucket's count is no less than that of each of its grams.
    Of a text only the grams in buckets of a looked up one are sent, and they
    meet the phrases without a sort.
    """
    t = texts.toDF("text").where(F.col("text").isNotNull()).distinct()
    p = phrases.toDF("phrase").where(F.length("phrase") > 0).distinct()
    low_t, low_p = F.lower("text"), F.lower("phrase")
    gram_length = F.least(F.length(low_p), F.lit(GRAM))
    bucket = F.pmod(F.xxhash64("_g"), F.lit(BUCKETS))
    lengths = p.agg(F.collect_set(gram_length)).scalar()
    cut = t.withColumn("_lengths", lengths).select("text", F.explode("_lengths").alias("_n"))
    looked = cut.select("text", F.explode(F.array_distinct(_grams(low_t, F.col("_n")))).alias("_g")).withColumn("_b", bucket)
    counts = F.broadcast(looked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")))
    # Count and place in one number, whose minimum needs no sort; any gram may stand for a phrase, so the first ones of an endless phrase do.
    first = F.slice(_grams(low_p, gram_length), 1, 1 << PLACE_BITS)
    grams = p.select("phrase", F.posexplode(first).alias("_at", "_g")).withColumn("_b", bucket)
    ranked = F.shiftleft(F.least(F.coalesce("_n", F.lit(0)), F.lit(1 << 42)).cast("long"), PLACE_BITS) + F.col("_at")
    rarest = grams.join(counts, "_b", "left").groupBy("phrase").agg(F.min(ranked).alias("_r"))
    place = F.col("_r").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int") + 1
    keyed = rarest.where(F.shiftright("_r", PLACE_BITS) > 0).select("phrase", F.substring(low_p, place, gram_length).alias("_g"))
    wanted = F.broadcast(keyed.select(bucket.alias("_b")).distinct())
    near = looked.join(wanted, "_b", "left_semi").select("text", "_g")
    return near.join(keyed.hint("shuffle_hash"), "_g").where(low_t.contains(low_p)).select("text", "phrase")


def first_correction(files: DataFrame, corrections: DataFrame) -> DataFrame:
    """(file_name, key, value) of the first correction (ord, key, value) whose key the file name contains."""
    pairs = contains_pairs(files.select("file_name"), corrections.select("key"))
    hits = pairs.join(corrections, F.col("phrase") == F.col("key"))
    return (hits.groupBy(F.col("text").alias("file_name"))
            .agg(F.min_by(F.struct("key", "value"), F.col("ord")).alias("_c"))
            .select("file_name", "_c.key", "_c.value"))


def mentions_report(items: DataFrame, shown: int = 3) -> DataFrame:
    """(item, sows, sow_list): how many SOWs mention each item, the first few by name and order.

    Items are (file_name, ord, item). Containment is tested on distinct items
    only; SOWs come back by an equi-join. The first files per item are cut by a
    group limit before the shuffle.
    """
    from pyspark.sql import Window as W

    vocabulary = items.select("item")
    pairs = contains_pairs(vocabulary, vocabulary)
    rows = (items.select("file_name", "ord", F.col("item").alias("text"))
            .join(pairs, "text").select(F.col("phrase").alias("item"), "file_name", "ord").distinct())
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("sows"))
    first = (rows.withColumn("_n", F.row_number().over(W.partitionBy("item").orderBy("ord", "file_name")))
             .where(F.col("_n") <= shown).groupBy("item")
             .agg(F.array_sort(F.collect_list(F.struct("_n", "file_name"))).alias("_f")))
    names = F.array_join(F.transform("_f", lambda x: x["file_name"]), ", ")
    more = F.when(F.col("sows") > shown, "...").otherwise("")
    return counts.join(first, "item").select("item", "sows", F.concat(names, more).alias("sow_list"))


def contained_either_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (left, right) of titles where one contains the other."""
    down = contains_pairs(left, right).toDF("left", "right")
    up = contains_pairs(right, left).toDF("right", "left")
    return down.select("left", "right").union(up.select("left", "right")).distinct()


def blend(a: DataFrame, b: DataFrame, key: str, wa: float, wb: float, labels: tuple[str, str, str]) -> DataFrame:
    """(key, score, strategy) of two scored lists; weights add up where both have the key."""
    both = a.select(key, F.col("score").alias("_a")).join(b.select(key, F.col("score").alias("_b")), key, "full")
    zero = F.lit(0.0)
    return both.select(
        key, (F.coalesce("_a", zero) * wa + F.coalesce("_b", zero) * wb).alias("score"),
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), labels[2])
        .when(F.col("_a").isNotNull(), labels[0]).otherwise(F.lit(labels[1])).alias("strategy"))


def blend_top(a: DataFrame, b: DataFrame, key: str, wa: float, wb: float, labels: tuple[str, str, str], k: int) -> DataFrame:
    """The first ``k`` rows of ``blend``, best first, without joining the whole lists.

    A threshold algorithm in three rounds. The ``k``-th best sum of what the
    first ``k`` rows of either list give is a floor. A key in the result has
    half the floor or more in one list, so only these rows of either list are
    read next; the ``k``-th best sum among them is a better floor, and keys
    that cannot reach it even with half a floor from the list they were not
    seen in go. What stays is looked up in both lists. With fewer than ``k``
    keys in the first round everything stays. Scores must not be negative; a
    key has one row in a list, and its ties go by key.
    """
    best = [F.col("score").desc(), F.col(key)]
    a, b = a.select(key, "score"), b.select(key, "score")

    def floor_of(sums: DataFrame) -> Column:
        top = sums.orderBy(F.col("score").desc()).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        return top.select(F.when(F.col("n") == k, F.greatest(F.lit(0.0), F.col("least") - 1e-9)).otherwise(F.lit(0.0))).scalar()

    heads = [d.orderBy(*best).limit(k) for d in (a, b)]
    half = floor_of(blend(*heads, key, wa, wb, labels)) / 2
    near = [d.where(F.col("score") * w >= half) for d, w in ((a, wa), (b, wb))]
    sums = blend(*near, key, wa, wb, labels)
    better = floor_of(sums)
    reach = F.col("score") + F.when(F.col("strategy") == labels[2], 0.0).otherwise(half)
    kept = sums.where(reach >= better).select(key)
    found = blend(a.join(kept, key, "left_semi"), b.join(kept, key, "left_semi"), key, wa, wb, labels)
    return found.orderBy(*best).limit(k)


def not_covered(extracted: DataFrame, recommended: DataFrame, plan: str, title: str) -> DataFrame:
    """Extracted roles whose title no recommended role of the same plan has."""
    have = recommended.select(F.col(plan).alias("_p"), F.lower(title).alias("_t")).distinct()
    return extracted.join(have, (F.col(plan) == F.col("_p")) & (F.lower(title) == F.col("_t")), "left_anti")


def compare_extractions(first: DataFrame, second: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """(key, field, llm_value, taxonomy_value, status) for two records per key.

    Lists count by length. The records meet once per key and are unpivoted
    afterwards, so the join moves one row per record and not one per field.
    """
    fields = fields or K.COMPARED_FIELDS
    joined = first.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields]).join(second.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields]), key)
    return compare_columns(joined, key, {f: f"_a_{f}" for f in fields}, {f: f"_b_{f}" for f in fields})


def compare_columns(df: DataFrame, key: str, first: dict[str, str], second: dict[str, str]) -> DataFrame:
    """The same for two records that stand in one row: ``first`` and ``second`` name the column of each field."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        return (F.size(F.coalesce(c, F.array().cast(kinds[c]))) if kinds[c].startswith("array") else F.col(c)).cast("string")

    def status(a: Column, b: Column) -> Column:
        has = lambda v: v.isNotNull() & ~v.isin("", "0")
        return (F.when(a.eqNullSafe(b), "Match").when(has(a) & ~has(b), "LLM Only")
                .when(has(b) & ~has(a), "Taxonomy Only").when(~has(a) & ~has(b), "Match").otherwise("Different"))

    shown = df.select(key, *[text(first[f]).alias(f"_x_{f}") for f in first], *[text(second[f]).alias(f"_y_{f}") for f in first])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_x_{f}").alias("llm_value"), F.col(f"_y_{f}").alias("taxonomy_value"),
                              status(F.col(f"_x_{f}"), F.col(f"_y_{f}")).alias("status")) for f in first])
    return shown.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def by_precedence(base: DataFrame, sources: list[DataFrame], key: str, field: str) -> DataFrame:
    """Base rows with the field of the first source that has a value for the key."""
    out, cols = base, []
    for i, s in enumerate(sources):
        out = out.join(s.select(F.col(key).alias(f"_k{i}"), F.col(field).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        cols.append(F.nullif(F.col(f"_v{i}"), F.lit("")))
    return out.select(*base.columns, F.coalesce(*cols).alias(field))


def other_clients(df: DataFrame, client: str) -> DataFrame:
    return df.where(F.col("client_name") != client)


# --- sets -------------------------------------------------------------------------------------


def union_results(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_terms(arr: Column) -> Column:
    """Distinct terms in their first order."""
    return F.array_distinct(arr)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)
