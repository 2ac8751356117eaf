"""Classification of texts, titles and projects as Catalyst expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill import constants as K
from sowmill.functions.scalars import any_word, find, first_group, let, number

# --- project features from text -----------------------------------------------------


def project_type(text: Column, lowered: bool = False) -> Column:
    return first_group(text, K.PROJECT_TYPE_WORDS, K.DEFAULT_PROJECT_TYPE, lowered)


def service_project_type(text: Column, company: Column) -> Column:
    return (first_group(text, K.SERVICE_TYPE_WORDS,
                        "General Project") if company is None else
            F.when(first_group(text, K.SERVICE_TYPE_WORDS, "") != "", first_group(text, K.SERVICE_TYPE_WORDS, ""))
            .when(F.lower(company).contains(K.LARGE_CLIENTS[0]), F.lit(K.SERVICE_TYPE_WORDS[0][0]))
            .otherwise(F.lit("General Project")))


def mentions(text: Column, words: list[str], marked: bool = True, lowered: bool = False) -> Column:
    """Number of occurrences of the words (plural allowed), followed by : or - when marked.

    No word is part of another, so one pass with alternatives counts the same as one pass per word.
    """
    end = r"s?[:\-]" if marked else "s?"
    shape = F.lit(f"(?:{'|'.join(words)}){end}")

    def count(low: Column) -> Column:
        held = low.isNull()
        for word in words:
            held = held | low.contains(word)
        return F.when(held, F.regexp_count(low, shape)).otherwise(0)

    return count(text) if lowered else let(F.lower(text), count)


def deliverable_mentions(text: Column, lowered: bool = False) -> Column:
    return F.greatest(mentions(text, K.DELIVERABLE_MENTIONS, lowered=lowered), F.lit(1))


def event_mentions(text: Column, lowered: bool = False) -> Column:
    return mentions(text, K.EVENT_MENTIONS, lowered=lowered)


def stakeholder_mentions(text: Column, lowered: bool = False) -> Column:
    return F.greatest(mentions(text, K.STAKEHOLDER_MENTIONS, marked=False, lowered=lowered), F.lit(1))


def _points(text: Column, steps: list[tuple[int, list[str]]], lowered: bool) -> Column:
    out = None
    for points, words in steps:
        cond = any_word(text, words, lowered)
        out = F.when(cond, points) if out is None else out.when(cond, points)
    return out.otherwise(1)


def complexity_points(text: Column, weeks: Column, events: Column | None = None, lowered: bool = False) -> Column:
    """Points for duration, budget, geography, stakeholders and events (their number may be given)."""
    w = F.coalesce(F.nullif(weeks, F.lit(0)), F.lit(K.DEFAULT_WEEKS))
    by_events = lambda n: F.when(n >= 5, 3).when(n >= 3, 2).when(n >= 1, 1).otherwise(0)
    return (F.when(w >= 52, 3).when(w >= 26, 2).otherwise(1)
            + _points(text, K.BUDGET_POINT_WORDS, lowered) + _points(text, K.GEO_POINT_WORDS, lowered)
            + F.when(any_word(text, K.STAKEHOLDER_POINT_WORDS, lowered), 2).otherwise(0)
            + (by_events(events) if events is not None else let(event_mentions(text, lowered), by_events)))


def complexity_of(points: Column, bound: bool = False) -> Column:
    def label(p: Column) -> Column:
        out = None
        for name, floor in K.COMPLEXITY_STEPS:
            out = F.when(p >= floor, F.lit(name)) if out is None else out.when(p >= floor, F.lit(name))
        return out.otherwise(F.lit("simple"))

    return label(points) if bound else let(points, label)


def duration_weeks(text: Column) -> Column:
    """Weeks from the first '<n> weeks' or '<n> months' in the text; a month counts four weeks."""
    shape = r"(?i)(\d+)\s*(week|month)s?"

    def weeks(hit: Column) -> Column:
        count = find(hit, shape, 1).try_cast("int")
        return F.when(F.lower(find(hit, shape, 2)) == "month", count * K.WEEKS_PER_MONTH).otherwise(count)

    return let(F.regexp_extract(text, shape, 0), weeks)


def budget_range(text: Column, lowered: bool = False) -> Column:
    return first_group(text, K.BUDGET_RANGE_WORDS, "low", lowered)


def client_size(text: Column, client: Column, lowered: bool = False) -> Column:
    return (F.when(any_word(text, K.LARGE_CLIENT_WORDS, lowered), "enterprise")
            .when(any_word(F.lower(F.coalesce(client, F.lit(""))), K.LARGE_CLIENTS, lowered=True), "enterprise")
            .when(any_word(text, K.MID_CLIENT_WORDS, lowered), "mid-market").otherwise("startup"))


def geo_scope(text: Column, lowered: bool = False) -> Column:
    return first_group(text, K.GEO_SCOPE_WORDS, "local", lowered)


def special_requirements(text: Column, lowered: bool = False) -> Column:
    found = lambda low: F.array_compact(F.array(*[
        F.when(low.contains(w), F.lit(w.title())) for w in K.SPECIAL_WORDS]))
    return found(text) if lowered else let(F.lower(text), found)


def with_requirements(df: DataFrame, text: str, client: str, weeks: str | None = None) -> DataFrame:
    """Add the requirement columns of a project: type, complexity, weeks, budget, size, scope, counts.

    The text is lower-cased once in its own projection; everything after it is
    generated code over that column.
    """
    low, bound = F.col("_low"), {"lowered": True}
    given = F.col(weeks) if weeks else F.lit(None).cast("int")
    counted = df.withColumn("_low", F.lower(text)).select(
        "*", event_mentions(low, **bound).alias("events_count"), deliverable_mentions(low, **bound).alias("deliverables_count"),
        stakeholder_mentions(low, **bound).alias("stakeholders_count"), duration_weeks(F.col(text)).alias("_weeks"))
    pointed = counted.withColumn("_points", complexity_points(low, given, F.col("events_count"), **bound))
    return pointed.select(
        *df.columns, project_type(low, **bound).alias("project_type"),
        complexity_of(F.col("_points"), bound=True).alias("complexity"),
        F.coalesce(F.nullif(given, F.lit(0)), F.nullif("_weeks", F.lit(0)), F.lit(K.DEFAULT_WEEKS)).alias("duration_weeks"),
        budget_range(low, **bound).alias("budget_range"), client_size(low, F.col(client), **bound).alias("client_size"),
        geo_scope(low, **bound).alias("geographic_scope"), "deliverables_count", "events_count", "stakeholders_count",
        special_requirements(low, **bound).alias("special_requirements"))


def project_category(deliverables: Column, title: Column) -> Column:
    return first_group(F.concat_ws(" ", deliverables, title), K.PROJECT_CATEGORY_WORDS, "General/Other")


def title_category(title: Column) -> Column:
    return first_group(title, K.TITLE_CATEGORY_WORDS, "Other")


def complexity10(months: Column, n_roles: Column, n_deliverables: Column, n_bullets: Column) -> Column:
    """Complexity 1-10 from the size of an extraction record."""
    score = (F.lit(5.0)
             + F.when(months >= 12, 2.0).when(months >= 6, 1.0).otherwise(0.0)
             + F.when(n_roles >= 6, 2.0).when(n_roles >= 4, 1.0).otherwise(0.0)
             + F.when(n_deliverables >= 5, 1.5).when(n_deliverables >= 3, 0.5).otherwise(0.0)
             + F.when(n_bullets >= 5, 1.0).otherwise(0.0))
    return F.least(score, F.lit(10.0))


def project_info(rec: Column) -> Column:
    """Project header from an extraction record; months become weeks of four to the month."""
    return F.struct(
        F.coalesce(F.nullif(rec["project_title"], F.lit("")), F.lit("Unknown Project")).alias("project_name"),
        F.coalesce(rec["company"], F.lit("Unknown")).alias("client_name"),
        F.coalesce(rec["sow_id"], F.lit("Unknown")).alias("project_id"),
        F.when(rec["term_months"] > 0, rec["term_months"] * K.WEEKS_PER_MONTH).alias("duration_weeks"))


def role_category(role: Column) -> Column:
    return first_group(role, K.ROLE_CATEGORY_WORDS, "Other")


def deliverable_category(item: Column) -> Column:
    return first_group(item, K.DELIVERABLE_CATEGORY_WORDS, "Other")


def describe_department(code: Column) -> Column:
    labels = F.create_map(*[F.lit(v) for pair in K.DEPARTMENT_LABELS.items() for v in pair])
    return F.coalesce(F.element_at(labels, code), code)


# --- titles to roles -----------------------------------------------------------------------


def map_role(title: Column) -> Column:
    """struct(role, department, level) of a title: exact, then containment either way, then keywords.

    The tables are literals and the title is looked up by position, which keeps
    the expression small however often it is used.
    """
    def row(entry) -> Column:
        return F.struct(F.lit(entry[1]).alias("role"), F.lit(entry[2]).alias("department"), F.lit(entry[3]).alias("level"))

    rows = F.array(*[row(e) for e in K.ROLE_MAP + K.ROLE_KEYWORDS])
    exact: dict[str, int] = {}
    for i, e in enumerate(K.ROLE_MAP):
        exact.setdefault(e[0], i)
    equal = F.create_map(*[F.lit(v) for pair in exact.items() for v in pair])
    patterns = F.array(*[F.lit(e[0]) for e in K.ROLE_MAP])

    def position(t: Column) -> Column:
        inside = F.array_position(F.transform(patterns, lambda p: t.contains(p) | p.contains(t)), F.lit(True))
        words = None
        for i, (needed, *_) in enumerate(K.ROLE_KEYWORDS):
            cond = t.contains(needed[0])
            for w in needed[1:]:
                cond = cond & t.contains(w)
            at = F.lit(len(K.ROLE_MAP) + i)
            words = F.when(cond, at) if words is None else words.when(cond, at)
        return F.when(t != "", F.coalesce(F.try_element_at(equal, t), F.nullif(inside, F.lit(0)).cast("int") - 1, words))

    return F.get(rows, let(F.lower(F.trim(title)), position))


def role_of_title(title: str) -> tuple[str, str, int] | None:
    """``map_role`` for a title that is known when the plan is built."""
    t = title.lower().strip()
    exact = [e for e in K.ROLE_MAP if e[0] == t]
    part = [e for e in K.ROLE_MAP if t and (e[0] in t or t in e[0])]
    words = [e for e in K.ROLE_KEYWORDS if t and all(w in t for w in e[0])]
    found = (exact or part or words or [None])[0]
    return found[1:] if found else None


def _org_names() -> list[tuple[str, int]]:
    """(lower-cased title or alias, position) in match order."""
    return [(n.lower(), i) for i, (title, _, _, aliases) in enumerate(K.ORG_ROLES) for n in (title, *aliases)]


def org_exact(title: Column) -> Column:
    """Position of the first organisation role with this title or alias, null when there is none."""
    first: dict[str, int] = {}
    for name, i in _org_names():
        first.setdefault(name, i)
    table = F.create_map(*[F.lit(v) for pair in first.items() for v in pair])
    return F.try_element_at(table, F.lower(F.trim(title)))


@F.pandas_udf(T.DoubleType())
def similarity_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings, 0 to 1."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()
                      for a, b in zip(left, right)], dtype="float64")


_LETTERS = "abcdefghijklmnopqrstuvwxyz "


def letter_counts(text: Column) -> Column:
    """How often each letter and the blank stand in a text, and how many other characters."""
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _LETTERS]
    return F.array(*counts, F.length(text) - sum(counts[1:], counts[0]))


def ratio_bound(left: Column, right: Column, left_counts: Column, right_counts: Column) -> Column:
    """Upper bound of the matching-blocks ratio: blocks hold no letter more often than both texts do."""
    common = F.aggregate(F.zip_with(left_counts, right_counts, lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    both = F.length(left) + F.length(right)
    return F.when(both == 0, 1.0).otherwise(2.0 * common / F.nullif(both, F.lit(0)))


def similar_pairs(pairs: DataFrame, left: str, right: str, above: float) -> DataFrame:
    """Distinct pairs of texts with their ``ratio``, where it is over ``above``.

    Letter counts settle most pairs; only those that may pass reach the exact
    ratio, and each pair reaches it once.
    """
    a, b = F.col(left), F.col(right)
    near = pairs.select(left, right).distinct().where(ratio_bound(a, b, letter_counts(a), letter_counts(b)) > above)
    return near.withColumn("ratio", similarity_ratio(left, right)).where(F.col("ratio") > above)


def closest_roles(titles: DataFrame) -> DataFrame:
    """(title, position) of the organisation role whose title or alias is most alike each distinct title; the earliest wins, 0.8 is not enough.

    ``titles`` has one column. Names whose letters cannot reach the ratio are
    left out before any ratio is taken.
    """
    counted = lambda n: [*[n.count(c) for c in _LETTERS], sum(c not in _LETTERS for c in n)]
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("position"), F.lit(at).alias("at"), F.array(*[F.lit(c) for c in counted(n)]).alias("counts"))
                      for at, (n, i) in enumerate(_org_names())])
    low = F.regexp_replace(F.lower("title"), r"^\s+|\s+$", "")
    asked = titles.toDF("title").where(F.col("title").isNotNull()).distinct().withColumn("_low", low).withColumn("_counts", letter_counts(F.col("_low")))
    near = asked.withColumn("_names", names).select("title", "_low", F.explode(F.filter(
        "_names", lambda n: ratio_bound(F.col("_low"), n["name"], F.col("_counts"), n["counts"]) > K.FUZZY_RATIO)).alias("_n")).select("title", "_low", "_n.*")
    rated = near.withColumn("ratio", similarity_ratio("_low", "name")).where(F.col("ratio") > K.FUZZY_RATIO)
    return rated.groupBy("title").agg(F.max_by("position", F.struct("ratio", -F.col("at"))).alias("position"))


def org_row(position: Column) -> Column:
    """struct(title, department, level) at a position of the organisation roles."""
    rows = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(d).alias("department"), F.lit(lv).alias("level"))
                     for t, lv, d, _ in K.ORG_ROLES])
    return F.get(rows, position)


def map_org_roles(df: DataFrame, title: str) -> DataFrame:
    """Add org_title, org_department, org_level.

    Exact matches are a map lookup in the scan stage. Only the distinct titles
    that have none are compared with the names of the roles.
    """
    exact = df.withColumn("_pos", org_exact(F.col(title)))
    rest = closest_roles(exact.where(F.col("_pos").isNull()).select(title)).toDF("_t", "_fuzzy")
    joined = exact.join(rest, F.when(F.col("_pos").isNull(), F.col(title)) == F.col("_t"), "left")
    org = org_row(F.coalesce("_pos", "_fuzzy"))
    return joined.select(*df.columns, org["title"].alias("org_title"), org["department"].alias("org_department"),
                         org["level"].alias("org_level"))


def map_sow_roles(df: DataFrame, key: str, texts: str, out: str) -> DataFrame:
    """Add ``out``: positions of the organisation roles for the ordered list of role texts of each row; keys are distinct.

    Each text takes the first role among its wording patterns and its own
    look-up that no earlier text has taken. The fold state holds at most one
    entry per organisation role. Texts that are no title or alias are compared
    with the names of the roles once each, and come back by key.
    """
    lookup = {name: i for name, i in reversed(_org_names())}
    unlike = df.select(key, F.explode(F.array_distinct(F.filter(texts, lambda t: org_exact(t).isNull() & t.isNotNull()))).alias("_t"))
    near = unlike.join(closest_roles(unlike.select("_t")).toDF("_t", "_p"), "_t")
    known = near.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_p"))).alias("_near"))
    none = F.create_map().cast("map<string,int>")
    joined = df.join(known, key, "left").withColumn("_near", F.coalesce("_near", none))
    pairs = F.transform(texts, lambda t: F.struct(t.alias("t"), F.coalesce(org_exact(t), F.try_element_at("_near", t)).alias("d")))

    def step(taken: Column, x: Column) -> Column:
        options = F.array_compact(F.array(
            *[F.when(x["t"].rlike("(?i)" + wording), F.lit(lookup[target.lower()]))
              for wording, target in K.ROLE_WORDING], x["d"]))
        return F.concat(taken, F.slice(F.array_except(options, taken), 1, 1))

    return joined.withColumn(out, F.aggregate(pairs, F.array().cast("array<int>"), step)).select(*df.columns, out)


def org_roles(spark) -> DataFrame:
    """The organisation roles as a table (ord, title, level, department, aliases)."""
    rows = [(i, t, lv, d, list(a)) for i, (t, lv, d, a) in enumerate(K.ORG_ROLES)]
    return spark.createDataFrame(rows, "ord int, title string, level int, department string, aliases array<string>")


def org_chart(spark) -> DataFrame:
    """Look-up chart (key, title, level) built from the organisation roles, first title wins."""
    seen: dict[str, tuple[str, str, int]] = {}
    for t, lv, _, _ in K.ORG_ROLES:
        seen.setdefault(t.lower(), (t.lower(), t, lv))
    return spark.createDataFrame(list(seen.values()), "key string, chart_title string, chart_level int")


def _constant_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def normalize_titles(minimal: DataFrame, chart: DataFrame) -> DataFrame:
    """Clean titles and levels of minimal staffing rows against a chart (key, chart_title, chart_level).

    The chart is a small file; Catalyst broadcasts it when its size allows and
    shuffles otherwise.
    """
    blank = F.lit("")
    candidate = F.coalesce(F.nullif(F.trim(F.coalesce("title", blank)), blank),
                           F.trim(F.coalesce("primary_role", blank)))
    squeezed = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col("_cand"), r"\.", ""), "/", " ")))
    first = chart.select(F.col("key").alias("_k1"), F.col("chart_title").alias("_t1"), F.col("chart_level").alias("_l1"))
    second = chart.select(F.col("key").alias("_k2"), F.col("chart_title").alias("_t2"), F.col("chart_level").alias("_l2"))
    df = (minimal.withColumn("_cand", candidate)
          .join(first, F.lower("_cand") == F.col("_k1"), "left")
          .withColumn("_full", F.when(F.col("_k1").isNull(),
                                      F.try_element_at(_constant_map(K.TITLE_ABBREVIATIONS), squeezed)))
          .join(second, F.lower("_full") == F.col("_k2"), "left"))
    new_title = F.coalesce("_t1", "_t2", "_full")
    raw_level = F.trim(F.coalesce("level", blank))
    fallback = F.try_element_at(_constant_map(K.TITLE_LEVELS), F.lower(F.trim(F.coalesce(new_title, F.col("_cand")))))
    level = (F.when(raw_level.rlike(r"^\d+\z"), raw_level)
             .otherwise(F.coalesce(F.coalesce("_l1", "_l2").cast("string"), fallback.cast("string"), F.col("level"))))
    cols = [F.coalesce(new_title, F.col("title")).alias("title") if c == "title"
            else level.alias("level") if c == "level" else F.col(c) for c in minimal.columns]
    return df.select(*cols)


def unmapped_roles(detected: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """Distinct detected roles (key, role) that no mapped title (key, title) covers, either way round.

    The mapped titles come from the organisation roles, so their set per key is
    bounded by that chart; detected roles are made distinct before they meet.
    """
    roles = detected.select(key, "role").distinct()
    sets = mapped.groupBy(key).agg(F.collect_set(F.lower("title")).alias("_titles"))
    low = F.lower("role")
    covered = F.exists(F.coalesce("_titles", F.array().cast("array<string>")),
                       lambda t: low.contains(t) | t.contains(low))
    return roles.join(sets, key, "left").where(~covered).select(key, "role")


def level_number(text: Column) -> Column:
    return number(text).cast("int")
