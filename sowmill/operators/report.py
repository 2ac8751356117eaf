"""Reports: statistics, frequencies, roll-ups, validation, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.functions import classify as C


def validation_flags(sow: DataFrame) -> DataFrame:
    """One boolean per declared rule, and their conjunction."""
    complete = F.forall("staffing", lambda s: s["title"].isNotNull() & s["pct"].isNotNull())
    return (sow.withColumn("end_after_start", F.coalesce(F.col("end_date") > F.col("start_date"), F.lit(False)))
            .withColumn("team_size", F.size("staffing") <= K.MAX_TEAM_SIZE)
            .withColumn("has_deliverable", F.size("deliverables") >= 1)
            .withColumn("short_items", F.forall("deliverables", lambda d: F.length(d) <= K.MAX_DELIVERABLE_CHARS))
            .withColumn("complete_entries", complete)
            .withColumn("ok", F.col("end_after_start") & F.col("team_size") & F.col("has_deliverable")
                        & F.col("short_items") & F.col("complete_entries")))


def validate(sow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    flagged = validation_flags(sow)
    return flagged.where("ok"), flagged.where("not ok")


def categorize(items: DataFrame) -> DataFrame:
    """Items (kind, item) counted per category; an empty category gives no row."""
    category = F.when(F.col("kind") == "role", C.role_category(F.col("item"))).otherwise(
        C.deliverable_category(F.col("item")))
    return (items.groupBy("kind", category.alias("category"))
            .agg(F.count(F.lit(1)).alias("items"), F.min("item").alias("first_item")))


def entry_totals(entries: DataFrame) -> DataFrame:
    """Entries with hours or percent, and their total hours, per file."""
    kept = entries.where(F.col("hours").isNotNull() | F.col("pct_time").isNotNull())
    return kept.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.sum("hours").alias("total_hours"))


def result_markdown(df: DataFrame) -> DataFrame:
    """Add a Markdown summary of each result row (needs ``staffing_lines``)."""
    from sowmill.functions.scalars import numbered

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    return df.withColumn("markdown", F.concat(
        F.lit("# SOW Search Result\n\n**Client:** "), text("client_name"), F.lit("\n**Project:** "), text("project_title"),
        F.lit("\n**Dates:** "), text("start_date"), F.lit(" to "), text("end_date"),
        F.lit("\n\n## Scope Summary\n"), F.coalesce("scope_summary", F.lit("")),
        F.lit("\n\n## Deliverables\n"), numbered(F.col("deliverables")),
        F.lit("\n\n## Staffing Plan\n"), numbered(F.col("staffing_lines")), F.lit("\n")))


# --- corpus and clients -----------------------------------------------------------------------


def corpus_stats(sow: DataFrame) -> DataFrame:
    client = F.nullif(F.trim("client_name"), F.lit(""))
    return sow.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(client).alias("clients"),
                   F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values without blanks."""
    value = F.trim(F.col(col).cast("string"))
    return df.select(value.alias("value")).where(F.col("value") != "").distinct().orderBy("value")


def role_of(display: Column) -> Column:
    """Role in the first parentheses of a display string."""
    return F.trim(F.regexp_extract(display, r"\(([^()]*)\)", 1))


def role_frequency(entries: DataFrame, display: str) -> DataFrame:
    """(role, n) from display strings, one per row."""
    return (entries.select(role_of(F.col(display)).alias("role")).where(F.col("role") != "")
            .groupBy("role").agg(F.count(F.lit(1)).alias("n")))


def top_roles(entries: DataFrame, display: str, k: int = 10) -> DataFrame:
    return role_frequency(entries, display).orderBy(F.col("n").desc(), "role").limit(k)


def role_usage(entries: DataFrame, display: str, projects: DataFrame, k: int = 3) -> DataFrame:
    """Share of projects for each of the top roles, in tenths of a percent rounded half up."""
    total = projects.agg(F.count(F.lit(1)).alias("n"))
    share = F.floor(F.col("n") * 1000 / total.scalar() + 0.5).cast("long")
    return top_roles(entries, display, k).select("role", "n", share.alias("share_permille"))


def type_counts(sow: DataFrame, kind: str) -> DataFrame:
    return sow.groupBy(kind).agg(F.count(F.lit(1)).alias("projects"))


def mode_type(sow: DataFrame, kind: str, order: str, group: list[str] | None = None) -> DataFrame:
    """Most common type; the one seen first wins a tie."""
    keys = group or []
    counts = sow.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = F.max_by(F.col(kind), F.struct(F.col("n"), (-F.col("_first")).alias("f")))
    return counts.groupBy(*keys).agg(best.alias("most_common_type"), F.max("n").alias("projects"))


def avg_team_size(sow: DataFrame, size: str) -> DataFrame:
    """Mean team size over all projects and over projects with staff."""
    staffed = F.count_if(F.col(size) > 0)
    return sow.agg(F.try_divide(F.sum(size), F.count(F.lit(1))).alias("per_project"),
                   F.try_divide(F.sum(size), staffed).alias("per_staffed_project"), staffed.alias("staffed_projects"))


def client_summary(sow: DataFrame) -> DataFrame:
    """Projects, staffing entries and deliverables per client (counts per SOW are given)."""
    return sow.groupBy("client_name").agg(F.count(F.lit(1)).alias("projects"), F.sum("n_staffing").alias("staffing"),
                                          F.sum("n_deliverables").alias("deliverables"))


def client_counts(sow: DataFrame) -> DataFrame:
    return sow.groupBy("client_name").agg(F.count(F.lit(1)).alias("projects")).orderBy(F.col("projects").desc(), "client_name")


def summary_metrics(sow: DataFrame, kind: str) -> DataFrame:
    """Long table (category, metric, value): overall, by client, by type, from one grouping-sets pass."""
    sets = (sow.select("client_name", F.col(kind).alias("kind"), "n_staffing", "n_deliverables")
            .groupingSets([[], ["client_name"], ["kind"]], "client_name", "kind")
            .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("projects"),
                 F.sum("n_staffing").alias("staffing"), F.sum("n_deliverables").alias("deliverables")))
    row = lambda category, metric, value: F.struct(
        F.lit(category).alias("category"), metric.alias("metric"), value.cast("double").alias("value"))
    average = F.round(F.try_divide(F.col("staffing").cast("decimal(20,0)"), F.col("projects").cast("decimal(20,0)")), 1)
    overall = F.array(row("Overall", F.lit("Total SOWs"), F.col("projects")),
                      row("Overall", F.lit("Total Staffing Entries"), F.col("staffing")),
                      row("Overall", F.lit("Total Deliverables"), F.col("deliverables")),
                      row("Overall", F.lit("Average Staffing per SOW"), average))
    client = F.array(row("By Client", F.concat("client_name", F.lit(" - Projects")), F.col("projects")),
                     row("By Client", F.concat("client_name", F.lit(" - Staffing")), F.col("staffing")))
    by_type = F.array(row("By Type", F.concat("kind", F.lit(" Projects")), F.col("projects")))
    rows = F.when(F.col("gid") == 3, overall).when(F.col("gid") == 1, client).otherwise(by_type)
    return sets.select(F.explode(rows).alias("r")).select("r.*")


# --- analysed results --------------------------------------------------------------------------


def company_summary(res: DataFrame) -> DataFrame:
    """Per company: SOW count, total weeks, mean weeks; failed rows carry the company ERROR and are left out."""
    return (res.where(F.col("company") != "ERROR").groupBy("company")
            .agg(F.count(F.lit(1)).alias("sow_count"), F.sum("duration_weeks").alias("total_weeks"))
            .withColumn("avg_weeks", F.try_divide("total_weeks", "sow_count")))


def company_projects(res: DataFrame) -> DataFrame:
    """Project rows with the figures of their company; the project list stays long, one row per project."""
    return (res.where(F.col("company") != "ERROR").select("company", "project_title")
            .join(company_summary(res), "company"))


def department_usage(departments: DataFrame, results: DataFrame, floor: float = 0.5) -> DataFrame:
    """(department, sows, permille): SOWs per department against the successful ones."""
    ok = results.agg(F.count_if(F.col("confidence") > floor).alias("n"))
    share = F.floor(F.try_divide(F.col("sows") * 1000, ok.scalar()) + 0.5).cast("long")
    return (departments.select("sow_key", "department").where(F.col("department").isNotNull()).distinct()
            .groupBy("department").agg(F.count(F.lit(1)).alias("sows")).withColumn("permille", share))


def item_frequency(items: DataFrame, col: str) -> DataFrame:
    return items.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), col)


def upper_middle(counts: DataFrame, value: str, weight: str, buckets: int = 4096):
    """The upper middle of ``value``, each standing ``weight`` times; None for no rows.

    Equal steps between the least and the greatest value are counted, and the
    step that holds the middle is cut again until it holds one value. Every
    pass adds up at most ``buckets`` sums, whatever the number of values, so no
    task and not the driver gets the list of them.
    """
    v, w = F.col(value).cast("double"), F.col(weight)
    total, low, high = counts.agg(F.sum(w), F.min(v), F.max(v)).first()
    if not total:
        return None
    place, left = total // 2, counts
    while low < high:
        step = (high - low) / buckets
        bucket = F.least(F.floor((v - F.lit(low)) / F.lit(step)), F.lit(buckets - 1))
        sums = left.groupBy(bucket.alias("b")).agg(F.sum(w).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("b").collect()
        for s in sums:
            if place < s.n:
                break
            place -= s.n
        left, low, high = left.where((v >= s.low) & (v <= s.high)), s.low, s.high
    return low


def duration_stats(res: DataFrame, col: str = "duration_weeks") -> DataFrame:
    """Min, max, mean and upper-middle median of the positive values, over one row per distinct value."""
    counts = res.where(F.col(col) > 0).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        middle = upper_middle(counts, "v", "n")
        row = counts.agg(F.min("v").alias("min_weeks"), F.max("v").alias("max_weeks"), F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")).alias("avg_weeks"))
        values, schema = row.collect(), row.schema
    finally:
        counts.unpersist()
    kind = schema["max_weeks"].dataType
    return res.sparkSession.createDataFrame(values, schema).withColumn("median_weeks", F.lit(middle).cast("long" if kind.typeName() == "integer" else kind))


def run_summary(res: DataFrame, floor: float = 0.5) -> DataFrame:
    ok = F.count_if(F.col("confidence") > floor)
    return res.agg(F.count(F.lit(1)).alias("total"), ok.alias("successful"), F.avg("confidence").alias("mean_confidence"),
                   F.try_divide(ok, F.count(F.lit(1))).alias("success_rate"))


def term_counts(profiles: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, term, n) over the list columns of term profiles."""
    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    rows = F.flatten(F.array(*[labelled(k) for k in kinds]))
    return (profiles.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.term").agg(F.count(F.lit(1)).alias("n")))


def term_taxonomy(profiles: DataFrame) -> DataFrame:
    """All term counts, and whether a term is common (top 10, 15 or 20 of its kind with a minimum count).

    Only the few common terms are ranked; the full counts are never put in order.
    """
    from sowmill.operators.ranking import top_terms

    limits = {"sections": (10, 2), "roles": (15, 1), "deliverables": (10, 2), "timeline": (20, 1), "budget": (20, 1)}
    counts = term_counts(profiles, list(limits))
    keep = F.lit(False)
    for kind, (k, least) in limits.items():
        keep = keep | ((F.col("kind") == kind) & (F.col("rank") <= k) & (F.col("n") >= least))
    common = (top_terms(counts, max(k for k, _ in limits.values())).where(keep)
              .select("kind", "term", F.lit(True).alias("_common")))
    return (counts.join(common, ["kind", "term"], "left")
            .select("kind", "term", "n", F.coalesce("_common", F.lit(False)).alias("common")))


def word_frequency(items: DataFrame, col: str, k: int = 20, longer_than: int = 3) -> DataFrame:
    """Most frequent words of the distinct items."""
    words = F.explode(F.split(F.lower(col), r"\s+"))
    return (items.select(col).distinct().select(words.alias("word")).where(F.length("word") > longer_than)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(k))


# --- comparison ------------------------------------------------------------------------------------

STATUSES = ["Match", "LLM Only", "Taxonomy Only", "Different"]


def comparison_stats(cmp: DataFrame, by: list[str]) -> DataFrame:
    """Counts per status and match rate in hundredths of a percent; without keys, over everything."""
    n = F.count(F.lit(1))
    match = F.count_if(F.col("status") == "Match")
    counts = [F.count_if(F.col("status") == s).alias(s.lower().replace(" ", "_")) for s in STATUSES]
    return cmp.groupBy(*by).agg(n.alias("total"), *counts, F.floor(F.try_divide(match * 10000, n) + 0.5).cast("long").alias("match_rate"))


def status_crosstab(cmp: DataFrame, by: str) -> DataFrame:
    """One column per status, zero filled; a fixed value list keeps the pivot in one pass."""
    wide = cmp.groupBy(by).pivot("status", STATUSES).count().na.fill(0)
    total = sum((F.col(f"`{s}`") for s in STATUSES[1:]), F.col(f"`{STATUSES[0]}`"))
    return wide.withColumn("match_rate", F.floor(F.try_divide(F.col("Match") * 10000, total) + 0.5).cast("long"))


# --- plans -----------------------------------------------------------------------------------------


def fte_by_department(roles: DataFrame, plan: str) -> DataFrame:
    """(plan, department, fte); roles without department or share are skipped. Totals come from the same rows."""
    kept = roles.where(F.col("department").isNotNull() & (F.coalesce("pct", F.lit(0.0)) != 0))
    return kept.groupBy(plan, "department").agg(F.sum("pct").alias("fte"))


def total_fte(roles: DataFrame, plan: str) -> DataFrame:
    return roles.groupBy(plan).agg(F.sum(F.coalesce("pct", F.lit(0.0))).alias("total_fte"))


def level_distribution(roles: DataFrame, plan: str) -> DataFrame:
    """(plan, level, fte) with ``executive``: whether any share lies on levels 7 to 9."""
    levels = (roles.where(F.col("level").isNotNull()).groupBy(plan, "level")
              .agg(F.sum(F.coalesce("pct", F.lit(0.0))).alias("fte")))
    top = levels.groupBy(plan).agg(F.max(F.col("level").between(7, 9) & (F.col("fte") > 0)).alias("executive"))
    return levels.join(top, plan)


def mapping_quality(roles: DataFrame, plan: str) -> DataFrame:
    mapped = F.count_if(F.col("department").isNotNull())
    return roles.groupBy(plan).agg(mapped.alias("mapped"), F.count(F.lit(1)).alias("roles"),
                                   F.try_divide(mapped, F.count(F.lit(1))).alias("role_mapping_quality"),
                                   (F.countDistinct("department") / len(K.DEPARTMENTS)).alias("department_coverage"))


def completeness(name: Column, client: Column, contract: Column, weeks: Column, n_roles: Column, n_mapped: Column,
                 budget: Column) -> Column:
    """Completeness 0 to 1: project fields 0.4, roles 0.4, budget 0.2 (exact to six decimals)."""
    d = lambda v: F.lit(v).cast("decimal(12,6)")
    has = lambda c, v: F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0"), d("0")).otherwise(d(v))
    project = has(name, "0.3") + has(client, "0.3") + has(contract, "0.2") + has(weeks, "0.2")
    size = F.least(n_roles / F.lit(3.0), F.lit(1.0))
    share = F.coalesce(F.try_divide(n_mapped, n_roles), F.lit(0.0))
    money = F.when(F.coalesce(budget, F.lit(0.0)) != 0, 0.2).otherwise(0.0)
    return project.cast("double") * 0.4 + (size * 0.6 + share * 0.4) * 0.4 + money


def quality_flags(confidence: Column, complete: Column, executive: Column, fte: Column, unmapped: Column,
                  departments: Column) -> Column:
    """Array of the quality issues of a plan."""
    return F.array_compact(F.array(
        F.when(confidence < 0.7, "Low overall confidence - manual review recommended"),
        F.when(complete < 0.8, "Low completeness score - may be missing key roles"),
        F.when(~executive & (fte > 200), "Large project without executive oversight"),
        F.when(unmapped > 0, F.concat(unmapped.cast("string"), F.lit(" roles not mapped to departments"))),
        F.when(departments == 1, "All roles in single department - may need cross-functional input")))


def plan_rollup(roles: Column) -> Column:
    """struct(role_count, total_percent, total_fte, departments) of an API plan."""
    total = F.aggregate(roles, F.lit(0).cast("long"), lambda a, r: a + r["allocation_percent"])
    names = F.array_sort(F.array_distinct(F.array_compact(F.transform(roles, lambda r: r["department"]))))
    return F.struct(F.size(roles).alias("role_count"), total.alias("total_percent"), (total / 100.0).alias("total_fte"),
                    names.alias("departments"))


def plan_confidence(n_detected: Column, n_roles: Column) -> Column:
    """min(roles / detected, 1) x max(0.7, 1 - 0.05 x roles), two decimals; 0.5 when nothing was detected."""
    dec = lambda c: c.cast("decimal(18,6)")
    ratio = F.least(F.try_divide(dec(n_roles), dec(n_detected)), dec(F.lit(1)))
    factor = F.greatest(dec(F.lit("0.7")), dec(F.lit(1)) - dec(n_roles) * F.lit("0.05").cast("decimal(4,2)"))
    return F.when(n_detected == 0, F.lit(0.5)).otherwise(F.round(ratio * factor, 2).cast("double"))


# --- semi-structured data -----------------------------------------------------------------------------


def profile_json(df: DataFrame, text: str) -> DataFrame:
    """(field, type, n, max_items, item_type, nested_keys) over JSON objects, one object per row."""
    entry = df.select(F.explode(F.from_json(text, "map<string,variant>")).alias("field", "v"))
    kind = F.regexp_extract(F.schema_of_variant("v"), r"^([A-Z]+)", 1)

    def python_name(c: Column) -> Column:
        return (F.when(c == "STRING", "str").when(c.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
                .when(c.isin("DOUBLE", "FLOAT", "DECIMAL"), "float").when(c == "BOOLEAN", "bool").when(c == "ARRAY", "list")
                .when(c == "OBJECT", "dict").otherwise("NoneType"))

    items = F.expr("size(try_variant_get(v, '$', 'array<variant>'))")
    first = python_name(F.regexp_extract(F.schema_of_variant(F.expr("try_variant_get(v, '$[0]', 'variant')")), r"^([A-Z]+)", 1))
    keys = F.array_join(F.array_sort(F.map_keys(F.expr("try_variant_get(v, '$', 'map<string,variant>')"))), ",")
    typed = entry.select("field", python_name(kind).alias("type"), items.alias("items"), first.alias("first"), keys.alias("keys"))
    lists, objects = F.col("type") == "list", F.col("type") == "dict"
    return typed.groupBy("field", "type").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(lists, F.col("items"))).alias("max_items"),
        F.max(F.when(lists, F.when(F.col("items") > 0, F.col("first")).otherwise("empty"))).alias("item_type"),
        F.max(F.when(objects, F.col("keys"))).alias("nested_keys"))


def recommend_schema(profile: DataFrame) -> DataFrame:
    """One row per field: main type mapped to a Spark type, and the index flags."""
    main = (profile.groupBy("field").agg(F.max_by("type", F.struct(F.col("n"), F.col("type"))).alias("t"),
                                         F.max(F.col("type") == "list").alias("is_list")))
    t, f = F.col("t"), F.col("field")
    scalar = t.isin("str", "int", "float", "bool")
    kind = (F.when(F.col("is_list"), "array<string>").when(t == "int", "int").when(t == "float", "double")
            .when(t == "bool", "boolean").otherwise("string"))
    return main.select(f, kind.alias("column_type"),
                       (f.isin(*K.SEARCHABLE_FIELDS) | (t == "str")).alias("searchable"),
                       (f.isin(*K.SORTED_FIELDS) | scalar).alias("filterable"),
                       (f.isin(*K.SORTED_FIELDS) | scalar).alias("sortable"),
                       (f.isin(*K.FACET_FIELDS) & (t == "str")).alias("facetable"))


def schema_stats(fields: DataFrame, schema: str, field: str) -> DataFrame:
    """Average, largest and smallest number of fields per schema."""
    per = fields.groupBy(schema).agg(F.countDistinct(field).alias("n"))
    return per.agg(F.avg("n").alias("avg_fields"), F.max("n").alias("max_fields"), F.min("n").alias("min_fields"))


def outcome_summary(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per status and error text; equal errors are one row."""
    return results.groupBy(*(keys or []), "status", "error").agg(F.count(F.lit(1)).alias("n"))


def count_docs(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("documents"))
