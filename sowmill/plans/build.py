"""Plans: building, baseline, export, combination, assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.functions import classify as C
from sowmill.functions.scalars import let, percent_text
from sowmill.operators import report as R
from sowmill.plans import rules as P


def title_case(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def two_digits(c: Column) -> Column:
    return c.cast("decimal(10,2)").cast("string")


# --- full plan from text -----------------------------------------------------------------------


def with_totals(df: DataFrame) -> DataFrame:
    """Add total_fte_percentage and department_allocation from the roles; null and zero shares do not count."""
    zero = F.lit(0.0)
    pct = lambda r: F.coalesce(r["pct"], zero)
    total = F.aggregate("roles", zero, lambda a, r: a + pct(r))

    def share(name: str) -> Column:
        return F.aggregate(F.filter("roles", lambda r: F.coalesce(r["department"] == name, F.lit(False))), zero,
                           lambda a, r: a + pct(r))

    entries = F.array(*[F.struct(F.lit(d).alias("k"), share(d).alias("v")) for d in K.DEPARTMENTS])
    return (df.withColumn("total_fte_percentage", total)
            .withColumn("department_allocation", F.map_from_entries(F.filter(entries, lambda e: e["v"] != 0))))


def roles_by_kind(spark: SparkSession, strict_order: bool = True) -> DataFrame:
    """Recommended roles after all rules, and their totals, for every project type and complexity: nothing else decides them."""
    kinds = dict.fromkeys([K.DEFAULT_PROJECT_TYPE, *[kind for kind, _ in K.PROJECT_TYPE_WORDS]])
    pairs = F.array(*[F.struct(F.lit(k).alias("project_type"), F.lit(c).alias("complexity")) for k in kinds for c in K.COMPLEXITIES])
    rows = spark.range(1).select(F.inline(pairs))
    planned = rows.withColumn("roles", P.synthesize_roles(F.col("project_type"), F.col("complexity")))
    return with_totals(P.apply_rules(planned, strict_order))


def recommend_plan(df: DataFrame, text: str, client: str, weeks: str | None = None, strict_order: bool = True) -> DataFrame:
    """Staffing plan of every text: requirements, recommended roles, rules, money and totals. No shuffle.

    Roles and rules are worked out once for each project type and complexity.
    """
    req = C.with_requirements(df, text, client, weeks)
    kind, level = F.col("project_type"), F.col("complexity")
    planned = req.withColumn("total_fte", P.total_fte(kind, level, F.col("events_count")))
    known = F.broadcast(roles_by_kind(df.sparkSession, strict_order))
    done = planned.join(known, ["project_type", "complexity"], "left").select(
        *planned.columns, "roles", "total_fte_percentage", "department_allocation")
    return (P.with_financials(done).withColumn("extraction_confidence", F.lit(K.PLAN_CONFIDENCE))
            .withColumn("completeness_score", F.lit(K.PLAN_COMPLETENESS)))


def build_plan(df: DataFrame, entries: str, budget: str) -> DataFrame:
    """Plan from extracted rows (array of struct(title, pct)): mapped roles, totals, completeness.

    Needs project_name, client_name, contract_number and duration_weeks.
    """
    out = with_totals(df.withColumn("roles", P.roles_of(F.col(entries))))
    mapped = F.size(F.filter("roles", lambda r: r["department"].isNotNull()))
    c = F.col
    return (out.withColumn("completeness_score", R.completeness(
                c("project_name"), c("client_name"), c("contract_number"), c("duration_weeks"), F.size("roles"), mapped, c(budget)))
            .withColumn("extraction_confidence", F.lit(0.8)))


# --- baseline plan ------------------------------------------------------------------------------


def baseline_allocations(found: Column) -> Column:
    """Array of struct(department, min, max, mid, titles) for the departments of the mapped roles."""
    rows = F.transform(found, lambda i: C.org_row(i))
    entries = []
    for d in K.ORG_DEPARTMENTS:
        low, high = K.BASELINE_FTE[d]
        titles = F.transform(_titles_in(rows, d), lambda r: r["title"])
        entries.append(F.when(F.size(titles) > 0, F.struct(
            F.lit(d).alias("department"), F.lit(low).alias("min_fte"), F.lit(high).alias("max_fte"),
            F.lit(round((low + high) / 2, 4)).alias("suggested_fte"), titles.alias("titles"))))
    return F.array_compact(F.array(*entries))


def _titles_in(rows: Column, department: str) -> Column:
    return F.filter(rows, lambda r: r["department"] == department)


def oversight_roles() -> list[tuple[str, str, int]]:
    """(title, department, level) of every role on level 7 or 8."""
    return [(t, d, lv) for t, lv, d, _ in K.ORG_ROLES if 7 <= lv <= 8]


def oversight_rows(plans: DataFrame) -> DataFrame:
    """One row per plan and oversight role, five percent each; the list is a fixed array, so nothing is joined."""
    rows = F.array(*[F.struct(F.lit(t).alias("role"), F.lit(d).alias("department"), F.lit(lv).alias("level"),
                              F.lit(K.OVERSIGHT_FTE).alias("fte")) for t, d, lv in oversight_roles()])
    return plans.select("*", F.explode(rows).alias("_r")).select(*plans.columns, "_r.*")


def baseline_total(allocations: Column) -> Column:
    """Suggested FTE of the departments plus the oversight roles, three decimals."""
    dec = lambda c: c.cast("decimal(12,4)")
    mids = F.aggregate(allocations, dec(F.lit(0)), lambda a, x: dec(a + dec(x["suggested_fte"])))
    return (mids + F.lit(str(round(len(oversight_roles()) * K.OVERSIGHT_FTE, 4))).cast("decimal(12,4)")).cast("double")


def baseline_to_plan(df: DataFrame, found: str, company: str, sow_id: str, months: str) -> DataFrame:
    """API plan from mapped roles: one role per detected title, the oversight roles, and a text summary."""
    lookup = {t: C.org_row(C.org_exact(F.lit(t))) for t, _, _ in oversight_roles()}
    api = lambda role, dept, level, pct, notes: F.struct(
        role.alias("role"), dept.alias("department"), level.cast("int").alias("level"), F.lit(1).alias("quantity"),
        pct.cast("int").alias("allocation_percent"), notes.alias("notes"))

    def of_department(a: Column) -> Column:
        name = title_case(a["department"])
        return F.transform(a["titles"], lambda t: api(
            t, name, C.org_row(C.org_exact(t))["level"], F.floor(F.round(a["suggested_fte"] * 100, 6)),
            F.concat(F.lit("AI DRAFT - "), name, F.lit(" allocation"))))

    special = F.array(*[api(F.lit(t), title_case(lookup[t]["department"]), lookup[t]["level"], F.lit(int(K.OVERSIGHT_FTE * 100)),
                            F.lit("AI DRAFT - l7_l8_oversight rule")) for t, _, _ in oversight_roles()])
    out = df.withColumn("allocations", baseline_allocations(F.col(found)))
    out = (out.withColumn("roles", F.concat(F.flatten(F.transform("allocations", of_department)), special))
           .withColumn("total_allocated_fte", baseline_total(F.col("allocations"))))
    names = F.array_join(F.transform("allocations", lambda a: title_case(a["department"])), ", ")
    term = F.col(months)
    return out.withColumn("summary", F.concat_ws(
        "\n", F.concat(F.lit("AI DRAFT Staffing Plan for "), F.col(company), F.lit(" - "), F.col(sow_id).cast("string")),
        F.when(term.isNotNull(), F.concat(F.lit("Project Duration: "), term.cast("string"), F.lit(" months")))
        .otherwise("Duration: TBD"),
        F.concat(F.lit("Departments: "), names),
        F.concat(F.lit("Total Allocation: "), percent_text(F.col("total_allocated_fte") * 100), F.lit(" FTE")),
        F.concat(F.lit("Roles Identified: "), F.size("roles").cast("string"), F.lit(" positions"))))


# --- API form -----------------------------------------------------------------------------------------


def plan_to_api(df: DataFrame, sow_id: str, title: str, client: str) -> DataFrame:
    """(sow_id, summary, roles, confidence, related_projects) of finished plans; percents are whole numbers."""
    api = F.transform("roles", lambda r: F.struct(
        r["title"].alias("role"), title_case(r["department"]).alias("department"), r["level"].alias("level"),
        F.lit(1).alias("quantity"), F.floor(F.round(F.coalesce(r["pct"], F.lit(0.0)), 6)).cast("int").alias("allocation_percent"),
        F.concat(F.lit("AI Generated - Confidence: "), two_digits(r["confidence"])).alias("notes")))
    shares = F.transform(F.map_entries("department_allocation"), lambda e: F.concat(
        F.lit("  • "), title_case(e["key"]), F.lit(": "), percent_text(e["value"]), F.lit(" FTE")))
    lines = F.transform("roles", lambda r: F.concat(
        F.lit("  • "), r["title"], F.lit(": "), percent_text(F.coalesce(r["pct"], F.lit(0.0))), F.lit(" FTE ("),
        F.coalesce(title_case(r["department"]), F.lit("Unknown")), F.lit(", "),
        F.coalesce(F.concat(F.lit("Level "), r["level"].cast("string")), F.lit("Unknown Level")), F.lit(") [Confidence: "),
        two_digits(r["confidence"]), F.lit("]")))
    c = lambda n: F.col(n).cast("string")
    summary = F.concat_ws(
        "\n", F.concat(F.lit("Staffing Plan for "), F.col(client)), F.concat(F.lit("Project: "), F.col(title)),
        F.concat(F.lit("Duration: "), c("duration_weeks"), F.lit(" weeks")),
        F.concat(F.lit("Total FTE: "), percent_text(F.col("total_fte_percentage"))),
        F.concat(F.lit("Total Roles: "), F.size("roles").cast("string"), F.lit(" positions")),
        F.lit("DEPARTMENT BREAKDOWN:"), shares, F.lit("ROLE BREAKDOWN:"), lines, F.lit("PROJECT ANALYSIS:"),
        F.concat(F.lit("Project Type: "), F.col("project_type")), F.concat(F.lit("Complexity: "), F.col("complexity")),
        F.concat(F.lit("Geographic Scope: "), F.col("geographic_scope")),
        F.concat(F.lit("Events Count: "), c("events_count")),
        F.concat(F.lit("Deliverables Count: "), c("deliverables_count")))
    return df.select(F.col(sow_id), summary.alias("summary"), api.alias("roles"),
                     F.col("extraction_confidence").alias("confidence"),
                     F.array().cast("array<string>").alias("related_projects"))


def export_plan(plans: DataFrame, key: str) -> DataFrame:
    """One row per role of a plan, ready for CSV."""
    return (plans.select(key, F.posexplode("roles").alias("_i", "r"))
            .select(key, (F.col("_i") + 1).alias("seq"), F.col("r.role").alias("Role"),
                    F.coalesce("r.department", F.lit("")).alias("Department"), F.col("r.level").alias("Level"),
                    F.col("r.quantity").alias("Quantity"), F.col("r.allocation_percent").alias("Allocation_Percent"),
                    F.coalesce("r.notes", F.lit("")).alias("Notes")))


# --- combination and assessment ---------------------------------------------------------------------


def combine_plans(extracted: DataFrame, recommended: DataFrame, key: str) -> DataFrame:
    """Recommended roles first, then extracted roles they do not cover, mapped and raised to the plan confidence."""
    e = extracted.select(key, F.col("roles").alias("_e"), F.col("extraction_confidence").alias("_ec"),
                         F.col("completeness_score").alias("_es"))
    both = recommended.join(e, key)
    titles = F.transform("roles", lambda r: F.lower(r["title"]))

    def enhanced(r: Column) -> Column:
        return let(F.when(r["department"].isNull(), C.map_role(r["title"])), lambda m: raised(r, m))

    def raised(r: Column, m: Column) -> Column:
        bare = r["department"].isNull()
        note = P._audit("enhancement", F.lit("Enhanced by the recommended plan"), F.col("extraction_confidence"), "Enhancement")
        return (r.withField("department", F.coalesce(r["department"], m["department"]))
                .withField("role", F.when(bare, m["role"]).otherwise(r["role"]))
                .withField("level", F.when(bare, m["level"]).otherwise(r["level"]))
                .withField("confidence", F.greatest(r["confidence"], F.col("extraction_confidence")))
                .withField("audit", F.array_append(r["audit"], note.cast(P.AUDIT))))

    missing = let(titles, lambda have: F.filter("_e", lambda r: ~F.array_contains(have, F.lower(r["title"]))))
    out = both.withColumn("roles", F.concat("roles", F.transform(missing, enhanced)))
    return (with_totals(out).withColumn("combined_confidence", (F.col("extraction_confidence") + F.col("_ec")) / 2)
            .withColumn("combined_completeness", F.greatest("completeness_score", "_es")).drop("_e"))


def assess_quality(df: DataFrame) -> DataFrame:
    """Quality columns of combined plans (output of ``combine_plans``)."""
    zero = F.lit(0.0)
    n, mapped = F.size("roles"), F.size(F.filter("roles", lambda r: r["department"].isNotNull()))
    depts = F.size(F.array_distinct(F.array_compact(F.transform("roles", lambda r: r["department"]))))
    top = lambda r: F.coalesce(r["level"].between(7, 9), F.lit(False))
    share = F.aggregate(F.filter("roles", top), zero, lambda a, r: a + F.coalesce(r["pct"], zero))
    conf = F.round(F.col("_ec") * 0.3 + F.col("extraction_confidence") * 0.7, 6)
    complete = F.round(F.col("_es") * 0.4 + F.col("completeness_score") * 0.6, 6)
    out = (df.withColumn("overall_confidence", F.round(conf, 3)).withColumn("overall_completeness", F.round(complete, 3))
           .withColumn("role_mapping_quality", F.round(F.coalesce(F.try_divide(mapped, n), zero), 3))
           .withColumn("department_coverage", F.round(depts / len(K.DEPARTMENTS), 3))
           .withColumn("has_executive_oversight", share > 0).withColumn("total_roles", n))
    flags = R.quality_flags(conf, complete, F.exists("roles", top), F.col("total_fte_percentage"), n - mapped, depts)
    return out.withColumn("quality_flags", flags)
