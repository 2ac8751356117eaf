"""Staffing rules over plans.

A plan is one row: project_type, complexity and ``roles``, an ordered array of
role structs. Recommended roles come from the fixed tables, so an array holds a
handful of entries; every rule is a row-wise projection and the whole chain
runs without a shuffle. A rule binds its input array once, so the expression
stays linear in the number of rules even where Catalyst inlines it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.functions.classify import map_role, role_of_title
from sowmill.functions.scalars import any_word, let, percent_text

AUDIT = "struct<field:string,text:string,value:double,confidence:double,section:string,method:string>"
ROLE = (f"struct<ord:int,title:string,department:string,role:string,level:int,pct:double,confidence:double,"
        f"reasons:array<string>,original:boolean,audit:array<{AUDIT}>>")
PENDING = 100  # roles a rule has not moved to the front keep an order above this
SECTION = "Business Rules"


def _audit(field: str, text: Column, value: Column, section: str = SECTION, confidence: float = 1.0,
           method: str = "heuristic") -> Column:
    return F.struct(F.lit(field).alias("field"), text.alias("text"), value.cast("double").alias("value"),
                    F.lit(confidence).alias("confidence"), F.lit(section).alias("section"), F.lit(method).alias("method"))


def _role(ord_: Column, title: Column, department: Column, role: Column, level: Column, pct: Column, confidence: float,
          reason: Column, original: bool, audit: Column) -> Column:
    return F.struct(ord_.cast("int").alias("ord"), title.alias("title"), department.alias("department"), role.alias("role"),
                    level.cast("int").alias("level"), pct.cast("double").alias("pct"), F.lit(confidence).alias("confidence"),
                    F.array(reason).alias("reasons"), F.lit(original).alias("original"), audit.alias("audit")).cast(ROLE)


def _added(ord_: int, title: str, department: str, role: str, level: int, pct: float, confidence: float, reason: str,
           field: str, why: str) -> Column:
    lit = F.lit
    return _role(lit(ord_), lit(title), lit(department), lit(role), lit(level), lit(pct), confidence, lit(reason), False,
                 F.array(_audit(field, lit(why), lit(pct))))


def roles_of(entries: Column, confidence: float = 0.8) -> Column:
    """Plan roles from an array of struct(title, pct), mapped to role, department and level."""
    empty = F.array().cast(f"array<{AUDIT}>")

    def one(e: Column, i: Column) -> Column:
        return let(map_role(e["title"]), lambda m: _role(
            i + PENDING, e["title"], m["department"], m["role"], m["level"], e["pct"], confidence, F.lit(""), True, empty))

    return F.transform(entries, one)


# --- rule tables ------------------------------------------------------------------------------


def _table(pairs: dict) -> Column:
    """Literal map, folded once by the optimizer, so a look-up names its key only once."""
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def department_split(project_type: Column, complexity: Column) -> Column:
    """map(department -> share); an unknown type takes the sponsorship row."""
    rows = {f"{kind}/{level}": _table({d: float(v) for d, v in zip(K.DEPARTMENTS, shares)})
            for kind, levels in K.DEPARTMENT_SPLIT.items() for level, shares in zip(K.COMPLEXITIES, levels)}
    at = lambda kind: F.try_element_at(_table(rows), F.concat(kind, F.lit("/"), complexity))
    return F.coalesce(at(project_type), at(F.lit(K.DEFAULT_PROJECT_TYPE)))


def level_split(complexity: Column) -> Column:
    """map(level -> share); an unknown complexity takes the moderate row."""
    rows = {name: _table({lv: float(v) for lv, v in zip(range(9, 0, -1), shares)}) for name, shares in K.LEVEL_SPLIT.items()}
    return F.coalesce(F.try_element_at(_table(rows), complexity), rows["moderate"])


def recommended_roles(project_type: Column, complexity: Column) -> Column:
    """Array of struct(title, level, low, high, reason) for a type and complexity."""
    def entry(t) -> Column:
        names = ("title", "level", "low", "high", "reason")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t)])

    none = F.filter(F.array(entry(K.COMPLEX_ROLE)), lambda x: F.lit(False))
    base = _table({kind: F.array(*[entry(r) for r in rows]) for kind, rows in K.TYPE_ROLES.items()})
    extra = F.when(complexity == "complex", F.array(entry(K.COMPLEX_ROLE))).otherwise(none)
    return F.concat(F.coalesce(F.try_element_at(base, project_type), none), extra)


def _lookup(key: Column, table: dict, default, kind: str) -> Column:
    return F.coalesce(F.try_element_at(_table({k: str(v) for k, v in table.items()}), key), F.lit(str(default))).cast(kind)


def total_fte(project_type: Column, complexity: Column, events: Column) -> Column:
    """Recommended FTE, one decimal, computed in DECIMAL."""
    base = _lookup(complexity, K.BASE_FTE, 2, "decimal(4,1)")
    factor = _lookup(project_type, K.TYPE_FACTOR, 1, "decimal(4,1)")
    many = F.when(events > 3, F.lit(str(K.MANY_EVENTS_FACTOR))).otherwise("1").cast("decimal(4,1)")
    return F.round(base * factor * many, 1).cast("double")


def timeline_phases(weeks: Column) -> Column:
    def phases(edge: int, share: float) -> Column:
        row = lambda n, w, s: F.struct(F.lit(n).alias("phase"), w.cast("int").alias("weeks"), F.lit(s).alias("fte"))
        return F.array(row("Planning", F.lit(edge), share), row("Execution", weeks - 2 * edge, 1.0),
                       row("Wrap-up", F.lit(edge), share))

    return F.when(weeks >= 26, phases(4, 0.3)).otherwise(phases(2, 0.5))


def assessment(df: DataFrame) -> DataFrame:
    """Add risks, success factors, challenges, resource needs, timeline notes and the justification."""
    c = F.col
    hard = c("complexity").isin("complex", "enterprise")
    several = lambda n: c("events_count") > n
    notes = lambda *pairs: F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]))
    special = F.size("special_requirements") > 0
    return (df.withColumn("risks", notes(
                (hard, "High complexity requires experienced team"),
                (c("duration_weeks") > 52, "Long duration may require team continuity planning"),
                (c("geographic_scope") == "global", "Global scope requires time zone coordination"),
                (several(5), "Multiple events require strong project management")))
            .withColumn("success_factors", F.array_compact(F.array(
                F.concat(F.lit("Clear "), F.replace("project_type", F.lit("_"), F.lit(" ")), F.lit(" focus")),
                F.concat(F.lit("Appropriate team size for "), c("complexity"), F.lit(" complexity")),
                F.when(special, F.concat(F.lit("Specialized expertise for: "), F.array_join("special_requirements", ", "))))))
            .withColumn("challenges", notes(
                (several(3), "Coordinating multiple events"),
                (c("geographic_scope").isin("national", "global"), "Multi-location coordination"),
                (c("deliverables_count") > 10, "Managing multiple deliverables")))
            .withColumn("team_size", F.when(c("complexity") == "simple", "Small").when(c("complexity") == "moderate", "Medium")
                        .otherwise("Large"))
            .withColumn("expertise_level", F.when(hard, "Senior").otherwise("Mid-level"))
            .withColumn("coordination_needs", F.when(several(3), "High").when(several(1), "Medium").otherwise("Low"))
            .withColumn("timeline_notes", notes(
                (c("duration_weeks") < 13, "Short timeline requires immediate mobilization"),
                (c("duration_weeks") > 52, "Long timeline allows for phased approach"),
                (several(1), "Multiple events require staggered execution")))
            .withColumn("justification", F.concat(
                F.lit("Project classified as "), c("complexity"), F.lit(" based on "), c("duration_weeks").cast("string"),
                F.lit("-week duration, "), c("budget_range"), F.lit(" budget, and "), c("geographic_scope"), F.lit(" scope"))))


def synthesize_roles(project_type: Column, complexity: Column) -> Column:
    """Plan roles from the recommendations: the middle of the range, but no more than the department share."""
    def entry(i: int, spec, split: Column) -> Column | None:
        title, _, low, high, reason = spec
        target = role_of_title(title)
        if target is None:
            return None
        role, department, level = target
        share = F.coalesce(F.try_element_at(split, F.lit(department)), F.lit(0.25)) * 100
        pct = F.least(F.lit((low + high) / 2), F.round(share, 6))
        why = F.lit(f"Recommended {title} with {low:.0f}-{high:.0f}% allocation")
        return _role(F.lit(i + PENDING), F.lit(title), F.lit(department), F.lit(role), F.lit(level), pct, K.ROLE_CONFIDENCE,
                     F.lit(reason), True, F.array(_audit("recommendation", why, pct, "Recommendation", K.ROLE_CONFIDENCE, "table")))

    def chosen(x: Column) -> Column:
        rows = [F.when(x["kind"] == kind, entry(i, spec, x["split"])) for kind, specs in K.TYPE_ROLES.items()
                for i, spec in enumerate(specs)]
        rows.append(F.when(x["level"] == "complex", entry(2, K.COMPLEX_ROLE, x["split"])))
        return F.array_compact(F.array(*rows))

    known = let(F.struct(project_type.alias("kind"), complexity.alias("level")), lambda x: F.struct(
        x["kind"].alias("kind"), x["level"].alias("level"), department_split(x["kind"], x["level"]).alias("split")))
    return let(known, chosen)


# --- rules -----------------------------------------------------------------------------------------


Body = Callable[[Column, Column, Column], Column]  # (roles, project type, complexity) -> roles


def _run(df: DataFrame, *bodies: Body) -> DataFrame:
    """Apply rule bodies one after the other; roles and plan features are bound once for all of them."""
    context = F.struct(F.col("roles").alias("roles"), F.col("project_type").alias("kind"), F.col("complexity").alias("level"))

    def chain(x: Column) -> Column:
        def step(roles: Column, rest: tuple[Body, ...]) -> Column:
            return let(rest[0](roles, x["kind"], x["level"]), lambda r: step(r, rest[1:])) if rest else roles

        return step(x["roles"], bodies)

    return df.withColumn("roles", let(context, chain))


def _move_or_add(match: Callable[[Column], Column], to: int, pct: float, added: Column,
                 when: Callable[[Column], Column]) -> Body:
    """The first matching original role gets the share and the front place; without one a role is added."""
    def body(roles: Column, kind: Column, level: Column) -> Column:
        first = F.array_min(F.transform(F.filter(roles, lambda r: r["original"] & match(r)), lambda r: r["ord"]))

        def moved(f: Column) -> Column:
            return F.when(f.isNull(), F.concat(roles, F.array(added))).otherwise(F.transform(roles, lambda r: F.when(
                r["ord"] == f, r.withField("ord", F.lit(to)).withField("pct", F.lit(pct))).otherwise(r)))

        return F.when(when(level), let(first, moved)).otherwise(roles)

    return body


def _creative_director() -> Body:
    match = lambda r: F.coalesce(r["role"] == "vp_creative_director", F.lit(False)) | any_word(r["title"], ["creative director"])
    added = _added(1, "Creative Director", K.PLANNING_CREATIVE, "vp_creative_director", 6, K.CREATIVE_DIRECTOR_PCT, 1.0,
                   "Creative oversight and direction", "business_rule", "Creative Director always pre-allocated at 5%")
    return _move_or_add(match, 1, K.CREATIVE_DIRECTOR_PCT, added, lambda level: F.lit(True))


def _executive() -> Body:
    match = lambda r: F.coalesce(r["level"].isin(7, 8) & r["role"].isin("vice_president", "sr_vice_president"), F.lit(False))
    added = _added(2, "Vice President - Executive Oversight", K.CLIENT_SERVICES, "vice_president", 7, K.OVERSIGHT_PCT, 1.0,
                   "Executive oversight and strategic guidance", "business_rule", "L7/L8 leaders allocated for oversight at 5%")
    return _move_or_add(match, 2, K.OVERSIGHT_PCT, added, lambda level: level.isin("complex", "enterprise"))


def _scale(member: Callable[[Column], Column], factor: Callable[[Column, Column], Column], field: Callable[[Column], Column],
           text: Callable[[Column, Column, Column], Column], cap: float | None = None, section: str = SECTION) -> Body:
    """Scale the shares of the members by a factor of their total; null means no change."""
    zero = F.lit(0.0)

    def scaled(r: Column, total: Column, f: Column) -> Column:
        def with_share(new: Column) -> Column:
            entry = F.struct(field(total).alias("field"), text(r["pct"], new, total).alias("text"), new.alias("value"),
                             F.lit(1.0).alias("confidence"), F.lit(section).alias("section"), F.lit("heuristic").alias("method"))
            return r.withField("pct", new).withField("audit", F.array_append(r["audit"], entry.cast(AUDIT)))

        return let(F.least(r["pct"] * f, F.lit(cap)) if cap is not None else r["pct"] * f, with_share)

    def body(roles: Column, kind: Column, level: Column) -> Column:
        total = F.aggregate(F.filter(roles, member), zero, lambda a, r: a + F.coalesce(r["pct"], zero))
        change = lambda t, f: F.transform(roles, lambda r: F.when(
            member(r) & (F.coalesce(r["pct"], zero) != 0), scaled(r, t, f)).otherwise(r))
        return let(total, lambda t: let(factor(t, kind), lambda f: F.when(f.isNull(), roles).otherwise(change(t, f))))

    return body


def _in_department(name: str) -> Callable[[Column], Column]:
    return lambda r: r["original"] & F.coalesce(r["department"] == name, F.lit(False))


def _sponsorship() -> tuple[Body, Body]:
    """Sponsorship roles of a sponsorship project: 25 percent together, then 50 each."""
    strategy = _in_department(K.STRATEGY)
    member = lambda r: strategy(r) & (any_word(r["title"], ["sponsorship"]) | F.coalesce(
        r["role"].isin("director_sponsorship_strategy", "manager_sponsorship_strategy"), F.lit(False)))
    ours = lambda kind: kind == "sponsorship_activation"
    together = _scale(
        member, lambda t, kind: F.when(ours(kind) & (t > K.SPONSORSHIP_CLIENT_PCT), K.SPONSORSHIP_CLIENT_PCT / t),
        lambda t: F.lit("sponsorship_limit_applied"),
        lambda old, new, t: F.concat(F.lit("Adjusted from "), percent_text(old), F.lit(" to "), percent_text(new),
                                     F.lit(" due to 25% client limit")))
    over = lambda r: member(r) & (F.coalesce(r["pct"], F.lit(0.0)) > K.SPONSORSHIP_PERSON_PCT)
    each = _scale(over, lambda t, kind: F.when(ours(kind) & (t > 0), F.lit(1.0)), lambda t: F.lit("sponsorship_person_limit_applied"),
                  lambda old, new, t: F.lit("Adjusted to 50.0% due to 50% person limit"), cap=K.SPONSORSHIP_PERSON_PCT)
    return together, each


def _range_text(low: str, high: str, low_floor: float):
    return lambda old, new, t: F.concat(
        F.lit("Adjusted to "), percent_text(new),
        F.when(t < low_floor, f" to meet {low} minimum FTE requirement").otherwise(
            f" to meet {high} maximum FTE requirement"))


def _range_factor(low: float, high: float) -> Callable[[Column, Column], Column]:
    return lambda t, kind: F.when(t < low, F.when(t > 0, low / t).otherwise(1.0)).when(t > high, high / t)


def _client_services() -> Body:
    low, high = K.CLIENT_SERVICES_MIN, K.CLIENT_SERVICES_MAX
    name = lambda t: F.when(t < low, "client_services_minimum_applied").otherwise("client_services_maximum_applied")
    return _scale(_in_department(K.CLIENT_SERVICES), _range_factor(low, high), name, _range_text("75%", "100%", low), cap=high)


def _experiences() -> Body:
    ours = lambda kind: kind.isin("event_management", "hospitality_program")
    factor = lambda t, kind: F.when(ours(kind) & (t < K.EXPERIENCES_FLOOR), F.when(t > 0, K.EXPERIENCES_PCT / t).otherwise(1.0))
    return _scale(_in_department(K.PRODUCTION), factor, lambda t: F.lit("experiences_hospitality_target_applied"),
                  lambda old, new, t: F.concat(F.lit("Adjusted to "), percent_text(new),
                                            F.lit(" to meet ~100% FTE target for experiences/hospitality")))


def _creative() -> Body:
    low, high = K.CREATIVE_MIN, K.CREATIVE_MAX
    name = lambda t: F.when(t < low, "creative_minimum_applied").otherwise("creative_maximum_applied")
    return _scale(_in_department(K.PLANNING_CREATIVE), _range_factor(low, high), name, _range_text("5%", "25%", low), cap=high)


def _scope(strict_order: bool) -> Callable[[Column], Column]:
    """All roles, or only those a rule has moved or added so far."""
    return lambda r: F.lit(True) if strict_order else r["ord"] < PENDING


def _min_pod(strict_order: bool) -> Body:
    """At least four people: account manager, senior executive and executive fill the pod in this order."""
    inside = _scope(strict_order)
    why = "Added to meet minimum pod size of 4 employees"
    filler = lambda o, t, role, lv, pct, what: _added(o, t, K.CLIENT_SERVICES, role, lv, pct, 0.8, what, "minimum_pod_size_rule", why)
    manager = filler(3, "Account Manager", "account_manager", 3, 25.0, "Account management and client coordination")
    senior = filler(4, "Senior Account Executive", "sr_account_executive", 2, 20.0, "Account coordination and project support")
    junior = filler(5, "Account Executive", "account_executive", 1, 15.0, "Project coordination and administrative support")

    def body(roles: Column, kind: Column, level: Column) -> Column:
        has = lambda role: F.exists(roles, lambda r: inside(r) & F.coalesce(r["role"] == role, F.lit(False)))
        need = F.lit(K.MIN_POD) - F.size(F.filter(roles, inside))

        def fill(n: Column) -> Column:
            def after(s: Column) -> Column:
                return F.concat(roles, F.array_compact(F.array(
                    F.when(s["a"], manager), F.when(s["b"], senior),
                    F.when(n - s["a"].cast("int") - s["b"].cast("int") > 0, junior))))

            first = (n > 0) & ~has("account_manager")
            return let(first, lambda a: let(F.struct(
                a.alias("a"), ((n - a.cast("int") > 0) & ~has("sr_account_executive")).alias("b")), after))

        return let(need, fill)

    return body


def _final_cap(strict_order: bool) -> Body:
    inside, high = _scope(strict_order), K.CLIENT_SERVICES_MAX
    member = lambda r: inside(r) & F.coalesce(r["department"] == K.CLIENT_SERVICES, F.lit(False))
    return _scale(member, lambda t, kind: F.when(F.round(t, 6) > high, high / t), lambda t: F.lit("final_client_services_adjustment"),
                  lambda old, new, t: F.concat(F.lit("Final adjustment to "), percent_text(new),
                                            F.lit(" to meet 100% maximum FTE requirement")), section=SECTION + " - Final Check")


# --- rules as plan transforms -----------------------------------------------------------------------


def rule_creative_director(df: DataFrame) -> DataFrame:
    return _run(df, _creative_director())


def rule_executive(df: DataFrame) -> DataFrame:
    return _run(df, _executive())


def rule_sponsorship(df: DataFrame) -> DataFrame:
    return _run(df, *_sponsorship())


def rule_client_services(df: DataFrame) -> DataFrame:
    return _run(df, _client_services())


def rule_experiences(df: DataFrame) -> DataFrame:
    return _run(df, _experiences())


def rule_creative(df: DataFrame) -> DataFrame:
    return _run(df, _creative())


def rule_min_pod(df: DataFrame, strict_order: bool = True) -> DataFrame:
    return _run(df, _min_pod(strict_order))


def rule_final_cap(df: DataFrame, strict_order: bool = True) -> DataFrame:
    return _run(df, _final_cap(strict_order))


def apply_rules(df: DataFrame, strict_order: bool = True) -> DataFrame:
    """All rules in their fixed order; moved and added roles come first.

    With ``strict_order=False`` pod size and final cap look only at the roles
    moved or added so far, which lets a plan end above the cap.
    """
    in_order = lambda roles, kind, level: F.array_sort(roles)
    return _run(df, _creative_director(), _executive(), *_sponsorship(), _client_services(), _experiences(), _creative(),
                _min_pod(strict_order), _final_cap(strict_order), in_order)


def with_financials(df: DataFrame, fte: str = "total_fte") -> DataFrame:
    """Add the budget of a plan: FTE x 40 h x weeks x rate, four fifths of it labour."""
    rate = _lookup(F.col("complexity"), K.HOURLY_RATE, 200, "double")
    budget = F.col(fte) * K.WEEK_HOURS * F.col("duration_weeks") * rate
    return df.withColumn("financial", F.struct(
        F.lit("retainer").alias("fee_type"), budget.alias("total_budget"), F.lit("USD").alias("currency"),
        F.lit("Monthly").alias("payment_schedule"), (budget * K.LABOUR_SHARE).alias("labor_costs"),
        (budget * (1 - K.LABOUR_SHARE)).alias("pass_through_costs")))


def compliance(roles: Column) -> Column:
    """struct of the rule checks of a finished plan."""
    zero = F.lit(0.0)
    cs = F.aggregate(F.filter(roles, lambda r: F.coalesce(r["department"] == K.CLIENT_SERVICES, F.lit(False))), zero,
                     lambda a, r: a + F.coalesce(r["pct"], zero))
    return F.struct(
        F.exists(roles, lambda r: any_word(r["title"], ["creative director"]) & F.coalesce(
            r["pct"] == K.CREATIVE_DIRECTOR_PCT, F.lit(False))).alias("creative_director"),
        F.exists(roles, lambda r: F.coalesce(r["level"].isin(7, 8), F.lit(False))).alias("executive"),
        (F.size(roles) >= K.MIN_POD).alias("min_pod"), cs.alias("client_services_pct"),
        F.round(cs, 6).between(K.CLIENT_SERVICES_MIN, K.CLIENT_SERVICES_MAX).alias("client_services"))
