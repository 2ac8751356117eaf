"""Column-to-column functions: names, ids, dates, allocations, display text.

All of them are plain Catalyst expressions, so they fuse into the scan stage
and never start a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sowmill import constants as K


def let(value: Column, body) -> Column:
    """Evaluate a value once and use it in ``body``; a lambda re-evaluates what it captures for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def if_any(value: Column) -> Column:
    """The value, null when it is empty; evaluated once, where ``nullif`` inside a branch or a lambda evaluates it twice."""
    return let(value, lambda v: F.when(v != "", v))


def _any_of(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | low.contains(word)
    return out


def any_word(text: Column, words: list[str], lowered: bool = False) -> Column:
    """True when the lower-cased text contains one of the words (substring match).

    ``lowered`` says that the column is lower case already; the test is then
    plain generated code.
    """
    return _any_of(text, words) if lowered else let(F.lower(text), lambda low: _any_of(low, words))


def first_group(text: Column, groups: list[tuple[str, list[str]]], default: str, lowered: bool = False) -> Column:
    """Label of the first word group that hits the text."""
    def label(low: Column) -> Column:
        out = None
        for name, words in groups:
            cond = _any_of(low, words)
            out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
        return out.otherwise(F.lit(default))

    return label(text) if lowered else let(F.lower(text), label)


def find(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when the pattern does not occur."""
    return if_any(F.regexp_extract(text, pattern, group))


def number(text: Column) -> Column:
    return text.try_cast("double")


def one_decimal(value: Column) -> Column:
    """Round half up to one decimal on DECIMAL, so that results do not depend on binary noise."""
    return value.cast("decimal(28,6)").cast("decimal(24,1)")


# --- file names and ids ----------------------------------------------------------


def parse_file_name(name: Column) -> Column:
    """struct(company, sow_id, ext) from names such as company_4_sow_2.pdf."""
    shape = r"(?i)company_(\d+).*?sow_(\d+)\.(\w+)\z"
    known = name.rlike(shape)
    return F.struct(
        F.when(known, F.concat(F.lit("Company_"), F.regexp_extract(name, shape, 1)))
        .otherwise(F.lit("Unknown")).alias("company"),
        F.when(known, F.regexp_extract(name, shape, 2)).otherwise(F.lit("Unknown")).alias("sow_id"),
        F.when(known, F.lower(F.regexp_extract(name, shape, 3)))
        .when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
        .otherwise(F.lit("bin")).alias("ext"),
    )


def doc_id(file_name: Column, title: Column, client: Column, content: Column) -> Column:
    """Stable document id; the content hash replaces a random id as the last resort."""
    raw = F.coalesce(*[F.nullif(c, F.lit("")) for c in (file_name, title, client)], F.sha2(content, 256))
    bare = F.regexp_replace(raw, r"\.[A-Za-z0-9]+\z", "")
    return F.regexp_replace(bare, r"[^A-Za-z0-9_\-=]", "_")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(pdf|docx|txt)\z", "")


def artifact_name(name: Column, suffix: str) -> Column:
    return F.concat(base_name(name), F.lit(suffix))


# --- missing values, dates -------------------------------------------------------------


def null_if_na(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(F.upper(trimmed).isin(*K.MISSING_WORDS), None).otherwise(trimmed)


def project_length(start: Column, end: Column) -> Column:
    """Length text between two YYYY-MM-DD values; null when one of them is no date."""
    days = F.datediff(F.try_to_date(end.cast("string"), "yyyy-MM-dd"),
                      F.try_to_date(start.cast("string"), "yyyy-MM-dd"))
    months = F.round(days / F.lit(K.DAYS_PER_MONTH)).cast("long").cast("string")
    weeks = F.round(days / F.lit(K.DAYS_PER_WEEK)).cast("long").cast("string")
    return (F.when(days >= 365, F.concat(months, F.lit(" months")))
            .when(days >= 30, F.concat(weeks, F.lit(" weeks")))
            .when(days.isNotNull(), F.concat(days.cast("string"), F.lit(" days"))))


# --- allocation text --------------------------------------------------------------------


def drop_thousands(text: Column) -> Column:
    """1,800 -> 1800 inside running text."""
    return F.regexp_replace(text, r"(\d),(\d{3})", "$1$2")


def percent_text(value: Column) -> Column:
    return F.concat(one_decimal(value).cast("string"), F.lit("%"))


def normalize_allocation_pct(text: Column) -> Column:
    """Percent text; hours count against the 1800-hour year, other text is kept."""
    t = F.trim(text)
    pct = number(find(t, r"(\d+(?:\.\d+)?)\s*%"))
    hours = number(find(drop_thousands(t), r"(?i)(\d+(?:\.\d+)?)\s*h(?:ours?|rs?)?"))
    return (F.when(text.isNull() | (t == ""), F.lit("0.0%"))
            .when(pct.isNotNull(), percent_text(pct))
            .when(hours.isNotNull(), percent_text(hours * 100.0 / K.YEAR_HOURS))
            .otherwise(t))


def normalize_allocation(text: Column) -> Column:
    """struct(pct_time, hours, months) from free allocation text."""
    t = drop_thousands(F.trim(text))
    fte = number(find(t, r"(?i)(\d+(?:\.\d+)?)\s*fte"))
    pct = F.coalesce(fte * 100.0, number(find(t, r"(\d+(?:\.\d+)?)\s*%")))
    hours = F.coalesce(fte * K.YEAR_HOURS, number(find(t, r"(?i)(\d+(?:\.\d+)?)\s*h(?:ours?|rs?)?")))
    times = r"(?i)(\d+(?:\.\d+)?)\s*x\s*(\d+(?:\.\d+)?)\s*months?"
    months = F.coalesce(number(find(t, times, 1)) * number(find(t, times, 2)),
                        number(find(t, r"(?i)(\d+(?:\.\d+)?)\s*months?")))
    has_pct, has_hours = F.coalesce(pct, F.lit(0.0)) != 0, F.coalesce(hours, F.lit(0.0)) != 0
    return F.struct(
        F.when(has_hours & ~has_pct, hours * 100.0 / K.YEAR_HOURS).otherwise(pct).alias("pct_time"),
        F.when(has_pct & ~has_hours, pct * K.YEAR_HOURS / 100.0).otherwise(hours).alias("hours"),
        months.alias("months"),
    )


def _where(text: Column, marks: str, value: Column) -> Column:
    """The value where the text holds one of the characters that it needs."""
    return F.when(_any_of(text, list(marks)), value)


def extract_pct(text: Column) -> Column:
    return F.coalesce(_where(text, "%", number(find(text, r"(\d{1,3}(?:\.\d+)?)\s*%"))),
                      _where(text, "fF", number(find(text, r"(?i)(\d(?:\.\d+)?)\s*fte")) * 100.0))


def extract_hours(text: Column) -> Column:
    return F.coalesce(_where(text, "hH", number(find(text, r"(?i)(\d{1,4}(?:\.\d+)?)\s*(?:hours|hrs|hr)\b"))),
                      number(find(F.trim(text), r"^(\d{1,4}(?:\.\d+)?)\z")))


def clean_hours(text: Column) -> Column:
    """Drop thousands marks: commas always, points only in 1.800-like numbers."""
    def whole(t: Column) -> Column:
        return F.when(t.contains(".") & t.rlike(r"^\d{1,3}(?:\.\d{3})+\z"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)

    return let(F.trim(F.replace(text, F.lit(","), F.lit(""))), whole)


def allocation_columns(text: Column) -> Column:
    """struct(hours, percentage) as report text; commas stay."""
    return F.struct(
        F.regexp_extract(text, r"(\d+(?:,\d+)?)\s*hrs?", 1).alias("hours"),
        F.regexp_extract(text, r"(\d+(?:\.\d+)?%)", 1).alias("percentage"),
    )


def normalize_fte(value: Column, kind: Column, weeks: Column) -> Column:
    """struct(hours, fte_percentage) at 40 hours a week; null where the weeks are needed but unknown."""
    known = F.nullif(weeks, F.lit(0))
    return F.struct(
        F.when(kind == "hours", value)
        .when(kind == "fte_percentage", value / 100.0 * K.WEEK_HOURS * known).alias("hours"),
        F.when(kind == "fte_percentage", value)
        .when(kind == "hours", F.try_divide(value, known) / K.WEEK_HOURS * 100.0).alias("fte_percentage"),
    )


def reconcile(hours: Column, pct: Column) -> Column:
    """struct(hours, hours_pct): a clamped percent wins, otherwise hours give the percent; one decimal."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct))
    return F.struct(
        one_decimal(F.when(pct.isNotNull(), share * K.YEAR_HOURS / 100.0).otherwise(hours))
        .cast("double").alias("hours"),
        one_decimal(F.when(pct.isNotNull(), share).otherwise(hours * 100.0 / K.YEAR_HOURS))
        .cast("double").alias("hours_pct"),
    )


# --- display text -------------------------------------------------------------------------


def plain_number(value: Column) -> Column:
    """Whole numbers without a point, others with one decimal."""
    d = one_decimal(value)
    return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(d.cast("string"))


def display_allocation(pct: Column, hours: Column) -> Column:
    return F.when(pct.isNotNull(), percent_text(pct)).when(
        hours.isNotNull(), F.concat(F.round(hours).cast("long").cast("string"), F.lit(" hours"))
    ).otherwise(F.lit(""))


def format_entry(name: Column, role: Column, allocation: Column) -> Column:
    """name (role): allocation, with N/A for what is missing."""
    na = F.lit("N/A")
    return F.concat(F.coalesce(name, na), F.lit(" ("), F.coalesce(role, na), F.lit("): "),
                    F.coalesce(allocation, na))


def format_entry_dashed(name: Column, title: Column, allocation: Column) -> Column:
    """name — title — allocation, skipping blanks."""
    return F.concat_ws(" — ", *[F.nullif(F.trim(c), F.lit("")) for c in (name, title, allocation)])


def parse_staffing(text: Column) -> Column:
    """struct(name, title, allocation) from one display string."""
    t = F.trim(text)
    pct_with_colon = r"(?U)^\s*([^:(\-]+?)\s*(?:\(([^)]*)\))?\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*\z"
    pct_with_dash = r"(?U)^\s*([^:]+?)[\s\-–—]+([^:]+?)[\s\-–—]+([0-9]+(?:\.[0-9]+)?)\s*%\s*\z"
    hours = r"(?iU)^\s*([^:]+?)\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*(?:hours|hrs)\s*\z"

    def part(pattern: str, group: int) -> Column:
        return F.trim(F.regexp_extract(t, pattern, group))

    def row(name: Column, title: Column, allocation: Column) -> Column:
        return F.struct(name.alias("name"), title.alias("title"), allocation.alias("allocation"))

    loose = F.concat(F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("%"))
    loose = F.when(loose == "%", F.lit("")).otherwise(loose)
    bracket = F.trim(F.regexp_extract(t, r"\(([^)]*)\)", 1))
    pieces = F.split(t, r"\s*[\-–—]\s*")
    before = F.regexp_replace(F.trim(F.element_at(F.split(t, r"\("), 1)), r"[:\-]+\z", "")
    return (F.when(t.rlike(pct_with_colon),
                   row(part(pct_with_colon, 1), part(pct_with_colon, 2),
                       percent_text(number(F.regexp_extract(t, pct_with_colon, 3)))))
            .when(t.rlike(pct_with_dash),
                  row(part(pct_with_dash, 1), part(pct_with_dash, 2),
                      percent_text(number(F.regexp_extract(t, pct_with_dash, 3)))))
            .when(t.rlike(hours),
                  row(F.lit(""), part(hours, 1),
                      F.concat(F.round(number(F.regexp_extract(t, hours, 2))).cast("long").cast("string"),
                               F.lit(" hours"))))
            .when(bracket != "", row(before, bracket, loose))
            .when(F.size(pieces) >= 2, row(F.trim(F.get(pieces, F.lit(0))), F.trim(F.get(pieces, F.lit(1))), loose))
            .otherwise(row(t, F.lit(""), loose)))


PLAN_ITEM = "name string, title string, role string, primary_role string, hours double, hours_pct double"


def is_structured(plan: Column) -> Column:
    """True for JSON text that is {entries: [...]} or a list whose first item has a known key."""
    first_keys = F.json_object_keys(F.get_json_object(plan, "$[0]"))
    known = F.array(*[F.lit(k) for k in ("name", "title", "role", "primary_role", "hours", "hours_pct")])
    entries = F.get_json_object(plan, "$.entries")
    return F.coalesce(entries.startswith("["), F.lit(False)) | F.coalesce(
        F.arrays_overlap(first_keys, known), F.lit(False))


def plan_items(plan: Column) -> Column:
    """Rows struct(name, title, allocation) of a plan given as JSON text of any supported shape."""
    wrapped = F.from_json(plan, f"struct<entries: array<struct<{_fields(PLAN_ITEM)}>>>")
    listed = F.from_json(plan, f"array<struct<{_fields(PLAN_ITEM)}>>")
    texts = F.from_json(plan, "array<string>")

    def of_struct(e: Column) -> Column:
        base = F.trim(F.coalesce(F.nullif(e["title"], F.lit("")), F.nullif(e["role"], F.lit("")), F.lit("")))
        primary = F.trim(F.coalesce(e["primary_role"], F.lit("")))
        return F.struct(
            F.trim(F.coalesce(e["name"], F.lit(""))).alias("name"),
            F.concat_ws(" — ", F.nullif(base, F.lit("")), F.nullif(primary, F.lit(""))).alias("title"),
            display_allocation(e["hours_pct"], e["hours"]).alias("allocation"))

    return (F.when(F.get_json_object(plan, "$.entries").isNotNull(), F.transform(wrapped["entries"], of_struct))
            .when(is_structured(plan), F.transform(listed, of_struct))
            .otherwise(F.transform(texts, parse_staffing)))


def _fields(ddl: str) -> str:
    return ", ".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(","))


def preview(arr: Column, n: int) -> Column:
    return F.slice(arr, 1, n)


def scope_preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def confidence_band(c: Column) -> Column:
    out = None
    for label, floor in K.CONFIDENCE_BANDS:
        out = F.when(c >= floor, F.lit(label)) if out is None else out.when(c >= floor, F.lit(label))
    return out.otherwise(F.lit("very low"))


def list_or_default(arr: Column, default: str, sep: str = " | ") -> Column:
    return F.when(F.size(arr) > 0, F.array_join(arr, sep)).otherwise(F.lit(default))


def numbered(arr: Column) -> Column:
    """1. first, 2. second, ... on separate lines."""
    return F.array_join(
        F.transform(arr, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


# --- embedding text ---------------------------------------------------------------------


def _section(label: str, body: Column, present: Column) -> Column:
    return F.when(present, F.concat(F.lit(label), body))


def labelled_text(full_text: Column, rec: Column) -> Column:
    """Long form: every section under its own heading."""
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("• "), x)), "\n")
    term = F.array_join(F.array_compact(F.array(
        _section("Start: ", rec["term_start"], rec["term_start"].isNotNull()),
        _section("End: ", rec["term_end"], rec["term_end"].isNotNull()),
        _section("Duration: ", F.concat(rec["term_months"].cast("string"), F.lit(" months")),
                 F.coalesce(rec["term_months"], F.lit(0)) > 0))), "\n")
    rates = F.array_join(rec["rates"], "\n")
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Document Content:\n"), full_text),
        _section("Scope of Work:\n", bullets(rec["scope_bullets"]), F.size(rec["scope_bullets"]) > 0),
        _section("Deliverables:\n", bullets(rec["deliverables"]), F.size(rec["deliverables"]) > 0),
        _section("Required Roles:\n", F.array_join(rec["roles"], ", "), F.size(rec["roles"]) > 0),
        _section("Assumptions:\n", bullets(rec["assumptions"]), F.size(rec["assumptions"]) > 0),
        _section("Project Term:\n", term, rec["term_start"].isNotNull() | rec["term_end"].isNotNull()),
        _section("Rate Information:\n", rates, F.size(rec["rates"]) > 0),
    )


def compact_text(rec: Column) -> Column:
    """Short form: one line with bars."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Company: "), rec["company"]),
        F.concat(F.lit("SOW ID: "), rec["sow_id"]),
        _section("Scope: ", F.array_join(rec["scope_bullets"], "; "), F.size(rec["scope_bullets"]) > 0),
        _section("Deliverables: ", F.array_join(rec["deliverables"], "; "), F.size(rec["deliverables"]) > 0),
        _section("Roles: ", F.array_join(rec["roles"], ", "), F.size(rec["roles"]) > 0),
        _section("Duration: ", F.concat(rec["term_months"].cast("string"), F.lit(" months")),
                 F.coalesce(rec["term_months"], F.lit(0)) > 0),
        _section("Rates: ", F.array_join(rec["rates"], "; "), F.size(rec["rates"]) > 0),
    )


def plain_text(*fields: Column) -> Column:
    """Plain join of the given fields, blanks skipped."""
    return F.concat_ws(" ", *[F.nullif(F.trim(f), F.lit("")) for f in fields])
