"""Field extraction from document text, as Catalyst expressions over whole texts.

A section is taken line by line by possessive loops, which never go back and
need no stack, so the length of a text never decides about the depth of the
matcher.
"""

from __future__ import annotations

import re
import string
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.functions.scalars import any_word, find, let, normalize_allocation, percent_text

W = K.FIELD_WORDING
SECTION_END = r"\n\s*\n|\n[A-Za-z][A-Za-z\s]+:"
_SECTION_END_LINE = r"\s*\n|[A-Za-z][A-Za-z\s]++:"  # the same behind its newline
SPACES = " \t\n\x0b\f\r"  # what \\s stands for
STOP = r"(?=\n\n|\n[A-Z][a-z]+\s+[A-Z]|\z)"


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def any_case(pattern: str) -> str:
    return "(?i)" + pattern


def _sorted_distinct(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


# --- first pass -----------------------------------------------------------------------------


def _first_few(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def parse_fields(text: Column, most: int | None = None, most_dates: int | None = None) -> Column:
    """struct of the first-pass fields: scope, deliverable, dates, roles, fte, hours, rate hits.

    All numbers, rates and dates of the text, or the first ``most`` and ``most_dates`` of them.
    """
    roles = F.transform(
        F.array_sort(F.transform(F.array_distinct(all_of(text, rf"(?i)\b({K.FIRST_PASS_ROLES})\b")),
                                 lambda r: F.struct(F.lower(r).alias("k"), r.alias("v")))), lambda x: x["v"])
    ints = lambda p: F.transform(_first_few(all_of(text, p), most), lambda x: x.try_cast("int"))
    rate = r"(?di)\b(rate|fee)s?\b.*?\b(hour|daily|monthly)\b"
    # one search over the text; the parts come from the short match itself
    hits = F.transform(all_of(text, rate, 0), lambda m: F.concat_ws(" ", F.regexp_extract(m, rate, 1), F.regexp_extract(m, rate, 2)))
    return F.struct(
        find(text, r"(?di)(?:Scope of Work|Scope|Services)[:\-]\s*(.+?)(?=(?:Deliverables|Term|Timeline|$))").alias("scope"),
        find(text, r"(?di)(?:Deliverables?)[:\-]\s*(.+?)(?=(?:Term|Timeline|$))").alias("deliverable"),
        _first_few(all_of(text, any_case(K.LOOSE_DATES[0]), 0), most_dates).alias("dates"),
        roles.alias("roles"),
        ints(r"(?i)\b(\d{1,3})\s*%?\s*FTE\b").alias("fte"),
        ints(r"(?i)\b(\d{1,4})\s*(?:hours|hrs)\b").alias("hours"),
        _first_few(hits, most).alias("rates"))


def project_info_heuristic(text: Column, most_dates: int | None = None) -> Column:
    """struct(project_name, client_name, contract_number, dates) by label; all dates, or the first ``most_dates``."""
    label = lambda words: F.trim(find(text, rf"(?di)(?:{words})[:\-]\s*(.+?)(?:\n|$)"))
    dates = F.flatten(F.array(*[all_of(text, any_case(p), 0) for p in K.LOOSE_DATES]))
    return F.struct(label("Project Title|Project Name").alias("project_name"),
                    label("Client|Company").alias("client_name"),
                    label("Contract Number|Contract #").alias("contract_number"),
                    _first_few(dates, most_dates).alias("dates"))


def roles_heuristic(text: Column) -> Column:
    """Array of struct(title, raw_line, fte_percentage, hours) from the lines of staffing sections."""
    sections = all_of(text, r"(?is)(?:Staffing Plan|Project Staffing|Resource Table|Team)(.*?)(?=\n\n|\n[A-Z]|\z)")
    lines = F.filter(F.transform(F.flatten(F.transform(sections, lambda s: F.split(s, "\n"))), lambda x: F.trim(x)), lambda x: x != "")

    def entry(line: Column) -> Column:
        title = F.coalesce(*[find(line, rf"(?i)\b({p})\b") for p in K.ROLE_LINE_TERMS])
        return F.struct(title.alias("title"), line.alias("raw_line"),
                        find(line, r"(?i)\b(\d{1,3})\s*%?\s*FTE\b").try_cast("double").alias("fte_percentage"),
                        find(line, r"(?i)\b(\d{1,4})\s*(?:hours|hrs)\b").try_cast("double").alias("hours"))

    return F.filter(F.transform(lines, entry), lambda e: e["title"].isNotNull())


# --- field extraction by wording ------------------------------------------------------------


def _allowed(value: Column, banned: list[str]) -> Column:
    return let(value, lambda v: F.when(~any_word(v, banned), v)) if banned else value


def _lowered(text: Column, low: Column | None, body) -> Column:
    """``body`` of the text in lower case, which a caller may have at hand."""
    return let(F.lower(text), body) if low is None else body(low)


def _first_of(text: Column, tries: list[tuple[str, object]], low: Column | None = None) -> Column:
    """First try with a value; a try runs its patterns only where its literal word occurs at all."""
    return _lowered(text, low, lambda lower: F.coalesce(*[F.when(lower.contains(word), value) for word, value in tries]))


def client_name(text: Column, own_names: list[str] | None = None, low: Column | None = None) -> Column:
    """Client by contract wording, then by label; own-side words and names are skipped."""
    wording = W["client_name"]
    banned = wording["exclusion_patterns"] + [n.lower() for n in own_names or []]
    stop = r"(?:\s+and\s+|\s+vs\.?\s+|\s+versus\s+|\s+\(|\s*\z)"
    tries = [(w, find(text, rf"(?i){w}\s+([^,]+?){stop}")) for w in wording["contract_indicators"]]
    tries += [(w, find(text, rf"(?i){w}\s*:?\s*([^\n\r]+)")) for w in wording["label_indicators"]]
    return _first_of(text, [(w, _allowed(F.trim(t), banned)) for w, t in tries], low)


def project_title(text: Column, low: Column | None = None) -> Column:
    wording = W["project_title"]
    return _first_of(text, [(w, _allowed(F.trim(find(text, rf"(?i){w}\s*:?\s*([^\n\r]+)")), wording["exclusion_patterns"]))
                            for w in wording["title_indicators"]], low)


def _value_after(text: Column, lead: str, patterns: list[str]) -> Column:
    return let(find(text, rf"(?i){lead}\s*([^\n\r]+)"),
               lambda rest: F.coalesce(*[find(rest, any_case(p), 0) for p in patterns]))


def _date_after(text: Column, field: str, low: Column | None = None) -> Column:
    wording = W[field]
    leads = [(w, w) for w in wording["context_patterns"]] + [(w, w + r"\s*:?") for w in wording["primary_indicators"]]
    return _first_of(text, [(w, _value_after(text, lead, wording["date_formats"])) for w, lead in leads], low)


def start_date(text: Column, low: Column | None = None) -> Column:
    return _date_after(text, "start_date", low)


def end_date(text: Column, low: Column | None = None) -> Column:
    return _date_after(text, "end_date", low)


def project_length_text(text: Column, low: Column | None = None) -> Column:
    wording = W["project_length"]
    return _first_of(text, [(w, _value_after(text, w + r"\s*:?", wording["duration_patterns"]))
                            for w in wording["duration_indicators"]], low)


def section_after(text: Column, header: str, numbered: bool = False) -> Column:
    """Text between the first occurrence of a header and the next section end, null without the header; a ``numbered`` line may end it, too."""
    end = _SECTION_END_LINE + (r"|\d+\." if numbered else "")
    return find(text, rf"(?i){header}[:\s]*+((?:[^\n]++|\n(?!{end}))*+)")


def scope_summary(text: Column, longest: int | None = None, low: Column | None = None) -> Column:
    """Scope section of over 50 characters, whole, or with an ellipsis after ``longest`` characters."""
    def guarded(header: str) -> Column:
        def shown(s: Column) -> Column:
            return s if longest is None else F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest), F.lit("..."))).otherwise(s)

        return let(F.trim(section_after(text, header, numbered=True)), lambda s: F.when(F.length(s) > 50, shown(s)))

    return _first_of(text, [(h, guarded(h)) for h in W["scope_summary"]["section_headers"]], low)


def _sections(text: Column, headers: list[str], low: Column | None = None) -> Column:
    return _lowered(text, low, lambda lower: F.array_compact(F.array(*[
        F.when(lower.contains(h), section_after(text, h)) for h in headers])))


def _list_items(text: Column, field: str, low: Column | None = None) -> Column:
    marks = W[field]["list_indicators"]

    def marked(section: Column, has: Column) -> Column:
        # most marks need a dot or a character beyond ASCII, which many sections lack
        may = lambda m: has["wide"] if not m.isascii() else has["dot"] if "." in m else F.lit(True)
        return F.flatten(F.array_compact(F.array(*[
            F.when(may(m) & section.contains(m), all_of(section, re.escape(m) + r"\s*([^\n\r]+)")) for m in marks])))

    def items(section: Column) -> Column:
        has = F.struct(section.contains(".").alias("dot"), (F.octet_length(section) > F.length(section)).alias("wide"))
        found = let(has, lambda h: marked(section, h))
        return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 10)

    return F.flatten(F.transform(_sections(text, W[field]["section_headers"], low), items))


def deliverables(text: Column, low: Column | None = None) -> Column:
    """List items of the deliverable sections, one pass per list mark; an item may occur more than once."""
    return _list_items(text, "deliverables", low)


def exclusions(text: Column, low: Column | None = None) -> Column:
    return _list_items(text, "exclusions", low)


def staffing_lines(text: Column, low: Column | None = None) -> Column:
    wording = W["staffing_plan"]
    lines = F.flatten(F.transform(_sections(text, wording["section_headers"], low), lambda s: F.split(s, "\n")))
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: any_word(x, wording["table_indicators"]))


EXTRACTORS = {
    "client_name": client_name, "project_title": project_title, "start_date": start_date, "end_date": end_date,
    "project_length": project_length_text, "scope_summary": scope_summary, "deliverables": deliverables,
    "exclusions": exclusions, "staffing_plan": staffing_lines,
}


def taxonomy_extract(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """All nine fields of every text in one projection over the text and its lower case."""
    lowered = df.withColumn("_low", F.lower(text))
    return lowered.select(*keep, *[fn(F.col(text), low=F.col("_low")).alias(field) for field, fn in EXTRACTORS.items()])


def wordings() -> list[tuple[str, str, str]]:
    """(field, kind, pattern) of every wording entry."""
    return [(field, kind, p) for field, kinds in W.items() for kind, ps in kinds.items() for p in ps]


def wording_hits(df: DataFrame, text: str) -> DataFrame:
    """(field, kind, word, documents): how many texts contain each entry of the wording lists, plain words and patterns alike, in any case."""
    # A hit is the number of its entry until the end, so that rows stay small. A pattern that stands in several fields is looked for once.
    entries = wordings()
    mark = "\x1f"
    listed = lambda values: F.split(F.lit(mark.join(values)), mark)
    patterns: dict[str, list[int]] = {}
    for i, (_, _, p) in enumerate(entries):
        if set("\\[(") & set(p):
            patterns.setdefault(p, []).append(i)
    plain = [i for i, (_, _, p) in enumerate(entries) if p not in patterns]
    words, numbers = listed(entries[i][2] for i in plain), listed(str(i) for i in plain).cast("array<int>")
    none = F.array().cast("array<int>")

    def hits(low: Column) -> Column:
        held = F.zip_with(words, numbers, lambda w, i: F.when(low.contains(w), i))
        matched = []
        for p, places in patterns.items():
            needs = [any_word(low, some, lowered=True) for some in K.PATTERN_NEEDS.get(p, [])]
            matched.append(F.when(reduce(and_, [*needs, F.col(text).rlike(any_case(p))]), F.array(*[F.lit(i) for i in places])).otherwise(none))
        return F.array_compact(F.concat(held, *matched))

    counts = df.select(F.explode(let(F.lower(F.col(text)), hits)).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("documents"))
    return counts.select(*[F.get(listed(e[at] for e in entries), F.col("i")).alias(name) for at, name in enumerate(("field", "kind", "word"))], "documents")


# --- term profile ------------------------------------------------------------------------------


def term_profile(text: Column, most_sentences: int | None = None, most_items: int | None = None, longest_phrase: int | None = None,
                 sample_chars: int | None = None) -> Column:
    """struct of the terms of one document, lists distinct and sorted where order carries no meaning.

    Everything is kept unless a limit is given: sentences looked at, deliverables and phrases listed, characters of a phrase and of the sample.
    """
    union = lambda parts: F.flatten(F.array(*parts))

    none = F.array().cast("array<string>")

    def where(low: Column, pattern: str, words: list[str], group: int = 1) -> Column:
        # without one of these words a text has no match
        return F.when(~any_word(low, words, lowered=True), none).otherwise(all_of(text, pattern, group))

    # Terms of different groups never overlap but for the last group of roles, so one search finds what one a group would.
    sections = all_of(text, rf"(?im)^(?:\d+\.?\s*)?({'|'.join(K.SECTION_TERMS)})")
    roles = union([all_of(text, rf"(?i)\b({p})\b") for p in ("|".join(K.ROLE_TERMS[:-1]), K.ROLE_TERMS[-1])])
    items = let(F.lower(text), lambda low: union([
        F.transform(where(low, any_case(p), words), lambda x: F.trim(x)) for p, words in zip(K.DELIVERABLE_TERMS, K.DELIVERABLE_NEEDS)]))
    timeline = let(F.lower(text), lambda low: union([
        where(low, any_case(p), words, 1 if i == 0 else 0) for i, (p, words) in enumerate(zip(K.TIMELINE_TERMS, K.TIMELINE_NEEDS))]))
    budget = let(F.lower(text), lambda low: union([where(low, any_case(p), words, 0) for p, words in zip(K.BUDGET_TERMS[:2], K.BUDGET_NEEDS)] +
                                                  [all_of(text, any_case("|".join(K.BUDGET_TERMS[2:])), 0)]))
    clients = F.array_compact(F.array(*[F.trim(find(text, any_case(p))) for p in K.CLIENT_TERMS]))
    sentences = _first_few(F.split(text, r"[.!?]+"), most_sentences)
    phrases = F.filter(F.transform(F.filter(sentences, lambda s: any_word(s, K.KEY_PHRASE_WORDS)), lambda s: F.btrim(s, F.lit(SPACES))), lambda s: F.length(s) > 20)
    return F.struct(
        F.length(text).alias("text_length"),
        _sorted_distinct(sections).alias("sections"), _sorted_distinct(roles).alias("roles"),
        _first_few(items, most_items).alias("deliverables"), _sorted_distinct(timeline).alias("timeline"),
        _sorted_distinct(budget).alias("budget"), clients.alias("clients"),
        _first_few(phrases if longest_phrase is None else F.transform(phrases, lambda s: F.substring(s, 1, longest_phrase)), most_items).alias("key_phrases"),
        (text if sample_chars is None else F.substring(text, 1, sample_chars)).alias("sample"))


# --- staffing windows and rows ---------------------------------------------------------------


def staffing_windows(text: Column, words: list[str] | None = None, before: int = 3, after: int = 15) -> Column:
    """Windows of lines around each line with a staffing word (-3/+15; the wide form is -5/+20)."""
    def windows(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.when(any_word(x, words or K.WINDOW_WORDS), i))

        def window(i: Column) -> Column:
            first = F.greatest(i - before, F.lit(0))
            return F.array_join(F.slice(lines, first + 1, i + after - first), "\n")

        return F.transform(F.filter(marked, lambda i: i.isNotNull()), window)

    return let(F.split(text, "\n"), windows)


def best_staffing_window(text: Column, longest_block: int | None = None) -> Column:
    """The title-discipline block where there is one, whole or up to ``longest_block`` characters, else the longest window, the first on a tie."""
    at = F.instr(text, K.TITLE_BLOCK)
    ranked = F.transform(staffing_windows(text), lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w")))
    return F.when(at > 0, F.substring(text, at, F.length(text) if longest_block is None else F.lit(longest_block))).otherwise(F.array_max(ranked)["w"])


def _spans(text: Column, pattern: str, before: int | None, after: int | None) -> Column:
    """Every match of a pattern with its context: so many characters, or all from the match before and up to the next one."""
    state = "struct<pos:int,out:array<struct<first:int,end:int>>>"

    def step(acc: Column, hit: Column) -> Column:
        at = F.call_function("locate", hit, text, acc["pos"])
        end = at + F.length(hit)
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(at.alias("first"), end.alias("end")))).alias("out"))

    start = F.struct(F.lit(1).alias("pos"), F.array().cast("array<struct<first:int,end:int>>").alias("out")).cast(state)

    def context(hits: Column) -> Column:
        def around(h: Column, i: Column) -> Column:
            first = F.greatest(h["first"] - before, F.lit(1)) if before is not None else F.coalesce(F.get(hits, i - 1)["end"], F.lit(1))
            end = h["end"] + after if after is not None else F.coalesce(F.get(hits, i + 1)["first"], F.length(text) + 1)
            return F.substring(text, first, end - first)

        return F.transform(hits, around)

    return let(F.aggregate(all_of(text, pattern, 0), start, step)["out"], context)


def staffing_sections(text: Column, before: int | None = None, after: int | None = None, loose_after: int | None = None) -> Column:
    """Staffing sections with context by their opening words, else any text around a staffing word.

    The context reaches from the section before to the next one, or ``before``
    and ``after`` characters (``loose_after`` around a mere word).
    """
    named = F.flatten(F.array(*[_spans(text, rf"(?is){p}.*?{STOP}", before, after) for p in K.SECTION_STARTS]))
    loose = _spans(text, rf"(?is)(?:staffing|team|personnel|resource|allocation).*?{STOP}", before, loose_after)
    return F.when(F.size(named) > 0, named).otherwise(F.filter(loose, lambda s: F.length(s) > 100))


def staffing_rows(text: Column) -> Column:
    """Array of struct(name, role, primary_role, percentage, location), the first row of a name wins."""
    who = r"([A-Z][a-z]+\s+[A-Z][a-z]+)\s+"
    header = r"(?i)project\s+staffing\s+plan\s+name\s+role\s+primary\s+role\s+%\s+primary\s+location"
    behind_block = r"(?i)\n\n[A-Z][a-z]+\s+[A-Z]|Total\s+\$|Fee\s+In\s+consideration"
    block_of = lambda t: F.coalesce(F.get(F.split(F.get(F.split(t, header, 2), F.lit(1)), behind_block, 2), F.lit(0)), F.lit(""))
    tail = r"\s+([^%]+?)\s+(\d+%)\s+"

    names = ["name", "role", "primary_role", "percentage", "location"]

    def rows(source: Column, pattern: str, ahead: str = "") -> Column:
        # one search over the text; the parts come from the short match itself
        whole = F.transform(all_of(source, pattern + ahead, 0), lambda m: F.struct(*[
            F.trim(F.regexp_replace(F.regexp_extract(m, pattern + r"\z", i + 1), r"\s+", " ")).alias(n)
            for i, n in enumerate(names)]))
        return F.when(source.rlike(r"\d%"), whole).otherwise(F.slice(whole, 1, 0))

    def until_last(t: Column) -> Column:
        # nothing after the word behind the last percent sign can belong to a row
        return let(F.substring_index(t, "%", -1), lambda behind: F.concat(
            F.substring(t, F.lit(1), F.length(t) - F.length(behind)), F.regexp_extract(behind, r"^\s+\S+", 0)))

    def found(block: Column, body: Column) -> Column:
        lines = F.flatten(F.transform(F.split(block, "\n"), lambda ln: let(F.trim(ln), lambda x: rows(
            x, rf"(?i)^{who}([A-Z]{{1,4}}){tail}([^%]+?)", r"\z"))))
        return F.concat(lines, rows(block, rf"(?i){who}([A-Z]{{1,4}}){tail}([^%]+?)", r"(?=\s+[A-Z][a-z]+\s+[A-Z]|\z)"),
                        rows(body, rf"(?i){who}([A-Z]{{2,4}}){tail}([^%]+?)", r"(?=\s|\z)"),
                        rows(body, rf"(?i){who}([A-Z]{{1,4}}){tail}([^%]+?)", r"(?=\s|\z)"))

    every = let(text, lambda t: let(block_of(t), lambda block: let(until_last(t), lambda body: found(block, body))))
    first = lambda rs, keys: F.filter(rs, lambda r, i: F.array_position(keys, F.lower(r["name"])) == i + 1)
    return let(every, lambda rs: let(F.transform(rs, lambda r: F.lower(r["name"])), lambda keys: first(rs, keys)))


def roles_hours_fte(text: Column) -> Column:
    """struct(roles, hours, fte): ordered distinct lists."""
    join = lambda ps, cast=None: F.array_distinct(F.flatten(F.array(*[
        F.transform(all_of(text, any_case(p)), lambda x: x.try_cast(cast) if cast else x) for p in ps])))
    roles = F.filter(join([f"({p})" for p in K.ROLE_LIST_TERMS]), lambda r: F.length(r) > 3)
    return F.struct(roles.alias("roles"), join(K.HOUR_TERMS, "int").alias("hours"), join(K.FTE_TERMS, "double").alias("fte"))


def role_values(text: Column) -> Column:
    """Array of struct(role, value, type) for wording such as 'Planner 40 hours'.

    One search over the text goes from run of letters to run of letters and
    takes each whole, with its number or without, so no character starts a
    second try; the parts come from the short match itself.
    """
    letters = string.ascii_letters + r"\x20\t\n\x0B\f\r"  # a class of single characters is a table look-up, ranges are not
    run = f"[{letters}]"
    none = F.array().cast("array<string>")

    def pairs(number: str, unit: str, word: str) -> Column:
        ends = rf"{number}{unit}"
        whole = F.filter(all_of(text, rf"({run}{run}++(?<=\s)(?i:{ends}))|{run}++[^{letters}]*+|[^{letters}]++"), lambda w: w != "")
        # without the word of its unit a text has no match
        found = F.when(~F.lower(text).contains(word), none).otherwise(whole)
        return F.transform(found, lambda w: F.struct(
            F.btrim(F.regexp_extract(w, rf"^{run}+", 0), F.lit(SPACES)).alias("role"),
            F.regexp_extract(w, rf"^{run}+({number})", 1).try_cast("double").alias("value"),
            F.when(F.lower(w).contains("fte") | w.contains("%"), "fte").otherwise("hours").alias("type")))

    return F.concat(*[pairs(*t) for t in K.ROLE_VALUE_PARTS])


# --- summary ---------------------------------------------------------------------------------------


def extractive_summary(text: Column, project_lines: int | None = None, description_lines: int | None = None, description_chars: int | None = None,
                       item_lines: int | None = None, items: int | None = None, sentences: int | None = None, opening_chars: int | None = None) -> Column:
    """Project, term, description and deliverables; else the first sentences.

    All lines after a label count, all items are listed and nothing is cut,
    unless a limit is given: lines after the project and the description,
    lines searched for items, items listed, sentences without any label, and
    characters of the description and of these sentences.
    """
    limits = (project_lines, description_lines, description_chars, item_lines, items, sentences, opening_chars)
    return let(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda lines: _summary(text, lines, *limits))


def _first_lines(lines: Column) -> Column:
    """struct of the first line of each label, null without it."""
    def places(lows: Column) -> Column:
        first = lambda words: F.array_min(F.transform(lows, lambda x, i: F.when(any_word(x, words, lowered=True), i)))
        return F.struct(first(["project:", "title of project:"]).alias("project"), first(["term of project:", "start date:"]).alias("term"),
                        first(["description:", "scope of work:"]).alias("description"), first(["deliverables:"]).alias("items"))

    return let(F.transform(lines, lambda x: F.lower(x)), places)


def _shortened(text: Column, most: int | None) -> Column:
    return text if most is None else let(text, lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t))


def _summary(text: Column, lines: Column, project_lines: int | None, description_lines: int | None, description_chars: int | None, item_lines: int | None,
             most_items: int | None, sentences: int | None, opening_chars: int | None) -> Column:
    def after(i: Column, n: int | None) -> Column:
        return F.slice(lines, i + 2, F.size(lines) if n is None else F.lit(n))

    def follow(i: Column, n: int | None, longer: int) -> Column:
        return F.array_join(F.concat(F.array(F.get(lines, i)), F.filter(after(i, n), lambda x: F.length(x) > longer)), " ")

    def listed(items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit("**Key Deliverables:**\n\n"), F.array_join(
            F.transform(items, lambda x: F.concat(F.lit("• "), x)), "\n\n")))

    def parts(at: Column) -> Column:
        p, t, d, v = (at[k] for k in ("project", "term", "description", "items"))
        skip = lambda x: x.startswith("project") | x.startswith("term") | x.startswith("fee") | x.startswith("agreement")
        items = _first_few(F.filter(after(v, item_lines), lambda x: (x != "") & ~skip(x)), most_items)
        return F.concat_ws("\n\n",
                           F.concat(F.lit("**Project:** "), F.when(p.isNotNull(), follow(p, project_lines, 0))),
                           F.concat(F.lit("**Term:** "), F.when(t.isNotNull(), F.get(lines, t))),
                           F.concat(F.lit("**Description:** "), F.when(d.isNotNull(), _shortened(follow(d, description_lines, 10), description_chars))),
                           F.when(v.isNotNull(), let(items, listed)))

    opening = _shortened(F.concat(F.array_join(_first_few(F.split(text, r"\."), sentences), ". "), F.lit(".")), opening_chars)
    return let(let(_first_lines(lines), parts), lambda found: F.when(found != "", found).otherwise(F.concat(F.lit("**Summary:** "), opening)))


# --- allocation records, layout text --------------------------------------------------------


def to_allocation(title: Column, pct: Column, hours: Column) -> Column:
    """struct(name, role, allocation, pct_time, hours): the first word is the name, the rest the role."""
    text = F.concat_ws(" ", title, F.concat(pct.cast("decimal(20,1)").cast("string"), F.lit("%")),
                       F.concat(hours.cast("decimal(20,1)").cast("string"), F.lit(" hours")))
    a = normalize_allocation(text)
    parts = F.split(title, " ", 2)
    two = F.size(parts) > 1
    label = (F.when(F.coalesce(a["pct_time"], F.lit(0.0)) != 0, percent_text(a["pct_time"]))
             .when(F.coalesce(a["hours"], F.lit(0.0)) != 0, F.concat(a["hours"].cast("string"), F.lit(" hours")))
             .otherwise(F.lit("N/A")))
    return F.struct(F.when(two, F.get(parts, F.lit(0))).otherwise(F.lit("N/A")).alias("name"),
                    F.when(two, F.get(parts, F.lit(1))).otherwise(title).alias("role"), label.alias("allocation"),
                    a["pct_time"].alias("pct_time"), a["hours"].alias("hours"), a["months"].alias("months"))


def layout_text(lines: DataFrame) -> DataFrame:
    """(file, text) from page lines (file, page, line_no, content); pages are joined by a blank line."""
    def joined(col: str, order: str, sep: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, col))), lambda x: x[col]), sep)

    pages = (lines.where(F.col("content") != "").groupBy("file", "page")
             .agg(joined("content", "line_no", "\n").alias("page_text")))
    return pages.groupBy("file").agg(joined("page_text", "page", "\n\n").alias("text"))


def layout_lines(lines: DataFrame) -> DataFrame:
    """(file, position, line) of the text that ``layout_text`` makes, in lines: pages are parted by a blank line.

    Nothing is brought together, so a file may be larger than a task's memory:
    its lines are numbered by a sort that spills.
    """
    order = Window.partitionBy("file").orderBy("page", "line_no", "content")
    kept = lines.where(F.col("content") != "").select("file", "page", "line_no", "content")
    numbered = kept.select("file", "content", F.row_number().over(order).alias("_n"), (F.lag("page").over(order) != F.col("page")).alias("_new"),
                           F.dense_rank().over(Window.partitionBy("file").orderBy("page")).alias("_page"))
    # A page after the first has its blank line in front of it.
    rows = F.when(F.col("_new"), F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("line")), F.struct(F.lit(1).alias("i"), F.col("content").alias("line")))) \
        .otherwise(F.array(F.struct(F.lit(1).alias("i"), F.col("content").alias("line"))))
    return numbered.select("file", F.col("_n").alias("n"), F.col("_page").alias("p"), F.explode(rows).alias("r")) \
        .select("file", (F.col("n") + F.col("p") - 2 + F.col("r.i")).alias("position"), "r.line")


def write_layout(lines: DataFrame, path: str) -> None:
    """The text of every file, as text parts in its own folder ``file=...``, whose names are in the order of the text."""
    rows = layout_lines(lines)
    dealt = rows.repartitionByRange("file", "position").sortWithinPartitions("file", "position")
    dealt.select("file", "line").write.partitionBy("file").text(path)
