"""Keyword, near-match, synonym, ranked, vector and blended search.

Query words are few and known when the plan is built, so every text match is a
row-wise expression: no token table is shuffled. Ranking needs the collection
figures of the query words only, which one aggregate supplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sowmill import constants as K
from sowmill.functions.scalars import plain_text
from sowmill.functions.vectors import knn, nearest_join
from sowmill.operators.ranking import dedup_best, top_per_group
from sowmill.operators.relate import attach_staffing, blend, blend_top

WORD_BREAK = r"[^\p{L}\p{N}_]+"
K1, B_LEN = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda x: x != "")


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


# --- expansion --------------------------------------------------------------------------------


def expand_terms(query: str, synonyms: dict[str, list[str]]) -> list[str]:
    """Query terms, each followed by its synonyms, in first order."""
    return list(dict.fromkeys(t for q in query.lower().split() for t in (q, *synonyms.get(q, []))))


def expand_synonyms(query: Column, synonyms: dict[str, list[str]]) -> Column:
    """The same for a column of queries, joined by spaces."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    none = F.array().cast("array<string>")
    each = F.transform(F.split(F.lower(F.trim(query)), r"\s+"),
                       lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none)))
    return F.array_join(F.array_distinct(F.flatten(each)), " ")


# --- matching one term against the tokens of a row ---------------------------------------------


def exact_hit(toks: Column, term: str) -> Column:
    return F.array_contains(toks, F.lit(term))


def fuzzy_hit(toks: Column, term: str) -> Column:
    """Equal, or for terms over two characters a prefix or one edit away."""
    if len(term) <= 2:
        return exact_hit(toks, term)
    return F.exists(toks, lambda x: x.startswith(F.lit(term)) | (F.levenshtein(x, F.lit(term), 1) >= 0))


def phonetic_hit(toks: Column, term: str, sound: bool = True) -> Column:
    """Equal, or for terms over three characters two edits away, the listed variant, or the same sound code."""
    if len(term) <= 3:
        return exact_hit(toks, term)
    names = [term, *([K.SOUND_ALIKE[term]] if term in K.SOUND_ALIKE else [])]

    def like(x: Column) -> Column:
        near = x.isin(*names) | (F.levenshtein(x, F.lit(term), 2) >= 0)
        return near | (F.soundex(x) == F.soundex(F.lit(term))) if sound else near

    return F.exists(toks, like)


def synonym_hit(toks: Column, term: str, synonyms: dict[str, list[str]]) -> Column:
    """The term or one of its synonyms; a synonym of several words needs all of them."""
    hit = exact_hit(toks, term)
    for s in synonyms.get(term, []):
        hit = hit | all_hits(toks, s.split(), exact_hit)
    return hit


def all_hits(toks: Column, terms: list[str], hit, mode: str = "all") -> Column:
    out = F.lit(mode == "all")
    for t in terms:
        out = (out & hit(toks, t)) if mode == "all" else (out | hit(toks, t))
    return out


# --- ranked keyword search -----------------------------------------------------------------------


def with_tokens(df: DataFrame, fields: dict[str, float]) -> DataFrame:
    """Token arrays per field, and all of them together."""
    text = lambda f: F.array_join(f, " ") if dict(df.dtypes)[f].startswith("array") else F.col(f)
    out = df.select("*", *[tokens(text(f)).alias(f"_t_{f}") for f in fields])
    return out.withColumn("_tokens", F.concat(*[F.col(f"_t_{f}") for f in fields]) if len(fields) > 1
                          else F.col(f"_t_{next(iter(fields))}"))


def with_bm25(df: DataFrame, fields: dict[str, float], terms: list[str], chosen=lambda term: F.lit(True)) -> DataFrame:
    """Add ``score``: BM25 over field-weighted term counts (needs the tokens of ``with_tokens``), of the terms that ``chosen`` admits."""
    # terms are counted among the tokens that are a term, which are few
    df = df.select("*", *[F.filter(f"_t_{f}", lambda x: x.isin(*terms)).alias(f"_h_{f}") for f in fields])
    count = lambda f, t: F.size(F.filter(f"_h_{f}", lambda x: x == t))
    weighted = [sum((count(f, t) * float(w) for f, w in fields.items()), F.lit(0.0)) for t in terms]
    counted = df.select("*", *[w.alias(f"_w{i}") for i, w in enumerate(weighted)], F.size("_tokens").alias("_len"))
    stats = counted.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg_len"),
        *[F.count_if(F.col(f"_w{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).alias("s"))
    known = counted.withColumn("_s", stats.scalar())
    score = F.lit(0.0)
    for i in range(len(terms)):
        df_i, w = F.col(f"_s.d{i}"), F.col(f"_w{i}")
        idf = F.log(1 + (F.col("_s.n") - df_i + 0.5) / (df_i + 0.5))
        norm = K1 * (1 - B_LEN + B_LEN * F.try_divide(F.col("_len"), F.col("_s.avg_len")))
        score = score + F.when((w > 0) & chosen(terms[i]), idf * w * (K1 + 1) / (w + norm)).otherwise(0.0)
    drop = [f"_w{i}" for i in range(len(terms))] + [f"_h_{f}" for f in fields] + ["_len", "_s"]
    return known.withColumn("score", F.round(score, 6)).drop(*drop)


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_t")])


def search_rows(df: DataFrame, query: str, fields: dict[str, float], mode: str = "all") -> DataFrame:
    """Matching rows with ``score``; ``*`` matches every row with score 0."""
    if query.strip() == "*":
        return df.withColumn("score", F.lit(0.0))
    terms = terms_of(query)
    scored = with_bm25(with_tokens(df, fields), fields, terms)
    toks = F.col("_tokens")
    # one look at each token, however many terms there are
    return _plain(scored.where(F.exists(toks, lambda x: x.isin(*terms)) if mode == "any" else all_hits(toks, terms, exact_hit)))


def keyword_search(df: DataFrame, query: str, fields: list[str], key: str, where: Column | None = None,
                   top: int = 50, skip: int = 0, mode: str = "all") -> DataFrame:
    """One page of the rows that hold all (or any) query terms in the chosen fields, best first."""
    rows = df.where(where) if where is not None else df
    return (search_rows(rows, query, {f: 1.0 for f in fields}, mode)
            .orderBy(F.col("score").desc(), key).offset(skip).limit(top))


def ranked_search(df: DataFrame, query: str, key: str, weights: dict[str, float] | None = None, top: int | None = 10) -> DataFrame:
    """Any-term search ranked with field priorities: title before content before keyword fields; ``top`` None keeps all hits."""
    ordered = search_rows(df, query, weights or K.SEARCH_FIELD_WEIGHTS, mode="any").orderBy(F.col("score").desc(), key)
    return ordered if top is None else ordered.limit(top)


def search_by_field(df: DataFrame, field: str, value: str, key: str, top: int = 50) -> DataFrame:
    return keyword_search(df, value, [field], key, top=top)


def search_by_date_range(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows that start on or after ``first`` and end on or before ``last``; either side may be open."""
    out = df
    if first:
        out = out.where(F.col("start_date") >= F.lit(first).cast("date"))
    if last:
        out = out.where(F.col("end_date") <= F.lit(last).cast("date"))
    return out


def near_search(df: DataFrame, query: str, fields: list[str], hit=fuzzy_hit, mode: str = "all", every: str | None = None) -> DataFrame:
    """Rows whose tokens match the query terms under ``hit`` (fuzzy, phonetic or synonym matching).

    ``every`` adds a column of that name which tells whether all terms match.
    """
    toks = with_tokens(df, {f: 1.0 for f in fields})
    hits = [hit(F.col("_tokens"), t) for t in terms_of(query)]
    flags = toks.withColumn("_t_hits", F.array(*hits) if hits else F.array().cast("array<boolean>"))
    test = F.forall if mode == "all" else F.exists
    found = flags.where(test("_t_hits", lambda x: x))
    return _plain(found if every is None else found.withColumn(every, F.forall("_t_hits", lambda x: x)))


def term_search(df: DataFrame, query: str, fields: list[str], key: str, top: int | None = None) -> DataFrame:
    """(term, key, score, rank) of the rows of each query term over two characters: all of them, or half of ``top`` per term."""
    terms = [t for t in terms_of(query) if len(t) > 2]
    weights = {f: 1.0 for f in fields}
    scored = with_bm25(with_tokens(df, weights), weights, terms)
    hits = F.array_compact(F.array(*[F.when(exact_hit(F.col("_tokens"), t), F.lit(t)) for t in terms]))
    rows = scored.select(key, "score", F.explode(hits).alias("term"))
    order = [F.col("score").desc(), F.col(key)]
    if top is not None:
        return top_per_group(rows, ["term"], order, top // 2)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(*order)))


def multi_search(df: DataFrame, query: str, ladder: str, fields: list[str], key: str, synonyms: dict[str, list[str]],
                 top: int | None = 20, vector_hits: DataFrame | None = None, sound: bool = True) -> DataFrame:
    """(key, priority, search_strategy, strategy_score) of a strategy ladder.

    All text strategies are judged in one pass over the rows. The first
    strategy of the ladder that matches a row owns it, whatever else matches
    more rows; the best ``top`` of all owned rows are returned.
    """
    steps = K.LADDERS[ladder]
    terms = terms_of(query)
    toks = F.col("_tokens")
    flags = {
        "exact_match": lambda: all_hits(toks, terms, exact_hit),
        "semantic_lexical": lambda: all_hits(toks, terms, exact_hit),
        "fuzzy_match": lambda: all_hits(toks, terms, fuzzy_hit),
        "phonetic_match": lambda: all_hits(toks, terms, lambda x, t: phonetic_hit(x, t, sound)),
        "synonym_match": lambda: all_hits(toks, terms, lambda x, t: synonym_hit(x, t, synonyms)),
        "term_match": lambda: all_hits(toks, [t for t in terms if len(t) > 2], exact_hit, "any") if len(terms) > 1 else F.lit(False),
    }
    owner = F.lit(None)
    for priority, (name, score) in reversed(list(enumerate(steps))):
        if name in flags:
            entry = F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("search_strategy"), F.lit(float(score)).alias("strategy_score"))
            owner = F.when(flags[name](), entry).otherwise(owner)
    # The first test that holds ends the row, and the tokens are made once.
    owned = with_tokens(df, {f: 1.0 for f in fields}).select(key, owner.alias("_o")).where(F.col("_o").isNotNull()).select(key, "_o.*")
    if vector_hits is not None and steps[0][0] == "semantic_vector":
        name, score = steps[0]
        first = vector_hits.select(key, F.lit(0).alias("priority"), F.lit(name).alias("search_strategy"), F.lit(float(score)).alias("strategy_score"))
        both = F.struct("priority", "search_strategy", "strategy_score")
        owned = owned.unionByName(first).groupBy(key).agg(F.min_by(both, F.col("priority")).alias("_o")).select(key, "_o.*")
    ordered = owned.orderBy(F.col("strategy_score").desc(), "priority", key)
    return ordered if top is None else ordered.limit(top)


# --- vectors and blends ---------------------------------------------------------------------------


def hybrid_text_vector(text_hits: DataFrame, vector_hits: DataFrame, key: str, k: int, fusion: str = "weighted") -> DataFrame:
    """The ``k`` best of all text hits and all vector hits (key, score).

    ``weighted`` adds 0.3 x text score over the best text score and 0.7 x cosine;
    ``rrf`` adds the weighted reciprocals of 60 + rank in either list.
    """
    labels = ("text", "vector", "hybrid")
    if fusion == "weighted":
        best = text_hits.agg(F.max("score").alias("m")).scalar()
        text = text_hits.select(key, F.coalesce(F.try_divide(F.col("score"), best), F.lit(0.0)).alias("score"))
        out = blend_top(text, vector_hits, key, K.TEXT_WEIGHT, K.VECTOR_WEIGHT, labels, k)
    elif fusion == "rrf":
        out = _reciprocal_ranks(text_hits, vector_hits, key, k, labels)
    else:
        raise ValueError(f"unknown fusion {fusion}")
    return out.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), key).limit(k)


def _reciprocal_ranks(text_hits: DataFrame, vector_hits: DataFrame, key: str, k: int, labels: tuple[str, str, str]) -> DataFrame:
    """Sums of weight / (60 + rank) of the keys that can be among the ``k`` best.

    The k-th key of a list has the smaller weight / (60 + k) at least, and a
    key with less than half of that in both lists stays below it, so a key of
    the result has a bounded rank in one list. Its rank in the other is counted.
    """
    weights = (K.TEXT_WEIGHT, K.VECTOR_WEIGHT)
    half = min(weights) / (60 + k) / 2
    order = [F.col("score").desc(), F.col(key)]
    # Both lists are read several times; their shuffle is made once and used again.
    lists = [d.select(key, "score").repartition(key) for d in (text_hits, vector_hits)]
    heads = [d.orderBy(*order).limit(int(w / half) - 59) for d, w in zip(lists, weights, strict=True)]
    kept = heads[0].select(key).union(heads[1].select(key)).distinct().select(F.col(key).alias("_kept")).where(F.col("_kept").isNotNull())
    ranked = []
    for d in lists:
        # a join that puts no filter of its own below the shuffle
        asked = d.join(kept, F.col(key).eqNullSafe(F.col("_kept"))).drop("_kept")
        # Rows before a kept one: every row falls behind the kept rows that are better, and counts are added up over these places.
        own = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))
        places = asked.agg(F.array_sort(F.collect_list(own)).alias("p"))
        # A row's place is found by halving: steps of falling powers of two, as many as the list of kept rows needs.
        steps = F.transform(F.sequence(F.ceil(F.log2(F.size("p") + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda x: F.call_function("shiftleft", F.lit(1), x))
        known = d.withColumn("_p", places.select(F.struct("p", steps.alias("steps"))).scalar())
        at_place = F.aggregate("_p.steps", F.lit(0), lambda at, step: F.when(F.get("_p.p", at + step - 1) <= own, at + step).otherwise(at))
        behind = known.select(at_place.alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
        before = behind.withColumn("before", F.sum("rows").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)))
        at = asked.select(key, F.row_number().over(Window.orderBy(*order)).alias("n"))
        ranked.append(at.join(before, "n", "left").select(key, (1.0 / (61 + F.coalesce("before", F.lit(0)))).alias("score")))
    return blend(*ranked, key, *weights, labels).orderBy(F.col("score").desc(), key).limit(k)


def hybrid_two_vector(docs: DataFrame, query_vector: list[float], k: int, first: str, second: str, key: str, name: str,
                      w1: float = K.FULL_TEXT_WEIGHT, w2: float = K.PARSED_WEIGHT) -> DataFrame:
    """The ``k`` best names by the weighted cosines of two vectors over all rows, best row per name, with the strategy label.

    Both cosines of a row are known when it is read, so nothing is cut before
    they are added; a row without one of the vectors is scored by the other.
    """
    asked = docs.sparkSession.createDataFrame([(0, [float(x) for x in query_vector])], "query_id long, query_vector array<double>")
    rows = docs.where(F.col(first).isNotNull() | F.col(second).isNotNull())
    best = nearest_join(rows, asked, k, key, "query_id", [(first, "query_vector", w1), (second, "query_vector", w2)], name)
    label = F.when(F.col(second).isNull(), "hybrid_full_text").when(F.col(first).isNull(), "hybrid_parsed").otherwise("hybrid_combined")
    named = best.select(key, "score").join(rows.select(key, name, label.alias("strategy")), key)
    return named.orderBy(F.col("score").desc(), key)


def min_score(df: DataFrame, floor: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= floor)


def recommend_similar(corpus: DataFrame, row: DataFrame, key: str, top: int = 3, client: str | None = None,
                      length: str | None = None, scope_chars: int | None = None, deliverables: int | None = None) -> DataFrame:
    """Past SOWs whose wording is most like the one in ``row``: its client, title, scope and deliverables are the query.

    ``scope_chars`` and ``deliverables`` use only so much of the scope and so
    many deliverables. The best SOW per file is kept before the cut.
    """
    scope = F.col("scope_summary") if scope_chars is None else F.substring("scope_summary", 1, scope_chars)
    items = F.col("deliverables") if deliverables is None else F.slice("deliverables", 1, deliverables)
    text = plain_text(F.col("client_name"), F.col("project_title"), scope, F.array_join(items, " "))
    terms = row.select(F.array_distinct(tokens(text)).alias("t"), F.col(key)).first()
    if terms is None or not terms[0]:
        return corpus.withColumn("score", F.lit(0.0)).limit(0)
    rows = corpus.where(F.col(key) != terms[1])
    if client:
        rows = rows.where(F.col("client_name") == client)
    if length:
        rows = rows.where(F.col("project_length") == length)
    hits = search_rows(rows, " ".join(terms[0]), K.SEARCH_FIELD_WEIGHTS, mode="any")
    return dedup_best(hits, "file_name", key, "score").orderBy(F.col("score").desc(), key).limit(top)


def similar_sows(corpus: DataFrame, asked: DataFrame, key: str, first: str, second: str, name: str = "file_name", top: int = 3,
                 same: tuple[str, ...] = (), structured: DataFrame | None = None, w1: float = K.FULL_TEXT_WEIGHT, w2: float = K.PARSED_WEIGHT) -> DataFrame:
    """(asked_key, key, score, rank, ...) of the ``top`` past SOWs most like each asked SOW by two vectors, with their staffing.

    ``asked`` has the columns of ``corpus``; a SOW is never like itself. Each
    column of ``same`` filters by the asked row's value where it has one. The
    best SOW per file is kept before the cut. Structured staffing
    (key, staffing_structured) is preferred to the ``staffing_plan`` of the row.
    """
    theirs = asked.select(F.col(key).alias("asked_key"), F.col(first).alias("_v1"), F.col(second).alias("_v2"), *[F.col(c).alias(f"_same_{c}") for c in same])
    best = nearest_join(corpus, theirs, top, key, "asked_key", [(first, "_v1", w1), (second, "_v2", w2)], name,
                        same=tuple((c, f"_same_{c}") for c in same), differ=((key, "asked_key"),))
    hits = best.join(corpus.drop(first, second), key)
    return hits if structured is None else attach_staffing(hits, structured, key)


def find_similar_ids(df: DataFrame, query: str, fields: list[str], key: str, k: int) -> DataFrame:
    return keyword_search(df, query, fields, key, top=k).select(key)


# --- company views ----------------------------------------------------------------------------------


def company_projects(df: DataFrame, company: str, key: str, top: int | None = None) -> DataFrame:
    """All projects of a company in order of their keys, or the first ``top``."""
    rows = df.where(F.col("client_name") == company).orderBy(key)
    return rows if top is None else rows.limit(top)


def similar_elsewhere(df: DataFrame, company: str, category: str | Column | None, fields: list[str], key: str, top: int | None = None) -> DataFrame:
    """Projects of other companies that hold a word of the category, best first; everything when the category has no words.

    The category may be a value that is not known before the query runs, such
    as ``DataFrame.scalar()``.
    """
    others = df.where(F.col("client_name") != company)
    weights = {f: 1.0 for f in fields}
    known = category if isinstance(category, Column) else F.lit(category)
    words = sorted({w for ws in K.CATEGORY_SEARCH_TERMS.values() for w in ws})
    table = F.create_map(*[x for c, ws in K.CATEGORY_SEARCH_TERMS.items() for x in (F.lit(c), F.array(*[F.lit(w) for w in ws]))])
    chosen = F.coalesce(F.try_element_at(table, known), F.array().cast("array<string>"))
    scored = with_bm25(with_tokens(others.withColumn("_words", chosen), weights), weights, words, lambda t: F.array_contains("_words", t))
    hits = _plain(scored.where((F.size("_words") == 0) | F.arrays_overlap("_words", "_tokens"))).drop("_words")
    ordered = hits.orderBy(F.col("score").desc(), key)
    return ordered if top is None else ordered.limit(top)


def company_analysis(sow: DataFrame, company: str, key: str, shown: int | None = 5) -> dict[str, DataFrame]:
    """Projects, type counts, top roles, role usage, team size, main type, advice and similar work elsewhere.

    All projects of the company count; ``shown`` only pages the list of similar
    work. ``sow`` needs client_name, project_title, deliverables, staffing_plan
    (display strings).
    """
    from sowmill.functions.classify import project_category
    from sowmill.operators import report as R

    mine = sow.where(F.col("client_name") == company).withColumn("kind", project_category(F.col("deliverables"), F.col("project_title")))
    entries = mine.select(F.explode("staffing_plan").alias("display"))
    sized = mine.withColumn("n", F.size("staffing_plan"))
    main = R.mode_type(mine, "kind", key)
    advice = F.create_map(*[x for c, a in K.CATEGORY_ADVICE.items() for x in (F.lit(c), F.array(*[F.lit(s) for s in a]))])
    hints = R.type_counts(mine, "kind").select("kind", F.explode(F.try_element_at(advice, F.col("kind"))).alias("advice"))
    return {
        "projects": mine, "types": R.type_counts(mine, "kind"), "roles": R.top_roles(entries, "display"),
        "usage": R.role_usage(entries, "display", mine), "team": R.avg_team_size(sized, "n"), "main_type": main,
        "advice": hints, "elsewhere": similar_elsewhere(sow, company, main.select("most_common_type").scalar(), ["project_title"], key, shown),
    }


# --- choice by name, local vectors ---------------------------------------------------------------

SEARCHES = {
    "keyword": keyword_search, "ranked": ranked_search, "field": search_by_field, "date_range": search_by_date_range,
    "near": near_search, "terms": term_search, "multi": multi_search, "hybrid_text_vector": hybrid_text_vector,
    "hybrid_two_vector": hybrid_two_vector, "knn": knn, "recommend": recommend_similar, "similar": similar_sows,
}


def search(kind: str, *args, **kwargs) -> DataFrame:
    """Run a search by its name; an unknown name is an error."""
    if kind not in SEARCHES:
        raise ValueError(f"unknown search type {kind!r}; known: {', '.join(sorted(SEARCHES))}")
    return SEARCHES[kind](*args, **kwargs)


def vectorize(df: DataFrame, text: str, size: int = 256, out: str = "vector") -> DataFrame:
    """Unit term vectors (hashed counts x inverse document frequency) for rows without vectors; blank text is dropped."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.where(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("_w", tokens(F.col(text)))
    counts = HashingTF(inputCol="_w", outputCol="_c", numFeatures=size).transform(words)
    weighted = IDF(inputCol="_c", outputCol="_i").fit(counts).transform(counts)
    unit = Normalizer(inputCol="_i", outputCol="_u").transform(weighted)
    return unit.withColumn(out, vector_to_array("_u")).drop("_w", "_c", "_i", "_u")
