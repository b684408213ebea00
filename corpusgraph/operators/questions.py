"""Classification, entity extraction and expansion of a ``(query_id, query)`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import (
    ascii_pattern, contains_any, count_contained, count_matches, extract_all, extract_lists, lookup, words_array)
from corpusgraph.operators.windows import distinct_terms
from corpusgraph.rules import query_rules as R


def classify_intent(texts: DataFrame, text_col: str = "query") -> DataFrame:
    """Adds ``intent`` and ``intent_confidence``; equal scores go to the earlier intent."""
    low = F.lower(F.col(text_col))
    scores = F.array(*[
        F.struct(
            (count_matches(low, R.INTENT_PATTERNS[i]) * R.PATTERN_WEIGHT
             + count_contained(low, R.INTENT_KEYWORDS[i])).alias("score"),
            F.lit(-n).alias("order"), F.lit(i).alias("intent"))
        for n, i in enumerate(R.INTENTS)])
    best = F.array_max(scores)
    out = texts.withColumn("_best", best)
    name, confidence = R.DEFAULT_INTENT
    none = F.col("_best.score") == 0
    return (
        out.withColumn("intent", F.when(none, name).otherwise(F.col("_best.intent")))
        .withColumn("intent_confidence", F.when(none, confidence).otherwise(
            F.least(F.col("_best.score") / R.INTENT_FULL_SCORE, F.lit(1.0))))
        .drop("_best"))


def expand_for_embedding(texts: DataFrame, technologies: str | None = None) -> DataFrame:
    """Adds ``expanded_query``: the query, its intent's phrases and, with a project context
    (``technologies`` names an array column, null = no context), technologies and project phrases."""
    phrases = F.coalesce(
        *[F.when(F.col("intent") == i, F.lit(" ".join(p))) for i, p in R.INTENT_PHRASES.items()])
    parts = [F.col("query"), phrases]
    if technologies:
        has = F.col(technologies).isNotNull()
        tech = F.when(has & (F.size(technologies) > 0), F.array_join(technologies, " "))
        parts += [tech, F.when(has, F.lit(" ".join(R.PROJECT_PHRASES)))]
    return texts.withColumn("expanded_query", F.concat_ws(" ", *parts))


def code_entities(texts: DataFrame, text_col: str = "query") -> DataFrame:
    """Adds ``functions``, ``classes``, ``files`` and ``variables`` arrays."""
    q = F.col(text_col)
    names = extract_all(q, R.VARIABLE_PATTERN)
    return (
        texts.withColumn("functions", extract_lists(q, R.FUNCTION_PATTERNS))
        .withColumn("classes", extract_lists(q, R.CLASS_PATTERNS))
        .withColumn("files", extract_lists(q, R.FILE_PATTERNS))
        .withColumn("variables", F.filter(names, lambda v: ~F.lower(v).isin(R.STOP_WORDS))))


def is_abstract(text: Column) -> Column:
    low = F.lower(text)
    return contains_any(low, R.ABSTRACT_WORDS) & ~contains_any(low, R.TECHNICAL_WORDS)


def abstract_terms(text: Column) -> Column:
    """Query, terms of every triggered group and the fixed terms, without repeats."""
    low = F.lower(text)
    none = words_array([])
    groups = [F.when(contains_any(low, words), words_array(terms)).otherwise(none)
              for words, terms in R.EXPANSION_GROUPS]
    return F.array_distinct(F.concat(F.array(text), *groups, words_array(R.ALWAYS_EXPAND)))


def search_terms(df: DataFrame) -> DataFrame:
    """Adds ``terms`` from ``query``, the entity arrays and ``related_components`` (all optional but query)."""
    def some(name: str, n: int) -> Column:
        return F.slice(F.col(name), 1, n) if name in df.columns else words_array([])

    def each(name: str, before: str, after: str = "") -> Column:
        return F.transform(some(name, 5), lambda x: F.concat(F.lit(before), x, F.lit(after)))

    terms = F.concat(
        F.array("query"), each("functions", "function "), each("functions", "def "),
        each("classes", "class "), each("classes", "", " implementation"),
        each("files", "file "), some("related_components", 10))
    return df.withColumn("terms", distinct_terms(terms, 20))


def expand_entities(df: DataFrame, related: DataFrame) -> DataFrame:
    """Add related names to the entity arrays by kind; a kind without an array, or a name already
    listed, goes to ``related_components``.

    ``related(query_id, rank, name, kind)`` is at most 50 rows per query (see related_entities).
    """
    lists = related.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "name", "kind"))).alias("_rel"))
    out = df.join(lists, "query_id", "left").withColumn("_rel", F.coalesce("_rel", F.array().cast(
        "array<struct<rank:int,name:string,kind:string>>")))
    for kind, col in (("function", "functions"), ("class", "classes"), ("file", "files")):
        new = F.transform(F.filter("_rel", lambda r: r["kind"] == kind), lambda r: r["name"])  # noqa: B023
        out = out.withColumn(f"_new_{kind}", new)
    known = {"function": "functions", "class": "classes", "file": "files"}

    def leftover(r, i):
        earlier = lambda kind: F.slice(F.col("_rel"), F.lit(1), i)
        listed = F.lit(False)
        for kind, col in known.items():
            before = F.exists(earlier(kind), lambda x: (x["kind"] == kind) & (x["name"] == r["name"]))
            listed = listed | ((r["kind"] == kind) & (F.array_contains(F.col(col), r["name"]) | before))
        return listed | ~r["kind"].isin(list(known))

    out = out.withColumn("related_components", F.transform(
        F.filter("_rel", leftover), lambda r: r["name"]))
    for kind, col in known.items():
        fresh = F.array_except(F.array_distinct(F.col(f"_new_{kind}")), F.col(col))
        out = out.withColumn(col, F.concat(F.col(col), fresh))
    return out.drop("_rel", *[f"_new_{k}" for k in known])


def search_filters(df: DataFrame) -> DataFrame:
    """Adds ``want_kind``, ``want_file`` and ``want_name`` (null = no filter); a class name wins."""
    first = {i: kinds[0] for i, kinds in R.PREFERRED_KINDS.items()}
    return (
        df.withColumn("want_kind", lookup(F.col("intent"), first))
        .withColumn("want_file", F.get("files", F.lit(0)))
        .withColumn("want_name", F.coalesce(F.get("classes", F.lit(0)), F.get("functions", F.lit(0)))))


def complexity_by_pattern(text: Column, mode: str = "regex") -> Column:
    """Complexity class of the planner; ``mode='literal'`` looks for the pattern texts themselves."""
    low = F.lower(text)
    out = F.lit("simple")
    for name in reversed(R.COMPLEXITY_ORDER):
        patterns = R.COMPLEXITY_PATTERNS[name]
        hit = contains_any(low, patterns) if mode == "literal" else low.rlike(
            "|".join(f"(?:{ascii_pattern(p)})" for p in patterns))
        out = F.when(hit, name).otherwise(out)
    return out


def complexity_by_score(n_words: Column, n_entities: Column, technical: Column) -> dict[str, Column]:
    score = ((n_words > 10).cast("int") + (n_entities > 3).cast("int") + technical.cast("int"))
    return {
        "complexity_score": score,
        "complexity_level": F.when(score >= 3, "complex").when(score >= 2, "moderate").otherwise("simple"),
        "recommended_enhanced": (score >= 1) | technical,
    }


def complexity_by_words(text: Column, content_length: Column) -> Column:
    """Complexity class of the role selection: keyword tiers, then length of query and code."""
    low = F.lower(text)
    long = (word_count(text) > 10) | (content_length > 5000)
    return F.when(contains_any(low, R.COMPLEX_WORDS), "complex").when(
        contains_any(low, R.MODERATE_WORDS) | long, "moderate").otherwise("simple")


def word_count(text: Column) -> Column:
    """Words separated by ASCII white space."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+"))


def plan_query(df: DataFrame) -> DataFrame:
    """``complexity`` and ``n_roles`` -> strategy, estimated seconds, streaming flag and hints."""
    c, n = F.col("complexity"), F.col("n_roles")
    seconds = lookup(c, R.PLAN_BASE_SECONDS) + n * R.PLAN_ROLE_SECONDS / R.PLAN_PARALLEL
    return (
        df.withColumn("strategy", F.when((c == "simple") & (n <= 2), "direct_search")
                      .when((c == "moderate") & (n <= 3), "focused_analysis")
                      .when(n <= 6, "multi_perspective").otherwise("comprehensive"))
        .withColumn("estimated_seconds", seconds)
        .withColumn("should_stream", seconds > R.PLAN_STREAM_SECONDS)
        .withColumn("expand_query", c.isin("complex", "architectural"))
        .withColumn("use_graph_search", n > 3)
        .withColumn("chunk_limit_per_role", F.when(n > 0, F.greatest(
            F.lit(10), F.floor(F.lit(100) / n).cast("int"))).otherwise(F.lit(10)))
        .withColumn("prioritize_architectural_files", c == "architectural")
        .withColumn("enable_entity_extraction", c != "simple"))


def mentions(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Names, relation triples, advice sentences and a two-sentence summary of free text.

    Distinct names keep their first-seen order, class-like ones first.
    """
    t = F.col(text_col)
    clean = F.trim(t)
    names = F.concat(F.array_distinct(extract_all(t, R.MENTION_CLASS)),
                     F.array_distinct(extract_all(t, R.MENTION_FUNCTION)))

    def triple(rel: str):
        return lambda a, b: F.struct(a.alias("from_name"), b.alias("to_name"), F.lit(rel).alias("relation"))

    triples = F.concat(*[F.zip_with(extract_all(t, p, 1), extract_all(t, p, 2), triple(rel))
                         for p, rel in R.RELATION_PATTERNS])
    advice = F.transform(F.concat(*[extract_all(t, p, 1) for p in R.ADVICE_PATTERNS]), lambda s: _strip(s))
    line = F.element_at(F.split(clean, "\n"), 1)
    sentences = F.split(line, "\\. ")
    return (
        texts.withColumn("components", F.slice(names, 1, 5))
        .withColumn("relations", F.slice(triples, 1, 3))
        .withColumn("advice", F.slice(F.filter(advice, lambda s: F.length(s) > 10), 1, 3))
        .withColumn("summary", F.when(
            F.size(sentences) >= 2, F.concat(F.array_join(F.slice(sentences, 1, 2), ". "), F.lit(".")))
            .when(F.length(line) > 200, F.concat(F.substring(line, 1, 200), F.lit("..."))).otherwise(line)))


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$", "")


def parse_sections(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Role report with ``### HEADER:`` lines -> analysis, insights, recs, confidence, focus.

    A repeated header keeps its last section; bullets start with ``-``, ``•`` or ``*`` (for
    recommendations also 1. 2. 3.).
    """
    names = "|".join(sorted(R.SECTION_HEADERS, key=len, reverse=True))
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), _strip), lambda s: F.length(s) > 0)
    header = f"^### (?:{names}):"
    body = F.array_join(lines, "\n")
    # a section is everything from one header line up to the next
    blocks = F.regexp_extract_all(
        body, F.lit(f"(?m)^### (?:{names}):.*(?:\\n(?!### (?:{names}):).*)*"), F.lit(0))
    entries = F.transform(blocks, lambda b: F.struct(
        F.regexp_extract(b, f"^### ({names}):", 1).alias("name"),
        _strip(F.regexp_replace(b, header, "")).alias("text")))
    out = texts.withColumn("_sections", entries)

    def section(name: str) -> Column:
        """Last section of that name; null when absent or empty."""
        found = F.filter(F.col("_sections"), lambda e: e["name"] == name)
        text = F.try_element_at(found, F.lit(-1))["text"]
        return F.when(F.length(text) > 0, text)

    def bullets(name: str, start: str, drop: str, n: int) -> Column:
        rows = F.filter(F.split(F.coalesce(section(name), F.lit("")), "\n"), lambda s: s.rlike(start))
        items = F.transform(rows, lambda s: _strip(F.regexp_replace(_strip(F.regexp_replace(s, drop, "")), ":$", "")))
        return F.slice(F.filter(items, lambda s: F.length(s) > 0), 1, n)

    confidence = F.lower(F.coalesce(
        F.try_element_at(F.filter(F.col("_sections"), lambda e: e["name"] == "CONFIDENCE"), F.lit(-1))["text"],
        F.lit("medium")))
    focus = F.coalesce(section("FOCUS AREAS FOR IMMEDIATE ATTENTION"), section("FOCUS AREAS"), F.lit(""))
    focus_rows = F.filter(F.split(focus, "\n"), lambda s: s.rlike("^[-•]"))
    return (
        out.withColumn("analysis", F.coalesce(
            section("DETAILED ANALYSIS"), section("ANALYSIS"), section("EXECUTIVE SUMMARY"),
            F.lit("Analysis not provided")))
        .withColumn("insights", bullets("KEY INSIGHTS", "^[-•*]", "^[-•*]+", 3))
        .withColumn("recs", bullets("RECOMMENDATIONS", "^(?:[-•*]|[123]\\.)", "^[-•*1-9.]+", 3))
        .withColumn("confidence", F.when(confidence.contains("high"), 0.8)
                    .when(confidence.contains("medium"), 0.6).otherwise(0.4))
        .withColumn("focus", F.slice(F.transform(
            focus_rows, lambda s: F.regexp_replace(s, "^[- ]+|[- ]+$", "")), 1, 2))
        .drop("_sections"))


def project_technologies(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    tags = F.array_compact(F.array(*[F.when(contains_any(low, words), tag)
                                     for tag, words in R.PROJECT_TECHNOLOGIES]))
    return F.when(F.size(tags) > 0, tags).otherwise(words_array([R.DEFAULT_TECHNOLOGY]))


def project_context(queries: DataFrame, projects: DataFrame,
                    everything: tuple[str, str, list[str]] = ("All projects", "Every indexed project", [])) -> DataFrame:
    """``(query_id, name, description, technologies)`` of the projects a query asks about.

    ``everything`` describes the context of a query without project ids.
    """
    asked = queries.select("query_id", F.posexplode("project_ids").alias("pos", "id"))
    found = asked.join(projects.select("id", "name", "description", "source_path"), "id").withColumn(
        "tech", project_technologies(F.col("source_path")))
    merged = found.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "name", "description", "tech"))).alias("p"))
    names = F.array_join(F.transform("p", lambda x: x["name"]), ", ")
    n = F.size("p")
    one = F.get("p", F.lit(0))
    many = merged.select(
        "query_id",
        F.when(n == 1, one["name"]).otherwise(F.concat(F.lit("Multi-project analysis ("), names, F.lit(")"))).alias("name"),
        F.when(n == 1, F.when(F.length(one["description"]) > 0, one["description"]).otherwise("No description available"))
        .otherwise(F.concat(F.lit("Analysis across "), n.cast("string"), F.lit(" projects: "), names)).alias("description"),
        F.array_distinct(F.flatten(F.transform("p", lambda x: x["tech"]))).alias("technologies"))
    asks = F.coalesce(F.size("project_ids"), F.lit(0)) > 0
    label, text, tech = everything
    unknown_name, unknown_text = R.UNKNOWN_PROJECT
    return queries.select("query_id", asks.alias("_asks")).join(many, "query_id", "left").select(
        "query_id",
        F.coalesce("name", F.when(F.col("_asks"), unknown_name).otherwise(label)).alias("name"),
        F.coalesce("description", F.when(F.col("_asks"), unknown_text).otherwise(text)).alias("description"),
        F.coalesce("technologies", F.when(F.col("_asks"), words_array([])).otherwise(words_array(tech))).alias("technologies"))
