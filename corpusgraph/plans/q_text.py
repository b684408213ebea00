"""Registered queries: question classification, extraction and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import questions as T
from corpusgraph.plans import sqltext as S
from corpusgraph.plans.catalog import query
from corpusgraph.plans.q_stats import joined, rounded
from corpusgraph.rules import query_rules as R
from corpusgraph.session import spread


def intent_sql(source: str, text: str = "query", keep: str = "query_id, query") -> str:
    arms = ", ".join(
        f"{{'score': {R.PATTERN_WEIGHT} * {S.matches_of('low', R.INTENT_PATTERNS[i])} + {S.count_of('low', R.INTENT_KEYWORDS[i])}, 'o': {-n}, 'intent': '{i}'}}"
        for n, i in enumerate(R.INTENTS))
    return f"""(SELECT * EXCLUDE (low, b), CASE WHEN b.score = 0 THEN 'search' ELSE b.intent END AS intent,
  CASE WHEN b.score = 0 THEN 0.5e0 ELSE least(b.score / 5.0e0, 1.0e0) END AS intent_confidence
  FROM (SELECT *, list_max([{arms}]) AS b FROM (SELECT {keep}, lower({text}) AS low FROM {source})))"""


@query("tx1_classify_intent", "questions", sql=f"SELECT query_id, intent, intent_confidence FROM {intent_sql('questions')}")
def tx1(d):
    return T.classify_intent(d.questions).drop("query")


@query("tx1_classify_documents", sql=f"""
SELECT doc_id, intent, intent_confidence FROM {intent_sql('documents', 'text', 'doc_id')}""")
def tx1_docs(d):
    # dozens of patterns per text: spread over all cores, however few files hold the table
    return T.classify_intent(spread(d.documents.select("doc_id", "text"), "doc_id"), "text").drop("text")


_PHRASE = S.map_of("intent", {k: " ".join(v) for k, v in R.INTENT_PHRASES.items()})


@query("tx2_expand_for_embedding", "questions", sql=f"""
SELECT query_id, concat_ws(' ', query, {_PHRASE}, tech, CASE WHEN tech IS NOT NULL THEN {S.lit(' '.join(R.PROJECT_PHRASES))} END) AS expanded_query
FROM (SELECT *, CASE query_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Python React' ELSE 'General' END AS tech FROM {intent_sql('questions')})""")
def tx2(d):
    q = T.classify_intent(d.questions)
    q = q.withColumn("tech", F.when(F.col("query_id") % 3 == 1, F.array(F.lit("Python"), F.lit("React")))
                     .when(F.col("query_id") % 3 == 2, F.array(F.lit("General"))))
    return T.expand_for_embedding(q, "tech").select("query_id", "expanded_query")


_ENT = f"""SELECT query_id, query, {S.extract_of('query', R.FUNCTION_PATTERNS)} AS functions, {S.extract_of('query', R.CLASS_PATTERNS)} AS classes,
  {S.extract_of('query', R.FILE_PATTERNS)} AS files, list_filter({S.extract_of('query', [R.VARIABLE_PATTERN], False)},
    lambda v: NOT list_contains({S.list_of(R.STOP_WORDS)}, lower(v))) AS variables FROM questions"""


@query("tx3_code_entities", "questions", sql=f"""
SELECT query_id, array_to_string(functions, '|') AS functions, array_to_string(classes, '|') AS classes,
  array_to_string(files, '|') AS files, array_to_string(variables, '|') AS variables FROM ({_ENT})""")
def tx3(d):
    return joined(T.code_entities(d.questions).drop("query"), "functions", "classes", "files", "variables")


def _dedup_sql(expr: str, n: int) -> str:
    return (f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)[1:{n}]")


@query("tx5_search_terms", "questions", sql=f"""
SELECT query_id, array_to_string({_dedup_sql('t', 20)}, '|') AS terms FROM (
  SELECT query_id, flatten([[query], list_transform(functions[1:5], lambda x: 'function ' || x), list_transform(functions[1:5], lambda x: 'def ' || x),
    list_transform(classes[1:5], lambda x: 'class ' || x), list_transform(classes[1:5], lambda x: x || ' implementation'),
    list_transform(files[1:5], lambda x: 'file ' || x)]) AS t FROM ({_ENT}))""")
def tx5(d):
    return joined(T.search_terms(T.code_entities(d.questions)), "terms").select("query_id", "terms")


_ABSTRACT = f"({S.any_of('lower(query)', R.ABSTRACT_WORDS)} AND NOT {S.any_of('lower(query)', R.TECHNICAL_WORDS)})"


@query("tx6_is_abstract", "questions", sql=f"SELECT query_id, {_ABSTRACT} AS is_abstract FROM questions")
def tx6(d):
    return d.questions.select("query_id", T.is_abstract(F.col("query")).alias("is_abstract"))


_GROUPS = ", ".join(f"CASE WHEN {S.any_of('lower(query)', w)} THEN {S.list_of(t)} ELSE [] END" for w, t in R.EXPANSION_GROUPS)


@query("tx7_expand_abstract", "questions", sql=f"""
SELECT query_id, array_to_string({_dedup_sql('t', 1000)}, '|') AS terms FROM (
  SELECT query_id, flatten([[query], {_GROUPS}, {S.list_of(R.ALWAYS_EXPAND)}]) AS t FROM questions)""")
def tx7(d):
    return d.questions.select("query_id", F.array_join(T.abstract_terms(F.col("query")), "|").alias("terms"))


@query("flt6_filter_derivation", "questions", sql=f"""
SELECT query_id, {S.map_of('intent', {k: v[0] for k, v in R.PREFERRED_KINDS.items()})} AS want_kind, files[1] AS want_file,
  coalesce(classes[1], functions[1]) AS want_name
FROM ({_ENT}) e JOIN {intent_sql('questions', keep='query_id')} i USING (query_id)""")
def flt6(d):
    return T.search_filters(T.code_entities(T.classify_intent(d.questions))).select(
        "query_id", "want_kind", "want_file", "want_name")


def complexity_sql(text: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(lower({text}), {S.lit('|'.join(f'(?:{p})' for p in R.COMPLEXITY_PATTERNS[c]))}) THEN '{c}'"
        for c in R.COMPLEXITY_ORDER)
    return f"(CASE {arms} ELSE 'simple' END)"


@query("tx14_complexity_by_pattern", "questions", sql=f"""
SELECT query_id, {complexity_sql('query')} AS complexity,
  CASE {' '.join(f"WHEN {S.any_of('lower(query)', R.COMPLEXITY_PATTERNS[c])} THEN '{c}'" for c in R.COMPLEXITY_ORDER)} ELSE 'simple' END AS literal_complexity
FROM questions""")
def tx14a(d):
    return d.questions.select("query_id", T.complexity_by_pattern(F.col("query")).alias("complexity"),
                              T.complexity_by_pattern(F.col("query"), "literal").alias("literal_complexity"))


@query("tx14_complexity_by_words", "questions", sql=f"""
SELECT query_id, len(regexp_extract_all(query, '[^ \\t\\n\\r\\f\\v]+')) AS n_words,
  CASE WHEN {S.any_of('lower(query)', R.COMPLEX_WORDS)} THEN 'complex' WHEN {S.any_of('lower(query)', R.MODERATE_WORDS)}
    OR len(regexp_extract_all(query, '[^ \\t\\n\\r\\f\\v]+')) > 10 OR length(query) * 20 > 5000 THEN 'moderate' ELSE 'simple' END AS complexity
FROM questions""")
def tx14c(d):
    return d.questions.select("query_id", T.word_count(F.col("query")).alias("n_words"),
                              T.complexity_by_words(F.col("query"), F.length("query") * 20).alias("complexity"))


@query("tx15_plan_query", "questions", sql=f"""
SELECT query_id, complexity, n_roles, CASE WHEN complexity = 'simple' AND n_roles <= 2 THEN 'direct_search' WHEN complexity = 'moderate' AND n_roles <= 3
  THEN 'focused_analysis' WHEN n_roles <= 6 THEN 'multi_perspective' ELSE 'comprehensive' END AS strategy,
  round(s, 6) AS estimated_seconds, s > 20 AS should_stream, complexity IN ('complex', 'architectural') AS expand_query, n_roles > 3 AS use_graph_search,
  CASE WHEN n_roles > 0 THEN greatest(10, 100 // n_roles) ELSE 10 END AS chunk_limit_per_role, complexity = 'architectural' AS prioritize_architectural_files,
  complexity <> 'simple' AS enable_entity_extraction
FROM (SELECT *, CASE complexity WHEN 'simple' THEN 5 WHEN 'moderate' THEN 15 WHEN 'complex' THEN 30 ELSE 45 END + n_roles * 8 / 3.0e0 AS s
  FROM (SELECT query_id, {complexity_sql('query')} AS complexity, length(query) % 9 AS n_roles FROM questions))""")
def tx15(d):
    q = d.questions.select("query_id", T.complexity_by_pattern(F.col("query")).alias("complexity"),
                           (F.length("query") % 9).alias("n_roles"))
    return T.plan_query(q).withColumn("estimated_seconds", F.round("estimated_seconds", 6))


_MENTION_TEXT = """m AS (SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN 'The SearchClient calls run_query() and depends on IndexManager. You should split the parser module. '
  WHEN 1 THEN 'TextProcessor extends BaseProcessor. It uses load_rows() and parse_all(). To improve latency cache results' WHEN 2 THEN 'optimization: use fewer joins here. a communicates with b '
  ELSE '' END) || text AS text FROM documents)"""


def mention_texts(d):
    k = F.col("doc_id") % 4
    lead = (F.when(k == 0, "The SearchClient calls run_query() and depends on IndexManager. You should split the parser module. ")
            .when(k == 1, "TextProcessor extends BaseProcessor. It uses load_rows() and parse_all(). To improve latency cache results")
            .when(k == 2, "optimization: use fewer joins here. a communicates with b ").otherwise(""))
    return d.documents.select("doc_id", F.concat(lead, "text").alias("text"))


_TRIPLES = "list_concat({})".format
_REL_SQL = "flatten([" + ", ".join(
    f"list_transform(list_zip(regexp_extract_all(text, {S.lit(p)}, 1), regexp_extract_all(text, {S.lit(p)}, 2)), lambda z: z[1] || '>' || z[2] || ':{rel}')"
    for p, rel in R.RELATION_PATTERNS) + "])"
_ADVICE_SQL = "flatten([" + ", ".join(f"regexp_extract_all(text, {S.lit(p)}, 1)" for p in R.ADVICE_PATTERNS) + "])"
_WS = "' \t\n\r\f\v'"


@query("tx16_extract_mentions", ctes=_MENTION_TEXT, sql=f"""
SELECT doc_id, array_to_string(c[1:5], '|') AS components, array_to_string(({_REL_SQL})[1:3], '|') AS relations,
  array_to_string(list_filter(list_transform({_ADVICE_SQL}, lambda s: trim(s, {_WS})), lambda s: length(s) > 10)[1:3], '|') AS advice,
  CASE WHEN len(ss) >= 2 THEN array_to_string(ss[1:2], '. ') || '.' WHEN length(line) > 200 THEN substr(line, 1, 200) || '...' ELSE line END AS summary
FROM (SELECT *, list_concat({_dedup_sql(f"regexp_extract_all(text, {S.lit(R.MENTION_CLASS)}, 1)", 99999)}, {_dedup_sql(f"regexp_extract_all(text, {S.lit(R.MENTION_FUNCTION)}, 1)", 99999)}) AS c,
  string_split(line, '. ') AS ss FROM (SELECT *, string_split(trim(text), chr(10))[1] AS line FROM m))""")
def tx16(d):
    out = T.mentions(mention_texts(d)).drop("text")
    rel = F.transform("relations", lambda r: F.concat(r["from_name"], F.lit(">"), r["to_name"], F.lit(":"), r["relation"]))
    return joined(out.withColumn("relations", rel), "components", "relations", "advice")


def report_texts(d):
    """Role reports around document texts, with and without sections."""
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(
        F.lit("intro\n### EXECUTIVE SUMMARY: short\n### DETAILED ANALYSIS:\n"), "text",
        F.lit("\n### KEY INSIGHTS:\n- first point:\n• second\n* third\n- fourth\n### RECOMMENDATIONS:\n1. do this\n2. do that:\n- more\n### CONFIDENCE: High\n### FOCUS AREAS:\n- tests\n- docs\n- more"))).when(
        k == 1, F.concat(F.lit("### ANALYSIS: "), "text", F.lit("\n### CONFIDENCE: low"))).otherwise(F.col("text"))
    return d.documents.select("doc_id", text.alias("text"))


@query("tx17_parse_sections")
def tx17(d):
    return joined(T.parse_sections(report_texts(d)).drop("text"), "insights", "recs", "focus")


_PROJ = """p AS (SELECT source AS id, 'project ' || source AS name, CASE WHEN source LIKE '%3' THEN '' ELSE 'about ' || source END AS description,
  CASE WHEN source LIKE '%1' THEN '/src/python/app' WHEN source LIKE '%2' THEN '/web/react/x.ts' ELSE '/data/' || source END AS source_path FROM documents GROUP BY source)"""
_TECH = "list_filter([" + ", ".join(
    f"CASE WHEN {S.any_of('lower(source_path)', w)} THEN {S.lit(t)} END" for t, w in R.PROJECT_TECHNOLOGIES) + "], lambda x: x IS NOT NULL)"


def text_projects(d):
    s = F.col("source")
    return d.documents.select("source").distinct().select(
        s.alias("id"), F.concat(F.lit("project "), s).alias("name"),
        F.when(s.endswith("3"), "").otherwise(F.concat(F.lit("about "), s)).alias("description"),
        F.when(s.endswith("1"), "/src/python/app").when(s.endswith("2"), "/web/react/x.ts")
        .otherwise(F.concat(F.lit("/data/"), s)).alias("source_path"))


@query("tx18_project_context", "questions", ctes=_PROJ, sql=f"""
, q AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['src' || query_id % 20] WHEN 2 THEN ['src' || query_id % 20, 'src' || query_id % 7]
  ELSE ['nothing'] END::VARCHAR[] AS project_ids FROM questions)
, f AS (SELECT query_id, pos, name, description, CASE WHEN len(t) > 0 THEN t ELSE ['General'] END AS t FROM (
    SELECT query_id, pos, p.*, {_TECH} AS t FROM (SELECT query_id, unnest(project_ids) AS id, generate_subscripts(project_ids, 1) AS pos FROM q) JOIN p USING (id)))
, m AS (SELECT query_id, count(*) AS n, list(name ORDER BY pos) AS names, first(description ORDER BY pos) AS descr, flatten(list(t ORDER BY pos)) AS t FROM f GROUP BY query_id)
SELECT q.query_id, CASE WHEN n = 1 THEN names[1] WHEN n > 1 THEN 'Multi-project analysis (' || array_to_string(names, ', ') || ')'
    WHEN len(project_ids) = 0 THEN 'All projects' ELSE 'Unknown Project' END AS name,
  CASE WHEN n = 1 THEN CASE WHEN descr = '' THEN 'No description available' ELSE descr END
    WHEN n > 1 THEN 'Analysis across ' || n || ' projects: ' || array_to_string(names, ', ')
    WHEN len(project_ids) = 0 THEN 'Every indexed project' ELSE 'Project information not available' END AS description,
  coalesce(array_to_string({_dedup_sql('t', 100)}, '|'), '') AS technologies
FROM q LEFT JOIN m ON m.query_id = q.query_id""")
def tx18(d):
    k, s = F.col("query_id") % 4, lambda n: F.concat(F.lit("src"), (F.col("query_id") % n).cast("string"))
    q = d.questions.select("query_id", F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(s(20)))
                           .when(k == 2, F.array(s(20), s(7))).otherwise(F.array(F.lit("nothing"))).alias("project_ids"))
    return joined(T.project_context(q, text_projects(d)), "technologies")
