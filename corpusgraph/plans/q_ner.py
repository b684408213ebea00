"""Registered queries: entity extraction and what is built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions.text import first_label
from corpusgraph.operators import filters, ner, stats
from corpusgraph.plans import sqltext as S
from corpusgraph.plans.catalog import query
from corpusgraph.plans.q_stats import _RES, joined, results, rounded
from corpusgraph.rules import area_rules as A
from corpusgraph.rules import ner_rules as N

_PATTERN_ROWS = " UNION ALL ".join(
    f"SELECT query_id, {seq} AS seq, '{kind}' AS type, regexp_extract_all(query, {S.lit(p)}, 0) AS w, "
    f"regexp_extract_all(query, {S.lit(p)}, 1) AS g, string_split_regex(query, {S.lit(p)}) AS gap FROM questions"
    for seq, kind, p in ner.numbered_patterns())
_DICT_ROWS = " UNION ALL ".join(
    f"SELECT query_id, {seq} AS seq, '{kind}' AS type, {S.lit(term)} AS text, {conf}e0 AS confidence, instr(lower(query), {S.lit(term.lower())}) - 1 AS start_pos, "
    f"instr(lower(query), {S.lit(term.lower())}) - 1 + {len(term)} AS end_pos, {S.list_of(al)} AS aliases FROM questions WHERE contains(lower(query), {S.lit(term.lower())})"
    for seq, term, kind, conf, al in ner.dictionary())
_FOUND = f"""
, raw AS MATERIALIZED ({_PATTERN_ROWS})
, pieces AS (SELECT query_id, seq, type, unnest(w) AS w, unnest(g) AS text, unnest(gap[1:len(w)]) AS gap, generate_subscripts(w, 1) AS i FROM raw WHERE len(w) > 0)
, pat AS (SELECT query_id, seq, type, text, 0.7e0 AS confidence,
    CAST(sum(length(gap) + length(w)) OVER (PARTITION BY query_id, seq ORDER BY i) - length(w) AS INT) AS start_pos,
    CAST(sum(length(gap) + length(w)) OVER (PARTITION BY query_id, seq ORDER BY i) AS INT) AS end_pos, []::VARCHAR[] AS aliases FROM pieces)
, dict AS ({_DICT_ROWS})
, found AS (SELECT query_id, seq, type, text, confidence, start_pos, end_pos, aliases FROM pat
  UNION ALL SELECT query_id, seq, type, text, confidence, CAST(start_pos AS INT), CAST(end_pos AS INT), aliases FROM dict)
"""
_SPEC = S.map_of("{x}.type", N.SPECIFICITY, "0", quote=False)
_MERGED = _FOUND + f"""
, el AS (SELECT query_id, {{'cur': {{'start_pos': start_pos, 'seq': seq, 'end_pos': end_pos, 'text': text, 'type': type, 'confidence': confidence, 'aliases': aliases}},
    'out': []::STRUCT(start_pos INT, seq INT, end_pos INT, text VARCHAR, type VARCHAR, confidence DOUBLE, aliases VARCHAR[])[]}} AS e, start_pos, seq FROM found)
, folded AS (SELECT query_id, list_reduce(list(e ORDER BY start_pos, seq, e.cur.end_pos), lambda a, x:
    CASE WHEN NOT (a.cur.end_pos <= x.cur.start_pos OR x.cur.end_pos <= a.cur.start_pos) THEN
      CASE WHEN CASE WHEN x.cur.confidence <> a.cur.confidence THEN x.cur.confidence > a.cur.confidence
             ELSE {_SPEC.format(x='x.cur')} > {_SPEC.format(x='a.cur')} END THEN {{'cur': x.cur, 'out': a.out}} ELSE a END
    ELSE {{'cur': x.cur, 'out': list_append(a.out, a.cur)}} END) AS r FROM el GROUP BY query_id)
, merged AS (SELECT query_id, unnest(list_append(r.out, r.cur)) AS e FROM folded)
"""
_BONUS = S.map_of("e.type", N.TYPE_BONUS, "0e0", quote=False).replace("THEN 0.", "THEN 0e0 + 0.")
_ENTITIES = _MERGED + f"""
, cnt AS (SELECT m.query_id, e, length(query) AS n, (length(query) - length(replace(lower(query), lower(e.text), ''))) * 1.0e0 / length(e.text) AS c
  FROM merged m JOIN questions q USING (query_id))
, sc AS (SELECT query_id, e, least(e.confidence + CASE WHEN c > 1 THEN least(c * 0.05e0, 0.2e0) ELSE 0 END + {_BONUS}
    + CASE WHEN e.start_pos < n * 0.2e0 THEN 0.05e0 ELSE 0 END, 1.0e0) AS confidence FROM cnt)
, entities AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, e.start_pos) AS rank, e.text AS text, e.type AS type,
    confidence, e.start_pos AS start_pos, e.end_pos AS end_pos, e.aliases AS aliases FROM sc)
"""


@query("tx8_ner_patterns", "questions", sql=_FOUND + """
SELECT query_id, seq, type, text, start_pos, end_pos, round(confidence, 6) AS confidence FROM pat""")
def tx8(d):
    return rounded(d.questions.select("query_id", F.inline(ner.pattern_entities(F.col("query")))).drop("aliases"))


@query("tx9_ner_dictionary", "questions", sql=_FOUND + """
SELECT query_id, type, text, start_pos, end_pos, round(confidence, 6) AS confidence, array_to_string(aliases, '|') AS aliases
FROM found WHERE seq >= (SELECT min(seq) FROM dict)""")
def tx9(d):
    return rounded(joined(d.questions.select(
        "query_id", F.inline(ner.dictionary_entities(F.col("query")))).drop("seq"), "aliases"))


@query("tx10_ner_merge", "questions", sql=_MERGED + """
SELECT query_id, e.text AS text, e.type AS type, e.start_pos AS start_pos, e.end_pos AS end_pos FROM merged""")
def tx10(d):
    found = F.concat(ner.pattern_entities(F.col("query")), ner.dictionary_entities(F.col("query")))
    return d.questions.withColumn("_f", found).select("query_id", F.inline(ner.merge(F.col("_f")))).select(
        "query_id", "text", "type", "start_pos", "end_pos")


@query("tx11_ner_score", "questions", sql=_ENTITIES + """
SELECT query_id, text, type, round(confidence + 1e-9, 6) AS confidence, start_pos, end_pos FROM entities""")
def tx11(d):
    return rounded(ner.extract_entities(d.questions).drop("rank", "aliases"))


_ALIAS = "flatten([aliases, CASE WHEN type = 'technology' THEN list_filter([" + ", ".join(
    f"CASE WHEN lower(text) = {S.lit(a.lower())} THEN {S.lit(b)} WHEN lower(text) = {S.lit(b.lower())} THEN {S.lit(a)} END" for a, b in N.ALIASES
) + "], lambda x: x IS NOT NULL) ELSE [] END])"
_KEYWORDS = S.map_of("type", {k: "|".join(v) for k, v in N.CONTEXT_KEYWORDS.items()}, "''")


@query("tx12_aliases_keywords", "questions", sql=_ENTITIES + f"""
SELECT query_id, text, type, start_pos, array_to_string({_ALIAS}, '|') AS all_aliases, {_KEYWORDS} AS keywords FROM entities""")
def tx12(d):
    e = ner.all_aliases(ner.extract_entities(d.questions)).withColumn("keywords", ner.context_keywords(F.col("type")))
    return joined(e, "all_aliases", "keywords").select("query_id", "text", "type", "start_pos", "all_aliases", "keywords")


@query("tx13_entity_to_nodes", "questions", "chunks", sql=_ENTITIES + """
, e AS (SELECT DISTINCT query_id, text, type FROM entities)
, te AS (SELECT DISTINCT text, type FROM e)
, c AS (SELECT id, name, file_path, content, regexp_replace(node_type, '_(definition|statement)$', '') AS kind FROM chunks)
, h AS (SELECT text, type, id FROM (SELECT te.*, c.id, row_number() OVER (PARTITION BY text, type ORDER BY c.id) AS r FROM te JOIN c ON
    (type IN ('function', 'class') AND kind = type AND contains(name, text)) OR (type = 'file' AND contains(file_path, text))
    OR (type IN ('person', 'organization') AND contains(content, text))) WHERE r <= 10)
SELECT query_id, text, type, array_to_string(list_sort(list(id)), '|') AS ids FROM e JOIN h USING (text, type) GROUP BY ALL""")
def tx13(d):
    hits = filters.node_match(ner.extract_entities(d.questions), d.chunks)
    return hits.groupBy("query_id", "text", "type").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids"))


@query("tx14_complexity_by_entities", "questions", sql=_ENTITIES + """
, n AS (SELECT query_id, count(*) AS n_entities, bool_or(type IN ('technology', 'framework', 'database', 'function', 'class')) AS technical FROM entities GROUP BY 1)
, b AS (SELECT q.query_id, len(regexp_extract_all(query, '[^ \\t\\n\\r\\f\\v]+')) AS n_words, coalesce(n_entities, 0) AS n_entities, coalesce(technical, false) AS technical FROM questions q LEFT JOIN n USING (query_id))
, s AS (SELECT *, (n_words > 10)::INT + (n_entities > 3)::INT + technical::INT AS complexity_score FROM b)
SELECT *, CASE WHEN complexity_score >= 3 THEN 'complex' WHEN complexity_score >= 2 THEN 'moderate' ELSE 'simple' END AS complexity_level,
  complexity_score >= 1 OR technical AS recommended_enhanced FROM s""")
def tx14b(d):
    return ner.complexity_by_entities(d.questions, ner.extract_entities(d.questions))


@query("ag22_entity_groups", "questions", sql=_ENTITIES + """
SELECT query_id, type, text, start_pos, rank FROM (SELECT query_id, type, text, start_pos,
  row_number() OVER (PARTITION BY query_id, type ORDER BY round(confidence, 9) DESC, start_pos, text) AS rank FROM entities) WHERE rank <= 5""")
def ag22_entities(d):
    return stats.entity_groups(ner.extract_entities(d.questions).withColumn("confidence", F.round("confidence", 9)).drop(
        "rank")).select("query_id", "type", "text", "start_pos", "rank")


def list_entities(d):
    """Entities of each question; fifteen conversations ask of one result list."""
    e = ner.extract_entities(d.questions)
    return e.withColumn("query_id", F.expr("query_id div 15000")).select("query_id", "text", "type").distinct()


_LISTED = _RES.replace("node_type, name, start_line,", "node_type, name, start_line, content,")
_LE = """
, le AS (SELECT DISTINCT query_id // 15000 AS query_id, text, type FROM entities)
"""


@query("jn10_entity_chunk_match", "chunks", "questions", ctes=_LISTED, sql=_ENTITIES + _LE + """
SELECT query_id, text, type, id, CASE WHEN contains(lower(coalesce(name, '')), lower(text)) THEN 'high' ELSE 'medium' END AS relevance
FROM le JOIN ranked USING (query_id) WHERE contains(lower(content), lower(text)) OR contains(lower(coalesce(name, '')), lower(text))""")
def jn10(d):
    return ner.entity_chunk_match(list_entities(d), results(d))


@query("tx19_entity_insights", "chunks", "questions", ctes=_LISTED, sql=_ENTITIES + _LE + f"""
, m AS (SELECT query_id, text, type, count(*) AS related, count(*) FILTER (contains(lower(coalesce(name, '')), lower(text))) AS related_by_name
  FROM le JOIN ranked USING (query_id) WHERE contains(lower(content), lower(text)) OR contains(lower(coalesce(name, '')), lower(text)) GROUP BY ALL)
SELECT le.query_id, le.text, le.type, array_to_string({_ALIAS.replace('lower(text)', 'lower(le.text)').replace('aliases', '[]').replace('type =', 'le.type =')}, '|') AS all_aliases,
  {_KEYWORDS.replace('CASE type', 'CASE le.type')} AS keywords, coalesce(related, 0) AS related, coalesce(related_by_name, 0) AS related_by_name
FROM le LEFT JOIN m ON m.query_id = le.query_id AND m.text = le.text AND m.type = le.type""")
def tx19(d):
    e = list_entities(d).withColumn("aliases", F.array().cast("array<string>"))
    return joined(ner.entity_insights(e, results(d)).drop("aliases"), "all_aliases", "keywords")


_FIVE = S.label_of("lower(file_path)", A.LAYERS_FIVE, "'other'")


@query("ag16_entity_layers", "chunks", "questions", ctes=_LISTED, sql=_ENTITIES + _LE + f"""
SELECT DISTINCT query_id, text, {_FIVE} AS layer FROM le JOIN ranked USING (query_id) WHERE contains(lower(content), lower(text))""")
def ag16_layers(d):
    return ner.entity_layers(list_entities(d), results(d), first_label(F.lower("file_path"), A.LAYERS_FIVE, "other"))


_FLAGS = ", ".join(f"CASE WHEN bool_or(contains(lower(name), {S.lit(w)})) THEN {S.lit(p)} END" for p, w in A.NAME_PATTERNS)


@query("ag17_pattern_flags", "chunks", "questions", ctes=_LISTED, sql=_ENTITIES + _LE + f"""
, t AS (SELECT query_id, bool_or(type = 'class') AND bool_or(type = 'interface') AS oo FROM le GROUP BY 1)
, n AS (SELECT query_id, [{_FLAGS}] AS f FROM ranked GROUP BY query_id)
SELECT query_id, array_to_string(list_filter(list_concat([CASE WHEN oo THEN {S.lit(A.OBJECT_PATTERN)} END], f), lambda x: x IS NOT NULL), '|') AS patterns
FROM n LEFT JOIN t USING (query_id)""")
def ag17(d):
    return joined(stats.pattern_flags(results(d), list_entities(d)), "patterns")
