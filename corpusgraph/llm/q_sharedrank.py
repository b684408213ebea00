"""op12: ranked lexical search."""

from corpusgraph.llm import sharedrank
from corpusgraph.llm.queries import query, table

_TERMS = (r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")
SQL = f"""
WITH terms AS (SELECT doc_id, {_TERMS} AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
scores AS (
    SELECT item_id, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""


@query("op12_shared_rank", SQL)
def op12(spark, folder):
    return sharedrank.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
