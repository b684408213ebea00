"""op11: exact deduplication."""

from corpusgraph.llm import contentsort
from corpusgraph.llm.queries import query, table

SQL = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
ranked AS (
    SELECT doc_id, norm, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS n
    FROM texts WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, n::BIGINT AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""


@query("op11_content_sort", SQL)
def op11(spark, folder):
    return contentsort.content_groups(table(spark, folder, "documents"))
