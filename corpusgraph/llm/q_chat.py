"""op5: chat formatting."""

from corpusgraph.llm import chat
from corpusgraph.llm.queries import query, table

#: Conversation -1: control strings inside both texts.
PROBE = """SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')
           AS t(conv_id, turn, role, text)"""

SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, length(text)
        + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 11
                    ELSE 16 + 2 * octet_length(encode(role)) END
        + CASE WHEN regexp_matches(text, ' (\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])')
               THEN 1 + len(regexp_extract_all(text, '[<\[]\\*(?:/?(?:INST|SYS|ANS|ROLE)\+?(?: [0-9A-F]*)?\]|/?s>)'))
               ELSE 0 END AS chars
    FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op5_chat_format", SQL)
def op5(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(turns.unionByName(spark.sql(PROBE)))
