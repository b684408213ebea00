"""op13: Merkle manifest."""

from corpusgraph.llm import merkle
from corpusgraph.llm.queries import query, table

#: Levels that the SQL unrolls: parts of up to 8 ** LEVELS rows, up to 8 ** PART_LEVELS parts.
LEVELS, PART_LEVELS = 8, 3
#: Unsigned crc32 of the decimal doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(
            [4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
            lambda a, c: list_reduce([xor(a, c)] || range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _tree(name: str, nodes: str, levels: int) -> str:
    """CTEs name0, name1, ... (tree, pos, n, h, l, r): the nodes of each level with the hashes before and after them."""
    beside = """coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN {}), '') AS {}"""
    both = ", ".join([beside.format("UNBOUNDED PRECEDING AND 1 PRECEDING", "l"),
                      beside.format("1 FOLLOWING AND UNBOUNDED FOLLOWING", "r")])
    out = [f"{name}0 AS MATERIALIZED (SELECT *, {both} FROM {nodes})"]
    for k in range(1, levels + 1):
        out.append(f"""{name}{k} AS MATERIALIZED (SELECT *, {both} FROM (
            SELECT tree, pos // 8 AS pos, (max(n) + 7) // 8 AS n,
                CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
            FROM {name}{k - 1} GROUP BY tree, pos // 8))""")
    return ",\n".join(out)


def _sql() -> str:
    docs = [f"a{k}" for k in range(LEVELS)]
    parts = [f"b{k}" for k in range(PART_LEVELS)]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars"]))
    # one row for each leaf and level
    joins = [f"JOIN node{k} a{k} ON a{k}.tree = d.tree AND a{k}.pos = d.pos // {8 ** k}" for k in range(LEVELS)]
    joins += [f"JOIN part{k} b{k} ON b{k}.pos = p.pos // {8 ** k}" for k in range(PART_LEVELS)]
    # each step of a fold is its own column, so that the text of the SQL stays short
    steps = []
    for i, a in enumerate(docs + parts):
        steps.append(f"f{i} AS MATERIALIZED (SELECT * EXCLUDE start, CASE WHEN n{i} = 1 THEN start ELSE "
                     f"sha256(l{i} || start || r{i}) END AS start FROM {'joined' if i == 0 else f'f{i - 1}'})")
    sides = ", ".join(f"{a}.n AS n{i}, {a}.l AS l{i}, {a}.r AS r{i}" for i, a in enumerate(docs + parts))
    proof = " || ".join(f"l{i} || r{i}" for i in range(len(docs + parts)))
    return f"""
WITH leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({fields} || {_field("text")}) AS h,
        sha256({fields} || {_field(lower)}) AS changed,
        {_CRC} AS crc FROM documents),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree("node", "(SELECT tree, pos, n, h FROM placed)", LEVELS)},
parts AS MATERIALIZED (
    SELECT 'all' AS tree, tree AS part, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n
    FROM node{LEVELS}),
{_tree("part", "(SELECT tree, pos, n, h FROM parts)", PART_LEVELS)},
joined AS (
    SELECT d.doc_id, d.h AS leaf, p.h AS subroot, top.h AS root, {sides},
        CASE WHEN d.crc % 3 = 0 THEN d.changed ELSE d.h END AS start
    FROM placed d JOIN parts p ON p.part = d.tree
    CROSS JOIN part{PART_LEVELS} top {' '.join(joins)}),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, start AS folded_root, start = root AS verified
FROM f{len(steps) - 1}
"""


@query("op13_merkle_manifest", _sql())
def op13(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))
