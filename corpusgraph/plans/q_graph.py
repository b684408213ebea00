"""Registered queries: graph traversal, neighbourhoods and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import graph
from corpusgraph.plans.catalog import query


def own_seeds(df, query_col="id"):
    """Every chunk as its own one-seed query."""
    return df.select(F.col(query_col).alias("query_id"), "id")


def nation_seeds(d):
    return d.selection


def doc_seeds(d):
    """Documents grouped into one query per source."""
    return d.chunks.select(F.col("project_id").alias("query_id"), "id")


@query("gr1_build_edges", "chunks", sql="""
, raw AS (
  SELECT 'd' || (doc_id - doc_id % 20) AS s, id AS t, 'PARENT_OF' AS f, 'CHILD_OF' AS b, 1.0e0 AS w FROM chunks WHERE doc_id % 20 <> 0
  UNION ALL SELECT id, 'd' || (doc_id * 3), 'CALLS', 'CALLED_BY', 0.5e0 FROM chunks
  UNION ALL SELECT id, 'd' || (doc_id + 2), 'CALLS', 'CALLED_BY', 0.5e0 FROM chunks
  UNION ALL SELECT id, 'd' || (doc_id // 2), 'IMPORTS', 'IMPORTED_BY', 0.3e0 FROM chunks),
u AS (SELECT DISTINCT * FROM raw WHERE s IN (SELECT id FROM chunks) AND t IN (SELECT id FROM chunks))
SELECT s AS src, t AS dst, f AS rel, w AS weight FROM u
UNION ALL SELECT t, s, b, w FROM u""")
def gr1(d):
    doc = F.col("doc_id")
    node = lambda c: F.concat(F.lit("d"), c.cast("bigint").cast("string"))
    chunks = d.chunks.select(
        "id", F.when(doc % 20 != 0, node(doc - doc % 20)).alias("parent_id"),
        F.array(node(doc * 3), node(doc + 2)).alias("calls"), F.array(node(F.floor(doc / 2))).alias("imports"))
    return graph.build_edges(chunks)


_WALK = """
, e AS (SELECT DISTINCT src, dst FROM edges WHERE rel = '{rel}')
, w AS ({levels})
SELECT DISTINCT query_id, id, other_id, depth FROM w"""


def _levels(depth: int, seeds: str) -> str:
    parts = []
    for n in range(1, depth + 1):
        joins = f" JOIN e e1 ON e1.src = s.id" + "".join(
            f" JOIN e e{i} ON e{i}.src = e{i - 1}.dst" for i in range(2, n + 1))
        parts.append(f"SELECT s.query_id, s.id, e{n}.dst AS other_id, {n} AS depth FROM {seeds} s{joins}")
    return " UNION ALL ".join(parts)


_ALL_NODES = "(SELECT id AS query_id, id FROM nodes)"


@query("gr2_ancestors", "edges", "nodes", sql=_WALK.format(rel="CHILD_OF", levels=_levels(5, _ALL_NODES)))
def gr2(d):
    return graph.ancestors(d.edges, own_seeds(d.nodes))


@query("gr3_descendants", "edges", "selection", sql=_WALK.format(rel="PARENT_OF", levels=_levels(3, "selection")))
def gr3(d):
    return graph.descendants(d.edges, d.selection)


@query("gr4_neighbours", "edges", "selection", sql="""
SELECT DISTINCT query_id, id, rel, dst AS other_id FROM selection JOIN edges ON src = id
WHERE rel IN ('CALLS', 'CALLED_BY', 'IMPORTS', 'IMPORTED_BY')""")
def gr4(d):
    return graph.neighbours(d.edges, d.selection)


_SIBLINGS = """
SELECT query_id, id, other_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY other_id) AS r FROM (
    SELECT DISTINCT s.query_id, s.id, b.src AS other_id FROM {seeds} s
    JOIN {edges} a ON a.src = s.id AND a.rel = 'CHILD_OF'
    JOIN {edges} b ON b.dst = a.dst AND b.rel = 'CHILD_OF' AND b.src <> s.id)) WHERE r <= 5"""


@query("jn8_siblings_join", "edges", "selection", sql=_SIBLINGS.format(seeds="selection", edges="edges"))
def jn8(d):
    return graph.siblings(d.edges, d.selection)


_SAME_FILE = """
SELECT query_id, id, other_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY other_id) AS r FROM (
    SELECT DISTINCT s.query_id, s.id, b.id AS other_id FROM {seeds} s JOIN {nodes} a ON a.id = s.id
    JOIN {nodes} b ON b.file_path = a.file_path AND b.id <> a.id {cond})) WHERE r <= {n}"""
_ARCH = "AND regexp_replace(b.node_type, '_(definition|statement)$', '') IN ('class', 'module', 'interface')"


@query("jn9_same_file_join", "nodes", "selection", sql="""
SELECT DISTINCT s.query_id, s.id, b.id AS other_id FROM selection s JOIN nodes a ON a.id = s.id
JOIN nodes b ON b.file_path = a.file_path AND b.id <> a.id""")
def jn9_all(d):
    return graph.same_file(d.nodes, d.selection)


@query("jn9_same_file_kinds", "nodes", "selection",
       sql=_SAME_FILE.format(seeds="selection", nodes="nodes", n=3, cond=_ARCH))
def jn9(d):
    return graph.same_file(d.nodes, d.selection, 3, ["class", "module", "interface"])


_DOC_SEEDS = "(SELECT project_id AS query_id, id FROM chunks)"
_CONTEXT = f"""
, e AS (SELECT DISTINCT src, dst FROM doc_edges WHERE rel = 'CHILD_OF')
, up AS (SELECT DISTINCT * FROM ({_levels(5, _DOC_SEEDS)}))
, f AS (SELECT DISTINCT src, dst FROM doc_edges WHERE rel = 'PARENT_OF')
, down AS (SELECT DISTINCT * FROM ({_levels(3, _DOC_SEEDS).replace("JOIN e ", "JOIN f ")}))
, context AS (
SELECT query_id, id, 'parents' AS context_type, other_id, depth FROM up
UNION ALL SELECT query_id, id, 'children', other_id, depth FROM down
UNION ALL SELECT DISTINCT s.query_id, s.id, lower(rel), dst, 1 FROM {_DOC_SEEDS} s JOIN doc_edges ON src = s.id
  WHERE rel IN ('CALLS', 'CALLED_BY', 'IMPORTS', 'IMPORTED_BY')
UNION ALL SELECT query_id, id, 'siblings', other_id, 1 FROM ({_SIBLINGS.format(seeds=_DOC_SEEDS, edges="doc_edges")})
UNION ALL SELECT query_id, id, 'architectural_context', other_id, 1
  FROM ({_SAME_FILE.format(seeds=_DOC_SEEDS, nodes="chunks", n=3, cond=_ARCH)}))
"""


@query("gr5_chunk_context", "chunks", "doc_edges", sql=_CONTEXT + "SELECT * FROM context")
def gr5(d):
    return graph.chunk_context(d.doc_edges, d.chunks, doc_seeds(d))


_RELATED_SEEDS = """
, names AS (SELECT DISTINCT conv_id AS query_id, CASE conv_id % 3 WHEN 0 THEN 'parse_document'
     WHEN 1 THEN 'UserManager_' || (conv_id * 12 + 1) ELSE 'app/models/src' || conv_id || '/main.py' END AS name FROM conversations)
, seeds AS (SELECT DISTINCT query_id, id FROM names n JOIN chunks c ON c.name = n.name OR c.file_path = n.name OR contains(c.content, n.name))
"""


def related_names(d):
    c = F.col("conv_id")
    return d.conversations.select(
        c.alias("query_id"),
        F.when(c % 3 == 0, "parse_document")
        .when(c % 3 == 1, F.concat(F.lit("UserManager_"), (c * 12 + 1).cast("string")))
        .otherwise(F.concat(F.lit("app/models/src"), c.cast("string"), F.lit("/main.py"))).alias("name")).distinct()


@query("gr6_related_entities", "chunks", "doc_edges", sql=_RELATED_SEEDS + """
, b AS (SELECT src, dst, rel, src || dst || rel AS e FROM doc_edges UNION ALL SELECT dst, src, rel, src || dst || rel FROM doc_edges WHERE src <> dst)
, reach AS (
  SELECT query_id, seeds.id AS s, b.dst AS t FROM seeds JOIN b ON b.src = seeds.id
  UNION SELECT query_id, seeds.id, b2.dst FROM seeds JOIN b b1 ON b1.src = seeds.id JOIN b b2 ON b2.src = b1.dst AND b2.e <> b1.e
  UNION SELECT query_id, seeds.id, y.id FROM seeds JOIN chunks x ON x.id = seeds.id JOIN chunks y ON y.file_path = x.file_path AND y.id <> x.id)
, scored AS (SELECT DISTINCT query_id, t AS id, CASE
    WHEN x.file_path = y.file_path THEN 0.9e0
    WHEN EXISTS (SELECT 1 FROM b WHERE b.src = s AND b.dst = t AND rel IN ('CALLS', 'CALLED_BY')) THEN 0.8e0
    WHEN EXISTS (SELECT 1 FROM b WHERE b.src = s AND b.dst = t AND rel IN ('IMPORTS', 'IMPORTED_BY')) THEN 0.7e0
    WHEN EXISTS (SELECT 1 FROM b WHERE b.src = s AND b.dst = t AND rel IN ('CHILD_OF', 'PARENT_OF')) THEN 0.85e0
    ELSE 0.6e0 END AS relevance
  FROM reach JOIN chunks x ON x.id = s JOIN chunks y ON y.id = t)
SELECT query_id, rank, id, relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM scored) WHERE rank <= 50""")
def gr6(d):
    return graph.related_to_names(d.doc_edges, d.chunks, related_names(d))


@query("gr7_explore_nodes", "chunks", "doc_edges", sql=f"""
, s AS (SELECT query_id, id FROM {_DOC_SEEDS})
SELECT DISTINCT query_id, id, 'out' AS reach, dst AS other_id FROM s JOIN doc_edges ON src = id
UNION ALL SELECT DISTINCT query_id, id, 'in', src FROM s JOIN doc_edges ON dst = id
UNION ALL SELECT DISTINCT query_id, id, 'second', b.dst FROM s JOIN doc_edges a ON a.src = id JOIN doc_edges b ON b.src = a.dst AND b.dst <> id""")
def gr7(d):
    return graph.explore_nodes(d.doc_edges, doc_seeds(d))


@query("gr7_explore_relationships", "chunks", "doc_edges", sql=f"""
, s AS (SELECT query_id, id FROM {_DOC_SEEDS})
SELECT DISTINCT query_id, src, dst, rel, weight FROM (
SELECT query_id, src, dst, rel, weight FROM s JOIN doc_edges ON src = id
UNION ALL SELECT query_id, src, dst, rel, weight FROM s JOIN doc_edges ON dst = id
UNION ALL SELECT query_id, b.src, b.dst, b.rel, b.weight FROM s JOIN doc_edges a ON a.src = id JOIN doc_edges b ON b.src = a.dst AND b.dst <> id)""")
def gr7_rel(d):
    return graph.explore_relationships(d.doc_edges, doc_seeds(d))


_PATHS = """
, e AS (SELECT DISTINCT src, dst, rel, src || chr(1) || dst || chr(1) || rel AS k FROM {edges})
, p1 AS (SELECT id AS query_id, id, 1 AS hops, [id, e.dst] AS path, [e.k] AS used FROM {nodes} JOIN e ON e.src = id)
, p2 AS (SELECT query_id, id, 2 AS hops, list_append(path, e.dst) AS path, list_append(used, e.k) AS used FROM p1 JOIN e ON e.src = path[2] AND e.k <> used[1])
, p3 AS (SELECT query_id, id, 3 AS hops, list_append(path, e.dst) AS path, list_append(used, e.k) AS used FROM p2 JOIN e ON e.src = path[3] AND e.k <> used[1] AND e.k <> used[2])
, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops, path, used) AS path_no
  FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE path[-1] <> id)
"""


@query("gr8_paths_1_3", "chunks", "doc_edges", sql=_PATHS.format(edges="doc_edges", nodes="chunks") + """
SELECT query_id, id, path_no, array_to_string(path, '>') AS path FROM ranked WHERE path_no <= 5""")
def gr8(d):
    return graph.paths(d.doc_edges, own_seeds(d.chunks)).withColumn("path", F.array_join("path", ">"))


_DEGREE = """
, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {edges} UNION ALL SELECT dst FROM {edges} WHERE src <> dst) GROUP BY id)
"""


@query("gr9_degree_centrality", "edges", "selection", sql=_DEGREE.format(edges="edges") + """
SELECT query_id, s.id, coalesce(degree, 0) AS degree,
       round(coalesce(degree, 0) * 1.0e0 / greatest(max(coalesce(degree, 0)) OVER (PARTITION BY query_id), 1), 6) AS centrality
FROM selection s LEFT JOIN deg ON deg.id = s.id""")
def gr9(d):
    return graph.degree_centrality(d.edges, d.selection).withColumn("centrality", F.round("centrality", 6))


_TOUCH = """
, t AS (SELECT DISTINCT query_id, src, dst, rel, weight FROM selection JOIN edges ON src = id OR dst = id)
"""


@query("gr10_graph_score", "edges", "selection", sql=_TOUCH.replace("edges ON src = id OR dst = id",
       "edges ON src = id UNION SELECT query_id, src, dst, rel, weight FROM selection JOIN edges ON dst = id") + """
SELECT query_id, id, round(least(count(*) * 0.1e0 + avg(weight) * 0.2e0, 1.0e0), 6) AS graph_score FROM (
  SELECT query_id, src AS id, weight FROM t UNION ALL SELECT query_id, dst, weight FROM t WHERE src <> dst)
GROUP BY query_id, id""")
def gr10(d):
    return graph.graph_score(graph.touching(d.links, d.selection), ways=2).withColumn("graph_score", F.round("graph_score", 6))


@query("gr11_path_score", "chunks", "doc_edges", sql=_PATHS.format(edges="doc_edges", nodes="chunks") + """
SELECT query_id, id, round(least(sum(1.0e0 / n), 1.0e0), 6) AS path_score FROM (
  SELECT query_id, len(path) AS n, unnest(list_distinct(path)) AS id FROM (SELECT 'd' || length(id) AS query_id, path FROM ranked WHERE path_no <= 5))
GROUP BY query_id, id""")
def gr11(d):
    rows = graph.paths(d.doc_edges, own_seeds(d.chunks)).withColumn(
        "query_id", F.concat(F.lit("d"), F.length("id").cast("string")))
    return graph.path_score(rows).withColumn("path_score", F.round("path_score", 6))


@query("jn6_or_join", "edges", "selection", sql="""
SELECT query_id, src, dst, rel FROM selection JOIN edges ON src = id WHERE rel = 'CALLS'
UNION SELECT query_id, src, dst, rel FROM selection JOIN edges ON dst = id WHERE rel = 'CALLS'""")
def jn6(d):
    return graph.touching(d.edges.filter("rel = 'CALLS'"), d.selection).drop("weight")


@query("gr12_data_flow", "edges", "nodes", "selection", sql="""
, s AS MATERIALIZED (SELECT * FROM selection)
, e AS MATERIALIZED (SELECT src, dst, rel FROM edges WHERE rel IN ('CALLS', 'IMPORTS'))
, t AS (SELECT query_id, src, dst, rel FROM s JOIN e ON src = id UNION SELECT query_id, src, dst, rel FROM s JOIN e ON dst = id)
, r AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, rel) AS rank FROM t) WHERE rank <= 20)
, ends AS MATERIALIZED (SELECT src AS id FROM r UNION SELECT dst FROM r)
, known AS MATERIALIZED (SELECT id, name, file_path, node_type FROM nodes SEMI JOIN ends USING (id))
SELECT query_id, rank, src, dst, a.name AS src_name, a.file_path AS src_file, a.node_type AS src_type, b.name AS dst_name,
       b.file_path AS dst_file, b.node_type AS dst_type, rel, CASE rel WHEN 'CALLS' THEN 'outbound' ELSE 'import' END AS flow_direction
FROM r JOIN known a ON a.id = src JOIN known b ON b.id = dst""")
def gr12(d):
    return graph.data_flow(d.edges, d.nodes, d.selection)


@query("gr14_rel_type_map", "edges", sql="""
SELECT src, dst, CASE rel WHEN 'PARENT_OF' THEN 'parent_child' WHEN 'CHILD_OF' THEN 'parent_child' WHEN 'CALLED_BY' THEN 'called_by'
  ELSE 'calls' END AS label, weight FROM edges""")
def gr14(d):
    return d.edges.select("src", "dst", graph.relationship_label(F.col("rel")).alias("label"), "weight")


_RELATED_RELS = ["CALLS", "CALLED_BY", "IMPORTS", "IMPORTED_BY", "CHILD_OF", "PARENT_OF"]


@query("so3_union_related", "chunks", "doc_edges", sql=f"""
, ways AS (SELECT src AS a, dst AS b, rel FROM doc_edges UNION SELECT dst, src, rel FROM doc_edges)
, walk AS (SELECT DISTINCT a, b FROM ways WHERE rel IN ({str(_RELATED_RELS)[1:-1]}))
SELECT a AS id, b AS other_id FROM walk JOIN chunks ON a = id WHERE a <> b
UNION SELECT x.a, y.b FROM walk x JOIN walk y ON x.b = y.a JOIN chunks ON x.a = id WHERE x.a <> y.b
UNION SELECT a, b FROM ways JOIN chunks ON a = id WHERE rel IN ('SIMILAR_TO', 'DEPENDS_ON') AND a <> b
UNION SELECT x.id, y.id FROM chunks x JOIN chunks y ON x.file_path = y.file_path AND x.id <> y.id""")
def so3(d):
    return graph.union_related(d.doc_edges, d.chunks, own_seeds(d.chunks)).select("id", "other_id")


@query("st3_depth_order", "edges", "nodes", sql=_WALK.format(rel="CHILD_OF", levels=_levels(5, _ALL_NODES)) +
       " ORDER BY depth, other_id, id")
def st3(d):
    return graph.ancestors(d.edges, own_seeds(d.nodes)).orderBy("depth", "other_id", "id")
