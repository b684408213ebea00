"""Registered queries: source files to chunks, relations, stored tables and embeddings."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from corpusgraph.functions import chunks as C
from corpusgraph.functions import metadata as M
from corpusgraph.functions.text import preview
from corpusgraph.operators import embed, outline, relate
from corpusgraph.plans import sqltext as S
from corpusgraph.plans.catalog import query
from corpusgraph.plans.q_stats import joined
from corpusgraph.rules import area_rules as A
from corpusgraph.session import run_dir
from corpusgraph.sources import buckets, scan, store

_WS = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"
_LINES = f"""
, lines AS MATERIALIZED (SELECT path, project_id, language, no, text, trim(text, {_WS}) AS t, length(text) - length(ltrim(text, {_WS})) AS ind, n FROM (
   SELECT path, project_id, language, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS no, len(string_split(content, chr(10))) AS n FROM files))
"""


def _head(pattern: str) -> str:
    return f"nullif(regexp_extract(t, {S.lit(pattern)}, 1), '')"


_OUTLINE = _LINES + f"""
, ph AS (SELECT *, {_head(outline.PY_CLASS)} AS name, 'class' AS k FROM lines WHERE language = 'python' AND {_head(outline.PY_CLASS)} IS NOT NULL
  UNION ALL SELECT *, {_head(outline.PY_FUNCTION)}, 'function' FROM lines WHERE language = 'python' AND {_head(outline.PY_FUNCTION)} IS NOT NULL)
, pe AS (SELECT h.path, h.no, h.k, min(x.no) AS nx FROM ph h LEFT JOIN lines x ON x.path = h.path AND x.no > h.no AND x.t <> '' AND x.ind <= h.ind GROUP BY ALL)
, pm AS (SELECT h.path, h.no, max_by(starts_with(x.t, 'class '), x.no) AS m FROM ph h JOIN lines x ON x.path = h.path AND x.no < h.no AND x.t <> ''
   AND CASE WHEN starts_with(x.t, 'class ') THEN x.ind < h.ind ELSE x.ind <= h.ind END WHERE h.k = 'function' GROUP BY ALL)
, jf AS (SELECT *, coalesce({', '.join(_head(p) for p in outline.JS_FUNCTIONS)}) AS fname, {_head(outline.JS_CLASS)} AS cname FROM lines WHERE language IN ('javascript', 'typescript'))
, jh AS (SELECT path, project_id, language, no, n, cname AS name, 'class' AS k FROM jf WHERE cname IS NOT NULL UNION ALL SELECT path, project_id, language, no, n, fname, 'function' FROM jf WHERE fname IS NOT NULL)
, b0 AS (SELECT path, no, unnest(regexp_extract_all(text, '[{{}}]')) AS b, generate_subscripts(regexp_extract_all(text, '[{{}}]'), 1) AS o FROM jf)
, b1 AS (SELECT path, no, CASE b WHEN '{{' THEN 1 ELSE -1 END AS step, sum(CASE b WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY no, o) AS depth FROM b0)
, jb AS (SELECT h.path, h.no, h.k, coalesce(sum(b.step), 0) AS base FROM jh h LEFT JOIN b1 b ON b.path = h.path AND b.no < h.no GROUP BY ALL)
, je AS (SELECT h.path, h.no, h.k, min(b.no) AS close FROM jb h LEFT JOIN b1 b ON b.path = h.path AND b.no >= h.no AND b.step = -1 AND b.depth = h.base GROUP BY ALL)
, heads AS (SELECT path, project_id, language, no AS start_line, coalesce(nx - 1, n) AS end_line, name,
     CASE WHEN k = 'class' THEN 'class_definition' WHEN m THEN 'method_definition' ELSE 'function_definition' END AS node_type, k
   FROM ph JOIN pe USING (path, no, k) LEFT JOIN pm USING (path, no)
   UNION ALL SELECT path, project_id, language, no, coalesce(close, n), name, k || '_definition', k FROM jh JOIN je USING (path, no, k))
, outl AS MATERIALIZED (SELECT md5(path || ':' || start_line || ':' || end_line || ':' || content) AS id, path AS file_path, project_id, language, start_line, end_line, node_type, name, content,
     start_line + CASE k WHEN 'function' THEN 1000000000 ELSE 0 END AS list_no
   FROM (SELECT h.path, h.project_id, h.language, start_line, end_line, node_type, name, k, string_agg(text, chr(10) ORDER BY no) AS content
     FROM heads h JOIN lines l ON l.path = h.path AND l.no BETWEEN start_line AND end_line GROUP BY ALL))
"""


@query("src1_scan_tree", sql="""
SELECT page_id, path FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a/node_modules/x.py' WHEN 1 THEN 'src/main.PY' WHEN 2 THEN 'web/app.tsx' WHEN 3 THEN 'build/out.js'
  WHEN 4 THEN 'docs/env/readme.md' ELSE 'lib/build.ts' END AS path FROM pages) WHERE page_id % 6 IN (1, 2, 5)""")
def src1(d):
    k = F.col("page_id") % 6
    path = (F.when(k == 0, "a/node_modules/x.py").when(k == 1, "src/main.PY").when(k == 2, "web/app.tsx")
            .when(k == 3, "build/out.js").when(k == 4, "docs/env/readme.md").otherwise("lib/build.ts"))
    return scan.select_files(d.pages.select("page_id", path.alias("path"))).select("page_id", "path")


@query("src2_detect_language", sql=f"""
SELECT page_id, {S.map_of("lower(regexp_extract(url, '(\\.[^./]+)$', 1))", {'.com/fr': 'x', **A.LANGUAGE_BY_SUFFIX})} AS language
FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '/x.JSX' WHEN 2 THEN '.tsx' ELSE '' END AS url FROM pages)""")
def src2(d):
    k = F.col("page_id") % 4
    url = F.concat("url", F.when(k == 0, ".py").when(k == 1, "/x.JSX").when(k == 2, ".tsx").otherwise(""))
    return d.pages.select("page_id", C.language_of(url).alias("language"))


@query("prj1_explode_lines", "files", sql=_LINES + "SELECT path, no AS line_no, text, t AS trimmed, ind AS indent, t = '' AS blank FROM lines")
def prj1(d):
    return outline.lines(d.files)


_SHOW = "SELECT id, file_path, start_line, end_line, node_type, name, content FROM outl"


@query("prj2_outline_python", "files", sql=_OUTLINE + _SHOW + " WHERE language = 'python'")
def prj2(d):
    return outline.outline_python(d.files.filter("language = 'python'")).drop("project_id", "language", "list_no")


@query("prj3_indent_block_end", "files", sql=_OUTLINE + "SELECT file_path, start_line, end_line FROM outl WHERE language = 'python' AND node_type = 'class_definition'")
def prj3(d):
    return outline.outline_python(d.files.filter("language = 'python'")).filter(
        "node_type = 'class_definition'").select("file_path", "start_line", "end_line")


@query("prj4_outline_braces", "files", sql=_OUTLINE + _SHOW + " WHERE language <> 'python'")
def prj4(d):
    return outline.outline_braces(d.files.filter("language <> 'python'")).drop("project_id", "language", "list_no")


@query("prj5_brace_block_end", "files", sql=_OUTLINE + "SELECT file_path, start_line, end_line FROM outl WHERE language <> 'python'")
def prj5(d):
    return outline.outline_braces(d.files.filter("language <> 'python'")).select("file_path", "start_line", "end_line")


@query("prj6_is_method", "files", sql=_OUTLINE + "SELECT id, node_type = 'method_definition' AS is_method FROM outl WHERE language = 'python' AND node_type <> 'class_definition'")
def prj6(d):
    return outline.outline_python(d.files.filter("language = 'python'")).filter("node_type <> 'class_definition'").select(
        "id", (F.col("node_type") == "method_definition").alias("is_method"))


@query("prj7_split_text", sql="""
SELECT doc_id, window_no, s AS start, substr(text, s + 1, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 900)) AS s,
  generate_subscripts(range(0, greatest(length(text), 1), 900), 1) - 1 AS window_no FROM documents)""")
def prj7(d):
    return outline.split_text(d.documents, "doc_id", "text")


_SITES = _OUTLINE + f"""
, fl AS (SELECT file_path, id AS caller_id, name AS caller_name, end_line - start_line AS size, start_line, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM outl WHERE node_type IN ('function_definition', 'method_definition'))
, tok AS (SELECT *, start_line + i AS line_no, unnest(list_distinct(regexp_extract_all(line, '\\b(\\w+)\\s*\\(', 1))) AS callee_name FROM fl)
, inn AS (SELECT *, row_number() OVER (PARTITION BY file_path, line_no, callee_name ORDER BY size, -start_line) AS r FROM tok)
, sites AS (SELECT DISTINCT file_path, caller_id, caller_name, callee_name FROM inn WHERE r = 1 AND NOT list_contains({S.list_of(A.CALL_KEYWORDS)}, callee_name) AND NOT (i = 0 AND callee_name = caller_name))
, lastn AS (SELECT file_path, name, max_by(id, list_no) AS id FROM outl GROUP BY ALL)
"""


@query("prj8_call_sites", "files", sql=_SITES + "SELECT * FROM sites")
def prj8(d):
    return outline.call_sites(outline.outline(d.files))


_PY = r"(?:from\s+(\S+)\s+import|import\s+(\S+))"
_JS = r"import.*?from\s+['\"]([^'\"]+)['\"]"


@query("prj9_extract_imports", "files", sql=f"""
SELECT path, array_to_string(list_concat(list_filter(flatten(list_transform(list_zip(regexp_extract_all(content, {S.lit(_PY)}, 1), regexp_extract_all(content, {S.lit(_PY)}, 2)), lambda z: [z[1], z[2]])), lambda x: length(x) > 0),
  regexp_extract_all(content, {S.lit(_JS)}, 1)), '|') AS imports FROM files""")
def prj9(d):
    return d.files.select("path", F.array_join(C.imports_in(F.col("content")), "|").alias("imports"))


@query("prj10_chunk_id", "chunks", sql="SELECT id, md5(file_path || ':' || start_line || ':' || end_line || ':' || content) AS chunk_id FROM chunks")
def prj10(d):
    return d.chunks.select("id", C.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("chunk_id"))


@query("prj11_chunk_content", "files", sql=_OUTLINE + "SELECT file_path, start_line, list_no, length(content) AS n, md5(content) AS digest FROM outl")
def prj11(d):
    return outline.outline(d.files).select("file_path", "start_line", "list_no", F.length("content").alias("n"), F.md5("content").alias("digest"))


@query("prj12_prepare_text", "chunks", sql="""
SELECT id, CASE WHEN doc_id % 5 <> 0 THEN node_type || ': ' || name || chr(10) ELSE '' END || 'File: ' || string_split(file_path, '/')[-1] || chr(10) || content AS prepared FROM chunks""")
def prj12(d):
    name = F.when(F.col("doc_id") % 5 != 0, F.col("name"))
    return d.chunks.select("id", C.prepared_text(F.col("node_type"), name, F.col("file_path"), F.col("content")).alias("prepared"))


@query("prj13_content_preview", sql="""
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS p100,
  CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '...' ELSE text END AS p1500 FROM documents""")
def prj13(d):
    return d.documents.select("doc_id", preview(F.col("text"), 100).alias("p100"), preview(F.col("text"), 1500).alias("p1500"))


@query("prj14_display_name", "chunks", sql="""
, l AS (SELECT *, list_transform(string_split(content, chr(10))[1:5], lambda s: trim(s)) AS ls FROM chunks)
, c AS (SELECT *, list_filter(list_transform(ls, lambda s: CASE WHEN starts_with(s, 'class ') THEN trim(split_part(split_part(split_part(s, 'class ', 2), '(', 1), ':', 1))
   WHEN starts_with(s, 'def ') THEN trim(split_part(split_part(s, 'def ', 2), '(', 1)) WHEN starts_with(s, 'function ') THEN trim(split_part(split_part(s, 'function ', 2), '(', 1)) END), lambda x: x IS NOT NULL) AS found FROM l)
SELECT id, CASE WHEN doc_id % 2 = 0 THEN name ELSE coalesce(found[1], regexp_replace(string_split(file_path, '/')[-1], '\\.(py|js|ts)$', '') || ' (line ' || start_line || ')') END AS display_name FROM c""")
def prj14(d):
    name = F.when(F.col("doc_id") % 2 == 0, F.col("name"))
    return d.chunks.select("id", C.display_name(name, F.col("content"), F.col("file_path"), F.col("start_line")).alias("display_name"))


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {S.any_of('lower(content)', w)} THEN {S.lit(t)} END" for t, w in A.CONSTRUCT_TAGS) + "], lambda x: x IS NOT NULL)"


@query("prj15_construct_tags", "chunks", sql=f"""
SELECT id, array_to_string(t, '|') AS tags, CASE WHEN len(t) > 0 THEN 'Contains: ' || array_to_string(t, ', ') || '; ' ELSE '' END || CASE WHEN n > 100 THEN 'High complexity (100+ lines)' WHEN n > 50 THEN 'Medium complexity (50+ lines)' ELSE 'Low complexity (<50 lines)' END AS summary
FROM (SELECT id, {_TAGS} AS t, len(string_split(content, chr(10))) AS n FROM chunks)""")
def prj15(d):
    return d.chunks.select("id", F.array_join(C.construct_tags(F.col("content")), "|").alias("tags"),
                           C.construct_summary(F.col("content")).alias("summary"))


def _first_seen(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


@query("prj17_identifiers", "files", sql="""
, l AS (SELECT path, string_split(content, chr(10)) AS ls FROM files)
, f AS (SELECT path, list_concat(list_filter(list_transform(list_filter(ls, lambda s: contains(s, 'def ')), lambda s: trim(split_part(split_part(s, 'def ', 2), '(', 1))), lambda x: regexp_matches(x, '^[A-Za-z_]\\w*$')),
    list_transform(list_filter(list_transform(list_filter(ls, lambda s: contains(s, 'async def ')), lambda s: trim(split_part(split_part(s, 'async def ', 2), '(', 1))), lambda x: regexp_matches(x, '^[A-Za-z_]\\w*$')), lambda x: 'async ' || x)) AS fn,
    list_filter(list_transform(list_filter(ls, lambda s: contains(s, 'class ')), lambda s: trim(split_part(split_part(split_part(s, 'class ', 2), '(', 1), ':', 1))), lambda x: regexp_matches(x, '^[A-Za-z_]\\w*$')) AS cn FROM l)
SELECT path, array_to_string(""" + _first_seen("fn") + """, '|') AS functions, array_to_string(""" + _first_seen("cn") + """, '|') AS classes, string_split(path, '/')[-1] AS files FROM f""")
def prj17(d):
    text = F.col("content")
    listing = F.concat(F.lit("File: "), F.col("path"), F.lit("\n"), text)
    return joined(d.files.select("path", C.function_names(text).alias("functions"), C.class_names(text).alias("classes"),
                                 C.file_names(listing).alias("files")), "functions", "classes", "files")


# ---- relations ----

_PARENT = """
, par AS (SELECT id, parent_id FROM (SELECT c.id, p.id AS parent_id, row_number() OVER (PARTITION BY c.id ORDER BY p.end_line - p.start_line, p.start_line, p.list_no) AS r
  FROM outl c JOIN outl p ON p.file_path = c.file_path AND (p.start_line, p.list_no) < (c.start_line, c.list_no) AND p.end_line >= c.end_line) WHERE r = 1)
"""


@query("jn1_containment_parent", "files", sql=_OUTLINE + _PARENT + "SELECT id, parent_id FROM par")
def jn1(d):
    return relate.containment_parent(outline.outline(d.files))


_INFILE = "SELECT DISTINCT a.id AS caller_id, b.id AS callee_id FROM sites s JOIN lastn a ON a.file_path = s.file_path AND a.name = s.caller_name JOIN lastn b ON b.file_path = s.file_path AND b.name = s.callee_name"
_CROSS = """SELECT DISTINCT a.id AS caller_id, o.id AS callee_id FROM sites s JOIN lastn a ON a.file_path = s.file_path AND a.name = s.caller_name
  JOIN outl o ON o.name = s.callee_name AND o.file_path <> s.file_path WHERE NOT EXISTS (SELECT 1 FROM lastn b WHERE b.file_path = s.file_path AND b.name = s.callee_name)"""


@query("jn2_calls_in_file", "files", sql=_SITES + _INFILE)
def jn2(d):
    c = outline.outline(d.files)
    return relate.calls_in_file(outline.call_sites(c), c)


@query("jn3_calls_cross_file", "files", sql=_SITES + _CROSS)
def jn3(d):
    c = outline.outline(d.files)
    return relate.calls_across_files(outline.call_sites(c), c)


@query("snk5_write_edges", "files", sql=_SITES + _PARENT + f"""
, rel AS (SELECT parent_id AS s, id AS t, 'PARENT_OF' AS f, 'CHILD_OF' AS b, 1.0e0 AS w FROM par UNION ALL SELECT caller_id, callee_id, 'CALLS', 'CALLED_BY', 0.5e0 FROM ({_INFILE} UNION {_CROSS}))
SELECT s AS src, t AS dst, f AS rel, w AS weight FROM rel UNION ALL SELECT t, s, b, w FROM rel""")
def snk5(d):
    from corpusgraph.operators.graph import build_edges
    from corpusgraph.session import materialize

    c = materialize(outline.outline(d.files), "chunks")
    return build_edges(relate.relate(c, outline.call_sites(c)).withColumn("imports", F.array().cast("array<string>")))


@query("jn4_vector_payload_join", "chunks", "vectors", sql="SELECT id, name, file_path, len(embedding) AS dim FROM chunks JOIN vectors USING (id)")
def jn4(d):
    return d.chunks.join(d.vectors.select("id", "embedding"), "id").select("id", "name", "file_path", F.size("embedding").alias("dim"))


# ---- stored tables ----

@query("snk1_upsert_vectors", "chunks", "vectors", sql="""
SELECT id, label, len(embedding) AS dim FROM (
  SELECT 'd' || vec_id AS id, 'old' AS label, embedding FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT id, 'new', embedding FROM vectors WHERE vec_id IN (SELECT doc_id FROM labels))""")
def snk1(d):
    old = d.vectors.select("id", F.lit("old").alias("label"), "embedding")
    new = d.labels.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("new").alias("label"))
    table = buckets.create(old, run_dir(d.spark, "vectors"), "id")
    for _ in range(2):  # the batch is sent again, and changes nothing
        store.store_vectors(table, new, d.vectors, batch=0)
    return table.read().select("id", "label", F.size("embedding").alias("dim"))


@query("snk2_replace_by_file", "chunks", sql="""
, new AS (SELECT 'd' || (doc_id + 3) AS id, file_path, 'new' AS version FROM chunks WHERE project_id = 'src4')
SELECT id, file_path, 'old' AS version FROM chunks WHERE file_path NOT IN (SELECT file_path FROM new) AND id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new""")
def snk2(d):
    old = d.chunks.select("id", "file_path", F.lit("old").alias("version"))
    new = d.chunks.filter("project_id = 'src4'").select(
        F.concat(F.lit("d"), (F.col("doc_id") + 3).cast("string")).alias("id"), "file_path", F.lit("new").alias("version"))
    table = buckets.create(old, run_dir(d.spark, "chunks"), "file_path")
    store.store_by_file(table, new)
    return table.read()


@query("snk2_metadata_round_trip", sql="""
SELECT 'd' || doc_id AS id, lang, upper(source) AS source, CAST(n_chars AS VARCHAR) AS n_chars, text, 4 AS n_keys FROM documents""")
def snk2_metadata(d):
    """Metadata of two writers, merged with the last one winning, stored as JSON and read again."""
    first = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("text"), "text")
    last = F.create_map(F.lit("source"), F.upper("source"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    rows = d.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
                              M.encoded(M.merged(first, last)).alias("metadata"))
    table = buckets.create(rows, run_dir(d.spark, "nodes"), "id")
    read = table.read().withColumn("m", M.decoded(F.col("metadata")))
    return read.select("id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("lang", "source", "n_chars", "text")],
                       F.size("m").alias("n_keys"))


@query("snk3_delete_by_file", "chunks", sql="SELECT id, file_path FROM chunks WHERE file_path NOT IN (SELECT file_path FROM chunks WHERE project_id = 'src9')")
def snk3(d):
    table = buckets.create(d.chunks.select("id", "file_path"), run_dir(d.spark, "chunks"), "file_path")
    table.delete(d.chunks.filter("project_id = 'src9'").select("file_path"), ["file_path"])
    return table.read()


@query("snk4_detach_delete", "chunks", "doc_edges", sql="""
, gone AS (SELECT id FROM chunks WHERE project_id = 'src5') SELECT * FROM doc_edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""")
def snk4(d):
    table = buckets.create(d.doc_edges, run_dir(d.spark, "edges"), "src")
    store.detach_nodes(table, d.chunks.filter("project_id = 'src5'"))
    return table.read()


@query("snk4_detach_compacted", "chunks", "doc_edges", sql="""
, gone AS (SELECT id FROM chunks WHERE project_id = 'src5') SELECT * FROM doc_edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""")
def snk4_compacted(d):
    table = buckets.create(d.doc_edges, run_dir(d.spark, "edges"), "src")
    store.detach_nodes(table, d.chunks.filter("project_id = 'src5'"))
    table.compact()
    return table.read()


@query("snk6_collection_recreate", "vectors", sql="SELECT id, project_id, len(embedding) AS dim FROM vectors")
def snk6(d):
    path = run_dir(d.spark, "collection")
    store.recreate(d.vectors, path)
    store.recreate(d.vectors, path)
    return d.spark.read.schema(d.vectors.schema).parquet(path).select("id", "project_id", F.size("embedding").alias("dim"))


@query("snk7_project_registry", sql="""
, cur AS (SELECT source AS id, 'project ' || source AS name, 'not_indexed' AS status, min(doc_id) AS total_files, 'boom' AS indexing_error, 0 AS indexed_at, 1 AS updated_at FROM documents GROUP BY source)
, chg AS (SELECT lang || source AS id, 'new' AS name, 'indexing' AS status, count(*) AS total_files, NULL AS indexing_error, NULL AS updated_at, false AS deleted FROM documents GROUP BY ALL
   UNION ALL SELECT source, NULL, CASE WHEN source LIKE '%1' THEN 'indexed' WHEN source LIKE '%2' THEN 'error' END, count(*), NULL, 9, source LIKE '%3' FROM documents GROUP BY source)
SELECT coalesce(cur.id, chg.id) AS id, coalesce(chg.name, cur.name) AS name, coalesce(chg.status, cur.status) AS status, coalesce(chg.total_files, cur.total_files) AS total_files,
  coalesce(chg.indexing_error, CASE WHEN chg.status IS NULL OR chg.status = 'error' THEN cur.indexing_error END) AS indexing_error,
  CASE WHEN chg.status = 'indexed' THEN chg.updated_at ELSE cur.indexed_at END AS indexed_at, coalesce(chg.updated_at, cur.updated_at) AS updated_at
FROM cur FULL JOIN chg ON cur.id = chg.id WHERE NOT coalesce(deleted, false)""")
def snk7(d):
    docs = d.documents
    none = lambda t: F.lit(None).cast(t)
    cur = docs.groupBy("source").agg(F.min("doc_id").alias("total_files")).select(
        F.col("source").alias("id"), F.concat(F.lit("project "), "source").alias("name"), F.lit("not_indexed").alias("status"),
        "total_files", F.lit("boom").alias("indexing_error"), F.lit(0).alias("indexed_at"), F.lit(1).alias("updated_at"))
    fresh = docs.groupBy("lang", "source").agg(F.count("*").alias("total_files")).select(
        F.concat("lang", "source").alias("id"), F.lit("new").alias("name"), F.lit("indexing").alias("status"), "total_files",
        none("string").alias("indexing_error"), none("int").alias("indexed_at"), none("int").alias("updated_at"), F.lit(False).alias("deleted"))
    change = docs.groupBy("source").agg(F.count("*").alias("total_files")).select(
        F.col("source").alias("id"), none("string").alias("name"), F.when(F.col("source").endswith("1"), "indexed").when(F.col("source").endswith("2"), "error").alias("status"), "total_files",
        none("string").alias("indexing_error"), none("int").alias("indexed_at"), F.lit(9).alias("updated_at"), F.col("source").endswith("3").alias("deleted"))
    return store.merge_projects(cur, fresh.unionByName(change))


# ---- embeddings ----

def byte_histogram():
    """A stand-in provider: shares of the eight residues of a text's bytes."""

    def fn(texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), 8))
        for i, t in enumerate(texts):
            b = np.frombuffer(t.encode(), dtype="uint8")
            rows[i] = np.bincount(b % 8, minlength=8) / max(len(b), 1)
        return rows

    return fn


@query("ud1_embed")
def ud1(d):
    out = embed.embed(d.documents, "doc_id", "text", byte_histogram, 8)
    return out.select("doc_id", F.posexplode("embedding").alias("pos", "x"))


@query("ud2_hash_embed")
def ud2(d):
    out = embed.hash_embed(d.documents, "doc_id", "text", 64, embed.fit_idf(d.documents, "text", 64))
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query("ud3_query_text_wrapping", "questions", sql="""
SELECT query_id, 'function_definition: query' || chr(10) || 'File: query' || chr(10) || query AS prepared FROM questions""")
def ud3(d):
    return d.questions.select("query_id", embed.query_text(F.col("query")).alias("prepared"))
