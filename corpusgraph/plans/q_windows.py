"""Registered queries: filters, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions.text import kind_of
from corpusgraph.operators import filters, windows
from corpusgraph.plans.catalog import query
from corpusgraph.rules import query_rules as R

_KIND = "regexp_replace(node_type, '_(definition|statement)$', '')"


@query("src3_lookup_by_id", "chunks", sql="""
SELECT id, name, file_path FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def src3(d):
    ids = d.labels.filter("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    return filters.lookup(d.chunks, ids).select("id", "name", "file_path")


@query("flt2_by_file", "chunks", sql="""
SELECT id, name, start_line FROM chunks WHERE file_path = 'app/models/src0/main.py'""")
def flt2(d):
    return filters.by_file(d.chunks, "app/models/src0/main.py").select("id", "name", "start_line")


@query("flt2_by_kind", "chunks", sql=f"SELECT id, name FROM chunks WHERE {_KIND} = 'class'")
def flt2_kind(d):
    return filters.by_kind(d.chunks, "class").select("id", "name")


@query("flt2_payload", "chunks", sql=f"""
SELECT id, name, project_id FROM chunks
WHERE project_id IN ('src0', 'src1', 'src2') AND {_KIND} = 'function'""")
def flt2_payload(d):
    return d.chunks.filter(filters.payload_filter(["src0", "src1", "src2"], kind="function")).select(
        "id", "name", "project_id")


@query("flt3_name_regex", "chunks", sql="""
SELECT id, name FROM chunks WHERE regexp_matches(name, '(?i)^(user|parse).*[0-9]$')""")
def flt3(d):
    return filters.by_name_pattern(d.chunks, "^(user|parse).*[0-9]$").select("id", "name")


_PROJECTS = """
SELECT source AS id, 'project ' || source AS name,
       CASE WHEN min(doc_id) % 3 = 0 THEN 'indexed' ELSE 'not_indexed' END AS status,
       min(doc_id) AS created, count(*) AS total_chunks
FROM documents GROUP BY source"""


def projects(d):
    return d.documents.groupBy("source").agg(F.min("doc_id").alias("created"), F.count("*").alias("total_chunks")).select(
        F.col("source").alias("id"), F.concat(F.lit("project "), "source").alias("name"),
        F.when(F.col("created") % 3 == 0, "indexed").otherwise("not_indexed").alias("status"),
        "created", "total_chunks")


@query("flt5_projects_by_status", ctes=f"p AS ({_PROJECTS})", sql="SELECT * FROM p WHERE status = 'indexed'")
def flt5(d):
    return filters.projects_by(projects(d), status="indexed")


@query("flt5_projects_by_name", ctes=f"p AS ({_PROJECTS})",
       sql="SELECT * FROM p WHERE name = 'project src7' AND id = 'src7'")
def flt5_name(d):
    return filters.projects_by(projects(d), name="project src7", project_id="src7")


@query("st1_page", ctes=f"p AS ({_PROJECTS})",
       sql="SELECT * FROM p ORDER BY created DESC, id LIMIT 7 OFFSET 4")
def st1(d):
    return windows.page(projects(d), [F.desc("created"), F.asc("id")], 4, 7)


_MATCH_ENTITIES = """
e AS (SELECT DISTINCT conv_id AS query_id,
        CASE conv_id % 5 WHEN 0 THEN 'parse' WHEN 1 THEN 'Manager' WHEN 2 THEN 'main.py'
                         WHEN 3 THEN 'the on' ELSE 'request_' || conv_id END AS text,
        CASE conv_id % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'file'
                         WHEN 3 THEN 'person' ELSE 'function' END AS type
      FROM conversations)"""


def match_entities(d):
    c = F.col("conv_id")
    pick = lambda *v: F.element_at(F.array(*v), (c % 5 + 1).cast("int"))
    return d.conversations.select(
        c.alias("query_id"),
        pick(F.lit("parse"), F.lit("Manager"), F.lit("main.py"), F.lit("the on"),
             F.concat(F.lit("request_"), c.cast("string"))).alias("text"),
        pick(F.lit("function"), F.lit("class"), F.lit("file"), F.lit("person"), F.lit("function")).alias("type"),
    ).distinct()


@query("flt4_node_match", "chunks", ctes=_MATCH_ENTITIES, sql=f"""
SELECT query_id, text, type, id FROM (
  SELECT e.*, c.id, row_number() OVER (PARTITION BY e.query_id, e.text, e.type ORDER BY c.id) AS r
  FROM e JOIN chunks c ON
    (e.type IN ('function', 'class') AND {_KIND} = e.type AND contains(c.name, e.text))
    OR (e.type = 'file' AND contains(c.file_path, e.text))
    OR (e.type IN ('person', 'organization') AND contains(c.content, e.text))) WHERE r <= 10""")
def flt4(d):
    return filters.node_match(match_entities(d), d.chunks)


@query("flt8_exclude_seen", "chunks", sql="""
SELECT id, project_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def flt8(d):
    seen = d.labels.filter("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    return windows.exclude_seen(d.chunks, seen, ["id"]).select("id", "project_id")


@query("wn1_first_per_key", "doc_edges", sql="""
SELECT src, dst, rel, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY dst) AS r FROM doc_edges) WHERE r = 1""")
def wn1(d):
    return windows.first_per_key(d.doc_edges, ["src", "rel"], ["dst"])


@query("wn2_dedup_prefix", sql="""
SELECT doc_id, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) AS r FROM documents)
WHERE r = 1""")
def wn2(d):
    return windows.dedup_prefix(d.documents, "text", ["doc_id"], score_col="n_chars").select(
        "doc_id", "source", "n_chars")


_RANKED = """ranked AS (
  SELECT doc_id // 150 AS query_id, id, file_path,
         row_number() OVER (PARTITION BY doc_id // 150 ORDER BY length(content) DESC, id) AS rank FROM chunks)"""


def ranked(d):
    """Result lists of 150 documents each, longest chunk first."""
    return windows.topk(
        d.chunks.withColumn("query_id", F.expr("doc_id div 150")), ["query_id"],
        [F.desc(F.length("content")), F.asc("id")], F.lit(2**31 - 1)).select("query_id", "id", "file_path", "rank")


@query("wn3_round_robin", "chunks", ctes=_RANKED, sql="""
SELECT query_id, id, file_path, rank, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pass, first_rank) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY rank) AS pass,
           min(rank) OVER (PARTITION BY query_id, g) AS first_rank FROM (
      SELECT *, string_split(file_path, '.')[-1] || '_' || regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS g
      FROM ranked))) WHERE position <= 25""")
def wn3(d):
    return windows.round_robin(ranked(d), 25)


@query("wn4_topk_per_query", sql="""
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders) WHERE rank <= 3""")
def wn4(d):
    return windows.topk(d.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select(
        "o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("wn5_normalise_by_max", sql="""
SELECT l_suppkey, l_partkey, n, round(n * 1.0e0 / greatest(max(n) OVER (PARTITION BY l_suppkey), 1), 6) AS share
FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)""")
def wn5(d):
    counts = d.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return windows.normalise_by_max(counts, ["l_suppkey"], "n", "share").withColumn("share", F.round("share", 6))


@query("wn6_block_end", sql="""
SELECT event_id, user_id,
       min(CASE WHEN event_type = 'purchase' THEN event_id END)
         OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase
FROM events""")
def wn6(d):
    return windows.next_matching(d.events, ["user_id"], "event_id", F.col("event_type") == "purchase",
                                 "next_purchase").select("event_id", "user_id", "next_purchase")


@query("wn7_running_mean", sql="""
SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running_mean
FROM events""")
def wn7(d):
    return windows.running_mean(d.events, "ts", "event_id", "value").select(
        "event_id", F.round(F.col("running_mean") + 1e-9, 6).alias("running_mean"))


@query("st2_sort_two_keys", sql="""
SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey""")
def st2(d):
    return d.part.orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").select(
        "p_partkey", "p_size", "p_retailprice")


@query("so1_union_results", "chunks", ctes=_RANKED, sql="""
SELECT 0 AS term_idx, query_id, id FROM ranked WHERE rank <= 20
UNION ALL SELECT 1, query_id, id FROM ranked WHERE rank <= 10""")
def so1(d):
    r = ranked(d)
    return windows.union_results(
        r.filter("rank <= 20").select(F.lit(0).alias("term_idx"), "query_id", "id"),
        r.filter("rank <= 10").select(F.lit(1).alias("term_idx"), "query_id", "id"))


@query("so2_distinct_terms", sql="""
SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS terms, count(*) AS n_terms FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (
    SELECT doc_id, w, min(p) AS p FROM (
      SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents)
    GROUP BY doc_id, w)) WHERE r <= 20 GROUP BY doc_id""")
def so2(d):
    terms = windows.distinct_terms(F.split("text", " "))
    return d.documents.select("doc_id", F.array_join(terms, " ").alias("terms"), F.size(terms).alias("n_terms"))


@query("so5_exclude", sql="""
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def so5(d):
    used = d.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return windows.exclude_seen(d.part, used, ["p_partkey"]).select("p_partkey", "p_name")
