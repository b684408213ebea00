"""Bounded-depth graph operators as joins on an ``edges(src, dst, rel, weight)`` table.

Every result is keyed by ``query_id``; ``seeds(query_id, id)`` may hold any number of queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import kind_of, lookup
from corpusgraph.operators.filters import begins_like, substring_join
from corpusgraph.operators.salting import salted_join
from corpusgraph.rules.area_rules import EDGE_KINDS
from corpusgraph.session import materialize

CALL_RELS = ["CALLS", "CALLED_BY"]
IMPORT_RELS = ["IMPORTS", "IMPORTED_BY"]
FAMILY_RELS = ["CHILD_OF", "PARENT_OF"]
WALK_RELS = CALL_RELS + IMPORT_RELS + FAMILY_RELS
LIKENESS_RELS = ["SIMILAR_TO", "DEPENDS_ON"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def edges_from(pairs: DataFrame, forward: str) -> DataFrame:
    """Forward and reverse edges of one relationship from ``(src, dst)`` pairs."""
    name, reverse, weight = next(e for e in EDGE_KINDS if e[0] == forward)
    there = pairs.select("src", "dst", F.lit(name).alias("rel"), F.lit(weight).alias("weight"))
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                        F.lit(reverse).alias("rel"), F.lit(weight).alias("weight"))
    return there.unionByName(back)


def build_edges(chunks: DataFrame) -> DataFrame:
    """Edges from ``parent_id``, ``calls`` and ``imports`` of the chunks; both ends must exist."""
    parents = chunks.filter(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    calls = chunks.select(F.col("id").alias("src"), F.explode("calls").alias("dst"))
    imports = chunks.select(F.col("id").alias("src"), F.explode("imports").alias("dst"))
    ids = chunks.select(F.col("id"))
    out = []
    for pairs, name in ((parents, "PARENT_OF"), (calls, "CALLS"), (imports, "IMPORTS")):
        known = (
            pairs.distinct()
            .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        out.append(edges_from(known, name))
    return _union(out)


def walk(edges: DataFrame, seeds: DataFrame, rel: str, depth: int) -> DataFrame:
    """``(query_id, id, other_id, depth)`` reached along one relationship within ``depth`` hops.

    Each level is stored and starts from the one before it, so a walk takes one join a hop. Where no node has two ways on (up a
    tree), only the first level is compared for rows that meet; later ones cannot meet unless their starts did.
    """
    step = edges.filter(F.col("rel") == rel).select(F.col("src").alias("_at"), F.col("dst").alias("_next"))
    front = seeds.select("query_id", "id", F.col("id").alias("_at"))
    single = depth > 1 and step.groupBy("_at").count().filter("_at IS NOT NULL AND count > 1").isEmpty()
    levels = []
    for hop in range(1, depth + 1):
        found = front.join(step, "_at").select("query_id", "id", F.col("_next").alias("_at"))
        front = materialize(found if single and hop > 1 else found.distinct(), "level")
        levels.append(front.select("query_id", "id", F.col("_at").alias("other_id"), F.lit(hop).alias("depth")))
    return _union(levels)


def ancestors(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    return walk(edges, seeds, "CHILD_OF", depth)


def descendants(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    return walk(edges, seeds, "PARENT_OF", depth)


def neighbours(edges: DataFrame, seeds: DataFrame, rels: list[str] | None = None) -> DataFrame:
    """One hop along the call and import relationships."""
    rels = rels or CALL_RELS + IMPORT_RELS
    e = edges.filter(F.col("rel").isin(rels)).select(F.col("src").alias("id"), F.col("dst").alias("other_id"), "rel")
    return seeds.select("query_id", "id").join(e, "id").select("query_id", "id", "rel", "other_id").distinct()


def siblings(edges: DataFrame, seeds: DataFrame, limit: int = 5) -> DataFrame:
    """Up to ``limit`` other children of the same parent.

    Only the first ``limit + 1`` children of a parent can ever be needed, so large families are cut
    before the join instead of being paired with themselves.
    """
    up = edges.filter(F.col("rel") == "CHILD_OF").select(F.col("src").alias("_kid"), F.col("dst").alias("_parent"))
    mine = seeds.select("query_id", "id").join(up.withColumnRenamed("_kid", "id"), "id")
    first = Window.partitionBy("_parent").orderBy("_kid")
    family = (
        up.join(mine.select("_parent").distinct(), "_parent", "left_semi").distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= limit + 1)
        .select("_parent", F.col("_kid").alias("other_id")))
    pairs = mine.join(family, "_parent").filter(F.col("other_id") != F.col("id"))
    return _first_per_seed(pairs, limit)


def same_file(chunks: DataFrame, seeds: DataFrame, limit: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The other chunks of the same file (the first ``limit`` if given), optionally of some kinds only."""
    pool = chunks if kinds is None else chunks.filter(kind_of(F.col("node_type")).isin(kinds))
    if limit is None:
        return _all_of_file(chunks, pool, seeds)
    mine = seeds.select("query_id", "id").join(chunks.select("id", "file_path"), "id")
    first = Window.partitionBy("file_path").orderBy("id")
    pool = (
        pool.select("file_path", "id").join(mine.select("file_path").distinct(), "file_path", "left_semi").withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= limit + 1).select("file_path", F.col("id").alias("other_id")))
    pairs = mine.join(pool, "file_path").filter(F.col("other_id") != F.col("id"))
    return _first_per_seed(pairs, limit)


def _all_of_file(chunks: DataFrame, pool: DataFrame, seeds: DataFrame) -> DataFrame:
    """All pairs of a file, each once. The pairs are as many as the square of the file, so nothing but the two sides is shuffled:
    a pair can come up twice only if both of its ends lie in several files, and only such pairs are compared afterwards."""
    def places(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("id").alias(name)).agg(F.collect_set("file_path").alias("_p")).select(
            name, (F.size("_p") > 1).alias(f"_{name}_often"), F.explode("_p").alias("file_path"))

    # files that no seed can share need not be looked at, nor do they make a pair come up twice
    seeds = materialize(seeds.select("query_id", "id").distinct(), "same-file-ids")
    mine = materialize(seeds.join(places(chunks.filter(begins_like(seeds, "id")("id")), "id"), "id"), "same-file-seeds")
    pool = pool.filter(begins_like(mine, "file_path")("file_path"))
    others = materialize(places(pool, "other_id").join(mine.select("file_path").distinct(), "file_path", "left_semi"), "same-file-pool")
    pairs = salted_join(mine, others, "file_path", "id", "other_id").filter("id <> other_id")
    twice = F.col("_id_often") & F.col("_other_id_often")
    cols = ["query_id", "id", "other_id"]
    once = pairs.filter(~twice).select(*cols)
    if others.filter("_other_id_often").isEmpty():
        return once
    return once.unionByName(pairs.filter(twice).select(*cols).distinct())


def _first_per_seed(pairs: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id", "id").orderBy("other_id")
    return (
        pairs.select("query_id", "id", "other_id").distinct()
        .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r"))


def chunk_context(edges: DataFrame, chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(query_id, id, context_type, other_id, depth)``: the eight kinds of context of each seed."""
    seeds = seeds.select("query_id", "id").distinct()
    kinds = {"CALLS": "calls", "CALLED_BY": "called_by", "IMPORTS": "imports", "IMPORTED_BY": "imported_by"}
    flat = lambda df, kind: df.withColumn("context_type", kind).withColumn("depth", F.lit(1))
    parts = [
        ancestors(edges, seeds).withColumn("context_type", F.lit("parents")),
        descendants(edges, seeds).withColumn("context_type", F.lit("children")),
        flat(neighbours(edges, seeds), lookup(F.col("rel"), kinds)).drop("rel"),
        flat(siblings(edges, seeds), F.lit("siblings")),
        flat(same_file(chunks, seeds, 3, ["class", "module", "interface"]), F.lit("architectural_context")),
    ]
    return _union([p.select("query_id", "id", "context_type", "other_id", "depth") for p in parts])


def union_related(edges: DataFrame, chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(query_id, id, other_id)``: nodes one or two relationships away in either direction, similar or
    dependent ones, and all other chunks of the same file."""
    s = seeds.select("query_id", "id").distinct()
    pair = lambda e: e.select("src", "dst").union(e.select(F.col("dst"), F.col("src"))).distinct()
    walk = pair(edges.filter(F.col("rel").isin(CALL_RELS + IMPORT_RELS + ["CHILD_OF", "PARENT_OF"])))
    like = pair(edges.filter(F.col("rel").isin("SIMILAR_TO", "DEPENDS_ON")))
    one = s.join(walk.toDF("id", "other_id"), "id")
    two = one.withColumnRenamed("other_id", "src").join(walk, "src").withColumnRenamed("dst", "other_id")
    near = _union([x.select("query_id", "id", "other_id") for x in (one, two, s.join(like.toDF("id", "other_id"), "id"))])
    near = near.filter("id <> other_id").distinct()
    # what lies in the same file comes from there, so that these many pairs need no comparison with the others
    files = chunks.select("id", "file_path").distinct()
    met = near.join(files, "id").join(files.toDF("other_id", "file_path"), ["other_id", "file_path"]).select(*near.columns)
    return near.join(met, near.columns, "left_anti").unionByName(same_file(chunks, s))


def related_seeds(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, id)``: chunks named so, filed so, or whose content contains the name."""
    n = names.select("query_id", "name").distinct()
    by_name = n.join(chunks.select("name", "id"), "name")
    by_path = n.join(chunks.select(F.col("file_path").alias("name"), "id"), "name")
    by_text = n.join(substring_join(chunks, "id", "content", n, "name"), "name")
    return _union([x.select("query_id", "id") for x in (by_name, by_path, by_text)]).distinct()


def related_entities(edges: DataFrame, chunks: DataFrame, seeds: DataFrame, limit: int = 50) -> DataFrame:
    """``(query_id, rank, id, relevance)``: chunks within two hops of a seed or in its file.

    Relevance: 0.9 same file, then 0.8 direct call, 0.7 direct import, 0.85 direct parent or child,
    0.6 anything else, tested in that order for every (seed, chunk); a chunk may be listed once per
    distinct relevance.  Two shortcuts keep hubs cheap and the result exact: a file contributes at
    most its first ``limit + 1`` chunks, and the second hop (always worth 0.6 or already counted)
    is only walked for queries that the better rows do not fill.
    """
    files = chunks.select("id", "file_path")
    s = seeds.select("query_id", "id").distinct().join(files, "id").select(
        "query_id", F.col("id").alias("_s"), F.col("file_path").alias("_sf"))
    e = edges.filter(F.col("rel").isin(WALK_RELS + LIKENESS_RELS)).select("src", "dst", "rel")

    def around(ids: DataFrame) -> DataFrame:
        """Links of the given nodes in both directions, one row per pair."""
        ends = ids.select(F.col("id").alias("src")).distinct()
        out = e.join(ends, "src", "left_semi").select("src", "dst", "rel")
        back = e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel")
        return (
            out.unionByName(back.join(ends, "src", "left_semi").select("src", "dst", "rel"))
            .groupBy("src", "dst").agg(
                F.max(F.col("rel").isin(CALL_RELS)).alias("_call"), F.max(F.col("rel").isin(IMPORT_RELS)).alias("_import"),
                F.max(F.col("rel").isin(FAMILY_RELS)).alias("_family"),
                F.count_if(F.col("rel").isin(WALK_RELS)).alias("_walks"))
            .join(files.withColumnRenamed("id", "dst").withColumnRenamed("file_path", "_f"), "dst"))

    hop = materialize(around(s.select(F.col("_s").alias("id"))), "hop")
    direct = s.join(hop.withColumnRenamed("src", "_s"), "_s").filter(F.col("_f") != F.col("_sf")).select(
        "query_id", F.col("dst").alias("id"),
        F.when(F.col("_call"), 0.8).when(F.col("_import"), 0.7).when(F.col("_family"), 0.85)
        .otherwise(0.6).alias("relevance"))

    # same file: every chunk but the seed itself, unless another seed shares the file or a walk leads back
    pool = (
        files.join(s.select(F.col("_sf").alias("file_path")).distinct(), "file_path", "left_semi")
        .withColumn("_r", F.row_number().over(Window.partitionBy("file_path").orderBy("id")))
        .filter(F.col("_r") <= limit + 1).select(F.col("file_path").alias("_sf"), "id"))
    lone = s.groupBy("query_id", "_sf").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    in_file = lone.join(pool, "_sf").filter(
        (F.col("_lo") != F.col("_hi")) | (F.col("id") != F.col("_lo"))).select(
        "query_id", "id", F.lit(0.9).alias("relevance"))
    returns = hop.groupBy("src").agg(F.max("_walks").alias("_w")).filter("_w >= 2").select(F.col("src").alias("_s"))
    back = s.join(returns, "_s", "left_semi").select("query_id", F.col("_s").alias("id"), F.lit(0.9).alias("relevance"))
    near = materialize(_union([direct, in_file, back]).distinct(), "near")

    strong = near.filter("relevance > 0.6").groupBy("query_id").agg(F.count("*").alias("_n"))
    hungry = s.join(strong.filter(F.col("_n") >= limit), "query_id", "left_anti")
    mids = hungry.join(hop.filter("_walks > 0").select(F.col("src").alias("_s"), F.col("dst").alias("_m")), "_s")
    next_hop = around(mids.select(F.col("_m").alias("id"))).filter("_walks > 0").select(F.col("src").alias("_m"), "dst", "_f")
    far = mids.join(next_hop, "_m").filter(
        F.col("_f") != F.col("_sf")).select("query_id", "_s", F.col("dst").alias("id")).distinct()
    adjacent = hop.select(F.col("src").alias("_s"), F.col("dst").alias("id"))
    far = far.join(adjacent, ["_s", "id"], "left_anti").select("query_id", "id", F.lit(0.6).alias("relevance"))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    return (
        near.unionByName(far).distinct().withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit).select("query_id", "rank", "id", "relevance"))


def related_to_names(edges: DataFrame, chunks: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """``related_entities`` of the chunks that each query's ``names(query_id, name)`` stand for. Queries with the same names have
    the same seeds and results, so that each set of names is looked up and walked once."""
    sets = materialize(names.select("query_id", "name").filter("name is not null").distinct().groupBy("query_id").agg(
        F.sort_array(F.collect_set("name")).alias("_names")).withColumn("_set", F.sha2(F.to_json("_names"), 256)), "names")
    asked = sets.groupBy("_set").agg(F.first("_names").alias("_names")).select(
        F.col("_set").alias("query_id"), F.explode("_names").alias("name"))
    found = materialize(related_entities(edges, chunks, materialize(related_seeds(asked, chunks), "seeds"), limit), "related")
    return sets.select("query_id", "_set").join(found.withColumnRenamed("query_id", "_set"), "_set").drop("_set")


def explore_nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(query_id, id, reach, other_id)`` with reach ``out``, ``in`` or ``second``."""
    s = seeds.select("query_id", "id").distinct()
    pairs = edges.select("src", "dst").distinct()
    out = s.join(pairs.select(F.col("src").alias("id"), F.col("dst").alias("other_id")), "id")
    inn = s.join(pairs.select(F.col("dst").alias("id"), F.col("src").alias("other_id")), "id")
    second = (
        out.withColumnRenamed("other_id", "src").join(pairs, "src").filter(F.col("dst") != F.col("id"))
        .select("query_id", "id", F.col("dst").alias("other_id")).distinct())
    label = lambda df, name: df.select("query_id", "id", F.lit(name).alias("reach"), "other_id")
    return _union([label(out, "out"), label(inn, "in"), label(second, "second")])


def explore_relationships(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct ``(query_id, src, dst, rel, weight)`` of the same neighbourhood."""
    s = seeds.select("query_id", "id").distinct()
    out = s.join(edges.withColumn("id", F.col("src")), "id")
    inn = s.join(edges.withColumn("id", F.col("dst")), "id")
    second = (
        out.select("query_id", "id", F.col("dst").alias("_m")).distinct()
        .join(edges.withColumn("_m", F.col("src")), "_m").filter(F.col("dst") != F.col("id")))
    return _union([x.select("query_id", "src", "dst", "rel", "weight") for x in (out, inn, second)]).distinct()


def paths(edges: DataFrame, seeds: DataFrame, depth: int = 3, limit: int = 5) -> DataFrame:
    """Up to ``limit`` directed paths of 1..``depth`` hops per seed, shortest first, then by node ids.

    An edge is used at most once and the end differs from the start.  A seed stops growing once it
    has enough paths, and edges to targets beyond a node's first few (in id order) can never be among
    the first ``limit`` extensions: of those targets one may be the start, and at most ``depth - 1``
    can be used up.  All relationship kinds to a kept target stay.
    """
    room = limit + 1 + (depth - 1)
    w = Window.partitionBy("src").orderBy("dst")
    pairs = edges.select("src", "dst", "rel")
    s = seeds.select("query_id", "id").distinct()
    front = s.select("query_id", "id", F.col("id").alias("_at"), F.array("id").alias("path"),
                     F.array().cast("array<string>").alias("_used"))
    done: list[DataFrame] = []
    for hop in range(1, depth + 1):
        near = (
            pairs.join(front.select(F.col("_at").alias("src")).distinct(), "src", "left_semi").distinct()
            .withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= room)
            .select(F.col("src").alias("_at"), F.col("dst").alias("_next"), "rel"))
        longer = (
            front.join(near, "_at")
            .withColumn("_edge", F.concat_ws("\u0001", "_at", "_next", "rel"))
            .filter(~F.array_contains("_used", F.col("_edge")))
            .select("query_id", "id", F.col("_next").alias("_at"),
                    F.concat("path", F.array("_next")).alias("path"),
                    F.concat("_used", F.array("_edge")).alias("_used")))
        # every later step reads this level, which is a few rows per unfinished seed
        front = materialize(longer, f"paths{hop}")
        best = Window.partitionBy("query_id", "id").orderBy("path", "_used")
        done.append(
            front.filter(F.col("_at") != F.col("id"))
            .withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit)
            .select("query_id", "id", F.lit(hop).alias("hops"), "path", "_used"))
        if hop < depth:
            enough = _union(done).groupBy("query_id", "id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= limit)
            front = front.join(enough, ["query_id", "id"], "left_anti")
    final = Window.partitionBy("query_id", "id").orderBy("hops", "path", "_used")
    return (
        _union(done).withColumn("path_no", F.row_number().over(final)).filter(F.col("path_no") <= limit)
        .select("query_id", "id", "path_no", "path"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree)``: relationships touching a node; a self-loop counts once."""
    ends = edges.select(F.explode(
        F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, id, degree, centrality)``: degree over the largest degree in the node set."""
    n = nodes.select("query_id", "id").distinct().join(degrees(edges), "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0)))
    top = n.groupBy("query_id").agg(F.greatest(F.max("degree"), F.lit(1)).alias("_top"))
    return n.join(top, "query_id").select(
        "query_id", "id", "degree", (F.col("degree") / F.col("_top")).alias("centrality"))


def graph_score(relationships: DataFrame, ways: int = 1) -> DataFrame:
    """``(query_id, id, graph_score)`` from the relationships touching each node; with 2 ``ways`` every one has its reverse, not listed."""
    ends = relationships.select("query_id", "weight", F.explode(
        F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("id"))
    return ends.groupBy("query_id", "id").agg(
        F.least(F.count("*") * F.lit(ways) * F.lit(0.1) + F.avg("weight") * F.lit(0.2), F.lit(1.0)).alias("graph_score"))


def path_score(path_rows: DataFrame) -> DataFrame:
    """``(query_id, id, path_score)``: each path of n > 1 nodes gives 1/n to every node on it.

    An optional ``times`` column says how often a path was found.
    """
    times = F.col("times") if "times" in path_rows.columns else F.lit(1)
    return (
        path_rows.filter(F.size("path") > 1)
        .select("query_id", (times / F.size("path")).alias("_v"), F.explode(F.array_distinct("path")).alias("id"))
        .groupBy("query_id", "id").agg(F.least(F.sum("_v"), F.lit(1.0)).alias("path_score")))


def touching(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """``(query_id, src, dst, rel, weight)``: edges whose source or target is selected, each once.

    An end that begins like no selected id is not looked up. Edges with one end left cannot come up from both sides and are made
    distinct where they were joined; only edges with both ends left are compared across the two sides.
    """
    s = materialize(selection.select("query_id", "id").distinct(), "touching")
    maybe = begins_like(s, "id")
    cols = ["query_id", "src", "dst", "rel", "weight"]
    rows = edges.select(*cols[1:])
    joined = lambda df, end: df.join(s.withColumnRenamed("id", end), end).select(*cols)
    both = rows.filter(maybe("src") & maybe("dst"))
    return _union([
        joined(rows.filter(maybe("src") & ~maybe("dst")), "src").distinct(), joined(rows.filter(~maybe("src") & maybe("dst")), "dst").distinct(),
        joined(both, "src").unionByName(joined(both, "dst")).distinct()])


def data_flow(edges: DataFrame, chunks: DataFrame, selection: DataFrame, limit: int = 20) -> DataFrame:
    """Call and import edges touching the selection, with the attributes of both ends."""
    hits = touching(edges.filter(F.col("rel").isin("CALLS", "IMPORTS")), selection)
    w = Window.partitionBy("query_id").orderBy("src", "dst", "rel")
    # a few rows for each query, and their ends: small enough to be sent to the nodes, unless the queries are many
    hits = materialize(hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit), "flow")
    ends = materialize(hits.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "flow-ends")
    known = materialize(chunks.join(ends, "id", "left_semi").select("id", "name", "file_path", "node_type"), "flow-nodes")
    side = lambda p: known.select(
        F.col("id").alias(p), F.col("name").alias(f"{p}_name"), F.col("file_path").alias(f"{p}_file"),
        F.col("node_type").alias(f"{p}_type"))
    return (
        hits.join(side("src"), "src").join(side("dst"), "dst")
        .select("query_id", "rank", "src", "dst", "src_name", "src_file", "src_type", "dst_name", "dst_file",
                "dst_type", "rel",
                F.when(F.col("rel") == "CALLS", "outbound").otherwise("import").alias("flow_direction")))


def relationship_label(rel: Column) -> Column:
    """Relationship name used at the graph export; unknown kinds count as calls."""
    return lookup(rel, {"PARENT_OF": "parent_child", "CHILD_OF": "parent_child", "CALLS": "calls",
                        "CALLED_BY": "called_by"}, "calls")
