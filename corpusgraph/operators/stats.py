"""Counts, distributions and reports over chunks, edges, selections and result lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import banded, contains_any, extension, first_label, kind_of, lookup
from corpusgraph.operators.filters import begins_like
from corpusgraph.rules import area_rules as A
from corpusgraph.session import materialize


def graph_statistics(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, relationships (both directions count) and distinct files."""
    left = chunks.agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"))
    right = edges.agg(F.count("*").alias("relationships"))
    both = left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one")
    return both.select("nodes", "relationships", "files")


def collection_info(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("project_id").agg(F.count("*").alias("points"))


def project_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(
        F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"))


def type_distribution(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("node_type").agg(F.count("*").alias("n"))


def layer_of(path: Column) -> Column:
    return first_label(F.lower(path), A.LAYERS, A.LAYER_DEFAULT)


def layer_components(chunks: DataFrame, selection: DataFrame, limit: int = 10) -> DataFrame:
    """Largest (file, type) groups of chunks that are selected or lie on an architectural path.

    Groups on an architectural path are the same for every query: they are counted once, and only
    their first ``limit`` are offered to each query next to the groups of its own selection.
    """
    by_path = contains_any(F.col("file_path"), A.LAYER_PATH_WORDS)

    def groups(df: DataFrame, keys: list[str]) -> DataFrame:
        # three names per group are picked before anything is collected
        by = [*keys, "file_path", "node_type"]
        first = Window.partitionBy(*by).orderBy("name")
        samples = (
            df.filter(F.col("name").isNotNull()).withColumn("_r", F.row_number().over(first))
            .filter(F.col("_r") <= 3).groupBy(*by)
            .agg(F.array_sort(F.collect_list("name")).alias("sample_components")))
        return df.groupBy(*by).agg(F.count("*").alias("component_count")).join(samples, by, "left")

    order = [F.desc("component_count"), F.asc("file_path"), F.asc("node_type")]
    shared = groups(chunks.filter(by_path), []).orderBy(*order).limit(limit)
    wanted = selection.select("query_id", "id").distinct()
    own = groups(wanted.join(chunks.filter(~by_path & begins_like(wanted, "id")("id")), "id"), ["query_id"])
    everyone = selection.select("query_id").distinct().join(F.broadcast(shared))
    w = Window.partitionBy("query_id").orderBy(*order)
    return (
        own.unionByName(everyone).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
        .select("query_id", "rank", layer_of(F.col("file_path")).alias("layer"), "file_path", "node_type",
                "component_count", "sample_components"))


def file_dependencies(edges: DataFrame, chunks: DataFrame, selection: DataFrame, limit: int = 15,
                      chosen: DataFrame | None = None) -> DataFrame:
    """Strongest call/import links between files around the selected files (``chosen(query_id, file_path)``, if known).

    Edges are first added up per file pair.  A pair with both files selected counts once for each.
    """
    files = chunks.select("id", "file_path")
    uses = edges.filter(F.col("rel").isin("CALLS", "IMPORTS")).select("src", "dst")
    chosen = _selected_files(files, selection) if chosen is None else chosen
    maybe, linked = begins_like(chosen, "file_path"), begins_like(uses, "src", "dst")
    ends = files.filter(linked("id"))
    pairs = (
        uses.join(ends.select(F.col("id").alias("src"), F.col("file_path").alias("source_file")), "src")
        .join(ends.select(F.col("id").alias("dst"), F.col("file_path").alias("target_file")), "dst")
        .filter(maybe("source_file") | maybe("target_file"))
        .groupBy("source_file", "target_file").agg(F.count("*").alias("n")))
    # each pair goes once to each of its files that may be chosen
    way = lambda when, own, other: F.when(when, F.struct(
        F.col(own).alias("file_path"), F.col(other).alias("_other"), F.lit(own == "source_file").alias("_out")))
    ways = F.array_compact(F.array(way(maybe("source_file"), "source_file", "target_file"),
                                   way(maybe("target_file") & F.expr("source_file <> target_file"), "target_file", "source_file")))
    found = pairs.select("n", F.inline(ways)).join(chosen, "file_path").select(
        "query_id", "n", F.when(F.col("_out"), F.col("file_path")).otherwise(F.col("_other")).alias("source_file"),
        F.when(F.col("_out"), F.col("_other")).otherwise(F.col("file_path")).alias("target_file"))
    w = Window.partitionBy("query_id").orderBy(F.desc("strength"), "source_file", "target_file")
    return (
        found.groupBy("query_id", "source_file", "target_file").agg(F.sum("n").alias("strength"))
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit))


def dependency_summary(dependencies: DataFrame) -> DataFrame:
    """Per query: number of file links, number of distinct files and their sorted list."""
    ends = dependencies.select("query_id", F.explode(F.array("source_file", "target_file")).alias("f")).distinct()
    nodes = ends.groupBy("query_id").agg(
        F.count("*").alias("unique_files"), F.array_sort(F.collect_list("f")).alias("nodes"))
    totals = dependencies.groupBy("query_id").agg(F.count("*").alias("total_dependencies"))
    return totals.join(nodes, "query_id")


def usage_counts(edges: DataFrame, chunks: DataFrame, selection: DataFrame) -> DataFrame:
    """Distinct callers and importers per (name, file, type) of the selected chunks; none counts as 0.

    Edges are counted once for each chunk, however many queries select it. A caller of several chunks of one group counts once
    for them, and which of them a query selects decides; only such callers are looked at query by query.
    """
    keys = ["name", "file_path", "node_type"]
    wanted = materialize(selection.select("query_id", "id").distinct(), "wanted")
    selected = begins_like(wanted, "id")
    named = materialize(wanted.select("id").distinct().join(chunks.filter(selected("id")).select("id", *keys), "id").distinct(), "named")
    groups = materialize(named.select(*keys).distinct().withColumn("_group", F.monotonically_increasing_id()), "groups")
    same = [named[k].eqNullSafe(groups[k]) for k in keys]
    # numbers instead of ids, so that the aggregates below need no sort
    members = materialize(named.join(groups, reduce(lambda x, y: x & y, same)).select(
        "id", "_group", F.monotonically_increasing_id().alias("_chunk")), "members")
    uses = edges.filter(F.col("rel").isin("CALLS", "IMPORTS") & F.col("src").isNotNull() & selected("dst")).select(
        F.col("dst").alias("id"), "src", (F.col("rel") == "CALLS").alias("_call"))
    callers = materialize(uses.join(members, "id").groupBy("_group", "_call", "src").agg(
        F.min("_chunk").alias("_chunk"), F.max("_chunk").alias("_last")), "callers")
    counted = [F.count_if("_call").alias("call_count"), F.count_if(~F.col("_call")).alias("import_count")]
    counts = callers.filter("_chunk = _last").groupBy("_chunk").agg(*counted)
    picked = wanted.join(members, "id").select("query_id", "_group", "_chunk")
    own = picked.join(counts, "_chunk", "left").select(
        "query_id", "_group", F.coalesce("call_count", F.lit(0)).alias("call_count"),
        F.coalesce("import_count", F.lit(0)).alias("import_count"))
    several = materialize(callers.filter("_chunk <> _last").select("_group", "_call", "src"), "several")
    met = (
        uses.join(several.select("_call", "src").distinct(), ["_call", "src"], "left_semi").join(members, "id")
        .join(several, ["_group", "_call", "src"], "left_semi").select("_chunk", "_call", "src"))
    shared = picked.join(met, "_chunk").select("query_id", "_group", "_call", "src").distinct().groupBy(
        "query_id", "_group").agg(*counted)
    total = own.unionByName(shared).groupBy("query_id", "_group").agg(
        F.sum("call_count").alias("call_count"), F.sum("import_count").alias("import_count"))
    return total.join(groups, "_group").select("query_id", *keys, "call_count", "import_count").withColumn(
        "total_usage", F.col("call_count") + F.col("import_count"))


def usage_category(total: Column) -> Column:
    return banded(total, A.USAGE_BANDS, A.USAGE_DEFAULT)


def usage_hotspots(edges: DataFrame, chunks: DataFrame, selection: DataFrame, limit: int = 10) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("total_usage"), "name", "file_path", "node_type")
    return (
        usage_counts(edges, chunks, selection)
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
        .withColumn("usage_category", usage_category(F.col("total_usage"))))


def _selected_files(files: DataFrame, selection: DataFrame) -> DataFrame:
    """``(query_id, file_path)``: files of the selected ids, stored."""
    wanted = selection.select("query_id", "id")
    return materialize(wanted.join(files.filter(begins_like(wanted, "id")("id")).select("id", "file_path"), "id").select(
        "query_id", "file_path").distinct(), "files")


def _file_types(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``(query_id, file_path, node_type, n)`` for every chunk of ``files(query_id, file_path)``, stored."""
    per_file = chunks.filter(begins_like(files, "file_path")("file_path")).groupBy("file_path", "node_type").agg(F.count("*").alias("n"))
    return materialize(files.join(per_file, "file_path"), "file-types")


def _overview(types: DataFrame) -> DataFrame:
    return types.groupBy("query_id").agg(
        F.countDistinct("file_path").alias("total_files"), F.sum("n").alias("total_chunks"),
        F.countDistinct("node_type").alias("node_types"),
        F.array_sort(F.collect_set("node_type")).alias("types_list"))


def system_overview(chunks: DataFrame, selection: DataFrame) -> DataFrame:
    return _overview(_file_types(chunks, _selected_files(chunks, selection)))


def complexity(chunks: DataFrame, selection: DataFrame) -> DataFrame:
    """Score 0.4 chunks/file + 0.3 types/10 + 0.3 e with e = -sum(p * sqrt(p)), and its level."""
    types = _file_types(chunks, _selected_files(chunks, selection))
    return _complexity(types, _overview(types))


def _complexity(file_types: DataFrame, overview: DataFrame) -> DataFrame:
    types = file_types.groupBy("query_id", "node_type").agg(F.sum("n").alias("n"))
    totals = materialize(overview.select("query_id", "total_files", "total_chunks", "node_types"), "totals")
    p = F.col("n") / F.col("total_chunks")
    spread = types.join(totals, "query_id").groupBy("query_id").agg((-F.sum(p * F.sqrt(p))).alias("_e"))
    per_file, diversity = F.col("total_chunks") / F.col("total_files"), F.col("node_types") / 10
    score = per_file * 0.4 + diversity * 0.3 + F.col("_e") * 0.3
    return totals.join(spread, "query_id").select(
        "query_id", F.bround(score, 2).alias("complexity_score"), F.bround(per_file, 1).alias("chunks_per_file"),
        F.bround(diversity, 2).alias("type_diversity"), F.bround("_e", 2).alias("organization_entropy"),
        banded(score, A.COMPLEXITY_BANDS, A.COMPLEXITY_DEFAULT).alias("complexity_level"))


def mode_file(results: DataFrame) -> DataFrame:
    """Most frequent file of every result list; ties go to the one ranked first."""
    per_file = results.groupBy("query_id", "file_path").agg(F.count("*").alias("n"), F.min("rank").alias("_first"))
    return per_file.groupBy("query_id").agg(
        F.min_by(F.struct("file_path", "n"), F.struct(-F.col("n"), "_first")).alias("m")).select(
        "query_id", F.col("m.file_path").alias("top_file"), F.col("m.n").alias("top_file_chunks"))


def kind_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "node_type").agg(F.count("*").alias("n"))


def relationship_histogram(relationships: DataFrame, both_ways: bool = False) -> DataFrame:
    """Relationships of each kind; with ``both_ways`` every one of ``relationships`` has its reverse, which is not listed."""
    counts = relationships.groupBy("query_id", "rel").agg(F.count("*").alias("n"))
    if not both_ways:
        return counts
    reverse = lookup(F.col("rel"), {name: back for name, back, _ in A.EDGE_KINDS})
    return counts.select("query_id", F.explode(F.array("rel", reverse)).alias("rel"), "n")


def graph_insights(centrality: DataFrame, paths: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per query: nodes above the centrality threshold, number of paths and mean nodes per path."""
    central = centrality.groupBy("query_id").agg(
        F.count_if(F.col("centrality") > threshold).alias("central_nodes"))
    walks = paths.groupBy("query_id").agg(
        F.count("*").alias("n_paths"), F.avg(F.size("path")).alias("mean_path_nodes"))
    return central.join(walks, "query_id", "full").select(
        "query_id", F.coalesce("central_nodes", F.lit(0)).alias("central_nodes"),
        F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "mean_path_nodes")


def top_central(centrality: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("centrality"), "id")
    best = centrality.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return best.join(chunks.select("id", "name", "node_type"), "id").select(
        "query_id", "rank", "id", "name", "node_type", "centrality")


def entity_groups(entities: DataFrame, limit: int = 5) -> DataFrame:
    """Best entities of each type."""
    w = Window.partitionBy("query_id", "type").orderBy(F.desc("confidence"), "start_pos", "text")
    return entities.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def coverage_area(path: Column) -> Column:
    return first_label(F.lower(path), A.COVERAGE_PATH, F.lit(None).cast("string"))


def coverage_histogram(results: DataFrame) -> DataFrame:
    """``(query_id, area, area_no, n)`` for all twelve areas, absent ones with 0."""
    areas = F.array(*[F.struct(F.lit(i).alias("area_no"), F.lit(a).alias("area"))
                      for i, (a, _) in enumerate(A.COVERAGE_PATH)])
    grid = results.select("query_id").distinct().select("query_id", F.inline(areas))
    counts = results.select("query_id", coverage_area(F.col("file_path")).alias("area")).groupBy(
        "query_id", "area").agg(F.count("*").alias("n"))
    return grid.join(counts, ["query_id", "area"], "left").select(
        "query_id", "area_no", "area", F.coalesce("n", F.lit(0)).alias("n"))


def missing_areas(coverage: DataFrame) -> DataFrame:
    """Uncovered areas, at most 5 in area order; if none, up to 3 areas with at most one chunk."""
    lists = coverage.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("n") == 0, F.struct("area_no", "area")))).alias("_zero"),
        F.sort_array(F.collect_list(F.when(F.col("n") <= 1, F.struct("area_no", "area")))).alias("_low"))
    pick = F.when(F.size("_zero") > 0, F.slice("_zero", 1, 5)).otherwise(F.slice("_low", 1, 3))
    return lists.select("query_id", F.inline(pick))


def layer_distribution(results: DataFrame) -> DataFrame:
    layer = first_label(F.lower("file_path"), A.LAYERS_FIVE, "other")
    return results.select("query_id", layer.alias("layer")).groupBy("query_id", "layer").agg(F.count("*").alias("n"))


def pattern_flags(results: DataFrame, entities: DataFrame) -> DataFrame:
    """``(query_id, patterns)``: design patterns suggested by chunk names and entity types."""
    name = F.lower(F.coalesce("name", F.lit("")))
    named = results.groupBy("query_id").agg(
        *[F.bool_or(name.contains(word)).alias(f"_{i}") for i, (_, word) in enumerate(A.NAME_PATTERNS)])
    types = entities.groupBy("query_id").agg(
        (F.bool_or(F.col("type") == "class") & F.bool_or(F.col("type") == "interface")).alias("_oo"))
    found = [F.when(F.coalesce("_oo", F.lit(False)), A.OBJECT_PATTERN)] + [
        F.when(F.col(f"_{i}"), label) for i, (label, _) in enumerate(A.NAME_PATTERNS)]
    return named.join(types, "query_id", "left").select(
        "query_id", F.array_compact(F.array(*found)).alias("patterns"))


def pairwise_relations(results: DataFrame) -> DataFrame:
    """Relations among each query's first four chunks: same file, or client path to server path."""
    cols = ["query_id", "rank", "name", "file_path", "start_line"]
    first = results.filter("rank <= 3").select(*[F.col(c).alias(f"a_{c}") for c in cols])
    other = results.filter("rank <= 4").select(*[F.col(c).alias(f"b_{c}") for c in cols])
    same = F.col("a_file_path") == F.col("b_file_path")
    talk = F.col("a_file_path").contains("client") & F.col("b_file_path").contains("server")
    line = lambda p: F.concat(F.lit("line_"), F.col(f"{p}_start_line").cast("string"))
    pairs = first.join(other, (F.col("a_query_id") == F.col("b_query_id")) & (F.col("a_rank") < F.col("b_rank")))
    w = Window.partitionBy("a_query_id").orderBy("a_rank", "b_rank")
    return (
        pairs.filter(same | talk).withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
        .select(F.col("a_query_id").alias("query_id"), "rank",
                F.coalesce("a_name", F.when(same, line("a")).otherwise(F.lit("client_component"))).alias("from_name"),
                F.coalesce("b_name", F.when(same, line("b")).otherwise(F.lit("server_component"))).alias("to_name"),
                F.when(same, "co-located").otherwise("communicates_with").alias("relationship")))


def perspective_rollup(perspectives: DataFrame, priorities: Column, keep: int = 7) -> DataFrame:
    """Mean confidence, distinct insight/recommendation counts, the most frequent recommendations
    (first mentioned first on ties) and how many perspectives are of high priority."""
    base = perspectives.withColumn("_priority", priorities)
    summary = base.groupBy("query_id").agg(
        F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n_perspectives"),
        F.count_if(F.col("_priority") <= 2).alias("high_priority"),
        F.count_if(F.col("_priority") > 2).alias("other_priority"))
    distinct = lambda col, out: base.select("query_id", F.explode(col).alias("_x")).distinct().groupBy(
        "query_id").agg(F.count("*").alias(out))
    mentions = base.select("query_id", "role_no", F.posexplode("recs").alias("_pos", "rec"))
    counted = mentions.groupBy("query_id", "rec").agg(
        F.count("*").alias("n"), F.min(F.struct("role_no", "_pos")).alias("_first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "_first")
    top = (
        counted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
        .groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_r", "rec"))).alias("_l"))
        .select("query_id", F.transform("_l", lambda s: s["rec"]).alias("action_items")))
    out = summary
    for part in (distinct("insights", "distinct_insights"), distinct("recs", "distinct_recs"), top):
        out = out.join(part, "query_id", "left")
    return out.fillna(0, ["distinct_insights", "distinct_recs"])


def perspective_quality(perspectives: DataFrame) -> DataFrame:
    base = perspectives.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.sum(F.size("insights")).alias("total_insights"), F.sum(F.size("recs")).alias("total_recs"),
        F.count_if(F.col("confidence") >= 0.8).alias("high"),
        F.count_if((F.col("confidence") >= 0.6) & (F.col("confidence") < 0.8)).alias("medium"),
        F.count_if(F.col("confidence") < 0.6).alias("low"))
    focus = perspectives.select("query_id", F.explode("focus").alias("f")).groupBy("query_id").agg(
        F.array_sort(F.collect_set("f")).alias("focus_areas"))
    return base.join(focus, "query_id", "left")


def job_metrics(jobs: DataFrame) -> DataFrame:
    """``jobs(query_id, success, processing_time)`` -> totals per orchestration."""
    return jobs.groupBy("query_id").agg(
        F.count("*").alias("total"), F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"), F.sum("processing_time").alias("processing_time"))


def query_log_metrics(log: DataFrame) -> DataFrame:
    """``log(response_time, cache_hit, confidence)`` -> one row of service metrics."""
    return log.agg(
        F.count("*").alias("total_queries"), F.count_if("cache_hit").alias("cache_hits"),
        (F.count_if("cache_hit") / F.greatest(F.count("*"), F.lit(1)) * 100).alias("hit_rate"),
        F.avg("response_time").alias("mean_response_time"), F.avg("confidence").alias("mean_confidence"))


def assignment_by_role(assigned: DataFrame) -> DataFrame:
    """``assigned(query_id, role, id, file_path)`` -> chunks, share, files and extensions per role."""
    exts = (
        assigned.groupBy("query_id", "role", extension(F.col("file_path"), "unknown").alias("ext"))
        .agg(F.count("*").alias("n")))
    listed = exts.groupBy("query_id", "role").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("n")).alias("o"), "ext", "n"))).alias("_l")).select(
        "query_id", "role",
        F.array_join(F.transform("_l", lambda s: F.format_string("%s(%d)", s["ext"], s["n"])), ", ").alias("extensions"))
    roles = assigned.groupBy("query_id", "role").agg(
        F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))
    totals = roles.groupBy("query_id").agg(F.sum("chunks").alias("_t"))
    return roles.join(totals, "query_id").join(listed, ["query_id", "role"]).select(
        "query_id", "role", "chunks", (F.col("chunks") / F.col("_t") * 100).alias("share"), "files", "extensions")


def assignment_overall(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("query_id").agg(
        F.count("*").alias("assigned"), F.countDistinct("id").alias("unique_chunks")).select(
        "query_id", "assigned", "unique_chunks", (F.col("assigned") - F.col("unique_chunks")).alias("overlap"),
        (F.col("unique_chunks") / F.col("assigned") * 100).alias("efficiency"))


def relations_dedup(edges: DataFrame) -> DataFrame:
    """``(id, calls, called_by)`` as sorted distinct lists."""
    return edges.filter(F.col("rel").isin("CALLS", "CALLED_BY")).groupBy(F.col("src").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("rel") == "CALLS", F.col("dst")))).alias("calls"),
        F.array_sort(F.collect_set(F.when(F.col("rel") == "CALLED_BY", F.col("dst")))).alias("called_by"))


def relation_pages(edges: DataFrame, size: int = 1000) -> DataFrame:
    """``(id, rel, page, others)``: the sorted distinct lists of ``relations_dedup`` in pages of ``size``, so that a chunk that
    everything calls has many rows instead of one large one."""
    from corpusgraph.operators.windows import pages

    calls = edges.filter(F.col("rel").isin("CALLS", "CALLED_BY") & F.col("src").isNotNull() & F.col("dst").isNotNull())
    rows = calls.select(F.col("src").alias("id"), "rel", F.col("dst").alias("other_id")).distinct()
    return pages(rows, ["id", "rel"], ["other_id"], size, "others").withColumn("others", F.col("others.other_id"))


def graph_export(chunks: DataFrame, edges: DataFrame, file_path: str | None = None,
                 project_ids: list[str] | None = None, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for drawing; the filter applies to nodes and to the source of an edge."""
    from corpusgraph.functions.text import preview
    from corpusgraph.operators.filters import payload_filter
    from corpusgraph.operators.graph import relationship_label

    kept = chunks.filter(payload_filter(project_ids, file_path))
    nodes = kept.orderBy("id").limit(limit).select(
        "id", F.coalesce("name", F.lit("unnamed")).alias("label"), kind_of(F.col("node_type")).alias("type"),
        "file_path", "start_line", "end_line", preview(F.col("content"), 100).alias("content_preview"))
    links = edges if not (file_path or project_ids) else edges.join(
        kept.select(F.col("id").alias("src")), "src", "left_semi")
    links = links.orderBy("src", "dst", "rel").limit(limit).select(
        F.col("src").alias("source"), F.col("dst").alias("target"), relationship_label(F.col("rel")).alias("type"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return nodes, links


def comprehensive_context(edges: DataFrame, chunks: DataFrame, selection: DataFrame) -> dict[str, DataFrame]:
    """All reports about one selection; what two of them need is made once."""
    from corpusgraph.operators.graph import data_flow

    selection = materialize(selection.select("query_id", "id"), "selection")
    files = _selected_files(chunks, selection)
    deps = materialize(file_dependencies(edges, chunks, selection, chosen=files), "dependencies")
    types = _file_types(chunks, files)
    overview = materialize(_overview(types), "overview")
    return {
        "architectural_patterns": layer_components(chunks, selection),
        "data_flow_patterns": data_flow(edges, chunks, selection),
        "file_dependencies": deps,
        "dependency_graph": dependency_summary(deps),
        "usage_patterns": usage_hotspots(edges, chunks, selection),
        "system_overview": overview,
        "system_complexity": _complexity(types, overview),
    }
