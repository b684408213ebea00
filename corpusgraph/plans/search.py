"""End-to-end search plans built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators import filters, graph, knn, ner, rank
from corpusgraph.session import materialize


def first_of_same(entities: DataFrame) -> DataFrame:
    """``(query_id, same_as)``: queries with the same entities, as often and as sure, have the same graph side; the first stands
    for all of them."""
    lists = entities.groupBy("query_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(
        F.struct("text", "type", "confidence")))), 256).alias("_list"))
    return lists.join(lists.groupBy("_list").agg(F.min("query_id").alias("same_as")), "_list").drop("_list")


def hits_of_same(query_vectors: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``cosine_topk`` that asks once for each different query vector."""
    asked = query_vectors.groupBy("embedding").agg(F.min("query_id").alias("same_as"))
    found = materialize(knn.cosine_topk(asked.withColumnRenamed("same_as", "query_id"), vectors, k), "hits")
    a, b = query_vectors.select("query_id", "embedding").alias("a"), asked.alias("b")
    who = a.join(b, F.expr("a.embedding <=> b.embedding")).select("a.query_id", "same_as")
    return materialize(who.join(found.withColumnRenamed("query_id", "same_as"), "same_as").select("query_id", "rank", "id", "score"), "hits")


def entity_hybrid_search(queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, chunks: DataFrame,
                         edges: DataFrame, k: int = 10, limit: int = 10) -> dict[str, DataFrame]:
    """Entity-first hybrid search of a whole question table.

    Vector hits and the graph around the chunks each question's entities stand for are scored
    separately and merged.  The graph side is made once for each different list of entities; what
    is returned of it by query is expanded only when read.
    """
    entities = materialize(ner.extract_entities(queries), "entities")
    same = materialize(first_of_same(entities), "same")
    asked = entities.join(same.filter("query_id = same_as").select("query_id"), "query_id", "left_semi")
    mapped = materialize(filters.node_match(asked, chunks), "mapped")
    occurrences = asked.select("query_id", "text", "type").join(mapped, ["query_id", "text", "type"]).groupBy(
        "query_id", "id").agg(F.count("*").alias("times"))
    seeds = mapped.select("query_id", "id").distinct()

    relationships = graph.explore_relationships(edges, seeds)
    nodes = materialize(
        seeds.unionByName(graph.explore_nodes(edges, seeds).select("query_id", F.col("other_id").alias("id"))).distinct(),
        "nodes")
    # the same chunk starts the same paths in every query
    starts = seeds.select(F.col("id").alias("query_id"), "id").distinct()
    walks = graph.paths(edges, starts).select(F.col("id").alias("_start"), "path")
    walks = occurrences.withColumnRenamed("id", "_start").join(walks, "_start")
    relevance = rank.entity_relevance(nodes, chunks, asked, mapped)
    side = materialize(rank.graph_side(nodes, graph.graph_score(relationships), graph.degree_centrality(edges, nodes),
                                       graph.path_score(walks), relevance), "side")
    hits = hits_of_same(query_vectors, vectors, k)
    ranked = materialize(rank.hybrid_rank_of_same(hits, same, side, k, limit), "ranked")
    counts = nodes.groupBy("query_id").agg(F.count("*").alias("n"))

    def each(df: DataFrame) -> DataFrame:
        return same.join(df.withColumnRenamed("query_id", "same_as"), "same_as").drop("same_as")

    return {"ranked": ranked, "hits": hits, "nodes": each(nodes), "node_counts": each(counts), "relationships": each(relationships),
            "paths": each(walks), "entities": entities, "mapped": each(mapped),
            "relevance": each(side.select("query_id", "id", "entity_relevance"))}
