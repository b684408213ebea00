"""Widening a short result list towards the architectural areas it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import lookup
from corpusgraph.operators import stats, windows
from corpusgraph.rules import area_rules as A

MANY_SHORT, LEAST_HITS = 20, 3


def _short(results: DataFrame, queries: DataFrame) -> DataFrame:
    sizes = results.groupBy("query_id").agg(F.count("*").alias("_n"))
    return queries.select("query_id", "query", "target").join(sizes, "query_id", "left").withColumn(
        "_n", F.coalesce("_n", F.lit(0))).withColumn("short", F.col("target") - F.col("_n"))


def coverage_searches(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, term_idx, term, k, short)``: the extra searches of every list below its target.

    Far below: ten broad searches; otherwise one per missing area.
    """
    short = _short(results, queries).filter("short > 0")
    broad = short.filter(F.col("short") > MANY_SHORT).select(
        "query_id", "query", "short", F.posexplode(F.array(*[F.lit(t) for t in A.BROAD_SEARCHES])).alias("term_idx", "words"),
        F.greatest(F.lit(LEAST_HITS), F.floor(F.col("short") / len(A.BROAD_SEARCHES))).cast("int").alias("k"))
    missing = stats.missing_areas(stats.coverage_histogram(results))
    n_missing = missing.groupBy("query_id").agg(F.count("*").alias("_m"))
    order = Window.partitionBy("query_id").orderBy("area_no")
    narrow = (
        short.filter(F.col("short") <= MANY_SHORT).join(missing, "query_id").join(n_missing, "query_id")
        .withColumn("term_idx", F.row_number().over(order) - 1)
        .select("query_id", "query", "short", "term_idx", lookup(F.col("area"), A.COVERAGE_TERMS).alias("words"),
                F.greatest(F.lit(LEAST_HITS), F.floor(F.col("short") / F.col("_m"))).cast("int").alias("k")))
    return broad.unionByName(narrow).select(
        "query_id", "term_idx", F.concat_ws(" ", "query", "words").alias("term"), "k", "short")


def coverage_expand(results: DataFrame, queries: DataFrame, extra: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lists with unseen chunks of ``extra(query_id, term_idx, rank, id)`` appended, then spread over
    file types and cut to each query's target (all targets are taken from ``queries``)."""
    short = _short(results, queries).select("query_id", "target", "short", "_n")
    fresh = extra.join(results.select("query_id", "id"), ["query_id", "id"], "left_anti")
    once = fresh.groupBy("query_id", "id").agg(F.min(F.struct("term_idx", "rank")).alias("_o"))
    w = Window.partitionBy("query_id").orderBy("_o", "id")
    added = (
        once.withColumn("_p", F.row_number().over(w)).join(short, "query_id")
        .filter((F.col("short") <= MANY_SHORT) | (F.col("_p") <= F.col("short")))
        .select("query_id", "id", (F.col("_n") + F.col("_p")).cast("int").alias("rank")))
    everything = results.select("query_id", "id", "rank").unionByName(added).join(chunks.select("id", "file_path"), "id")
    goal = queries.select("query_id", F.col("target").alias("_target"))
    return windows.round_robin(everything.join(goal, "query_id"), F.col("_target")).drop("_target")
