"""Parent and call relations between the chunks of ``outline``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators import folds
from corpusgraph.operators.salting import salted_join
from corpusgraph.session import materialize


def containment_parent(chunks: DataFrame) -> DataFrame:
    """``(id, parent_id)``: the smallest chunk of the same file that starts no later (and comes
    earlier in start order) and contains this one; the first of equals.

    Works inside one array per file - never larger than the file row the chunks came from - with one stack, so no
    pairs of chunks are ever materialised.
    """
    per_file = chunks.groupBy("file_path").agg(F.sort_array(F.collect_list(
        F.struct("start_line", "list_no", "end_line", "id"))).alias("a"))
    around = folds.smallest_around_of(F.transform("a", lambda c: c["start_line"]), F.transform("a", lambda c: c["end_line"]))
    found = per_file.withColumn("p", around).select(F.inline(F.transform("a", lambda c, i: F.struct(
        c["id"].alias("id"), F.when(F.get("p", i) >= 0, F.get("a", F.get("p", i))["id"]).alias("parent_id")))))
    return found.filter(F.col("parent_id").isNotNull())


def _last_by_name(chunks: DataFrame) -> DataFrame:
    """A name used twice in a file stands for its last chunk."""
    named = chunks.filter(F.col("name").isNotNull())
    return named.groupBy("file_path", "name").agg(F.max_by("id", "list_no").alias("id"))


def calls_in_file(sites: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(caller_id, callee_id)`` for names defined in the caller's file."""
    last = _last_by_name(chunks)
    callers = last.select("file_path", F.col("name").alias("caller_name"), F.col("id").alias("caller_id"))
    callees = last.select("file_path", F.col("name").alias("callee_name"), F.col("id").alias("callee_id"))
    return (
        sites.select("file_path", "caller_name", "callee_name").distinct()
        .join(callers, ["file_path", "caller_name"]).join(callees, ["file_path", "callee_name"])
        .select("caller_id", "callee_id").distinct())


def calls_across_files(sites: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(caller_id, callee_id)`` for names unknown in the caller's file: every chunk of that name elsewhere.

    Callers are distinct per (file, caller, name) before the join; the pairs of a frequent name are dealt to many tasks.
    """
    last = _last_by_name(chunks)
    callers = last.select("file_path", F.col("name").alias("caller_name"), F.col("id").alias("caller_id"))
    local = last.select("file_path", F.col("name").alias("callee_name"))
    foreign = materialize(
        sites.select("file_path", "caller_name", "callee_name").distinct()
        .join(local, ["file_path", "callee_name"], "left_anti")
        .join(callers, ["file_path", "caller_name"]), "callers")
    known = materialize(chunks.filter(F.col("name").isNotNull()).select(
        F.col("name").alias("callee_name"), F.col("id").alias("callee_id"), F.col("file_path").alias("_other")), "callees")
    return (
        salted_join(foreign, known, "callee_name", "caller_id", "callee_id").filter(F.col("_other") != F.col("file_path"))
        .select("caller_id", "callee_id").distinct())


def relate(chunks: DataFrame, sites: DataFrame) -> DataFrame:
    """Chunks with ``parent_id``, ``calls`` and ``called_by`` filled in."""
    calls = calls_in_file(sites, chunks).unionByName(calls_across_files(sites, chunks)).distinct()
    out = calls.groupBy(F.col("caller_id").alias("id")).agg(F.array_sort(F.collect_set("callee_id")).alias("calls"))
    back = calls.groupBy(F.col("callee_id").alias("id")).agg(F.array_sort(F.collect_set("caller_id")).alias("called_by"))
    none = F.array().cast("array<string>")
    return (
        chunks.join(containment_parent(chunks), "id", "left").join(out, "id", "left").join(back, "id", "left")
        .withColumn("calls", F.coalesce("calls", none)).withColumn("called_by", F.coalesce("called_by", none)))
