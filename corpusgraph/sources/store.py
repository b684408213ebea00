"""Store operations: what a table holds after an upsert, replace or delete, and the same on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.sources.buckets import BucketTable, Manifest


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Insert or replace rows by key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_vectors(existing: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Upsert of the chunks that have an embedding; the others are skipped."""
    return upsert(existing, chunks.join(vectors.select("id", "embedding"), "id").select(*existing.columns))


def replace_by_file(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the incoming files go, then all rows with incoming ids, then the new rows come."""
    kept = existing.join(new.select("file_path").distinct(), "file_path", "left_anti")
    return upsert(kept.select(*existing.columns), new.select(*existing.columns))


def delete_by_file(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("file_path"), "file_path", "left_anti").select(*chunks.columns)


def detach_delete(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges left after their nodes are deleted."""
    gone = ids.select("id").distinct()
    return (
        edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
        .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns))


def store_vectors(table: BucketTable, chunks: DataFrame, vectors: DataFrame, batch: int | None = None) -> Manifest:
    """Stored form of ``upsert_vectors``; the table is dealt by id."""
    new = chunks.join(vectors.select("id", "embedding"), "id")
    return table.merge(new, ["id"], batch=batch)


def store_by_file(table: BucketTable, new: DataFrame, batch: int | None = None) -> Manifest:
    """Stored form of ``replace_by_file``; the table is dealt by file_path."""
    return table.merge(new, ["file_path", "id"], batch=batch)


def detach_nodes(edges: BucketTable, ids: DataFrame, batch: int | None = None) -> Manifest:
    """Stored form of ``detach_delete``: the deleted ids are noted, and hide edges at either end until ``compact``."""
    return edges.delete(ids.select("id"), ["src", "dst"], batch=batch)


def recreate(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Drop and write a stored collection."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def merge_projects(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Registry after changes: new ids are inserted, given fields replace, null fields keep.

    ``changes`` has the registry's columns and ``deleted BOOLEAN``.  Becoming ``indexed`` stamps
    ``indexed_at`` with the change's ``updated_at``; any given status but ``error`` clears an error
    that the change does not set itself.
    """
    fields = [c for c in current.columns if c != "id"]
    c, n = current.alias("c"), changes.alias("n")
    merged = c.join(n, F.col("c.id") == F.col("n.id"), "full").filter(~F.coalesce(F.col("n.deleted"), F.lit(False)))
    done = F.coalesce(F.col("n.status") == "indexed", F.lit(False))
    clears = F.coalesce(F.col("n.status") != "error", F.lit(False))
    cols = []
    for f in fields:
        value = F.coalesce(F.col(f"n.{f}"), F.col(f"c.{f}"))
        if f == "indexed_at":
            value = F.when(done, F.col("n.updated_at")).otherwise(value)
        if f == "indexing_error":
            value = F.coalesce(F.col(f"n.{f}"), F.when(~clears, F.col(f"c.{f}")))
        cols.append(value.alias(f))
    return merged.select(F.coalesce("c.id", "n.id").alias("id"), *cols)


def duplicate_names(projects: DataFrame) -> DataFrame:
    """Names that more than one project uses (must be empty)."""
    return projects.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
