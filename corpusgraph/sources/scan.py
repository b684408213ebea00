"""Source trees as a ``files(path, project_id, language, content)`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.chunks import language_of
from corpusgraph.rules.area_rules import EXCLUDED_DIRS, LANGUAGE_BY_SUFFIX


def keep_path(path, excluded: list[str] | None = None):
    """True for supported languages outside every excluded folder."""
    names = F.array(*[F.lit(x) for x in (EXCLUDED_DIRS if excluded is None else excluded)])
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return language_of(path).isNotNull() & ~F.arrays_overlap(folders, names)


def select_files(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Supported files of a ``files(path, ...)`` table, with their language."""
    return files.filter(keep_path(F.col("path"), excluded)).withColumn("language", language_of(F.col("path")))


def scan_tree(spark: SparkSession, root: str, project_id: str, excluded: list[str] | None = None) -> DataFrame:
    """All supported files under a root; the path is relative to the root.

    The glob keeps other file types from being opened at all.
    """
    suffixes = ",".join(s.lstrip(".") for s in LANGUAGE_BY_SUFFIX)
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + suffixes + "}").load(root))
    base = F.lit(root.rstrip("/") + "/")
    path = F.element_at(F.split(F.col("path"), base, 2), -1)
    files = raw.select(path.alias("path"), F.lit(project_id).alias("project_id"), F.decode("content", "UTF-8").alias("content"))
    return select_files(files, excluded).select("path", "project_id", "language", "content")
