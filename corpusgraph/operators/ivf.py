"""Coarse quantiser for vectors: lists around centroids, searched in the order of their centroids' likeness to a query.

``fit`` finds the centroids by spherical k-means over a sample of bounded size; every row is then indexed in the list of its
nearest centroid. The number of lists grows with the square root of the rows. A search either probes so many lists that a sample
of queries reaches a wanted recall (``probes_for``), or, to be exact, all lists that can still hold one of the ``k`` nearest: no
row of a list is nearer to a query than the list's radius allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.operators.knn_math import matrix
from corpusgraph.session import materialize

#: Numbers in the centroids (every task holds them) and in the sample that they are fitted on.
CENTROID_CELLS, SAMPLE_CELLS = 1 << 22, 1 << 24
#: Sampled rows for each list, rounds of k-means.
PER_LIST, ROUNDS = 64, 6
#: The list of rows without direction (null, empty or zero vectors), whose cosine is 0 with everything.
NOWHERE = -1
#: Scores are compared after rounding, so bounds get this much room.
SLACK = 2e-6


@dataclass
class Index:
    centroids: np.ndarray  # unit rows
    radius: np.ndarray  # largest angle between a list's centroid and a row of it
    rows: DataFrame  # the vector table with ``bucket``, stored
    nowhere: bool  # whether there are rows without direction
    per_group: int = 1  # lists with following numbers that make a group


def _share(df: DataFrame, key: str, share: float) -> DataFrame:
    """About ``share`` of the rows, the same ones each time."""
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def _nearest(unit: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list of each row, angle to its centroid)."""
    score = unit @ centroids.T
    best = score.argmax(axis=1)
    angle = np.arccos(np.clip(score[np.arange(len(unit)), best], -1, 1))
    zero = ~unit.any(axis=1)
    return np.where(zero, NOWHERE, best), np.where(zero, 0.0, angle)


def centroids(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Unit centroids of (id, embedding), by rounds of assigning a bounded sample and averaging; as many as ``lists`` at most."""
    known = vectors.filter("size(embedding) > 0").select("id", "embedding")
    first = known.select(F.size("embedding").alias("dim")).first()
    if first is None:
        return np.zeros((0, 0))
    n, dim = known.count(), first["dim"]
    lists = lists or int(np.ceil(np.sqrt(n)))
    lists = max(1, min(lists, CENTROID_CELLS // dim, n))
    sample = materialize(_share(known, "id", min(PER_LIST * lists, max(SAMPLE_CELLS // dim, lists)) / n), "sample")
    at = np.stack(sample.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(lists).toPandas()["embedding"].map(np.asarray))
    found = matrix(at)
    found = np.unique(found[found.any(axis=1)], axis=0) if found.any() else np.zeros((0, dim))
    spark = vectors.sparkSession
    for _ in range(ROUNDS if len(found) > 1 else 0):
        shared = spark.sparkContext.broadcast(found)

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(shared.value)
            for batch in batches:
                unit = matrix(batch["embedding"])
                own, _ = _nearest(unit, shared.value)
                np.add.at(total, own[own >= 0], unit[own >= 0])
            used = np.flatnonzero(total.any(axis=1))
            yield pd.DataFrame({"bucket": used, "total": list(total[used])})

        parts = sample.mapInPandas(sums, "bucket long, total array<double>")
        met = parts.groupBy("bucket").applyInPandas(
            lambda g: pd.DataFrame({"bucket": g["bucket"].iloc[:1], "total": [np.sum(np.stack(list(g["total"])), axis=0)]}),
            "bucket long, total array<double>").toPandas()
        moved = found.copy()
        if len(met):
            moved[met["bucket"].to_numpy()] = matrix(met["total"])
        # a centroid whose rows cancel each other stays where it was
        found = np.where(moved.any(axis=1, keepdims=True), moved, found)
    return found


def build(vectors: DataFrame, lists: int | None = None, group_rows: int = 1) -> Index:
    """Index of all rows of ``vectors`` (id, embedding, payload), with their list as ``bucket``; groups of lists have about
    ``group_rows`` rows on average."""
    found = centroids(vectors, lists)
    shared = vectors.sparkSession.sparkContext.broadcast(found)
    schema = T.StructType([*vectors.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(shared.value):
                own, angle = _nearest(matrix(batch["embedding"], shared.value.shape[1]), shared.value)
            else:
                own, angle = np.full(len(batch), NOWHERE), np.zeros(len(batch))
            yield batch.assign(bucket=own.astype("int32"), angle=angle)

    rows = materialize(vectors.mapInPandas(assign, schema), "ivf")
    radii = rows.groupBy("bucket").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).toPandas()
    radius = np.full(len(found), -1.0)  # an empty list
    inside = radii[radii["bucket"] >= 0]
    radius[inside["bucket"].to_numpy()] = inside["radius"].to_numpy()
    per_group = max(1, int(group_rows * len(found) / max(inside["n"].sum(), 1)))
    return Index(found, radius, rows.drop("angle"), bool((radii["bucket"] == NOWHERE).any()), min(per_group, max(len(found), 1)))


def _order(unit: np.ndarray, index_centroids: np.ndarray) -> np.ndarray:
    """Lists of each query from the likest centroid on."""
    return np.argsort(-(unit @ index_centroids.T), axis=1, kind="stable")


def grouped(index: Index) -> DataFrame:
    """The indexed rows with their group as ``bucket`` and their list's place in it as ``_place``."""
    return index.rows.withColumn("_place", F.pmod("bucket", F.lit(index.per_group)).cast("int")).withColumn(
        "bucket", F.floor(F.col("bucket") / index.per_group).cast("int"))


def probe(queries: DataFrame, index: Index, first: int, skip: int = 0, bound: str | None = None, groups: bool = False) -> DataFrame:
    """``queries`` once for each list to look into, as ``bucket``: the ``first`` likest ones, or, with the column ``bound`` (a score
    that a row has to reach; null: any), all others of which a row can reach it. ``skip`` lists have been looked into.

    With ``groups`` once for each group of lists that has one to look into, and ``_lists``: a bit for each of the group's lists.
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radius))
    nowhere, per_group = index.nowhere, index.per_group
    fields = [*queries.schema.fields, T.StructField("bucket", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField("_lists", T.BinaryType())] if groups else fields)

    def in_groups(part: pd.DataFrame, use: np.ndarray) -> list[pd.DataFrame]:
        rows = []
        for group, low in enumerate(range(0, use.shape[1], per_group)):
            own = use[:, low:low + per_group]
            some = np.flatnonzero(own.any(axis=1))
            bits = np.packbits(np.pad(own[some], ((0, 0), (0, per_group - own.shape[1]))), axis=1)
            rows.append(part.iloc[some].assign(bucket=np.full(len(some), group, "int32"), _lists=[b.tobytes() for b in bits]))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, radius = shared.value
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.iloc[low:low + 512]
                use = np.zeros((len(part), len(at)), bool)
                if len(at):
                    unit = matrix(part["embedding"], at.shape[1])
                    order = _order(unit, at)
                    if bound is None:
                        np.put_along_axis(use, order[:, skip:first], True, axis=1)
                    else:
                        angle = np.arccos(np.clip(unit @ at.T, -1, 1))
                        best = np.where(unit.any(axis=1)[:, None], np.cos(np.maximum(angle - radius[None, :], 0)), 0.0)
                        use = best >= part[bound].fillna(-2.0).to_numpy(float)[:, None] - SLACK
                        np.put_along_axis(use, order[:, :skip], False, axis=1)
                    use &= radius[None, :] >= 0
                if groups:
                    rows = in_groups(part, use)
                else:
                    pairs = np.argwhere(use)
                    rows = [part.iloc[pairs[:, 0]].assign(bucket=pairs[:, 1].astype("int32"))]
                if nowhere and bound is None and not skip:
                    rows.append(part.assign(bucket=np.full(len(part), NOWHERE, "int32")))
                    if groups:
                        rows[-1]["_lists"] = b"\xff" * -(-per_group // 8)
                if rows:
                    yield pd.concat(rows, ignore_index=True)

    return queries.mapInPandas(run, schema)


def probes_for(index: Index, sample: DataFrame, exact: DataFrame, keys: list[str], recall: float) -> int:
    """How many of the likest lists hold ``recall`` of the ``exact`` neighbours (keys, id) of the sampled queries."""
    if not len(index.centroids):
        return 1
    shared = sample.sparkSession.sparkContext.broadcast(index.centroids)
    schema = T.StructType([*[sample.schema[k] for k in keys], T.StructField("places", T.ArrayType(T.IntegerType()))])

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = _order(matrix(batch["embedding"], shared.value.shape[1]), shared.value)
            place = np.argsort(order, axis=1).astype("int32")
            yield batch[keys].assign(places=list(place))

    where = exact.join(index.rows.select("id", "bucket"), "id").join(sample.mapInPandas(places, schema), keys)
    counts = (where.filter(F.col("bucket") >= 0).select(F.get("places", F.col("bucket")).alias("place"))
              .groupBy("place").count().toPandas())
    if not len(counts):
        return 1
    found = np.bincount(counts["place"].to_numpy(), counts["count"].to_numpy(), minlength=len(index.centroids))
    return int(np.searchsorted(np.cumsum(found) / found.sum(), recall - 1e-12)) + 1
