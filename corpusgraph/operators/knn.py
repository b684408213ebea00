"""Exact and approximate cosine nearest neighbours for whole tables of queries.

Exact search has two physical forms with equal results:

* few queries (checked against ``max_cells``): they travel to every task once and each task
  scores its own Arrow batches, so the vector table is never shuffled;
* many queries: vectors beyond one block are indexed in lists (``ivf``). Each query looks into its likest lists, which gives a bound,
  then into the lists that can still reach it. A list and the queries that look into it meet in blocks of bounded size, so
  neither side has to fit anywhere.

Both emit only a running top k per query and task; one window finishes the ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.operators import ivf
from corpusgraph.operators.knn_math import matrix
from corpusgraph.session import materialize

SCORE_DIGITS = 6
BATCH_ROWS = 4096
BLOCK_QUERIES = 1024
BLOCK_VECTORS = 8192
#: Vectors scored at a time (with BLOCK_QUERIES queries), and the difference that rounding can make to a score.
TILE_VECTORS = 2048
ROUNDING = 1e-6
#: Rows of a side that meet in one task at a time: both sides are sent as often as the other one has such groups.
GROUP_QUERIES, GROUP_VECTORS = 32768, 65536
#: Groups of queries, of BLOCK_QUERIES at least, that keep the tasks busy where there are few.
SPREAD = 16
#: Lists that give an exact search its bound.
FIRST_LISTS = 4
#: Queries that a search by lists is fitted on (the bound of what is sent to every task there).
SAMPLE_QUERIES = 256
#: Share of the lists left in beyond which bounds are not worth looking at.
DENSE = 0.25


def _top(keys: pd.DataFrame, ks: np.ndarray, queries: np.ndarray, ids: np.ndarray,
         vectors: np.ndarray, allowed) -> pd.DataFrame:
    """Best ``k`` rows of one vector block per query; ties go to the smaller id.

    The vectors are looked at in tiles in the order of their ids, first in single precision; what may be above a query's ``k`` th
    score so far is scored again in double precision and merged once there are as many such rows as are held.
    """
    order = np.argsort(ids, kind="stable")
    order = order[np.isfinite(vectors[order]).all(axis=1)]  # others have no score with anything
    single = vectors[order].astype(np.float32)
    margin = ROUNDING + 2 * (vectors.shape[1] + 2) * np.finfo(np.float32).eps
    parts = []
    for lo in range(0, len(queries), BLOCK_QUERIES):
        hi = min(lo + BLOCK_QUERIES, len(queries))
        k = ks[lo:hi]
        most = max(int(k.max()), 0)
        asked = queries[lo:hi].astype(np.float32)
        q, v, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bar = np.where(k > 0, -np.inf, np.inf)
        new, waiting = [], 0
        for at in range(0, len(order) if most else 0, TILE_VECTORS):
            tile = order[at:at + TILE_VECTORS]
            scores = asked @ single[at:at + TILE_VECTORS].T
            mask = allowed(lo, hi, tile)
            if mask is not None:
                scores[~mask] = -np.inf
            floor = bar.copy()
            short = np.flatnonzero(bar == -np.inf)
            if len(tile) > most and len(short):
                # at least ``most`` rows of a tile are as good as this, so rows below it are left out
                floor[short] = np.partition(scores[short], len(tile) - most, axis=1)[:, len(tile) - most]
            near = scores >= (floor - margin).astype(np.float32)[:, None]
            new_q, new_v = np.divmod(np.flatnonzero(near if mask is None else near & mask), len(tile))
            found = np.round(np.einsum("ij,ij->i", queries[lo + new_q], vectors[tile[new_v]]), SCORE_DIGITS) + 0.0
            good = np.isfinite(found) & (found > bar[new_q])
            new.append((new_q[good], at + new_v[good], found[good]))
            waiting += int(good.sum())
            if waiting < (hi - lo) * most and not len(short) and at + TILE_VECTORS < len(order):
                continue
            q, v, held = (np.concatenate(c) for c in zip((q, v, held), *new))
            new, waiting = [], 0
            ranked = np.lexsort((v, -held, q))
            q, v, held = q[ranked], v[ranked], held[ranked]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k[q]
            q, v, held = q[keep], v[keep], held[keep]
            full = np.flatnonzero((np.bincount(q, minlength=hi - lo) >= k) & (k > 0))
            bar[full] = held[np.searchsorted(q, full, "right") - 1]
        if len(q):
            part = keys.iloc[lo + q].reset_index(drop=True)
            part["id"] = ids[order[v]]
            part["score"] = held
            parts.append(part)
    if not parts:
        return pd.DataFrame(columns=list(keys.columns) + ["id", "score"])
    return pd.concat(parts, ignore_index=True)


def _masker(queries: pd.DataFrame, vectors: pd.DataFrame, exclude_self: str | None):
    """What a query may not have, as a mask: of a group of vector lists those that it does not look into, and itself."""
    bits = places = None
    if "_lists" in queries and len(queries):
        bits = np.unpackbits(np.frombuffer(b"".join(queries["_lists"]), np.uint8).reshape(len(queries), -1), axis=1).astype(bool)
        places = vectors["_place"].to_numpy()
        if bits[:, np.unique(places)].all():
            bits = None
    if bits is None and exclude_self is None:
        return lambda lo, hi, order: None

    def allowed(lo: int, hi: int, order: np.ndarray) -> np.ndarray:
        mask = np.ones((hi - lo, len(order)), dtype=bool) if bits is None else bits[lo:hi][:, places[order]]
        if exclude_self is not None:
            own = queries[exclude_self].iloc[lo:hi].to_numpy(dtype=object)
            mask &= own[:, None] != vectors["id"].to_numpy(dtype=object)[order][None, :]
        return mask

    return allowed


def _alike(queries: pd.DataFrame, vectors: pd.DataFrame, equal: list[tuple[str, str]],
           member: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries with the same payload filter and of the vectors it lets through: equality (null = no filter), list
    membership (empty = no filter). A vector without a payload passes no filter on it."""
    codes, wanted = [], []
    for qcol, vcol in [*equal, *member]:
        code, values = pd.factorize(vectors[vcol])
        known = {value: i for i, value in enumerate(values)}
        codes.append(code)
        if (qcol, vcol) in equal:
            wanted.append([None if pd.isna(x) else (known.get(x, len(known)),) for x in queries[qcol]])
        else:
            wanted.append([tuple(sorted({known[x] for x in xs if x in known})) if xs is not None and len(xs) else None for xs in queries[qcol]])
    asked: dict[tuple, list[int]] = {}
    for i, filters in enumerate(zip(*wanted)):
        asked.setdefault(filters, []).append(i)
    for filters, rows in asked.items():
        mask = np.ones(len(vectors), dtype=bool)
        for code, want in zip(codes, filters):
            if want is not None:
                mask &= np.isin(code, want)
        yield np.array(rows), np.flatnonzero(mask)


def _top_filtered(queries: pd.DataFrame, asked: np.ndarray, vectors: pd.DataFrame, keys: list[str], equal: list[tuple[str, str]],
                  member: list[tuple[str, str]], exclude_self: str | None) -> pd.DataFrame:
    """``_top`` under payload filters: queries that filter alike are scored together, and with the vectors they may have only."""
    labels, ids = queries[keys + ["_k"]], vectors["id"].to_numpy()
    if not equal and not member:
        return _top(labels, labels["_k"].to_numpy(), asked, ids, matrix(vectors["embedding"]), _masker(queries, vectors, exclude_self))
    vectors = vectors.iloc[np.argsort(ids, kind="stable")]
    ids, rows = vectors["id"].to_numpy(), matrix(vectors["embedding"])
    parts = []
    for own, let in _alike(queries, vectors, equal, member):
        if len(let):
            mine = queries.iloc[own]
            parts.append(_top(labels.iloc[own], mine["_k"].to_numpy(), asked[own], ids[let], rows[let],
                              _masker(mine, vectors.iloc[let], exclude_self)))
    parts = [part for part in parts if len(part)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=keys + ["_k", "id", "score"])


def _finish(hits: DataFrame, keys: list[str], k: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int | str = 10,
    keys: tuple[str, ...] = ("query_id",),
    equal: list[tuple[str, str]] | None = None,
    member: list[tuple[str, str]] | None = None,
    exclude_self: str | None = None,
    max_cells: int = 4_000_000,
    force_blocks: bool = False,
) -> DataFrame:
    """``(keys.., rank, id, score)`` of the nearest vectors by cosine, filters applied first.

    ``queries``: key columns, ``embedding`` and any filter columns; ``vectors``: ``id``,
    ``embedding`` and any payload columns.  ``k`` is a number or a column of ``queries``.
    ``equal`` / ``member`` pair a query column with a vector column.  ``max_cells`` bounds what is
    sent to every task (rows times dimensions); beyond it the blocked form runs.
    """
    equal, member = equal or [], member or []
    key_list = list(keys)
    q_cols = key_list + ["_k"] + [c for c, _ in equal] + [c for c, _ in member]
    if exclude_self:
        q_cols.append(exclude_self)
    q_cols = list(dict.fromkeys(q_cols)) + ["embedding"]
    v_cols = list(dict.fromkeys(["id"] + [c for _, c in equal] + [c for _, c in member])) + ["embedding"]
    k_col = F.lit(k) if isinstance(k, int) else F.col(k)
    q = queries.withColumn("_k", k_col.cast("int")).select(*q_cols)
    v = vectors.select(*v_cols)
    out_schema = T.StructType(
        [q.schema[c] for c in key_list] + [T.StructField("_k", T.IntegerType()), v.schema["id"],
                                           T.StructField("score", T.DoubleType())])

    small = None
    if not force_blocks:
        first = q.select(F.size("embedding").alias("n")).filter("n > 0").first()
        room = max_cells // max(first["n"] if first else 1, 1)
        small = q.limit(room + 1).toPandas()
        if len(small) > room:
            small = None
    if small is not None:
        payload = small.drop(columns=["embedding"])
        shared = q.sparkSession.sparkContext.broadcast((payload, matrix(small["embedding"])))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            meta, asked = shared.value
            held: list[pd.DataFrame] = []
            rows = 0
            for batch in batches:
                for lo in range(0, len(batch), BATCH_ROWS):
                    held.append(_top_filtered(meta, asked, batch.iloc[lo: lo + BATCH_ROWS], key_list, equal, member, exclude_self))
                    rows += len(held[-1])
                if rows > 500_000:
                    held = [_keep_best(pd.concat(held, ignore_index=True), key_list)]
                    rows = len(held[0])
            if held:
                yield _keep_best(pd.concat(held, ignore_index=True), key_list)

        hits = v.mapInPandas(score, out_schema)
    else:
        form = _one_block if v.limit(BLOCK_VECTORS + 1).count() <= BLOCK_VECTORS else _pruned
        hits = form(q, v, key_list, out_schema, equal, member, exclude_self)
    return _finish(hits, key_list, F.lit(k) if isinstance(k, int) else F.col("_k")).drop("_k").select(*key_list, "rank", "id", "score")


def _keep_best(hits: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    hits = hits.sort_values(["score", "id"], ascending=[False, True], kind="stable")
    place = hits.groupby(keys, sort=False, dropna=False).cumcount()
    return hits[place.to_numpy() < hits["_k"].to_numpy()]


def _blocked(q: DataFrame, v: DataFrame, keys: list[str], out_schema: T.StructType,
             equal, member, exclude_self) -> DataFrame:
    """Block nested loop inside each bucket (a group of lists): every (query block, vector block) is one group of bounded size.

    The block counts come from exact bucket sizes, so a bucket holding a third of all rows is
    simply cut into more blocks. A query is sent to a group of lists once, however many of them it looks into, and gets at most
    ``k`` rows back from there.
    """
    # fresh column identities: both sides may come from the same table
    q, v = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (q, v))
    sizes = (
        q.groupBy("bucket").agg(F.count("*").alias("nq"))
        .join(v.groupBy("bucket").agg(F.count("*").alias("nv")), "bucket")
        .select("bucket",
                F.least(F.ceil(F.col("nq") / BLOCK_QUERIES), F.greatest(F.ceil(F.col("nq") / GROUP_QUERIES), F.lit(SPREAD))).cast(
                    "int").alias("qn"),
                F.ceil(F.col("nv") / GROUP_VECTORS).cast("int").alias("vn")))
    q_side = (
        q.join(sizes, "bucket")
        .withColumn("qb", F.pmod(F.xxhash64(*keys), F.col("qn")).cast("int"))
        .withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vn") - 1)))
        .drop("qn", "vn"))
    v_side = (
        v.join(sizes, "bucket")
        .withColumn("vb", F.pmod(F.xxhash64("id"), F.col("vn")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
        .drop("qn", "vn"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=keys + ["_k", "id", "score"])
        return _top_filtered(left, matrix(left["embedding"]), right, keys, equal, member, exclude_self)

    where = ["bucket", "qb", "vb"]
    return q_side.groupBy(*where).cogroup(v_side.groupBy(*where)).applyInPandas(pair, out_schema)


def _one_block(q: DataFrame, v: DataFrame, keys: list[str], out_schema: T.StructType, equal, member, exclude_self) -> DataFrame:
    """Hits among vectors that fit one block: every block of queries meets it."""
    return _blocked(q.withColumn("bucket", F.lit(0)), v.withColumn("bucket", F.lit(0)), keys, out_schema, equal, member, exclude_self)


def _pruned(q: DataFrame, v: DataFrame, keys: list[str], out_schema: T.StructType, equal, member, exclude_self,
            first: int = FIRST_LISTS) -> DataFrame:
    """Exact hits by lists: a bound from the likest lists, then all lists that can reach it. Where vectors have so little structure
    that the true bounds of a sample of queries leave more than ``DENSE`` of the lists in, all pairs are scored at once instead."""
    index = ivf.build(v, group_rows=GROUP_VECTORS)
    q = materialize(q, "queries")

    def bounded(side: DataFrame, bound: DataFrame) -> DataFrame:
        same = F.lit(True)
        for c in keys:
            same &= side[c].eqNullSafe(bound[f"key_{c}"])
        return side.join(bound, same & (side["_k"] == bound["place"]), "left").select(*side.columns, "bound")

    def bounds(hits: DataFrame, place: str) -> DataFrame:
        return hits.select(*[F.col(c).alias(f"key_{c}") for c in keys], F.col(place).alias("place"), F.col("score").alias("bound"))

    sample = materialize(_sample(q, keys), "asked")
    exact = cosine_topk(sample, v, "_k", tuple(keys), equal, member, exclude_self, max_cells=1 << 30)
    left = ivf.probe(bounded(sample, bounds(exact, "rank")), index, 0, bound="bound").count()
    if left > DENSE * sample.count() * len(index.centroids):
        return _blocked(q.withColumn("bucket", F.lit(0)), index.rows.withColumn("bucket", F.lit(0)), keys, out_schema, equal, member, exclude_self)

    rows = ivf.grouped(index)
    looked = lambda side: _blocked(side, rows, keys, out_schema, equal, member, exclude_self)
    near = materialize(looked(ivf.probe(q, index, first, groups=True)), "near")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"))
    bound = bounds(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") == F.col("_k")), "place")
    return near.unionByName(looked(ivf.probe(bounded(q, bound), index, first, skip=first, bound="bound", groups=True)))


def _sample(q: DataFrame, keys: list[str]) -> DataFrame:
    """About ``SAMPLE_QUERIES`` of the queries, the same ones each time."""
    share = SAMPLE_QUERIES / max(q.count(), 1)
    if share >= 1:
        return q
    return q.filter(F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def approx_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, keys: tuple[str, ...] = ("query_id",),
                target: float = 0.95, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """The ``k`` nearest vectors in each query's likest lists, ranked exactly; misses are possible.

    Unless ``probes`` says how many lists a query looks into, that is fitted: so many that about ``SAMPLE_QUERIES`` of the
    queries, compared with all vectors, have ``target`` of their true neighbours in them. Where vectors lie in groups these are
    few lists of about sqrt(rows) rows each; where they have no structure, no number of lists short of most of them will do.
    """
    key_list = list(keys)
    q = queries.select(*key_list, "embedding").withColumn("_k", F.lit(k))
    out_schema = T.StructType(
        [q.schema[c] for c in key_list] + [T.StructField("_k", T.IntegerType()), vectors.schema["id"],
                                           T.StructField("score", T.DoubleType())])
    index = ivf.build(vectors.select("id", "embedding"), lists, GROUP_VECTORS)
    if probes is None:
        sample = _sample(q, key_list)
        exact = cosine_topk(sample, index.rows, k, keys, max_cells=1 << 30)
        probes = ivf.probes_for(index, sample, exact, key_list, target)
    hits = _blocked(ivf.probe(q, index, probes, groups=True), ivf.grouped(index), key_list, out_schema, [], [], None)
    return _finish(hits, key_list, F.lit(k)).select(*key_list, "rank", "id", "score")


def recall(approx: DataFrame, exact: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Share of the exact result rows that the approximate result also has."""
    join = list(keys) + ["id"]
    found = approx.select(*join).withColumn("hit", F.lit(1))
    return exact.join(found, join, "left").agg(
        F.count("*").alias("expected"),
        F.sum(F.coalesce("hit", F.lit(0))).alias("found"),
        (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def multi_query_terms(queries: DataFrame, route: str = "search") -> DataFrame:
    """One row per search term with the number of neighbours that route asks for.

    ``queries``: ``query_id, limit_n, terms ARRAY``.
    """
    n = F.size("terms")
    share = F.floor(F.col("limit_n") / n).cast("int")
    k = {
        "search": F.when(F.col("term_idx") == 0, F.col("limit_n")).otherwise(F.greatest(F.lit(5), share)),
        "flow": F.greatest(F.lit(5), share),
        "enhanced": F.greatest(F.lit(3), share),
        "stream": F.greatest(F.lit(10), share),
    }[route]
    return (
        queries.select("*", F.posexplode("terms").alias("term_idx", "term"))
        .withColumn("k", k.cast("int")).drop("terms"))


def embedding_pool(tokens: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Mean of the token vectors of each id, position by position."""
    return (
        tokens.select(id_col, F.posexplode(vector_col).alias("pos", "x"))
        .groupBy(id_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"))
        .select(id_col, F.transform("p", lambda s: s["x"]).alias(vector_col)))


def zero_fill(df: DataFrame, dim: int, vector_col: str = "embedding") -> DataFrame:
    """Missing vectors become zeros of the collection's dimension."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.withColumn(vector_col, F.coalesce(F.col(vector_col), zeros))
