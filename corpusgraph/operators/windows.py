"""Per-key ranking, de-duplication, running values, paging and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import dir_name, extension
from corpusgraph.session import materialize


def _desc_nulls(cols: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key in the given order.

    An aggregate rather than a window: copies of one key combine before the shuffle, so a key
    holding a third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_prefix(df: DataFrame, text_col: str, order: list[str], size: int = 200,
                 score_col: str | None = None) -> DataFrame:
    """Keep the first-seen row of every text prefix (not the best one); the caller sorts by score."""
    out = first_per_key(df.withColumn("_prefix", F.substring(text_col, 1, size)), ["_prefix"], order)
    out = out.drop("_prefix")
    return out.orderBy(F.desc(score_col), *order) if score_col else out


def topk(df: DataFrame, keys: list[str], order: list[Column | str], n: int | Column,
         rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark prunes each task to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_desc_nulls(order))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def round_robin(df: DataFrame, limit: int | Column, keys: tuple[str, ...] = ("query_id",),
                path_col: str = "file_path", rank_col: str = "rank") -> DataFrame:
    """Spread a ranked list over (extension, folder) groups, one row per group and pass.

    Lists no longer than ``limit`` keep their order.  As a column, ``limit`` may differ between lists.
    """
    key_list = list(keys)
    grouped = df.withColumn(
        "_group", F.concat_ws("_", extension(F.col(path_col), "no_ext"), dir_name(F.col(path_col))))
    sizes = df.groupBy(*key_list).agg(F.count("*").alias("_n"))
    in_group = Window.partitionBy(*key_list, "_group").orderBy(rank_col)
    short = (
        grouped.withColumn("_pass", F.row_number().over(in_group)).filter(F.col("_pass") <= limit)
        .withColumn("_first", F.min(rank_col).over(Window.partitionBy(*key_list, "_group")))
        .join(sizes, key_list))
    spread = F.col("_n") > limit
    place = Window.partitionBy(*key_list).orderBy(
        F.when(spread, F.col("_pass")).otherwise(F.lit(0)),
        F.when(spread, F.col("_first")).otherwise(F.lit(0)), rank_col)
    return (
        short.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= limit)
        .drop("_group", "_pass", "_first", "_n"))


def normalise_by_max(df: DataFrame, keys: list[str], value_col: str, out_col: str) -> DataFrame:
    """Value over the largest value of its key, the largest counting as at least 1."""
    top = df.groupBy(*keys).agg(F.greatest(F.max(value_col), F.lit(1)).alias("_top"))
    return df.join(top, keys).withColumn(out_col, F.col(value_col) / F.col("_top")).drop("_top")


def next_matching(df: DataFrame, keys: list[str], order_col: str, predicate: Column,
                  out_col: str) -> DataFrame:
    """Position of the next later row of the key for which the predicate holds."""
    w = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out_col, F.min(F.when(predicate, F.col(order_col))).over(w))


def _prefix(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running totals up to each row in ``order``, one column for each of ``sums``.

    A two-level scan: sampled splitters over the whole order deal the rows evenly, however they crowd in time; each
    block's totals (one row a block) are summed over the blocks before it, and a window runs inside each block. ``order``
    has to tell rows apart, or rows that it doesn't tell apart stay in one block.
    """
    rows = materialize(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "blocks")
    totals = rows.groupBy("_b").agg(*[F.sum(v).alias(f"_t_{c}") for c, v in sums.items()])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_p_{c}") for c in sums])
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, "_b").withColumns(
        {c: F.col(f"_p_{c}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for c, v in sums.items()}).drop(
            "_b", *[f"_p_{c}" for c in sums])


def running_mean(df: DataFrame, time_col: str, tie_col: str, value_col: str, out_col: str = "running_mean") -> DataFrame:
    """Mean of all rows up to each row in time order; nulls don't count."""
    value = F.col(value_col)
    both = _prefix(df, [time_col, tie_col], {"_sum": value.cast("double"), "_count": F.when(value.isNotNull(), 1).otherwise(0)})
    return both.withColumn(out_col, F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))).drop("_sum", "_count")


def running_sum(df: DataFrame, time_col: str, ties: list[str], value_col: str, out_col: str) -> DataFrame:
    """Sum of all rows up to each row in time order, by the same two levels as ``running_mean``."""
    return _prefix(df, [time_col, *ties], {out_col: F.col(value_col)})


def numbered(df: DataFrame, by: list[str], order: list[str], out_col: str = "position") -> DataFrame:
    """Place of each row, from 1, among the rows of its group; no task sorts a whole large group.

    The rows are dealt evenly in order of group and ``order``; a group that runs over several blocks goes on from the sum of
    its rows in the blocks before. Columns of ``by`` are not null, and ``order`` tells the rows of a group apart.
    """
    rows = materialize(df.repartitionByRange(*by, *order).withColumn("_b", F.spark_partition_id()), "blocks")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_b", *by).agg(F.count("*").alias("_n")).select(
        "_b", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_p"))
    inside = Window.partitionBy("_b", *by).orderBy(*order)
    return rows.join(carried, ["_b", *by]).withColumn(out_col, F.col("_p") + F.row_number().over(inside)).drop("_b", "_p")


def pages(df: DataFrame, by: list[str], order: list[str], size: int, out_col: str) -> DataFrame:
    """``(*by, page, out_col)``: the rows of each group in order, as arrays of ``order`` structs of at most ``size``."""
    placed = numbered(df.select(*by, *order), by, order).withColumn("page", F.floor((F.col("position") - 1) / size))
    return placed.groupBy(*by, "page").agg(F.sort_array(F.collect_list(F.struct(*order))).alias(out_col))


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def union_results(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def distinct_terms(terms: Column, limit: int = 20) -> Column:
    """Terms without repeats, first seen first, at most ``limit``."""
    return F.slice(F.array_distinct(terms), 1, limit)


def merge_context(context: DataFrame) -> DataFrame:
    """``(query_id, context_type, position, other_id)``: the context rows of all results, first seen first."""
    w = Window.partitionBy("query_id", "context_type").orderBy("rank", "depth", "other_id", "id")
    return context.select("query_id", "context_type", F.row_number().over(w).alias("position"), "other_id")


def exclude_seen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the used ones."""
    return df.join(seen.select(*keys), keys, "left_anti")
