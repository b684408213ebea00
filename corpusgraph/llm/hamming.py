"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments. If two codes differ in at most m (r + 1) - 1 bits, one of their m segments differs in at most r
bits. Round r probes, for every open query and segment, the segment values at distance r; each pair is counted in one round
and segment only (where its smallest segment distance is met first). A query closes when its k-th verified distance is at
most m (r + 1) - 1: nothing unseen can be closer. Equal codes are one index entry that holds the smallest ids it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.session import materialize, spread

BITS, SEGMENT = 32, 16


def code_column(vector: str, bits: int = BITS) -> Column:
    """``bits`` signs of a vector's sums over runs of size(vector) / bits coordinates; missing numbers and NaN count as 0.

    A vector shorter than ``bits`` gives one bit per coordinate and ones for the rest.
    """
    return F.expr(f"""
        aggregate(transform(sequence(0, {bits - 1}), i ->
            aggregate(slice({vector}, i * greatest(1, size({vector}) div {bits}) + 1, greatest(1, size({vector}) div {bits})),
                      cast(0 as double), (a, x) -> a + coalesce(nanvl(cast(x as double), cast(0 as double)), cast(0 as double)))
            >= 0), 0L, (a, b) -> a * 2 + if(b, 1L, 0L))""")


def _segment(code: str, j: int) -> Column:
    return F.shiftrightunsigned(code, SEGMENT * j).bitwiseAND(F.lit((1 << SEGMENT) - 1))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, distance: the ``k`` nearest other rows of every query row of (vec_id, embedding).

    Distances are Hamming distances of codes; ties go to the smaller vec_id. Rows without vec_id or with a null or empty
    vector take no part; repeated rows of one vec_id count once. Fewer than ``k`` other rows give fewer results, no rows
    none. ``bits`` is a multiple of 16 up to 48. Further columns may be used by ``is_query`` and are dropped.
    """
    m = bits // SEGMENT
    rows = materialize(
        vectors.filter("vec_id is not null and size(embedding) > 0")
        .select("vec_id", code_column("embedding", bits).alias("code"), is_query.alias("asks"))
        .groupBy("vec_id").agg(F.min("code").alias("code"), F.max("asks").alias("asks")), "codes")
    first = Window.partitionBy("code").orderBy("vec_id")
    index = materialize(
        rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.count(F.lit(1)).alias("n")), "index")
    buckets = index.select("code", "n", F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), _segment("code", j).alias("value")) for j in range(m)])).alias("s")).select(
            "code", "n", "s.*")
    queries = rows.filter("asks").select(F.col("code").alias("q")).distinct()
    active = materialize(queries.withColumn("kth", F.lit(bits)), "active")
    best, closed = None, None
    for radius in range(SEGMENT + 1):
        if active.isEmpty():
            break
        masks = F.expr(f"filter(sequence(0L, {(1 << SEGMENT) - 1}L), x -> bit_count(x) = {radius})")
        sides = F.array(*[F.struct(F.lit(j).alias("j"), _segment("q", j).alias("own")) for j in range(m)])
        # probes are C(16, radius) times as many as their queries, which Spark's size estimate does not see: dealt to all
        # tasks first, and joined by a shuffle on both sides, never by a broadcast
        probes = (spread(active, "q").select("q", "kth", F.explode(sides).alias("s"))
                  .select("q", "kth", "s.j", "s.own", F.explode(masks).alias("mask"))
                  .select("q", "kth", "j", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
        apart = [F.bit_count(_segment("differ", j)) for j in range(m)]
        counted_here = F.lit(False)
        for j in range(m):
            here = F.col("j") == j
            for other in range(m):
                if other != j:
                    here &= apart[other] > radius if other < j else apart[other] >= radius
            counted_here |= here
        found = (probes.hint("merge").join(buckets.hint("merge"), ["j", "value"])
                 .withColumn("differ", F.col("q").bitwiseXOR(F.col("code")))
                 .withColumn("distance", F.bit_count("differ"))
                 .filter(counted_here & (F.col("distance") <= F.col("kth")))
                 .select("q", "code", "n", "distance"))
        if best is not None:
            found = found.unionByName(best.join(active.select("q"), "q", "left_semi"))
        # k + 1 places, for the query itself may be among them
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("distance"))
        at_least = F.min(F.when(F.col("upto") > k, F.col("distance"))).over(Window.partitionBy("q"))
        best = materialize(found.withColumn("upto", upto).withColumn("kth", F.coalesce(at_least, F.lit(bits)))
                           .filter(F.col("distance") <= F.col("kth")).select("q", "code", "n", "distance", "kth"), "best")
        covered = m * (radius + 1) - 1
        done = best.filter((F.col("kth") <= covered) | F.lit(covered >= bits)).select("q", "code", "distance")
        closed = done if closed is None else closed.unionByName(done)
        bound = best.groupBy("q").agg(F.min("kth").alias("new"))
        active = materialize(
            active.join(bound, "q", "left").select("q", F.coalesce("new", F.lit(bits)).alias("kth"))
            .filter((F.col("kth") > covered) & F.lit(covered < bits)), "active")
        best = best.drop("kth")
    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    if closed is None:
        closed = index.select(F.col("code").alias("q"), "code", F.lit(0).alias("distance")).limit(0)
    near = closed.join(index.select("code", F.explode("ids").alias("vec_id")), "code").select("q", "vec_id", "distance")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (asked.join(near, "q").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("long"), "vec_id", F.col("distance").cast("long").alias("distance")))
