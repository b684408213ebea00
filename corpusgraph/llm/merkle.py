"""Merkle manifests of a dataset: a hash tree for each part (language), and one over the parts.

Positions of all leaves come from one range-partitioned sort: the row's place in its partition plus the rows that partitions
before it hold of the same tree. A level of a tree is a slot pivot: the parent of ``FANOUT`` consecutive nodes gathers them
into ``FANOUT`` columns by conditional aggregates (partly before the shuffle, for neighbours lie together); concatenating
the columns gives its hash, and leaving out a node's own column gives the node's siblings. The way back goes down from the
root: every parent hands its children their siblings and the way that it was handed itself. Levels are written tables with an
eighth of the rows of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.session import materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WAY = "cast(array() as array<struct<before:string,after:string>>)"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` if null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return hashed(*[field(text if c == "text" else F.col(c)) for c in FIELDS])


def tampered() -> Column:
    """Rows whose text counts as changed when their proof is checked."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos`` (place in its ``tree``, from 0, by ``order``) and ``n``, the rows of its tree."""
    sort = [F.col("tree"), *order]
    dealt = materialize(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "dealt")
    # one row for each partition and tree in it
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("start"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select(
        "tree", "part", (F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("start")).alias("shift"),
        F.sum("own").over(Window.partitionBy("tree")).alias("n")), "offsets")
    return (dealt.join(offsets, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
            .drop("at", "part", "shift"))


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of the trees over ``nodes`` (tree, pos, n, hash, payload).

    A level has one row for each parent: tree, pos, n (parents in its tree), hash and the slots s0, s1, ... of its children
    (hash, payload). Roots have tree, hash, and of a tree that is a lone leaf its payload.
    """
    levels: list[DataFrame] = []
    roots = nodes.filter("n = 1").select("tree", "hash", "payload", F.lit(True).alias("is_leaf"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    slots = [f"s{j}" for j in range(FANOUT)]
    while most > 1:
        slot = F.col("pos") % FANOUT
        pivot = (nodes.filter("n > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("up")).agg(
            F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n"),
            *[F.max(F.when(slot == j, F.struct("hash", "payload"))).alias(s) for j, s in enumerate(slots)])
            .withColumnRenamed("up", "pos"))
        levels.append(materialize(pivot.withColumn("hash", hashed(*_hashes(slots))), "level"))
        nodes = levels[-1].select("tree", "pos", "n", "hash", F.lit(None).cast(nodes.schema["payload"].dataType).alias("payload"))
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", "hash", "payload", F.lit(False).alias("is_leaf")))
        most = -(-most // FANOUT)
    return levels, roots


def _hashes(slots: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"{s}.hash"), F.lit("")) for s in slots]


def ways(levels: list[DataFrame], roots: DataFrame, handed: list[str]) -> DataFrame:
    """hash, payload, ``way`` and the ``handed`` columns of every leaf of the trees with ``roots`` (of ``build``, with a way and
    the handed columns). The way lists the hashes before and after a leaf and each of its ancestors, upwards."""
    found = roots.filter("is_leaf").select("hash", "payload", "way", *handed)
    tops = roots.filter("not is_leaf").select("tree", "way", *handed)
    slots = [f"s{j}" for j in range(FANOUT)]
    digests = _hashes(slots)
    children = F.array(*[
        F.when(F.col(s).isNotNull(), F.struct(
            F.lit(j).alias("slot"), f"{s}.hash", f"{s}.payload",
            F.struct(F.concat(F.lit(""), *digests[:j]).alias("before"),
                     F.concat(F.lit(""), *digests[j + 1:]).alias("after")).alias("beside")))
        for j, s in enumerate(slots)])
    down = None
    for k in reversed(range(len(levels))):
        parents = levels[k].filter("n = 1").select("tree", "pos").join(tops, "tree")
        if down is not None:
            parents = parents.unionByName(down)
        met = (levels[k].join(parents, ["tree", "pos"])
               .select("tree", "pos", "way", *handed, F.explode(F.array_compact(children)).alias("c"))
               .withColumn("way", F.concat(F.array("c.beside"), "way")))
        down = met.select("tree", (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos"), "way", *handed)
        if k == 0:
            found = found.unionByName(met.select("c.hash", "c.payload", "way", *handed))
    return found


def fold(way: str, start: Column) -> Column:
    """The root that a node with hash ``start`` has by its way."""
    return F.aggregate(way, start, lambda h, x: hashed(x["before"], h, x["after"]))


def proof(way: str) -> Column:
    """Hash of all siblings on a way, from the node upwards, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(way, lambda x: F.array(x["before"], x["after"])))), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    Leaves hash ``FIELDS`` (null: ``-``). Each ``lang`` (null is one, before all others) is a tree over its rows by doc_id, null
    first; rows with the same doc_id follow by leaf, and equal rows each take a place. A lone node is its tree's root. Where
    ``tampered``, the root is folded from a leaf whose text has its A-Z lower-cased. Empty and very long texts are hashed
    whole; further columns are ignored; no rows give no rows.
    """
    rows = docs.select(*FIELDS)
    changed = F.when(tampered() & F.col("text").rlike("[A-Z]"), leaf(F.translate("text", _CAPITALS, _SMALL)))
    leaves = materialize(rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf(F.col("text")).alias("hash"), F.struct("doc_id", changed.alias("changed")).alias("payload")), "leaves")
    levels, roots = build(positions(leaves, [F.asc("payload.doc_id"), F.col("hash")]))
    parts = roots.select(F.lit("").alias("tree"), "hash", F.struct("tree").alias("payload"))
    upper, root = build(positions(parts, [F.col("payload.tree")]))
    top = root.select("*", F.expr(_NO_WAY).alias("way"), F.col("hash").alias("root"))
    of_tree = ways(upper, top, ["root"]).select(F.col("payload.tree").alias("tree"), "way", "root")
    found = ways(levels, roots.join(of_tree, "tree").withColumn("subroot", F.col("hash")), ["subroot", "root"])
    folded = found.select("payload.doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof("way").alias("proof_sha256"),
                          fold("way", F.coalesce("payload.changed", "hash")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
