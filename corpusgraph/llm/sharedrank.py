"""Ranked lexical search for many items at once, by common subexpressions of their scores.

A score is a sum over an item's terms, so any set of terms that several items share can be summed once per document. The items'
terms, the most shared ones first, are compressed in rounds of joins: neighbours that stand together in two items or more
become a node of their own, the sum of both, until no two items share a pair. The nodes form a directed graph: terms at the
bottom, shared sums above, every item the sum of the few nodes that are left of it.

Documents are read once for their counts of the items' terms; document frequencies come from these. Then every task fills the
accumulators of a block of documents from the bottom of the graph to the top, each node once, sums the items from them, and
keeps the best of each item. Items are worked on in blocks whose graph is bounded by ``BLOCK_TERMS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.blocks import U64, signed, text_blocks, words
from corpusgraph.session import materialize

#: Terms of the items of one block on average (8 bytes each in every task); more items make more blocks, each a pass of its own.
BLOCK_TERMS = 1 << 19
#: Cells of the accumulators that a task holds at a time.
CELLS = 1 << 21
#: A rank's last candidates are found in so many parts of each item's documents first.
PARTS = 64


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch):
            word, _, _, first = words(data, offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            pairs, times = np.unique(np.stack([row.astype(U64), word]), axis=1, return_counts=True) if len(word) else (
                np.zeros((2, 0), U64), np.zeros(0, np.int64))
            ids = batch.column(0).slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(pairs[0].astype(np.int64))), pa.array(signed(pairs[1])), pa.array(times.astype(np.int64))],
                names=["item_id", "word", "times"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, word (64-bit hash of a term), times. A repeated row counts once; different texts of one item are added up."""
    kind = items.schema["item_id"].dataType.simpleString()
    return (items.select("item_id", "text").distinct().mapInArrow(_item_terms, f"item_id {kind}, word long, times long")
            .groupBy("item_id", "word").agg(F.sum("times").alias("times")))


def _count_terms(vocabulary):
    """doc_id, n_terms and the counts of the vocabulary's terms in every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for rows, data, offsets in text_blocks(batch):
                word, _, _, first = words(data, offsets)
                size = np.diff(first)
                at = np.searchsorted(known, word)
                at[at == len(known)] = 0
                hit = np.flatnonzero(known[at] == word) if len(known) else np.zeros(0, np.int64)
                row = np.searchsorted(first, hit, "right") - 1
                code, times = np.unique(row * max(len(known), 1) + at[hit], return_counts=True)
                ends = np.searchsorted(code, np.arange(len(size) + 1) * max(len(known), 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
                         for x in (code % max(len(known), 1), times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(size)), pa.array(size), *lists],
                                                 names=["doc_id", "n_terms", "terms", "times"])

    return run


def share(terms: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(what is left of each item: item_id, node; for each round the new nodes: node, low, high) of (item_id, place, node).

    Places are any numbers that order an item's nodes, of which none occurs twice in an item. Pairs of neighbours that two
    items or more have are candidates; of overlapping ones the most frequent wins, so that the most frequent of all always
    becomes a node and rounds end. Node names are 64-bit hashes of what they stand for.
    """
    rounds: list[DataFrame] = []
    along = Window.partitionBy("item_id").orderBy("place")
    while True:
        paired = terms.withColumn("after", F.lead("node").over(along))
        shared = (paired.filter("after is not null").groupBy("node", "after").agg(F.count(F.lit(1)).alias("items"))
                  .filter("items > 1")
                  .withColumn("weight", F.struct("items", F.xxhash64("node", "after").alias("joined"), "node", "after")))
        met = paired.join(shared.select("node", "after", "weight"), ["node", "after"], "left")
        wins = F.col("weight").isNotNull() & F.coalesce(F.col("weight") > F.lag("weight").over(along), F.lit(True)) & F.coalesce(
            F.col("weight") > F.lead("weight").over(along), F.lit(True))
        chosen = materialize(
            met.withColumn("wins", wins).withColumn("taken", F.coalesce(F.lag("wins").over(along), F.lit(False)))
            .select("item_id", "place", "node", "after", "wins", "taken", "weight.joined"), "pairs")
        new = chosen.filter("wins")
        if new.isEmpty():
            return terms.select("item_id", "node"), rounds
        rounds.append(new.select(F.col("joined").alias("node"), F.col("node").alias("low"), F.col("after").alias("high")).distinct())
        terms = chosen.filter("not taken").select("item_id", "place", F.when(F.col("wins"), F.col("joined"))
                                                  .otherwise(F.col("node")).alias("node"))


@dataclass
class Graph:
    """Accumulators 0, 1, ...: first one for each (term, times in the item), then those of each round."""

    weight: np.ndarray  # of each vocabulary term
    term: np.ndarray  # vocabulary term of each bottom node
    times: np.ndarray
    rounds: list[tuple[np.ndarray, np.ndarray]]  # (low, high) of the round's nodes
    slots: np.ndarray  # nodes of all items, one item after the other
    begin: np.ndarray  # first slot of each item
    item_id: pa.Array


def _graph(bottom: pd.DataFrame, rounds: list[pd.DataFrame], rest: pd.DataFrame, vocabulary: np.ndarray,
           weight: np.ndarray, ids: pa.Array) -> Graph:
    number: dict[int, int] = {node: at for at, node in enumerate(bottom["node"].tolist())}
    made = []
    for frame in rounds:
        # a pair that lost to its neighbours in some items can win there rounds later: its node is made once, in the first round
        frame = frame[~frame["node"].isin(number.keys())]
        made.append(frame)
        for node in frame["node"].tolist():
            number[node] = len(number)
    of = lambda c: np.array([number[x] for x in c.tolist()], np.int64)
    order = np.argsort(rest["item"].to_numpy(), kind="stable")
    item = rest["item"].to_numpy()[order]
    return Graph(weight, np.searchsorted(vocabulary, bottom["word"].to_numpy(np.int64).view(U64)),
                 bottom["times"].to_numpy(np.int64), [(of(r["low"]), of(r["high"])) for r in made],
                 of(rest["node"])[order], np.flatnonzero(np.r_[True, item[1:] != item[:-1]][:len(item)]), ids)


def accumulate(graph: Graph, m: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(items x documents) scores of a block of documents with lengths ``m`` and the counts (row, term, times)."""
    cells = np.zeros((len(graph.weight), len(m)), np.int64)
    cells[term, row] = graph.weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))
    nodes = np.empty((len(graph.term) + sum(len(low) for low, _ in graph.rounds), len(m)), np.int64)
    end = len(graph.term)
    np.multiply(cells[graph.term], graph.times[:, None], out=nodes[:end])
    for low, high in graph.rounds:
        np.add(nodes[low], nodes[high], out=nodes[end:end + len(low)])
        end += len(low)
    return np.add.reduceat(nodes[graph.slots], graph.begin, axis=0)


_LAST = np.iinfo(np.int64).max


def _best(shared, k: int):
    """The ``k`` best documents of each item in a task: (item_id, score, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Graph = shared.value
        items = len(graph.begin)
        wide = len(graph.weight) + 2 * len(graph.slots) + sum(2 * len(low) for low, _ in graph.rounds)
        step = max(1, CELLS // max(wide, 1))
        # kept candidates, and of each item the score and id that a new one has to beat
        item, score, doc = (np.zeros(0, np.int64) for _ in range(3))
        bar, bar_id = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64()).fill_null(_LAST).to_numpy()
            m = batch["m"].to_numpy()
            ends = batch["terms"].offsets.to_numpy()
            term, times = (batch[c].values.to_numpy().astype(np.int64) for c in ("terms", "times"))
            for low in range(0, len(ids), step):
                high = min(low + step, len(ids))
                row = np.repeat(np.arange(high - low), np.diff(ends[low:high + 1]))
                part = slice(ends[low], ends[high])
                found = accumulate(graph, m[low:high], row, term[part], times[part])
                here = ids[low:high]
                which, at = np.nonzero((found > bar[:, None]) | ((found == bar[:, None]) & (here[None, :] < bar_id[:, None])))
                if not len(which):
                    continue
                item, score, doc = np.r_[item, which], np.r_[score, found[which, at]], np.r_[doc, here[at]]
                order = np.lexsort((doc, -score, item))
                item, score, doc = item[order], score[order], doc[order]
                begin = np.searchsorted(item, np.arange(items))
                keep = np.arange(len(item)) - begin[item] < k
                item, score, doc = item[keep], score[keep], doc[keep]
                full = np.flatnonzero(np.bincount(item, minlength=items) == k)
                last = np.searchsorted(item, full, "right") - 1
                bar[full], bar_id[full] = score[last], doc[last]
        yield pa.RecordBatch.from_arrays(
            [graph.item_id.take(pa.array(item)), pa.array(score), pa.array(doc, mask=doc == _LAST)],
            names=["item_id", "score", "doc_id"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    near = found.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= k)
    return (near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
            .filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id integer, text) of every item (item_id, text).

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased, told apart by 64-bit hashes;
    whole texts count. Only scores above 0 are results; equal ones go by doc_id, null last. Null and empty texts have no terms;
    an item without terms, or one that no document meets, has no results. A repeated item row counts once, different texts of
    one item_id (null is one) make one item; repeated documents are ranked each. Further columns are ignored; no documents or
    no items give no rows.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    terms = materialize(item_terms(items), "item-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).withColumn("node", F.xxhash64("word", "times"))
        vocabulary = np.unique(own.select("word").distinct().toPandas()["word"].to_numpy(np.int64).view(U64))
        counts = materialize(docs.select("doc_id", "text").mapInArrow(
            _count_terms(spark.sparkContext.broadcast(vocabulary)),
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_terms long, terms array<int>, times array<int>"), "counts")
        n, total = counts.agg(F.count(F.when(F.col("n_terms") > 0, 1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        if not n or not len(vocabulary):
            continue
        weight = np.zeros(len(vocabulary), np.int64)
        df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        held = df.select("term", F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1))).alias("w")).toPandas()
        weight[held["term"].to_numpy()] = held["w"].to_numpy()
        # the terms that most items have come first, so that items alike in them are alike in their beginnings
        often = own.groupBy("node").agg(F.count(F.lit(1)).alias("items"))
        placed = own.join(often, "node").select("item_id", "node", F.row_number().over(
            Window.partitionBy("item_id").orderBy(F.desc("items"), "node")).alias("place"))
        rest, rounds = share(placed)
        left = rest.toArrow()
        coded = left["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        left = pd.DataFrame({"item": coded.indices.to_numpy(), "node": left["node"].to_numpy()})
        graph = _graph(own.select("node", "word", "times").distinct().toPandas(), [r.toPandas() for r in rounds], left,
                       vocabulary, weight, coded.dictionary)
        lengths = F.lit(25) + F.expr(f"(75 * n_terms * {n}L) div {total}L")
        best = counts.filter("size(terms) > 0").select("doc_id", lengths.alias("m"), "terms", "times").mapInArrow(
            _best(spark.sparkContext.broadcast(graph), k), f"item_id {kind}, score long, doc_id long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind}, score long, doc_id long")
    return _ranked(found, k)
