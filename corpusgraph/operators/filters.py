"""Row filters, exact substring matching between two tables and lookups by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.functions.text import grams, kind_of

try:
    import ahocorasick
except ImportError:  # the n-gram form below needs nothing beyond Spark
    ahocorasick = None

GRAM = 3
SHARED_PATTERN_CHARS = 4_000_000
SHARED_PATTERNS = 100_000


def by_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("file_path") == path)


def by_kind(chunks: DataFrame, kind: str) -> DataFrame:
    return chunks.filter(kind_of(F.col("node_type")) == kind)


def by_name_pattern(chunks: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive pattern search on chunks that have a name."""
    return chunks.filter(F.col("name").isNotNull() & F.col("name").rlike("(?i)" + pattern))


def payload_filter(project_ids: list[str] | None = None, file_path: str | None = None,
                   kind: str | None = None, name: str | None = None) -> Column:
    """Conjunction of the given conditions; nothing given keeps every row."""
    cond = F.lit(True)
    if project_ids:
        cond = cond & F.col("project_id").isin(project_ids)
    if file_path:
        cond = cond & (F.col("file_path") == file_path)
    if kind:
        cond = cond & (kind_of(F.col("node_type")) == kind)
    if name:
        cond = cond & (F.col("name") == name)
    return cond


def projects_by(projects: DataFrame, status: str | None = None, name: str | None = None,
                project_id: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("name", name), ("id", project_id)):
        if value is not None:
            projects = projects.filter(F.col(column) == value)
    return projects


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks whose id is asked for."""
    return chunks.join(ids.select("id"), "id", "left_semi")


def min_support(assigned: DataFrame, tasks: DataFrame, minimum: int = 5) -> DataFrame:
    """Role tasks that got at least ``minimum`` chunks."""
    enough = assigned.groupBy("query_id", "role").agg(F.count("*").alias("n_chunks"))
    return tasks.join(enough.filter(F.col("n_chunks") >= minimum), ["query_id", "role"])


def min_confidence(perspectives: DataFrame, above: float = 0.3) -> DataFrame:
    return perspectives.filter(F.col("confidence") > above)


def _text_grams(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    pieces = F.concat(*[grams(F.col(text_col), n) for n in range(1, GRAM + 1)])
    return texts.select(F.col(key).alias("_key"), F.explode(pieces).alias("_gram"))


def substring_join(texts: DataFrame, key: str, text_col: str, patterns: DataFrame,
                   pattern_col: str, shared: int = SHARED_PATTERNS) -> DataFrame:
    """Distinct ``(key, pattern)`` for every text that contains the pattern, without comparing all pairs.

    A pattern list of checked size goes to every task as one matching automaton, and each text is
    read once where it lies.  A longer list takes the n-gram form, which shuffles.  Both are exact.
    """
    wanted = patterns.select(F.col(pattern_col).alias("_p")).filter(F.length("_p") > 0).distinct()
    if ahocorasick is not None and shared > 0:
        rows = [r["_p"] for r in wanted.limit(shared + 1).collect()]
        if len(rows) <= shared and sum(map(len, rows)) <= SHARED_PATTERN_CHARS:
            return _scan(texts, key, text_col, rows, pattern_col).distinct()
    return _gram_join(texts, key, text_col, wanted, pattern_col).distinct()


def _scan(texts: DataFrame, key: str, text_col: str, words: list[str], pattern_col: str) -> DataFrame:
    schema = T.StructType([texts.schema[key], T.StructField(pattern_col, T.StringType())])
    if not words:
        return texts.sparkSession.createDataFrame([], schema)
    sent = texts.sparkSession.sparkContext.broadcast(sorted(words))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for word in sent.value:
            machine.add_word(word, word)
        machine.make_automaton()
        for batch in batches:
            pairs = [(k, word) for k, text in zip(batch[key], batch[text_col]) if text
                     for word in {w for _, w in machine.iter(text)}]
            yield pd.DataFrame(pairs, columns=[key, pattern_col])

    return texts.select(*dict.fromkeys([key, text_col])).mapInPandas(scan, schema)


def _gram_join(texts: DataFrame, key: str, text_col: str, wanted: DataFrame,
               pattern_col: str) -> DataFrame:
    """Each pattern is looked up through the n-gram of its own that fewest texts contain.

    A frequent n-gram is only used when every n-gram of the pattern is frequent.
    """
    own = F.when(F.length("_p") == 1, grams(F.col("_p"), 1)).when(
        F.length("_p") == 2, grams(F.col("_p"), 2)).otherwise(grams(F.col("_p"), GRAM))
    pieces = wanted.select("_p", F.explode(own).alias("_gram"))
    text_grams = _text_grams(texts, key, text_col).join(
        pieces.select("_gram").distinct(), "_gram", "left_semi")
    frequency = text_grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = (
        pieces.join(frequency, "_gram", "left")
        .groupBy("_p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("g"))
        .filter("g.n > 0").select("_p", F.col("g._gram").alias("_gram")))
    candidates = text_grams.join(rarest, "_gram").select("_key", "_p").distinct()
    return (
        candidates.join(texts.select(F.col(key).alias("_key"), F.col(text_col).alias("_text")), "_key")
        .filter(F.col("_text").contains(F.col("_p")))
        .select(F.col("_key").alias(key), F.col("_p").alias(pattern_col)))


def node_match(entities: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """``(query_id, text, type, id)``: up to ``limit`` chunks an entity stands for.

    Functions and classes match on the name of that kind, files on the path, people and
    organisations on the content.
    """
    c = chunks.withColumn("_kind", kind_of(F.col("node_type")))
    named = c.filter(F.col("_kind").isin("function", "class") & F.col("name").isNotNull())
    e = entities.select("query_id", "text", "type").distinct()

    name_hits = substring_join(named.select("name").distinct(), "name", "name",
                               e.filter(F.col("type").isin("function", "class")), "text")
    by_name = _ranked(
        name_hits.join(named.select("name", F.col("_kind").alias("type"), "id"), "name"),
        ["text", "type"], limit)
    path_hits = substring_join(c.select("file_path").distinct(), "file_path", "file_path",
                               e.filter(F.col("type") == "file"), "text")
    by_path = _ranked(
        path_hits.join(c.select("file_path", "id"), "file_path").withColumn("type", F.lit("file")),
        ["text", "type"], limit)
    people = ["person", "organization"]
    content_hits = substring_join(c, "id", "content", e.filter(F.col("type").isin(people)), "text")
    by_content = _ranked(
        content_hits.withColumn("type", F.explode(F.array(*[F.lit(p) for p in people]))),
        ["text", "type"], limit)
    hits = by_name.unionByName(by_path).unionByName(by_content)
    return e.join(hits, ["text", "type"]).select("query_id", "text", "type", "id")


def _ranked(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("id")
    return (
        hits.select(*keys, "id").withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= limit).drop("_r"))


#: Different first characters that ``begins_like`` looks at.
MOST_INITIALS = 64


def begins_like(df: DataFrame, *cols: str) -> Callable[[Column | str], Column]:
    """Condition that a key has the first character of some value in ``cols``: others have no equal there and need not be shuffled
    for a join. Ids and paths of a kind begin alike. Never null; a null key does not pass."""
    initials = F.explode(F.array(*[F.substring(c, 1, 1) for c in cols])).alias("c")
    found = [r["c"] for r in df.select(initials).filter("c IS NOT NULL").distinct().limit(MOST_INITIALS + 1).collect()]

    def passes(key: Column | str) -> Column:
        key = F.col(key) if isinstance(key, str) else key
        return key.isNotNull() if len(found) > MOST_INITIALS else F.coalesce(F.substring(key, 1, 1).isin(found), F.lit(False))

    return passes
