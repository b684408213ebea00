"""Rule-based entity extraction over a ``(query_id, query)`` table.

An entity is ``struct(start_pos, seq, end_pos, text, type, confidence, aliases)``; ``seq`` is the
order in which the rules found it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import ascii_pattern, lookup, words_array
from corpusgraph.operators.questions import complexity_by_score, word_count
from corpusgraph.rules import ner_rules as N
from corpusgraph.session import spread

ENTITY = ("struct<start_pos:int,seq:int,end_pos:int,text:string,type:string,confidence:double,"
          "aliases:array<string>>")


def numbered_patterns(strict_reference: bool = False) -> list[tuple[int, str, str]]:
    """``(seq, type, pattern)``; all but the constant pattern ignore case unless strict."""
    flat = [(kind, p) for kind, patterns in N.ENTITY_PATTERNS for p in patterns]
    return [
        (i, kind, p if p == N.CASE_SENSITIVE_PATTERN and not strict_reference else "(?i)" + p)
        for i, (kind, p) in enumerate(flat)]


def dictionary() -> list[tuple[int, str, str, float, list[str]]]:
    """``(seq, term, type, confidence, aliases)`` of the known names."""
    base = len(numbered_patterns())
    rows = [(t, "company", N.DICTIONARY_CONFIDENCE, []) for t in N.COMPANIES]
    rows += [(t, "person", N.DICTIONARY_CONFIDENCE, []) for t in N.PEOPLE]
    rows += [(a, "technology", N.ALIAS_CONFIDENCE, [full]) for a, full in N.ALIASES]
    return [(base + i, *row) for i, row in enumerate(rows)]


def _entity(start: Column, seq: int, end: Column, text: Column, kind: str, confidence: float,
            aliases: list[str]) -> Column:
    return F.struct(
        start.cast("int").alias("start_pos"), F.lit(seq).alias("seq"), end.cast("int").alias("end_pos"),
        text.alias("text"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"),
        words_array(aliases).alias("aliases"))


def _pattern_matches(text: Column, seq: int, kind: str, pattern: str) -> Column:
    """Entities of one pattern with the offsets of the whole match.

    The text between matches and the matches themselves alternate, so their running lengths are
    the offsets.
    """
    p = F.lit(ascii_pattern(pattern))
    whole, group = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(1))
    gaps = F.split(text, p, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), group.alias("g")),
                       lambda gap, m: F.struct(F.length(gap).alias("gap"), m["w"].alias("w"), m["g"].alias("g")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{ENTITY}>").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        at = acc["pos"] + m["gap"]
        end = at + F.length(m["w"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(
            _entity(at, seq, end, m["g"], kind, N.PATTERN_CONFIDENCE, []))).alias("out"))

    found = F.aggregate(steps, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(ascii_pattern(pattern)), found).otherwise(F.array().cast(f"array<{ENTITY}>"))


def pattern_entities(text: Column, strict_reference: bool = False) -> Column:
    return F.concat(*[_pattern_matches(text, *row) for row in numbered_patterns(strict_reference)])


def dictionary_entities(text: Column) -> Column:
    """Known names that occur anywhere in the text, at their first position."""
    low = F.lower(text)
    found = []
    for seq, term, kind, confidence, aliases in dictionary():
        at = F.instr(low, term.lower()) - 1
        found.append(F.when(at >= 0, _entity(
            at, seq, at + len(term), F.lit(term), kind, confidence, aliases)))
    return F.array_compact(F.array(*found))


def specificity(kind: Column) -> Column:
    return lookup(kind, N.SPECIFICITY, 0)


def merge(entities: Column) -> Column:
    """Fold overlapping spans from left to right, comparing with the current survivor only.

    The better one has the higher confidence, then the more specific type; otherwise the earlier
    one stays.
    """
    ordered = F.array_sort(entities)
    empty = F.array().cast(f"array<{ENTITY}>")
    start = F.struct(F.lit(None).cast(ENTITY).alias("cur"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        overlap = ~((cur["end_pos"] <= x["start_pos"]) | (x["end_pos"] <= cur["start_pos"]))
        better = F.when(x["confidence"] != cur["confidence"], x["confidence"] > cur["confidence"]).otherwise(
            specificity(x["type"]) > specificity(cur["type"]))
        return F.struct(
            F.when(cur.isNull() | ~overlap | better, x).otherwise(cur).alias("cur"),
            F.when(cur.isNull() | overlap, acc["out"]).otherwise(F.concat(acc["out"], F.array(cur))).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.when(
        acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))


def score(entity: Column, text: Column, context: Column | None = None) -> Column:
    """Confidence raised for repeats, presence in the context, type and an early position."""
    word, low = F.lower(entity["text"]), F.lower(text)
    count = (F.length(low) - F.length(F.replace(low, word, F.lit("")))) / F.length(word)
    repeat = F.when(count > 1, F.least(count * N.REPEAT_STEP, F.lit(N.REPEAT_CAP))).otherwise(F.lit(0.0))
    known = F.lit(0.0) if context is None else F.when(
        F.coalesce(F.lower(context).contains(word), F.lit(False)), F.lit(N.CONTEXT_BONUS)).otherwise(F.lit(0.0))
    early = F.when(entity["start_pos"] < F.length(text) * N.EARLY_SHARE, N.EARLY_BONUS).otherwise(F.lit(0.0))
    total = entity["confidence"] + (repeat + known) + lookup(entity["type"], N.TYPE_BONUS, 0.0) + early
    return F.least(total, F.lit(1.0))


def extract_entities(texts: DataFrame, text_col: str = "query", key: str = "query_id",
                     context_col: str | None = None, strict_reference: bool = False) -> DataFrame:
    """One row per entity: key, rank (best first), text, type, confidence, offsets, aliases."""
    texts = spread(texts, key)
    t = F.col(text_col)
    context = F.col(context_col) if context_col else None
    found = F.concat(pattern_entities(t, strict_reference), dictionary_entities(t))
    rows = texts.withColumn("_merged", merge(found))
    scored = F.transform("_merged", lambda e: F.struct(
        (-score(e, t, context)).alias("o"), e["start_pos"].alias("start_pos"), e.alias("e")))
    # flat structs: fields picked from a nested struct after the explode would be pushed below it
    # and evaluate the whole extraction once per field
    flat = F.transform(F.array_sort(scored), lambda s, i: F.struct(
        (i + 1).alias("rank"), s["e"]["text"].alias("text"), s["e"]["type"].alias("type"), (-s["o"]).alias("confidence"),
        s["start_pos"].alias("start_pos"), s["e"]["end_pos"].alias("end_pos"), s["e"]["aliases"].alias("aliases")))
    return rows.select(key, F.inline(flat))


def all_aliases(entities: DataFrame) -> DataFrame:
    """Adds ``all_aliases``: own aliases, then for technologies the table looked up both ways."""
    word = F.lower(F.col("text"))
    hits = [
        F.when(word == alias.lower(), F.lit(full)).when(word == full.lower(), F.lit(alias))
        for alias, full in N.ALIASES]
    table = F.array_compact(F.array(*hits))
    none = words_array([])
    return entities.withColumn("all_aliases", F.concat(
        F.coalesce("aliases", none), F.when(F.col("type") == "technology", table).otherwise(none)))


def context_keywords(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, words_array(v)) for k, v in N.CONTEXT_KEYWORDS.items()], words_array([]))


def entity_chunk_match(entities: DataFrame, results: DataFrame) -> DataFrame:
    """``(query_id, text, type, id, relevance)``: result chunks that mention an entity of their query.

    The few entities of a query ride along as one array, so only real matches become rows.
    """
    lists = entities.groupBy("query_id").agg(F.collect_set(F.struct("text", "type")).alias("_e"))
    body, name = F.lower("content"), F.lower(F.coalesce("name", F.lit("")))
    tagged = F.transform("_e", lambda e: F.struct(
        e["text"].alias("text"), e["type"].alias("type"), body.contains(F.lower(e["text"])).alias("b"),
        name.contains(F.lower(e["text"])).alias("n")))
    return (
        results.select("query_id", "id", "content", "name").join(lists, "query_id")
        .select("query_id", "id", F.inline(F.filter(tagged, lambda m: m["b"] | m["n"])))
        .select("query_id", "text", "type", "id", F.when(F.col("n"), "high").otherwise("medium").alias("relevance")))


def entity_layers(entities: DataFrame, results: DataFrame, layer: Column) -> DataFrame:
    """``(query_id, text, layer)``: layers of the result chunks whose content mentions the entity."""
    lists = entities.groupBy("query_id").agg(F.collect_set("text").alias("_e"))
    return (
        results.withColumn("layer", layer).select("query_id", "layer", "content").join(lists, "query_id")
        .select("query_id", "layer", F.explode(F.filter(
            "_e", lambda e: F.lower("content").contains(F.lower(e)))).alias("text"))
        .distinct())


def entity_insights(entities: DataFrame, results: DataFrame) -> DataFrame:
    """Entities with aliases, context keywords and how many result chunks mention them how."""
    matched = entity_chunk_match(entities, results).groupBy("query_id", "text", "type").agg(
        F.count("*").alias("related"), F.count_if(F.col("relevance") == "high").alias("related_by_name"))
    return (
        all_aliases(entities).withColumn("keywords", context_keywords(F.col("type")))
        .join(matched, ["query_id", "text", "type"], "left")
        .fillna(0, ["related", "related_by_name"]))


def complexity_by_entities(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Score from query length, number of entities and presence of technical ones."""
    from corpusgraph.rules.query_rules import TECHNICAL_ENTITY_TYPES

    counts = entities.groupBy("query_id").agg(
        F.count("*").alias("n_entities"), F.bool_or(F.col("type").isin(TECHNICAL_ENTITY_TYPES)).alias("technical"))
    base = texts.join(counts, "query_id", "left").fillna(0, ["n_entities"]).fillna(False, ["technical"]).withColumn(
        "n_words", word_count(F.col("query")))
    cols = complexity_by_score(F.col("n_words"), F.col("n_entities"), F.col("technical"))
    return base.select("query_id", "n_words", "n_entities", "technical", *[c.alias(n) for n, c in cols.items()])
