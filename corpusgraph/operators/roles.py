"""Reviewer roles: scoring, selection, chunk assignment and rule-based findings."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.functions import chunks as C
from corpusgraph.functions.text import (
    base_name, contains_any, count_contained, kind_of, lookup, words_array)
from corpusgraph.operators.questions import complexity_by_words
from corpusgraph.rules import area_rules as A
from corpusgraph.rules import role_rules as R
from corpusgraph.session import materialize, spread


def result_text(results: DataFrame, first: int) -> DataFrame:
    """``(query_id, code, paths, n_chunks)``: lower-cased text and paths of each list's first chunks."""
    head = results.filter(F.col("rank") <= first).groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct("rank", F.lower("content").alias("c"), F.lower("file_path").alias("p")))).alias("x"))
    sizes = results.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    return head.join(sizes, "query_id").select(
        "query_id", F.array_join(F.transform("x", lambda s: s["c"]), " ").alias("code"),
        F.array_join(F.transform("x", lambda s: s["p"]), "\n").alias("paths"), "n_chunks")


def role_scores(queries: DataFrame, results: DataFrame, key: str = "query_id") -> DataFrame:
    """``(query_id, role_no, role, priority, score, complexity)`` for all twelve roles.

    ``queries(query_id, query)`` and, for lists that several questions ask of, the ``key`` that ``results`` has in place of
    ``query_id``. What a list's texts say for each role is counted once for each list; only numbers go to its questions.
    """
    lists = results if key == "query_id" else results.withColumnRenamed(key, "query_id")

    def points(role: str, **where: Column) -> Column:
        steps = {"query": R.QUERY_STEP, "content": R.CONTENT_STEP, "path": R.PATH_STEP}
        words = R.ROLE_KEYWORDS[role]
        score = reduce(lambda a, b: a + b, [count_contained(c, words) * steps[source] for source, c in where.items()])
        for who, source, hints, extra in R.ROLE_BONUS:
            if who == role and source in where:
                score = score + F.when(contains_any(where[source], hints), extra).otherwise(0)
        return score

    # stored, or each of the hundreds of words looked for would put the text together again
    said = materialize(spread(result_text(lists, 10)), "list-texts").select(
        F.col("query_id").alias(key), F.length("code").alias("_length"),
        F.array(*[points(role, content=F.col("code"), path=F.col("paths")) for role in R.ROLES]).alias("_said"))
    text = queries.select(*dict.fromkeys(["query_id", "query", key])).join(said, key, "left")
    q = F.lower("query")
    rows = [F.struct(F.lit(no).alias("role_no"), F.lit(role).alias("role"), F.lit(R.ROLE_PRIORITY[role]).alias("priority"),
                     (F.lit(R.PRIORITY_BASE[R.ROLE_PRIORITY[role]]) + points(role, query=q)
                      + F.coalesce(F.get("_said", F.lit(no)), F.lit(0))).alias("score")) for no, role in enumerate(R.ROLES)]
    return text.select("query_id", complexity_by_words(F.col("query"), F.coalesce("_length", F.lit(0))).alias("complexity"),
                       F.inline(F.array(*rows)))


def select_roles(scores: DataFrame) -> DataFrame:
    """Roles above the complexity's threshold: first those of priority 1, then the best others."""
    low = lookup(F.col("complexity"), {c: v[0] for c, v in R.ROLE_LIMITS.items()})
    most = lookup(F.col("complexity"), {c: v[1] for c, v in R.ROLE_LIMITS.items()})
    first = F.col("priority") == 1
    w = Window.partitionBy("query_id").orderBy(
        F.when(first, 0).otherwise(1), F.when(first, F.col("role_no")).otherwise(-F.col("score")), "role_no")
    return (
        scores.filter(F.col("score") >= low).withColumn("position", F.row_number().over(w))
        .filter(first | (F.col("position") <= most)).select("query_id", "position", "role", "score"))


def planned_roles(queries: DataFrame) -> DataFrame:
    """``queries(query_id, query, complexity)`` -> role tasks with chunks needed and focus words."""
    q = F.lower("query")
    rows = []
    for no, (role, (priority, triggers, task)) in enumerate(R.PLANNED_ROLES.items()):
        score = F.lit(R.PLANNED_BASE[priority]) + count_contained(q, triggers) * R.PLANNED_STEP
        focus = F.array_compact(F.array(*[F.when(q.contains(t), t) for t in triggers]))
        extra = R.PLANNED_EXTRA if role in R.PLANNED_EXTRA_ROLES else 0
        rows.append(F.struct(F.lit(no).alias("role_no"), F.lit(role).alias("role"), F.lit(priority).alias("priority"),
                             F.lit(task).alias("task"), F.lit(extra).alias("extra"), score.alias("score"), focus.alias("focus")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "role_no")
    c = F.col("complexity")
    return (
        queries.select("query_id", "complexity", F.inline(F.array(*rows)))
        .withColumn("position", F.row_number().over(w))
        .filter((F.col("position") <= lookup(c, R.PLANNED_TOP)) & (F.col("score") >= R.PLANNED_MINIMUM))
        .select("query_id", "position", "role", "task", "priority",
                (lookup(c, R.PLANNED_CHUNKS) + F.col("extra")).alias("chunks_needed"), "focus"))


def role_query(query: Column, role: Column) -> Column:
    """The question with a role's focus, for the role's own search."""
    return F.concat(query, F.lit(" "), lookup(role, R.ROLE_QUERY_FOCUS), F.lit(" "),
                    F.coalesce(lookup(role, {r: " ".join(w) for r, w in R.ROLE_QUERY_WORDS.items()}), F.lit("")))


_TAKEN = T.ArrayType(T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("area", T.StringType()),
    T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("before", T.LongType())]))


def area_turns(counts: list[int], roles: list[tuple[int, str]], share: int) -> list[tuple]:
    """(position, role, area, low, high, places before) of what every role in turn takes: rows ``low`` to ``high`` of an area."""
    left, used, out = dict(zip(A.AREA_ORDER, counts)), dict.fromkeys(A.AREA_ORDER, 0), []
    for position, role in roles:
        liked = R.ROLE_AREAS.get(role, [])
        place = 0
        for area in [*liked, *(a for a in A.AREA_ORDER if a not in liked)]:
            n = min(share - place, left[area] - used[area])
            if n > 0:
                out.append((position, role, area, used[area], used[area] + n, place))
                used[area] += n
                place += n
    return out


@F.pandas_udf(_TAKEN)
def area_turns_of(counts: pd.Series, positions: pd.Series, names: pd.Series, share: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("position", "role", "area", "low", "high", "before"), r)) for r in area_turns(
        [int(x) for x in c], list(zip(map(int, p), n)), int(s))] for c, p, n, s in zip(counts, positions, names, share)], dtype=object)


def assign_unique(selected: DataFrame, results: DataFrame, turns: int = len(R.ROLES)) -> DataFrame:
    """``(query_id, position, role, place, id)``: every role in turn takes unused chunks, the areas
    it prefers first; the share is ``max(15, chunks / roles)``, or ``max(3, ..)`` when they are short."""
    area = C.area_of(F.col("file_path"), F.col("content"))
    pool = materialize(results.select("query_id", "rank", "id", area.alias("area")), "areas")
    sizes = pool.groupBy("query_id").agg(
        F.count("*").alias("_n"), F.array(*[F.count_if(F.col("area") == a) for a in A.AREA_ORDER]).alias("counts"))
    asked = selected.groupBy("query_id").agg(F.count("*").alias("_r"), F.sort_array(F.collect_list(
        F.when(F.col("position") <= turns, F.struct("position", "role")))).alias("turns"))
    even = F.floor(F.col("_n") / F.col("_r")).cast("int")
    share = F.when(F.col("_n") < F.col("_r") * R.SHARE_MINIMUM, F.greatest(F.lit(R.SHARE_SHORT), even)).otherwise(
        F.greatest(F.lit(R.SHARE_MINIMUM), even))
    # who takes which rows of an area follows from the areas' sizes alone
    taken = sizes.join(asked, "query_id").select("query_id", F.inline(area_turns_of(
        "counts", F.transform("turns", lambda t: t["position"]), F.transform("turns", lambda t: t["role"]), share)))
    nth = F.row_number().over(Window.partitionBy("query_id", "area").orderBy("rank", "id")) - 1
    return (
        pool.withColumn("nth", nth).join(taken, ["query_id", "area"])
        .filter((F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")))
        .select("query_id", "position", "role", (F.col("before") + F.col("nth") - F.col("low") + 1).cast("int").alias("place"), "id"))


def assign_by_score(roles: DataFrame, results: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """``roles(query_id, role, start, target)``: the chunks from ``start`` on, then the best-scoring others.

    What a chunk's text says is counted once for all roles; the text goes no further.
    """
    # a lambda's argument is made once; a column would be lower-cased again for each word
    said = F.transform(F.array(F.struct(F.lower("content").alias("low"), F.lower("file_path").alias("path"))), lambda t: F.array(*[
        (count_contained(t["low"], words) * 1.0 + count_contained(t["path"], words) * 0.5) / len(words)
        for words in R.ROLE_KEYWORDS.values()]))
    counted = results.select("query_id", "id", "rank", lookup(kind_of(F.col("node_type")), R.SCORE_KIND_BONUS, 0.0).alias("_bonus"),
                             F.get(said, F.lit(0)).alias("_said"))
    parts = [F.when(F.col("role") == role, F.get("_said", F.lit(i))) for i, role in enumerate(R.ROLE_KEYWORDS)]
    bonus = F.col("_bonus")
    rows = roles.join(counted, "query_id")
    if used is None:
        fresh = F.lit(True)
    else:
        rows = rows.join(used.select("query_id", "id").distinct().withColumn("_used", F.lit(True)), ["query_id", "id"], "left")
        fresh = F.col("_used").isNull()
    score = F.least(F.coalesce(*parts) + bonus, F.lit(R.SCORE_CAP)) + F.when(fresh, R.SCORE_UNUSED_BONUS).otherwise(0.0)
    inside = (F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + F.col("target"))
    w = Window.partitionBy("query_id", "role").orderBy(
        F.when(inside, 0).otherwise(1), F.when(inside, F.lit(0.0)).otherwise(-F.round("score", 9)), "rank")
    return (
        rows.withColumn("score", score).withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= F.col("target")).select("query_id", "role", "place", "id", "score"))


def role_retrieval(tasks: DataFrame, primary: DataFrame, fallback: DataFrame, turns: int,
                   minimum: int = 10) -> DataFrame:
    """Each role in turn keeps its best unused hits and tops up from a plain search when short.

    ``tasks(query_id, position, role, chunks_needed)``; both hit tables are ``(query_id, role, rank,
    id)``: the first 2n rows of ``primary`` and the first 3n of ``fallback`` count.
    """
    n = F.greatest(F.col("chunks_needed"), F.lit(minimum))
    t = tasks.withColumn("n", n).select("query_id", "position", "role", "n")
    cols = ["query_id", "role", "rank", "id"]
    cand = (
        primary.select(*cols).join(t, ["query_id", "role"]).filter(F.col("rank") <= 2 * F.col("n")).withColumn("source", F.lit(0))
        .unionByName(fallback.select(*cols).join(t, ["query_id", "role"]).filter(F.col("rank") <= 3 * F.col("n")).withColumn(
            "source", F.lit(1))))
    cand = cand.select("query_id", "position", "role", "n", "source", "rank", "id")
    out = T.StructType([cand.schema["query_id"], cand.schema["role"], T.StructField("place", T.IntegerType()), cand.schema["id"],
                        T.StructField("position", T.IntegerType())])

    def turns_of(group: pd.DataFrame) -> pd.DataFrame:
        """All turns of one query: at most 5n candidates for each role."""
        own = group[group["position"] <= turns]
        found = sorted(zip(*(own[c].tolist() for c in ("position", "source", "rank", "id", "n", "role"))),
                       key=lambda r: (*r[:3], r[3] is None, r[3] or ""))
        seen: set = set()
        rows = []
        for position, hits in groupby(found, lambda r: r[0]):
            turn = list(hits)
            n, role = int(turn[0][4]), turn[0][5]
            best = [[r[3] for r in turn if r[1] == s and r[3] not in seen][:n] for s in (0, 1)]
            short = len(best[0]) < max(5, n // 2)
            kept = list(dict.fromkeys(best[0] + (best[1] if short else [])))[:n]
            seen.update(kept)
            rows += [(group["query_id"].iloc[0], role, k + 1, i, int(position)) for k, i in enumerate(kept)]
        return pd.DataFrame(rows, columns=out.names)

    return cand.groupBy("query_id").applyInPandas(turns_of, out)


def fallback_slices(roles: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks for roles that got none: their slice of the list, else every n-th chunk, else the first 3.

    ``roles(query_id, role, position, n_roles)``.
    """
    sizes = results.groupBy("query_id").agg(F.count("*").alias("_n"))
    i, r, n = F.col("position") - 1, F.col("n_roles"), F.col("_n")
    idx = F.col("rank") - 1
    per = F.greatest(F.lit(R.SHARE_MINIMUM), F.floor(n / r)).cast("int")
    every = (idx >= i) & (F.pmod(idx - i, r) == 0) & (F.floor((idx - i) / r) < R.SHARE_MINIMUM)
    few = F.ceil((n - i) / r) < R.SHARE_SHORT
    keep = F.when(i * per < n, (idx >= i * per) & (idx < (i + 1) * per)).when(few, idx < 3).otherwise(every)
    return roles.join(sizes, "query_id").join(results.select("query_id", "rank", "id"), "query_id").filter(keep).select(
        "query_id", "role", "rank", "id")


def role_findings(roles: DataFrame, results: DataFrame) -> DataFrame:
    """``roles(query_id, role)`` and each list's first chunks -> insights, recommendations, confidence, focus."""
    text = result_text(results, R.RULE_CHUNKS)
    rows = roles.join(text, "query_id", "left")
    where = {"content": F.coalesce("code", F.lit("")), "path": F.coalesce("paths", F.lit(""))}

    def holds(conditions) -> Column:
        out = F.lit(True)
        for source, words in conditions:
            out = out & ((F.coalesce("n_chunks", F.lit(0)) > words) if source == "count" else contains_any(where[source], words))
        return out

    insights, recs = [], []
    for role in R.ROLES:
        said, advised = [], []
        for who, conditions, insight, yes, no in R.ROLE_RULES:
            if who != role:
                continue
            ok = holds(conditions)
            if insight:
                said.append(F.when(ok, insight))
            if yes or no:
                advised.append(F.when(ok, F.lit(yes)).otherwise(F.lit(no)))
        mine = F.col("role") == role
        cut = lambda items: F.slice(F.array_compact(F.array(*items)), 1, R.SENTENCES_KEPT)
        insights.append(F.when(mine, cut(said)))
        recs.append(F.when(mine, cut(advised)))
    return rows.select(
        "query_id", "role", F.coalesce(*insights).alias("insights"), F.coalesce(*recs).alias("recs"),
        lookup(F.col("role"), {r: c for r, (c, _) in R.ROLE_PROFILE.items()}).alias("confidence"),
        F.coalesce(*[F.when(F.col("role") == r, words_array(f)) for r, (_, f) in R.ROLE_PROFILE.items()]).alias("focus"))


def stage_flow(categories: DataFrame) -> DataFrame:
    """``categories(query_id, category)`` -> up to five flow labels in the fixed stage order."""
    flags = categories.groupBy("query_id").agg(*[
        F.bool_or(F.col("category").isin(c)).alias(f"_{i}") for i, (_, _, c) in enumerate(A.FLOW_STAGES)])
    steps = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), label) for i, (_, label, _) in enumerate(A.FLOW_STAGES)]))
    return flags.select("query_id", F.slice(steps, 1, 5).alias("steps"))


def chunk_flow(results: DataFrame) -> DataFrame:
    """``(query_id, rank, step)`` for each list's first five chunks, worded by name or content."""
    name, low = F.col("name"), F.lower("content")
    file, line = base_name(F.col("file_path")), F.col("start_line").cast("string")

    def fill(template: str, who: Column) -> Column:
        a, b, c = template.split("{}")
        return F.concat(F.lit(a), who, F.lit(b), file, F.lit(c))

    by_name = F.coalesce(
        *[F.when(contains_any(F.lower(name), verbs), fill(t, name)) for verbs, t in A.STEP_VERBS],
        F.when(low.contains("async") & F.col("content").contains(F.concat(F.lit("def "), name)), fill(A.STEP_ASYNC, name)),
        fill(A.STEP_DEFAULT, name))
    trimmed = F.transform(F.split("content", "\n"), C.strip)
    head = lambda word, stops: F.get(F.transform(
        F.filter(trimmed, lambda s: s.startswith(word)), lambda s: C._after(s, word, *stops)), F.lit(0))
    cls, fun = head("class ", "(:"), head("def ", "(")
    at = F.concat(file, F.lit(":"), line)
    unnamed = (
        F.when(low.contains("class "), F.coalesce(
            F.concat(F.lit("📦 Initialize "), cls, F.lit(" class in "), file), F.concat(F.lit("📦 Initialize class structure in "), at)))
        .when(low.contains("def "), F.coalesce(
            F.concat(F.lit("🔧 Execute "), fun, F.lit("() function in "), file), F.concat(F.lit("🔧 Execute function in "), at)))
        .when(contains_any(low, ["import", "from"]), F.concat(F.lit("📥 Load dependencies and modules in "), file))
        .when(contains_any(low, ["config", "settings"]), F.concat(F.lit("⚙️ Configure system settings in "), file))
        .otherwise(F.concat(F.lit("📄 Process code block in "), at)))
    text = F.when(F.length(name) > 0, by_name).otherwise(unnamed)
    return results.filter(F.col("rank") <= 5).select(
        "query_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), text).alias("step"))


def findings_to_components(perspectives: DataFrame) -> DataFrame:
    """``(query_id, position, name, purpose, type, confidence)``: each role's first two insights, at most 8.

    An insight that speaks of a file, function or class takes the first word that looks like one as its name.
    """
    rows = perspectives.select("query_id", "role_no", "role", "confidence", F.posexplode(F.slice("insights", 1, 2)).alias("_i", "insight"))
    title = F.concat(F.initcap("role"), F.lit(" Analysis"))
    words = F.split(F.trim("insight"), "[ \\t\\n]+")
    labelled = F.filter(F.transform(words, lambda x: F.when(
        x.rlike("\\.(?:py|js|ts)$"), F.concat(F.lit("File: "), x)).when(
        x.endswith("()"), F.concat(F.lit("Function: "), F.replace(x, F.lit("()"), F.lit(""))))), lambda x: x.isNotNull())
    name = F.when(contains_any(F.lower("insight"), ["file", "function", "class"]), F.coalesce(F.get(labelled, F.lit(0)), title)).otherwise(title)
    w = Window.partitionBy("query_id").orderBy("role_no", "_i")
    return rows.withColumn("position", F.row_number().over(w)).filter("position <= 8").select(
        "query_id", "position", name.alias("name"), F.col("insight").alias("purpose"), F.col("role").alias("type"),
        F.format_string("%.1f", "confidence").alias("confidence"))


def findings_to_relations(perspectives: DataFrame) -> DataFrame:
    """Each role analyses its first focus area; at most 6 per query."""
    w = Window.partitionBy("query_id").orderBy("role_no")
    return (
        perspectives.filter(F.size("focus") > 0).withColumn("position", F.row_number().over(w)).filter("position <= 6")
        .select("query_id", "position", F.initcap("role").alias("from_name"), F.get("focus", F.lit(0)).alias("to_name"),
                F.lit("analyzes").alias("relationship"), F.format_string("%.1f", "confidence").alias("strength")))
