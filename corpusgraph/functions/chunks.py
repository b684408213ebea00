"""Column builders over one chunk row (content, file_path, name, kind, lines)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.text import (
    ascii_pattern, base_name, banded, contains_any, count_contained, extract_all, first_label, let, lookup)
from corpusgraph.rules import area_rules as A

_BLANK = "^[ \\t\\r\\f\\x0B]+|[ \\t\\r\\f\\x0B]+$"
_IDENTIFIER = "^[A-Za-z_]\\w*$"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _BLANK, "")


def occurrences(col: Column, word: str) -> Column:
    return ((F.length(col) - F.length(F.replace(col, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def language_of(path: Column) -> Column:
    """Language by extension; null when unknown."""
    return lookup(F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1)), A.LANGUAGE_BY_SUFFIX)


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.md5(F.concat_ws(":", path, start.cast("string"), end.cast("string"), content))


def imports_in(content: Column) -> Column:
    """Python ``from x import`` / ``import x`` names in order, then JS ``import .. from 'x'`` names."""
    py = ascii_pattern(r"(?:from\s+(\S+)\s+import|import\s+(\S+))")
    froms, plain = extract_all(content, py, 1), extract_all(content, py, 2)
    python = F.filter(F.flatten(F.zip_with(froms, plain, lambda a, b: F.array(a, b))), lambda x: F.length(x) > 0)
    js = extract_all(content, r"import.*?from\s+['\"]([^'\"]+)['\"]", 1)
    return F.concat(python, js)


def prepared_text(kind: Column, name: Column, path: Column, content: Column) -> Column:
    """Text handed to an embedding function."""
    head = F.when(F.length(name) > 0, F.concat(kind, F.lit(": "), name))
    return F.concat_ws("\n", head, F.concat(F.lit("File: "), base_name(path)), content)


def _after(line: Column, word: str, *stops: str) -> Column:
    """Text after the first ``word`` up to the first of the stop characters."""
    part = F.get(F.split(line, word), F.lit(1))
    for stop in stops:
        part = F.get(F.split(part, "[" + stop + "]"), F.lit(0))
    return strip(part)


def display_name(name: Column, content: Column, path: Column, start_line: Column) -> Column:
    """Name; else a class/def/function name from the first five lines; else ``file (line n)``."""
    lines = F.transform(F.slice(F.split(content, "\n"), 1, 5), strip)
    named = F.filter(F.transform(lines, lambda s: F.when(s.startswith("class "), _after(s, "class ", "(", ":"))
                                 .when(s.startswith("def "), _after(s, "def ", "("))
                                 .when(s.startswith("function "), _after(s, "function ", "("))),
                     lambda s: s.isNotNull())
    stem = F.regexp_replace(F.regexp_replace(base_name(path), "^.*\\\\", ""), "\\.(?:py|js|ts)$", "")
    place = F.concat(stem, F.lit(" (line "), start_line.cast("string"), F.lit(")"))
    return F.coalesce(F.when(F.length(name) > 0, name), F.get(named, F.lit(0)), place)


def construct_tags(content: Column) -> Column:
    low = F.lower(content)
    return F.array_compact(F.array(*[F.when(contains_any(low, words), tag) for tag, words in A.CONSTRUCT_TAGS]))


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def construct_summary(content: Column) -> Column:
    """``Contains: ..; <size class>``."""
    tags, n = construct_tags(content), line_count(content)
    size = F.when(n > 100, "High complexity (100+ lines)").when(n > 50, "Medium complexity (50+ lines)").otherwise(
        "Low complexity (<50 lines)")
    return F.concat_ws("; ", F.when(F.size(tags) > 0, F.concat(F.lit("Contains: "), F.array_join(tags, ", "))), size)


def content_profile(content: Column) -> Column:
    """Counts of classes, functions and async functions, then the keyword groups present."""
    low = F.lower(content)

    def counted(word: str, one: str, many: str) -> Column:
        n = occurrences(content, word)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n > 1, many).otherwise(one)))

    parts = [counted("class ", "class", "classes"), counted("def ", "function", "functions"),
             counted("async def", "async operation", "async operations")]
    parts += [F.when(contains_any(low, words), label) for label, words in A.CONTENT_GROUPS]
    text = F.concat_ws("; ", *parts)
    return F.when(F.length(text) > 0, text).otherwise(A.CONTENT_DEFAULT)


def function_names(text: Column) -> Column:
    lines = F.split(text, "\n")
    plain = F.transform(lines, lambda s: F.when(s.contains("def "), _after(s, "def ", "(")))
    found = F.filter(F.transform(lines, lambda s: F.when(s.contains("async def "), _after(s, "async def ", "("))),
                     lambda s: s.rlike(_IDENTIFIER))
    return F.array_distinct(F.concat(
        F.filter(plain, lambda s: s.rlike(_IDENTIFIER)), F.transform(found, lambda s: F.concat(F.lit("async "), s))))


def class_names(text: Column) -> Column:
    names = F.transform(F.split(text, "\n"), lambda s: F.when(s.contains("class "), _after(s, "class ", "(", ":")))
    return F.array_distinct(F.filter(names, lambda s: s.rlike(_IDENTIFIER)))


def file_names(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s.startswith("File:"))
    paths = F.filter(F.transform(lines, lambda s: strip(F.substring(s, 6, 2**31 - 1))), lambda s: F.length(s) > 0)
    return F.array_distinct(F.transform(paths, lambda p: F.when(p.contains("/"), base_name(p)).otherwise(
        F.regexp_replace(p, "^.*\\\\", ""))))


# ---- areas, layers and categories ----

def area_of(path: Column, content: Column) -> Column:
    """First area with a word in the path, then in the content, else ``other``."""
    return first_label(F.lower(path), A.AREA_PATH, first_label(F.lower(content), A.AREA_CONTENT, "other"))


def area_by_name(path: Column) -> Column:
    return first_label(F.lower(path), A.AREA_NAMES, "other")


def category_of(path: Column, content: Column, name: Column) -> Column:
    """Best category by path, content and import evidence (a later source overrides an earlier
    one for the same category); below the threshold a generic rule decides."""
    texts = F.struct(
        F.lower(path).alias("path"), F.lower(content).alias("body"),
        F.lower(F.coalesce(name, F.lit(""))).alias("name"),
        F.transform(imports_in(content), F.lower).alias("packages"))

    def scores(t: Column) -> Column:
        fields = [(count_contained(t["path"], w) / len(w)).alias(f"path_{c}") for c, w in A.CATEGORY_PATH]
        fields += [F.least((count_contained(t["body"], w) * 0.5 + count_contained(t["name"], w)) / len(w), F.lit(1.0))
                   .alias(f"content_{c}") for c, w in A.CATEGORY_CONTENT]
        fields += [F.least(F.aggregate(t["packages"], F.lit(0), _adder(w)) / len(w), F.lit(1.0)).alias(f"import_{c}")
                   for c, w in A.CATEGORY_IMPORT]
        return let(F.struct(*fields), lambda s: pick(s, t["path"]))

    # equal scores go to the category that entered first: path order, then content, then imports
    sources = [("path", A.CATEGORY_PATH), ("content", A.CATEGORY_CONTENT), ("import", A.CATEGORY_IMPORT)]
    place = {(kind, c): -(100 * n + i) for n, (kind, rules) in enumerate(sources) for i, (c, _) in enumerate(rules)}
    names = list(dict.fromkeys(c for _, rules in sources for c, _ in rules))

    def pick(s: Column, low_path: Column) -> Column:
        entries = []
        for c in names:
            kinds = [k for k, _ in sources if (k, c) in place]
            some = lambda k: s[f"{k}_{c}"] > 0  # noqa: E731, B023
            value = F.coalesce(*[F.when(some(k), s[f"{k}_{c}"]) for k in reversed(kinds)])
            entered = F.coalesce(*[F.when(some(k), F.lit(place[k, c])) for k in kinds])
            entries.append(F.struct(F.coalesce(value, F.lit(-1.0)).alias("v"), entered.alias("o"), F.lit(c).alias("c")))
        generic = F.when(contains_any(low_path, A.CODE_SUFFIXES),
                         first_label(low_path, A.GENERIC_CATEGORY, A.GENERIC_CODE)).otherwise(A.GENERIC_OTHER)
        return let(F.array_max(F.array(*entries)), lambda best: F.when(
            best["v"] >= A.CATEGORY_THRESHOLD, best["c"]).otherwise(generic))

    return let(texts, scores)


def _adder(words: list[str]):
    return lambda acc, package: acc + count_contained(package, words)


def purpose_of(category: Column, name: Column) -> Column:
    fallback = F.concat(F.lit("Handles "), F.replace(category, F.lit("_"), F.lit(" ")), F.lit(" functionality"))
    base = F.coalesce(lookup(category, A.CATEGORY_PURPOSE), fallback)
    low = F.lower(F.coalesce(name, F.lit("")))
    suffix = first_label(low, [(text, [word]) for word, text in A.PURPOSE_SUFFIX], "")
    return F.concat(base, suffix)


def file_bonus(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a + b, [
        F.when(contains_any(low, words), F.lit(points)).otherwise(F.lit(0.0)) for points, words in A.FILE_BONUS])


def importance(kind: Column, path: Column, name: Column, n_calls: Column, n_called_by: Column,
               start_line: Column, end_line: Column, n_categories: Column | None = None) -> Column:
    low_path, low_name = F.lower(path), F.lower(F.coalesce(name, F.lit("")))
    lines = end_line - start_line + 1
    some = lambda n: F.least(F.coalesce(n, F.lit(0)) * 0.1, F.lit(0.3))
    n = F.lit(1) if n_categories is None else n_categories
    return (
        lookup(kind, A.KIND_IMPORTANCE, A.KIND_IMPORTANCE_OTHER)
        + F.when(contains_any(low_path, A.ENTRY_FILES), 0.5).otherwise(0.0)
        + F.when(contains_any(low_name, A.CORE_NAMES), 0.3).otherwise(0.0)
        + F.when(n > 1, n * 0.2).otherwise(0.0)
        + some(n_calls) + some(n_called_by)
        + F.when(lines > 50, 0.2).when(lines > 20, 0.1).otherwise(0.0))


def confidence_label(value: Column) -> Column:
    return banded(value, A.CONFIDENCE_BANDS, A.CONFIDENCE_DEFAULT)
