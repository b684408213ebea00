"""Column builders for word lists, ordered rules, patterns and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_pattern(pattern: str) -> str:
    """Make word boundaries ASCII on every Java version, as ``\\w`` already is.

    Java before 19 treats accented letters as word characters for ``\\b`` only, so the same
    job would give different rows on different clusters.
    """
    flags = "(?d)"  # the dot stops at a line feed only
    if pattern.startswith("(?i)"):
        flags, pattern = "(?di)", pattern[4:]
    if pattern.startswith(r"\b"):
        pattern = r"(?<!\w)(?=\w)" + pattern[2:]
    return flags + pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def words_array(words: list[str]) -> Column:
    if not words:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(w) for w in words])


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def count_contained(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [col.contains(w).cast("int") for w in words])


def count_matches(col: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b,
                  [F.regexp_count(col, F.lit(ascii_pattern(p))) for p in patterns])


def extract_all(col: Column, pattern: str, group: int = 1, ignore_case: bool = False) -> Column:
    body = ascii_pattern(pattern)
    return F.regexp_extract_all(col, F.lit(("(?i)" if ignore_case else "") + body), F.lit(group))


def extract_lists(col: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """All matches of the first pattern, then of the second, and so on."""
    parts = [extract_all(col, p, 1, ignore_case) for p in patterns]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def first_label(col: Column, rules: list[tuple[str, list[str]]], default) -> Column:
    """Label of the first rule with a word in the column; the order of the rules decides."""
    otherwise = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(
        *[F.when(contains_any(col, words), F.lit(label)) for label, words in rules], otherwise)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(col: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table; the column is evaluated once."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), col)
    return found if default is None else F.coalesce(found, F.lit(default))


def banded(col: Column, bands: list[tuple[float, str]], default: str) -> Column:
    out = F.lit(default)
    for low, label in reversed(bands):
        out = F.when(col >= F.lit(low), F.lit(label)).otherwise(out)
    return out


def preview(col: Column, size: int) -> Column:
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size), F.lit("..."))).otherwise(col)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; ``root`` when there is none."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit("root"))


def extension(path: Column, missing: str) -> Column:
    """Text after the last dot of the whole path."""
    return F.when(path.contains("."), F.element_at(F.split(path, "\\."), -1)).otherwise(F.lit(missing))


def kind_of(node_type: Column) -> Column:
    """``function_definition`` -> ``function``; other names stay."""
    return F.regexp_replace(node_type, "_(definition|statement)$", "")


def grams(col: Column, size: int) -> Column:
    """Distinct character n-grams of a text, in one pass over its characters.

    The character array is bound as a lambda variable so that it is split once per text.
    """

    def pieces(chars: Column) -> Column:
        if size == 1:
            return chars
        return F.transform(
            chars, lambda c, i: F.concat(c, *[F.get(chars, i + F.lit(k)) for k in range(1, size)]))

    found = F.flatten(F.transform(F.array(F.split(col, "")), pieces))
    return F.array_distinct(F.filter(found, lambda g: g.isNotNull() & (F.length(g) == size)))
