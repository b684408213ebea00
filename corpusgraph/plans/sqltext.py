"""Small builders for the SQL side of a check."""

from __future__ import annotations


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def count_of(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {lit(w)}) AS INT)" for w in words) + ")"


def label_of(col: str, rules, default: str) -> str:
    """Ordered rules as CASE; ``default`` is an SQL expression."""
    arms = " ".join(f"WHEN {any_of(col, words)} THEN {lit(label)}" for label, words in rules)
    return f"(CASE {arms} ELSE {default} END)"


def map_of(col: str, table: dict, default: str = "NULL", quote: bool = True) -> str:
    arms = " ".join(
        f"WHEN {lit(k) if isinstance(k, str) else k} THEN {lit(v) if quote else v}"
        for k, v in table.items())
    return f"(CASE {col} {arms} ELSE {default} END)"


def band_of(col: str, bands, default: str) -> str:
    arms = " ".join(f"WHEN {col} >= {low}e0 THEN {lit(label)}" for low, label in bands)
    return f"(CASE {arms} ELSE {lit(default)} END)"


def matches_of(col: str, patterns: list[str]) -> str:
    return "(" + " + ".join(
        f"len(regexp_extract_all({col}, {lit(p)}))" for p in patterns) + ")"


def list_of(words: list[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]::VARCHAR[]"


def extract_of(col: str, patterns: list[str], ignore_case: bool = True) -> str:
    flag = "(?i)" if ignore_case else ""
    parts = [f"regexp_extract_all({col}, {lit(flag + p)}, 1)" for p in patterns]
    return parts[0] if len(parts) == 1 else "list_concat(" + ", ".join(parts) + ")" if len(parts) == 2 \
        else f"flatten([{', '.join(parts)}])"
