"""Chunks (functions, classes, methods) of source files, found row by row without a shuffle, in near linear time (``folds``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.chunks import chunk_id, imports_in
from corpusgraph.functions.text import ascii_pattern, extract_all, kind_of
from corpusgraph.operators import folds
from corpusgraph.rules.area_rules import CALL_KEYWORDS

# ---- fixed values: header patterns, applied to the trimmed line ----
PY_CLASS = r"^class\s+(\w+).*?:"
PY_FUNCTION = r"^def\s+(\w+).*?:"
JS_CLASS = r"^class\s+(\w+)"
JS_FUNCTIONS = [r"^function\s+(\w+)", r"^const\s+(\w+)\s*=\s*\(", r"^(\w+)\s*\("]

_LEAD = "^[ \\t\\r\\f\\x0B]*"
_EDGE = "^[ \\t\\r\\f\\x0B]+|[ \\t\\r\\f\\x0B]+$"


def line_array(content: Column) -> Column:
    """Array of ``struct(no, text, trimmed, indent)`` with 1-based line numbers."""
    return F.transform(F.split(content, "\n"), lambda s, i: F.struct(
        (i + 1).alias("no"), s.alias("text"), F.regexp_replace(s, _EDGE, "").alias("trimmed"),
        F.length(F.regexp_extract(s, _LEAD, 0)).alias("indent")))


def lines(files: DataFrame) -> DataFrame:
    """One row per line with indent, blank flag and trimmed text."""
    rows = files.select("path", F.inline(line_array(F.col("content"))))
    return rows.select("path", F.col("no").alias("line_no"), "text", "trimmed", "indent",
                       (F.length("trimmed") == 0).alias("blank"))


def _name(trimmed: Column, pattern: str) -> Column:
    found = F.regexp_extract(trimmed, ascii_pattern(pattern), 1)
    return F.when(F.length(found) > 0, found)


def _rows(files: DataFrame, find: Callable, *lists: str) -> DataFrame:
    """Chunks that ``find`` makes of the files' texts, headers and further ``lists``.

    ``list_no`` is a chunk's place in the file's chunk list (classes first).
    """
    heads = []
    for column, names in (("_classes", "_class_names"), ("_functions", "_function_names")):
        heads += [F.transform(column, lambda h: h["no"]).alias(column), F.transform(column, lambda h: h["name"]).alias(names)]
    rows = files.select("path", "project_id", "language", "content", *heads, *lists).mapInArrow(find, folds.CHUNK_ROW)
    return rows.select(
        chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("id"),
        F.col("path").alias("file_path"), "project_id", "language", "start_line", "end_line", "node_type", "name",
        "content", "list_no")


def _with_heads(files: DataFrame, names: list[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """``files`` with ``_lines`` and, for each (column, name in a trimmed line), the headers' (line, name) structs."""
    def heads(name_of) -> Column:
        named = F.transform("_lines", lambda x: F.struct(x["no"].alias("no"), name_of(x["trimmed"]).alias("name")))
        return F.filter(named, lambda h: h["name"].isNotNull())

    rows = files.withColumn("_lines", line_array(F.col("content")))
    return rows.withColumns({column: heads(name_of) for column, name_of in names})


def outline_python(files: DataFrame) -> DataFrame:
    """Classes, functions and methods by header line; a block ends before the next non-blank line
    that is not indented deeper than its header."""
    rows = _with_heads(files, [("_classes", lambda t: _name(t, PY_CLASS)), ("_functions", lambda t: _name(t, PY_FUNCTION))])
    rows = rows.withColumn("_solid", F.filter("_lines", lambda x: F.length(x["trimmed"]) > 0)).withColumns({
        "_no": F.transform("_solid", lambda x: x["no"]), "_indent": F.transform("_solid", lambda x: x["indent"]),
        "_is_class": F.transform("_solid", lambda x: x["trimmed"].startswith("class "))})
    # headers are solid lines, found again by their numbers
    return _rows(rows, folds.block_chunks, "_no", "_indent", "_is_class")


def outline_braces(files: DataFrame) -> DataFrame:
    """JavaScript / TypeScript headers; a block ends on the line of the first closing brace that
    brings the depth counted from the header back to zero, else at the end of the file."""
    rows = _with_heads(files, [("_classes", lambda t: _name(t, JS_CLASS)),
                               ("_functions", lambda t: F.coalesce(*[_name(t, p) for p in JS_FUNCTIONS]))])
    rows = rows.withColumn("_braces", F.flatten(F.transform("_lines", lambda x: F.transform(
        F.regexp_extract_all(x["text"], F.lit("[{}]"), F.lit(0)),
        lambda b: F.struct(x["no"].alias("no"), F.when(b == "{", 1).otherwise(-1).alias("step")))))).withColumns({
            "_brace_no": F.transform("_braces", lambda b: b["no"]), "_step": F.transform("_braces", lambda b: b["step"])})
    return _rows(rows, folds.brace_chunks, "_brace_no", "_step")


def outline(files: DataFrame) -> DataFrame:
    """Chunks of all supported files."""
    python = outline_python(files.filter(F.col("language") == "python"))
    return python.unionByName(outline_braces(files.filter(F.col("language").isin("javascript", "typescript"))))


def split_text(docs: DataFrame, key: str, text_col: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Overlapping fixed-size windows ``(key, window_no, start, piece)`` over whole texts."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(size - overlap))
    rows = docs.select(key, text_col, F.posexplode(starts).alias("window_no", "start"))
    return rows.select(key, "window_no", "start", F.expr(f"substring({text_col}, start + 1, {size})").alias("piece"))


def call_sites(chunks: DataFrame) -> DataFrame:
    """``(file_path, caller_id, caller_name, callee_name)``: names followed by ``(``, each credited to
    the innermost function around it; keywords and a function's own header are left out."""
    functions = chunks.filter(kind_of(F.col("node_type")).isin("function", "method"))
    rows = functions.select(
        "file_path", F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), "start_line", "end_line",
        F.posexplode(F.split("content", "\n")).alias("_i", "_line"))
    tokens = rows.select(
        "file_path", "caller_id", "caller_name", (F.col("start_line") + F.col("_i")).alias("line_no"),
        (F.col("end_line") - F.col("start_line")).alias("_size"), F.col("_i"),
        F.explode(F.array_distinct(extract_all(F.col("_line"), r"\b(\w+)\s*\("))).alias("callee_name"))
    inner = tokens.groupBy("file_path", "line_no", "callee_name").agg(
        F.min_by(F.struct("caller_id", "caller_name", "_i"), F.struct("_size", -F.col("line_no") + F.col("_i"))).alias("c"))
    return (
        inner.filter(~F.col("callee_name").isin(CALL_KEYWORDS))
        .filter(~((F.col("c._i") == 0) & (F.col("callee_name") == F.col("c.caller_name"))))
        .select("file_path", F.col("c.caller_id").alias("caller_id"), F.col("c.caller_name").alias("caller_name"),
                "callee_name").distinct())


def with_imports(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("imports", imports_in(F.col("content")))
