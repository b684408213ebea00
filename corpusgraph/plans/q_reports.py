"""Registered query: all reports about a selection as one table."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpusgraph.plans.q_graph  # noqa: F401  (its SQL is part of the one here)
from corpusgraph.operators import stats
from corpusgraph.plans import catalog
from corpusgraph.plans import sqltext as S
from corpusgraph.plans.catalog import query
from corpusgraph.plans.q_stats import _USAGE
from corpusgraph.rules import area_rules as A
from corpusgraph.sources.derived import with_views

# report: columns of an entry, in order
_COLUMNS = {
    "architectural_patterns": ["rank", "layer", "file_path", "node_type", "component_count", "sample_components"],
    "data_flow_patterns": ["rank", "src", "dst", "src_name", "src_file", "src_type", "dst_name", "dst_file", "dst_type", "rel", "flow_direction"],
    "file_dependencies": ["rank", "source_file", "target_file", "strength"],
    "dependency_graph": ["total_dependencies", "unique_files", "nodes"],
    "usage_patterns": ["rank", "name", "file_path", "node_type", "call_count", "import_count", "total_usage", "usage_category"],
    "system_overview": ["total_files", "total_chunks", "node_types", "types_list"],
    "system_complexity": ["complexity_score", "chunks_per_file", "type_diversity", "organization_entropy", "complexity_level"],
}
_FLOATS = {"complexity_score", "chunks_per_file", "type_diversity", "organization_entropy"}
_OWN_USAGE = with_views("nodes", "edges", "selection") + ", sel AS (SELECT query_id, id FROM selection)" + _USAGE[_USAGE.index(
    "\n, picked"):] + f"""
SELECT *, {S.band_of('total_usage', A.USAGE_BANDS, A.USAGE_DEFAULT)} AS usage_category FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total_usage DESC, name, file_path, node_type) AS rank
  FROM (SELECT *, call_count + import_count AS total_usage FROM usage)) WHERE rank <= 10"""
_SOURCES = {
    "architectural_patterns": "ag5_layer_components", "data_flow_patterns": "gr12_data_flow", "file_dependencies": "ag6_file_dependencies",
    "dependency_graph": "ag7_dependency_summary", "usage_patterns": _OWN_USAGE, "system_overview": "ag9_system_overview",
    "system_complexity": "ag10_complexity_score"}


def _report_sql(report: str) -> str:
    text = catalog.ENTRIES[_SOURCES[report]][1] if _SOURCES[report] in catalog.ENTRIES else _SOURCES[report]
    parts = [f"CAST(CAST({c} AS DECIMAL(18, 6)) AS VARCHAR)" if c in _FLOATS else f"CAST({c} AS VARCHAR)" for c in _COLUMNS[report]]
    return f"SELECT query_id, '{report}' AS report, concat_ws('|', {', '.join(parts)}) AS entry FROM ({text})"


@query("gr13_comprehensive_context", sql=" UNION ALL ".join(map(_report_sql, _COLUMNS)))
def gr13(d):
    """(query_id, report, entry) of all seven reports; an entry lists its columns, lists inside it too, with ``|``."""
    out = None
    for report, rows in stats.comprehensive_context(d.edges, d.nodes, d.selection).items():
        kinds = dict(rows.dtypes)
        parts = [F.col(c).cast("decimal(18,6)").cast("string") if c in _FLOATS else F.array_join(c, "|") if kinds[c].startswith("array")
                 else F.col(c).cast("string") for c in _COLUMNS[report]]
        part = rows.select("query_id", F.lit(report).alias("report"), F.concat_ws("|", *parts).alias("entry"))
        out = part if out is None else out.unionByName(part)
    return out
