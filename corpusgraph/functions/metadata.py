"""Free metadata of chunks: maps of strings, merged with the last value winning, kept as JSON at the graph sink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def merged(*maps: Column) -> Column:
    """All entries of ``maps``; of one key the last map's value counts, also if it is null. A null map is empty."""
    empty = F.create_map().cast(_MAP)
    out = F.coalesce(maps[0], empty)
    for new in maps[1:]:
        new = F.coalesce(new, empty)
        out = F.map_concat(_without(out, new), new)
    return out


def _without(old: Column, new: Column) -> Column:
    return F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))


def encoded(metadata: Column) -> Column:
    """JSON text with keys in order, so that equal maps give equal texts; null values stay, a null map is ``{}``."""
    entries = F.array_sort(F.map_entries(F.coalesce(metadata, F.create_map().cast(_MAP))))
    return F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})


def decoded(text: Column) -> Column:
    """The map of a JSON text; values that are no strings come as their JSON. Null or broken text is an empty map."""
    return F.coalesce(F.from_json(text, _MAP), F.create_map().cast(_MAP))
