"""Carrying whole rows of ``documents`` through an operator, whatever their other columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``rest``, a struct of all other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("rest"))


def unpack(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return packed.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in columns])
