"""Turning text into vectors: a hook for any embedding function and an offline hashing one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.functions.chunks import prepared_text


def embed(df: DataFrame, id_col: str, text_col: str, load: Callable[[], Callable[[list[str]], np.ndarray]],
          dim: int, batch: int = 32) -> DataFrame:
    """``(id, embedding)`` from a caller's function, called on ``batch`` texts at a time.

    ``load()`` runs once per task and returns the function; texts of a failing batch get zeros.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for frame in frames:
            out = []
            for lo in range(0, len(frame), batch):
                texts = frame[text_col].iloc[lo: lo + batch].tolist()
                try:
                    rows = np.asarray(fn(texts), dtype="float32").reshape(len(texts), dim)
                except Exception:  # noqa: BLE001 - any provider failure becomes zero vectors
                    rows = np.zeros((len(texts), dim), dtype="float32")
                out.extend(rows)
            yield pd.DataFrame({id_col: frame[id_col], "embedding": out})

    return df.select(id_col, text_col).mapInPandas(run, schema)


def term_vectors(df: DataFrame, text_col: str, dim: int) -> DataFrame:
    """Adds ``_tf``: hashed word counts."""
    words = F.filter(F.split(F.lower(text_col), "[^a-z0-9_]+"), lambda w: F.length(w) > 0)
    return HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(df.withColumn("_words", words))


def fit_idf(df: DataFrame, text_col: str, dim: int) -> IDFModel:
    return IDF(inputCol="_tf", outputCol="_idf").fit(term_vectors(df, text_col, dim))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 256, idf: IDFModel | None = None) -> DataFrame:
    """Deterministic ``(id, embedding)`` without a model: hashed words, optional IDF, unit length."""
    tf = term_vectors(df, text_col, dim)
    col = "_tf"
    if idf is not None:
        tf, col = idf.transform(tf), "_idf"
    unit = Normalizer(p=2.0, inputCol=col, outputCol="_unit").transform(tf)
    return unit.select(id_col, vector_to_array("_unit", "float32").alias("embedding"))


def query_text(query: Column) -> Column:
    """A question is embedded as if it were a function called ``query`` in a file ``query``."""
    return prepared_text(F.lit("function_definition"), F.lit("query"), F.lit("query"), query)
