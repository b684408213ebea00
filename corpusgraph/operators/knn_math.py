"""Vector columns as matrices."""

from __future__ import annotations

import numpy as np


def matrix(values, dim: int | None = None) -> np.ndarray:
    """Row-normalised float64 matrix; zero or missing vectors stay zero (cosine 0); unequal lengths are an error."""
    rows = list(values)
    sizes = {len(v) for v in rows if v is not None and len(v)} | ({dim} if dim else set())
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    out = np.zeros((len(rows), max(sizes, default=0)))
    for i, v in enumerate(rows):
        if v is not None and len(v):
            out[i] = v
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
