"""Vector columns: which rows count, integer forms, matrices in Arrow batches and codebooks from bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Largest integer component, so that inner products and squared distances of up to 2,048 components fit 64 bits.
MOST_COMPONENT = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are, each a finite number (an empty vector is)."""
    one = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, one), F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """Components ``floor(scale * x)`` as integers; those beyond MOST_COMPONENT stop the job."""
    big = F.raise_error(F.concat(F.lit("vector component too large: "), F.lit(scale).cast("string"), F.lit(" times it must stay below 2^26")))
    one = lambda x: F.when(F.abs(x.cast("double") * scale) < MOST_COMPONENT, F.floor(x.cast("double") * scale)).otherwise(big.cast("long"))
    return F.transform(vector, one).cast("array<int>")


def width(rows: DataFrame, vector: str) -> int:
    """Components of the longest vector; 0 for an empty table."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(flat) == len(column) * dim:
        return flat.reshape(len(column), dim)
    size = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(column), dim), kind)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def squared_distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((m**2).sum(1)[:, None] - 2 * m @ centres.T + (centres**2).sum(1), 0)


def codebook(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` centres (fewer if there are fewer distinct rows) of a bounded sample by Lloyd's rounds, in any order of its rows."""
    sample = np.unique(sample, axis=0)
    k = min(k, len(sample))
    centres = sample[np.random.default_rng(20_121_107).choice(len(sample), k, replace=False)] if k else sample
    for _ in range(rounds if k > 1 else k):
        own = squared_distances(sample, centres).argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def sample_matrix(rows: DataFrame, vector: str, most: int, dim: int) -> np.ndarray:
    """At most ``most`` vectors, first by a hash of the vector: a documented, bounded sample to fit centres on."""
    few = rows.select(vector).orderBy(F.xxhash64(vector), vector).limit(most).toArrow()
    return matrix(few.column(0), dim) if few.num_rows else np.zeros((0, dim))
