"""Vector arithmetic as columns. Sums are in double precision, so they do not depend on storage precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for vectors of unequal length (zip_with would pad them with null), null for a null vector."""
    product = _sum(F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: x * y))
    return F.when(F.size(a) == F.size(b), product).when(a.isNotNull() & b.isNotNull(), 0.0)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v.cast(DOUBLES), lambda x: x * x)))


def l2_normalize(v: Column, floor: float | None = 1e-9) -> Column:
    """The vector over its norm. With a floor a zero vector stays zero; without one (None) it becomes NaN."""
    length = F.greatest(norm(v), F.lit(floor)) if floor is not None else norm(v)
    return F.transform(v.cast(DOUBLES), lambda x: F.when(length == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, length)))


def decay(age_s: Column) -> Column:
    """Weight by age: one hundredth less each hour, from 1 down to a half; a row from the future weighs 1."""
    hours = F.greatest(age_s, F.lit(0)) / 3600.0
    return F.greatest(F.least(1.0 - hours * 0.01, F.lit(1.0)), F.lit(0.5))


def attention_bias(mask: Column) -> Column:
    """0 where the mask is 1, else -10000."""
    return F.transform(mask, lambda m: F.when(m == 1, 0.0).otherwise(-10000.0))


def mean_pool(tokens: Column, mask: Column, dim: int) -> Column:
    """Mean of the token vectors whose mask is 1; the mask's sum counts as 1e-9 at least."""
    total = F.greatest(_sum(F.transform(mask, lambda m: m.cast("double"))), F.lit(1e-9))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _sum(F.zip_with(tokens, mask, lambda v, m: F.get(v, i).cast("double") * m)) / total)


#: Rows and queries that are scored at once.
ROWS, COLUMNS = 256, 256


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the vectors of a column without null: their places, and a matrix; a null in a vector is NaN."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of old versions
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    off = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = np.diff(off)
    return {int(d): (at := np.flatnonzero(size == d), flat[off[at][:, None] + np.arange(d)]) for d in np.unique(size)}


def best(column: pa.ChunkedArray, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, weight: np.ndarray | None, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of the k best rows of each query, ties by place; ``dot`` times the weight, sums in its order. NaN scores go."""
    rows, n = matrices(column), len(place)
    for d, (names, q) in queries.items():
        at, v = rows.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
        for j in range(0, len(q), COLUMNS):
            part = np.ascontiguousarray(q[j : j + COLUMNS].T)
            score = np.zeros((n, part.shape[1]))  # vectors of another length score 0
            with np.errstate(invalid="ignore", over="ignore"):
                for i in range(0, len(at), ROWS):
                    x = np.ascontiguousarray(v[i : i + ROWS].T)
                    sums, product = np.zeros((x.shape[1], part.shape[1])), np.empty((x.shape[1], part.shape[1]))
                    for c in range(d):
                        np.multiply(x[c][:, None], part[c], out=product)
                        sums += product
                    score[at[i : i + ROWS]] = sums
                if weight is not None:
                    score *= weight[:, None]
            score = np.ascontiguousarray(score.T)
            real = ~np.isnan(score)
            score[~real] = -np.inf
            if 0 < k < n:
                real &= score >= np.partition(score, n - k, axis=1)[:, n - k][:, None]
            who, row = np.nonzero(real)
            order = np.lexsort((place[row], -score[who, row], who))
            who, row = who[order], row[order]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            who, row = who[nth < k], row[nth < k]
            yield names[j : j + COLUMNS][who], row, score[who, row]
